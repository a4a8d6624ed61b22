"""Deduplicating new batches against all history: a prefix-tree hash forest over sets of chunk hashes.

Each tree orders all hashes by a permutation of its own. The label of a set in a tree is the sequence of its smallest
hashes in that order (DEPTH of them), so two sets share a prefix of d with about the d-th power of their likeness. The
labels of accepted sets are kept in sorted runs; a prefix is a range of a run, found by binary search in the files that
can hold it. One more label, of the whole set, finds equal sets.

An entry is first searched with its longest prefixes. The best match so far says how far they must be widened until
anything better is met with the target probability: not at all beside an equal set, to WIDEST where nothing was found.
A range of more than RANGE members in a tree (a hot prefix) gives no candidates there. If the other trees reach the
target all the same, it isn't needed; else the entry is compared with the members of its hot ranges by their rarest
hashes, which misses none (`exact`). Candidates are verified on whole sets, read by key from a run of their own.

Entries of a batch with equal sets are one class and travel once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.hashes import hash_bytes
from cairn.llm import runs
from cairn.llm.ribbon import mix
from cairn.llm.runs import Part, Places, ramp
from cairn.session import checkpoint_dir, cut

THRESHOLD = 0.7
TREES, DEPTH, WIDEST = 24, 4, 2
#: Target probability that an entry meets any set that is at least as like as its best match so far.
RECALL = 0.999999
#: Members from which a range is hot, and how many of them are tried all the same, to start with a good bound.
RANGE, SEEDS = 64, 4
#: Runs of about one size that are merged into one; sets in a row group of the run of sets.
FAN, SET_GROUP = 4, 1 << 10
#: Pairs of one rare hash from which they are compared in blocks, and the sides of a block.
PAIRS, BLOCK = 1 << 14, (256, 1024)
#: Sizes of sets from which the probability of a prefix is that of this size.
LARGEST = 96
_END = np.uint64(2**64 - 1)
_TREE = 57  # a label's first word: tree (6 bits), first hash (28), second (29); its second word: third (31), fourth (32)


# --- how far to widen ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def misses() -> np.ndarray:
    """(depth, level, size): least log probability over partners that a tree misses a pair of a set of `size` at a likeness
    of level / 100 or more, by a prefix of `depth`; 0 at depth 0. The hash of the whole set finds equal ones, so level 100 is never missed."""
    out = np.zeros((DEPTH + 1, 101, LARGEST + 1))
    n = np.arange(1, LARGEST + 1)[:, None]
    union = n + np.arange(int(LARGEST * (1 / THRESHOLD - 1)) + 1)[None, :]
    for level in range(int(THRESHOLD * 100), 101):
        s = level / 100
        common = np.ceil(s * union - 1e-9)
        apart = (union <= n / s + 1e-9) & (common <= n) & (common < union)
        same = np.ones(union.shape)
        for d in range(1, DEPTH + 1):
            same = same * np.maximum(0, common - d + 1) / np.maximum(1, union - d + 1)
            out[d, level, 1:] = np.log1p(-np.minimum(np.where(apart, same, 1).min(axis=1), 1 - 1e-16))
    return out


def log_miss(depth: np.ndarray, likeness: np.ndarray, size: np.ndarray) -> np.ndarray:
    levels = np.clip((np.asarray(likeness) * 100 + 1e-6).astype(int), 0, 100)
    return misses()[depth, levels, np.minimum(size, LARGEST)]


def need(likeness: np.ndarray, size: np.ndarray, trees: int = TREES, recall: float = RECALL) -> np.ndarray:
    """The longest prefix that reaches the target for partners of at least this likeness; WIDEST if none does."""
    out = np.full(len(size), WIDEST)
    for d in range(WIDEST + 1, DEPTH + 1):
        out[trees * log_miss(np.full(len(size), d), likeness, size) <= np.log(1 - recall)] = d
    return out


# --- sets and labels -------------------------------------------------------------------------------------------------


def set_ids(chunks: Column) -> Column:
    """Sorted distinct 64-bit ids of the usable hashes of a list; empty for a null list. Two hashes of a pair of sets
    share an id with probability 2^-64."""
    ids = F.transform(F.array_compact(F.transform(chunks, hash_bytes)), lambda x: F.xxhash64(x))
    return F.coalesce(F.sort_array(F.array_distinct(ids)), F.array().cast("array<bigint>"))


def classes(entries: DataFrame) -> DataFrame:
    """(batch_no, entry_id, ids, set_id): entries of a batch with equal sets (set_id) are one class, whose key is the lowest
    entry_id. Entries without a usable hash, id or batch are left out; a row delivered twice is one."""
    rows = entries.where("entry_id is not null and batch_no is not null").select("entry_id", "batch_no", set_ids(F.col("chunks")).alias("ids"))
    return rows.where(F.size("ids") > 0).withColumn("set_id", F.unhex(F.md5(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))))))


def arrivals(batches: list[tuple[int, int, int, int]]) -> list[int]:
    """First batches of the groups of consecutive batches (batch_no, entries, lowest id, highest id) that are taken as one.

    Entries are judged by batch_no, then entry_id, so batches are as good as one batch where each has higher ids than those
    before it; batch 0 stays alone. A group is at most as large as all before it, if it is more than one batch: the number
    of groups follows the logarithm of the entries and not the number of batches."""
    firsts, before, own, top = [], 0, 0, 0
    for batch, n, low, high in batches:
        if not firsts or 0 in (batch, firsts[-1]) or low <= top or own + n > before:
            firsts.append(batch)
            before, own, top = before + own, 0, high
        own, top = own + n, max(top, high)
    return firsts


def staged(entries: DataFrame, folder: str) -> dict[int, int]:
    """Write the classes of all batches, one directory a group of `arrivals`, named by its first batch: sets (key, ids) and
    members (entry_id, key); the number of classes of each, in order."""
    rows = cut(classes(entries).select("batch_no", "set_id", "entry_id", "ids"))
    sizes = rows.groupBy("batch_no").agg(F.count("*").alias("n"), F.min("entry_id").alias("low"), F.max("entry_id").alias("high")).collect()
    firsts = F.array(*map(F.lit, arrivals(sorted(map(tuple, sizes))))).cast("array<int>")
    rows = rows.withColumn("batch_no", F.array_max(F.filter(firsts, lambda b: b <= F.col("batch_no"))))
    sets = cut(rows.groupBy("batch_no", "set_id").agg(F.first("ids").alias("ids"), F.min("entry_id").alias("key")))
    sets.select("batch_no", "key", "ids").write.partitionBy("batch_no").parquet(f"{folder}/sets")
    members = rows.select("batch_no", "set_id", "entry_id").distinct().join(sets.select("batch_no", "set_id", "key"), ["batch_no", "set_id"])
    members.select("batch_no", "entry_id", "key").write.partitionBy("batch_no").parquet(f"{folder}/members")
    return {r.batch_no: r.n for r in sorted(sets.groupBy("batch_no").agg(F.count("*").alias("n")).collect())}


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a list column."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets)


def label_words(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """The two words (sets, trees + 1) of the labels of sets; the last column is the hash of the whole set. Shorter sets
    end in a mark, so they share longer prefixes with sets of the same hashes only."""
    flat = values.astype(np.uint64)
    first, second = np.zeros((len(sizes), trees + 1), np.uint64), np.zeros((len(sizes), trees + 1), np.uint64)
    for tree in range(trees):
        order, low = mix(flat, 1000 + tree), []
        for _ in range(DEPTH):
            low.append(np.minimum.reduceat(order, starts))
            order = np.where(order == np.repeat(low[-1], sizes), _END, order)
        first[:, tree] = np.uint64(tree << _TREE) | (low[0] >> np.uint64(36) << np.uint64(29)) | (low[1] >> np.uint64(35))
        second[:, tree] = (low[2] >> np.uint64(33) << np.uint64(32)) | (low[3] >> np.uint64(32))
    whole = mix(np.add.reduceat(mix(flat, 11), starts) ^ sizes.astype(np.uint64), 13)
    first[:, trees] = np.uint64(trees << _TREE) | (whole >> np.uint64(7))
    second[:, trees] = mix(whole, 17) >> np.uint64(1)
    return first.astype(np.int64), second.astype(np.int64)


def labels(sets: DataFrame, keep: dict[str, str] | None = None, whole: bool = True) -> DataFrame:
    """(key, n, a, b, keep...) of sets (key, ids, keep...): one row a tree, and one for the whole set."""
    keep = keep or {}
    names = ["key", "n", "a", "b", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, starts, sizes = _lists(batch.column(1))
                a, b = (x if whole else x[:, :TREES] for x in label_words(values, starts, sizes))
                again = pa.array(np.repeat(np.arange(len(sizes)), a.shape[1]))
                columns = [batch.column(0).take(again), pa.array(sizes.astype(np.int32)).take(again), pa.array(a.reshape(-1)), pa.array(b.reshape(-1))]
                yield pa.RecordBatch.from_arrays([*columns, *(c.take(again) for c in batch.columns[2:])], names=names)

    kinds = "".join(f", {k} {v}" for k, v in keep.items())
    return sets.select(F.col("key").cast("long"), "ids", *keep).mapInArrow(run, f"key long, n int, a long, b long{kinds}")


# --- search ----------------------------------------------------------------------------------------------------------


def _bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Position of wanted[i] in the sorted values[low[i]:high[i]], for all i at once."""
    low, high = low.copy(), high.copy()
    while (active := low < high).any():
        middle = (low + high) // 2
        at = values[np.where(active, middle, 0)]
        up = active & ((at <= wanted) if right else (at < wanted))
        low, high = np.where(up, middle + 1, low), np.where(active & ~up, middle, high)
    return low


FOUND = "query long, key long, least double, place long, depth int"


def find(run: pa.Table, asked: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (query, key) of the ranges of the asked labels (key, n, a, b, depth, least), each at its own prefix length; of
    a hot range only SEEDS, and a row with the place of its widest prefix, key null, and the longest prefix that was
    searched in full instead (0: none)."""
    query, n, qa, qb, depth, least = (c.to_numpy() for c in asked.columns)
    a, b, key, size = (run.column(c).to_numpy() for c in ("a", "b", "key", "n"))
    low, high = np.searchsorted(a, qa, "left"), np.searchsorted(a, qa, "right")
    third = qb >> 32 << 32
    ranges = {2: (low, high), 3: tuple(_bisect(b, low, high, x, r) for x, r in ((third, False), (third + (1 << 32) - 1, True))), 4: tuple(_bisect(b, low, high, qb, r) for r in (False, True))}
    at, width, full = low.copy(), np.zeros(len(query), np.int64), np.zeros(len(query), np.int32)
    for d in (4, 3, 2):  # the widest range that is asked for and not hot
        m, w = ranges[d][0], ranges[d][1] - ranges[d][0]
        take = (d >= depth) & (w <= RANGE)
        at, width, full = np.where(take, m, at), np.where(take, w, width), np.where(take, d, full)
    hot = full != depth
    none = full == 0
    at, width = np.where(none, ranges[4][0], at), np.where(none, np.minimum(SEEDS, ranges[4][1] - ranges[4][0]), width)
    who = np.repeat(np.arange(len(query)), width)
    mine = np.repeat(at, width) + ramp(width)
    fits = np.minimum(n[who], size[mine]) >= least[who] * np.maximum(n[who], size[mine]) - 1e-9
    who, mine = who[fits], mine[fits]
    hots = np.flatnonzero(hot)
    keys = pa.concat_arrays([pa.array(key[mine], pa.int64()), pa.nulls(len(hots), pa.int64())])
    both = np.concatenate([who, hots])
    return pa.RecordBatch.from_arrays([pa.array(query[both]), keys, pa.array(least[both]), pa.array(qa[both]), pa.array(full[both])], names=["query", "key", "least", "place", "depth"])


def members_of(run: pa.Table, asked: pa.RecordBatch) -> pa.RecordBatch:
    """Keys of the whole ranges of the asked places."""
    a, key = run.column("a").to_numpy(), run.column("key").to_numpy()
    places = np.unique(asked.column(0).to_numpy())
    low = np.searchsorted(a, places, "left")
    n = np.searchsorted(a, places, "right") - low
    return pa.RecordBatch.from_arrays([pa.array(key[np.repeat(low, n) + ramp(n)])], names=["key"])


def _take_sets(run: pa.Table, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which of the wanted keys the run has, and their ids: values, starts, sizes."""
    keys = run.column("key").to_numpy()
    at = np.searchsorted(keys, wanted)
    have = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)) if len(keys) else np.zeros(0, np.int64)
    column = run.column("ids")
    values, starts, sizes = _lists(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    at = at[have]
    n = sizes[at]
    return have, values[np.repeat(starts[at], n) + ramp(n)], np.cumsum(n) - n, n


def overlaps(values: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, given by both sides' joined ids and lengths."""
    pair = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    joined = np.concatenate(values)
    order = np.lexsort((joined, pair))
    pair, joined = pair[order], joined[order]
    twice = (pair[1:] == pair[:-1]) & (joined[1:] == joined[:-1])
    return np.bincount(pair[1:][twice], minlength=len(sizes[0]))


LIKE = "query long, key long, common int, total int"


def compare(run: pa.Table, asked: pa.RecordBatch) -> pa.RecordBatch:
    """The asked pairs (key, query, ids, least) whose likeness is at least `least`, on whole sets."""
    key, query, least = (asked.column(k).to_numpy() for k in (0, 1, 3))
    have, values, _, size = _take_sets(run, key)
    own, _, n = _lists(asked.column(2).take(pa.array(have)))
    common = overlaps((own, values), (n, size))
    total = n + size - common
    good = common >= least[have] * total - 1e-9
    columns = [query[have][good], key[have][good], common[good].astype(np.int32), total[good].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "key", "common", "total"])


def fetch(run: pa.Table, asked: pa.RecordBatch) -> pa.RecordBatch:
    """(key, ids) of the asked keys."""
    key = asked.column(0).to_numpy()
    have, values, starts, size = _take_sets(run, key)
    ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array(key[have]), ids], names=["key", "ids"])


def best(pairs: DataFrame) -> DataFrame:
    """Of each query the match of highest likeness, on ties the lowest key."""
    chosen = F.max_by(F.struct("key", "common", "total"), F.struct(F.col("common") / F.col("total"), -F.col("key")))
    return pairs.groupBy("query").agg(chosen.alias("b")).select("query", "b.key", "b.common", "b.total")


# --- the rest, exactly -----------------------------------------------------------------------------------------------


def rare_first(sets: DataFrame, counts: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, key, least, n, hash, place) of sets (scope, key, ids, least): the rarest hashes of each set, of which any set
    of likeness `least` has one.

    counts: (scope, hash, many). A set of n hashes has ceil(least n) in common with such a partner, so one of its
    n - ceil(least n) + 1 rarest is among them; place counts from 1. least is that of the set, at least THRESHOLD."""
    each = sets.select(*scope, "key", "least", F.size("ids").alias("n"), F.explode("ids").alias("hash")).join(counts, [*scope, "hash"])
    lists = each.groupBy(*scope, "key").agg(F.first("least").alias("least"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("many", "hash"))).alias("all"))
    length = F.col("n") - F.ceil(F.col("least") * F.col("n") - 1e-9) + 1
    cut_lists = lists.select(*scope, "key", "least", "n", F.posexplode(F.slice("all", F.lit(1), length.cast("int"))).alias("place", "x"))
    return cut_lists.select(*scope, "key", "least", "n", F.col("x.hash").alias("hash"), (F.col("place") + 1).alias("place"))


def hash_counts(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (s.select(F.explode("ids").alias("hash")) for s in sets)).groupBy("hash").agg(F.count("*").alias("many"))


def block_best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The best match of each query of a block: intersections of all its pairs are one product of matrices."""
    if left.empty or right.empty:
        return pd.DataFrame({"query": [], "key": [], "common": [], "total": []})
    right = right.sort_values("key")
    sides = [(np.array([len(x) for x in s["ids"]]), np.concatenate(s["ids"].to_numpy())) for s in (left, right)]
    hashes, where = np.unique(np.concatenate([x for _, x in sides]), return_inverse=True)
    grids, at = [], 0
    for n, values in sides:
        grid = np.zeros((len(n), len(hashes)), np.float32)
        grid[np.repeat(np.arange(len(n)), n), where[at : at + len(values)]] = 1
        grids.append(grid)
        at += len(values)
    common = grids[0] @ grids[1].T
    total = sides[0][0][:, None] + sides[1][0][None, :] - common
    rate = common / total
    top = rate.argmax(axis=1)  # the first of equals: the lowest key
    rows = np.arange(len(left))
    good = rate[rows, top] >= left["least"].to_numpy() - 1e-9
    out = {"query": left["query"].to_numpy(), "key": right["key"].to_numpy()[top], "common": common[rows, top].astype(np.int32), "total": total[rows, top].astype(np.int32)}
    return pd.DataFrame({k: v[good] for k, v in out.items()})


def exact(queries: DataFrame, members: DataFrame) -> DataFrame:
    """(query, key, common, total): matches of queries (query, ids, least) among members (key, ids), the best of each among
    them, by the rarest hashes of both. Pairs of a common rare hash of many sets are compared in blocks, so what is
    shuffled follows the sets and not the pairs."""
    queries, members = cut(queries), cut(members)
    counts = cut(hash_counts(queries, members))
    q = cut(rare_first(queries.withColumnRenamed("query", "key"), counts).withColumnRenamed("key", "query").withColumnRenamed("place", "q_place").withColumnRenamed("n", "q_n"))
    m = cut(rare_first(members.withColumn("least", F.lit(THRESHOLD)), counts).drop("least"))
    both = q.groupBy("hash").agg(F.count("*").alias("nq")).join(m.groupBy("hash").agg(F.count("*").alias("nm")), "hash")
    both = cut(both)
    few, many = both.where(F.col("nq") * F.col("nm") <= PAIRS).select("hash"), both.where(F.col("nq") * F.col("nm") > PAIRS)

    smaller, larger = F.least("n", "q_n"), F.greatest("n", "q_n")
    reach = 1 + F.least(F.col("q_n") - F.col("q_place"), F.col("n") - F.col("place"))  # common hashes if this is the first of them
    wanted = F.col("least") / (1 + F.col("least")) * (F.col("n") + F.col("q_n"))
    met = q.join(few, "hash", "left_semi").join(m, "hash").where((smaller >= F.col("least") * larger - 1e-9) & (reach >= wanted - 1e-9)).select("query", "key").distinct()
    pairs = met.join(queries, "query").join(members.withColumnRenamed("ids", "key_ids"), "key")
    counted = pairs.select("query", "key", "least", F.size(F.array_intersect("ids", "key_ids")).alias("common"), (F.size("ids") + F.size("key_ids")).alias("sizes"))
    found = counted.select("query", "key", "common", (F.col("sizes") - F.col("common")).alias("total"), "least").where("common >= least * total - 1e-9").drop("least")

    blocks = many.select("hash", F.ceil(F.col("nq") / BLOCK[0]).cast("int").alias("qs"), F.ceil(F.col("nm") / BLOCK[1]).cast("int").alias("ms"))
    left = q.join(blocks, "hash").withColumn("qb", F.pmod(F.xxhash64("query"), F.col("qs")).cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
    right = m.join(blocks, "hash").withColumn("mb", F.pmod(F.xxhash64("key"), F.col("ms")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    left = left.select("hash", "qb", "mb", "query").join(queries, "query").groupBy("hash", "qb", "mb")
    right = right.select("hash", "qb", "mb", "key").join(members, "key").groupBy("hash", "qb", "mb")
    return best(found.unionByName(left.cogroup(right).applyInPandas(block_best, LIKE)))


def shortfall(hot: DataFrame, asked: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, query) of those whose trees without hot ranges do not reach the target. hot: (query, depth), a row a hot tree with
    the prefix that was searched there; asked: (scope, query, n, least, depth)."""
    counts = hot.groupBy(*scope, "query").agg(*(F.count_if(F.col("depth") == d).cast("int").alias(f"h{d}") for d in (0, 3, 4)))

    @F.pandas_udf("boolean")
    def short(n: pd.Series, least: pd.Series, depth: pd.Series, h0: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.Series:
        per = [log_miss(np.full(len(n), d), least.to_numpy(), n.to_numpy()) for d in (3, 4)]
        own = log_miss(depth.to_numpy(), least.to_numpy(), n.to_numpy())
        return pd.Series((TREES - h0 - h3 - h4).to_numpy() * own + h3.to_numpy() * per[0] + h4.to_numpy() * per[1] > np.log(1 - RECALL))

    return asked.join(counts, [*scope, "query"]).where(short("n", "least", "depth", "h0", "h3", "h4")).select(*scope, "query")


# --- within a batch --------------------------------------------------------------------------------------------------


def crowd(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """(bucket, many) of the buckets of more than one row, counted on the map side."""
    return rows.groupBy(*bucket).agg(F.count("*").alias("many")).where("many > 1")


def buckets(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Where the sets (batch_no, key, ids) of each batch meet each other: (batch_no, bucket, key), of at most RANGE members
    a bucket and of more; the latter None if there are none.

    Buckets are prefixes of WIDEST that are not hot, and, for sets whose other trees fall short of the target, the rarest
    hashes of all members of their hot prefixes."""
    bucket = ["batch_no", "bucket"]
    rows = cut(labels(sets, {"batch_no": "int"}, whole=False).select("batch_no", F.col("a").alias("bucket"), "key", "n"))
    met = cut(rows.join(crowd(rows, bucket), bucket))
    small, hot = met.where(F.col("many") <= RANGE).select(*bucket, "key"), met.where(F.col("many") > RANGE)
    if hot.isEmpty():
        return small, None
    asked = hot.groupBy(F.col("key").alias("query"), "batch_no").agg(F.first("n").alias("n")).withColumns({"least": F.lit(THRESHOLD), "depth": F.lit(WIDEST)})
    short = shortfall(hot.select("batch_no", F.col("key").alias("query"), F.lit(0).alias("depth")), asked, ["batch_no"])
    places = hot.join(short.withColumnRenamed("query", "key"), ["batch_no", "key"], "left_semi").select(*bucket).distinct()
    touched = hot.join(places, bucket, "left_semi").select("batch_no", "key").distinct()
    touched = cut(sets.join(touched, ["batch_no", "key"], "left_semi").withColumn("least", F.lit(THRESHOLD)))
    counts = touched.select("batch_no", F.explode("ids").alias("hash")).groupBy("batch_no", "hash").agg(F.count("*").alias("many"))
    rare = rare_first(touched, counts, ["batch_no"]).select("batch_no", (-F.abs(F.xxhash64("hash", F.lit("rare"))) - 1).alias("bucket"), "key")
    rare = cut(rare)
    sized = cut(rare.join(crowd(rare, bucket), bucket))
    return small.unionByName(sized.where(F.col("many") <= RANGE).select(*bucket, "key")), sized.where(F.col("many") > RANGE).select(*bucket, "key")


def likeness(pairs: DataFrame, sets: DataFrame, scope: list[str] = [], least: float = THRESHOLD) -> DataFrame:  # noqa: B006
    """pairs (scope, query, key) of sets (scope, key, ids) whose likeness is at least `least`, with the sizes common and
    total of the intersection and the union."""
    sides = [sets.select(*scope, F.col("key").alias(c), F.col("ids").alias(f"{c}_ids")) for c in ("query", "key")]
    both = pairs.join(sides[0], [*scope, "query"]).join(sides[1], [*scope, "key"])
    smaller, larger = F.least(F.size("key_ids"), F.size("query_ids")), F.greatest(F.size("key_ids"), F.size("query_ids"))
    both = both.where(smaller >= least * larger - 1e-9)
    counted = both.select(*scope, "query", "key", F.size(F.array_intersect("query_ids", "key_ids")).alias("common"), (smaller + larger).alias("sizes"))
    return counted.select(*scope, "query", "key", "common", (F.col("sizes") - F.col("common")).cast("int").alias("total")).where(F.col("common") >= least * F.col("total") - 1e-9)


def near_pairs(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(batch_no, query, key, common, total) of the pairs of each batch that are alike, key before query, for all batches of
    sets (batch_no, key, ids) at once; and the rows of the buckets that are too large for all their pairs."""
    small, large = buckets(sets)
    pairs = small.join(small.withColumnRenamed("key", "query"), ["batch_no", "bucket"]).where("key < query").select("batch_no", "query", "key").distinct()
    return likeness(pairs, sets, ["batch_no"]), large


def leaders(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (key, query), key before query, of the first `most` members of each bucket with its other members, and the
    keys that are beyond the first in some bucket and may have unseen pairs. The first members are found salt by salt."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    few = salted.withColumn("i", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("key"))).where(F.col("i") <= most)
    first = cut(few.withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy("key"))).where(F.col("i") <= most).select("bucket", "key"))
    pairs = rows.withColumnRenamed("key", "query").join(first, "bucket").where("key < query").select("key", "query").distinct()
    return pairs, cut(rows.join(first, ["bucket", "key"], "left_anti").select("key").distinct())


def refuse(edges: DataFrame, unseen: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """(key) of the queries of edges (key, query) that have an accepted key, and the edges that could not be settled since
    their key is unseen, or waits for one that is. Each step accepts the keys that wait for none; the number of steps is
    that of the longest chain of dependent decisions."""
    out = None
    while not edges.isEmpty():
        heads = edges.select("key").distinct().join(edges.select(F.col("query").alias("key")), "key", "left_anti")
        heads = heads if unseen is None else heads.join(unseen, "key", "left_anti")
        gone = cut(edges.join(heads, "key", "left_semi").select(F.col("query").alias("key")).distinct())
        if gone.isEmpty():
            break
        out = gone if out is None else out.unionByName(gone)
        edges = cut(edges.join(gone, "key", "left_anti").join(gone.withColumnRenamed("key", "query"), "query", "left_anti"))
    return out, edges


def accept(keys: DataFrame, near: DataFrame, large: DataFrame | None, sets: DataFrame) -> DataFrame:
    """(key) of those of keys that have no earlier accepted neighbour among them: by the pairs near (key, query) and the
    buckets large (bucket, key). In a large bucket only the first members meet the others; their number doubles from round
    to round, so the rounds are the logarithm of the largest bucket."""
    keys = cut(keys)
    edges = cut(near.select("key", "query").join(keys, "key", "left_semi").join(keys.withColumnRenamed("key", "query"), "query", "left_semi"))
    if large is None:
        gone, _ = refuse(edges, None)
        return keys if gone is None else cut(keys.join(gone, "key", "left_anti"))
    open_keys, done, most = keys, None, RANGE
    while not open_keys.isEmpty():
        pairs, unseen = leaders(large.join(open_keys, "key", "left_semi"), most)
        gone, edges = refuse(cut(edges.unionByName(likeness(pairs, sets).select("key", "query")).distinct()), unseen)
        open_keys = open_keys if gone is None else open_keys.join(gone, "key", "left_anti")
        waiting = unseen.unionByName(edges.select(F.col("query").alias("key")))
        settled = cut(open_keys.join(waiting, "key", "left_anti"))
        done = settled if done is None else done.unionByName(settled)
        # what is settled has met all its bucket: those it is like are gone or still wait for it by an edge that is gone with it
        open_keys, most = cut(open_keys.join(settled, "key", "left_anti")), 2 * most
    return keys if done is None else cut(done)


# --- the forest ------------------------------------------------------------------------------------------------------


class Forest:
    """Accepted sets of all batches so far, in a folder: runs of labels, runs of sets, and their manifest."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        kept = runs.load_manifest(folder)
        self.labels: list[list[Part]] = kept.get("labels", [])
        self.sets: list[list[Part]] = kept.get("sets", [])

    def add(self, sets: DataFrame, most: int | None = None) -> None:
        """Keep accepted sets (key, ids), at most `most` (counted if not given), as one more run."""
        self._merge()
        most = sets.count() if most is None else most
        self.labels.append(runs.write_run(labels(sets), "a", f"{self.folder}/labels", most * (TREES + 1), then=("b",)))
        self.sets.append(runs.write_run(sets.select("key", "ids"), "key", f"{self.folder}/sets", most * 16, SET_GROUP))
        self._save()

    def _save(self) -> None:
        runs.save_manifest(self.folder, {"labels": self.labels, "sets": self.sets})

    def _merge(self) -> None:
        """Merge the runs of a size class once there are FAN of them, so a row is rewritten once a class."""
        for kind, by, group, then in (("labels", "a", runs.GROUP_ROWS, ("b",)), ("sets", "key", SET_GROUP, ())):
            kept: list[list[Part]] = getattr(self, kind)
            size = [int(np.log(max(1, sum(p.rows for p in run))) / np.log(FAN)) for run in kept]
            for level in sorted(set(size)):
                alike = [run for run, s in zip(kept, size) if s == level]
                if len(alike) >= FAN:
                    old = [p for run in alike for p in run]
                    frame = self.spark.read.parquet(*(p.path for p in old))
                    merged = runs.write_run(frame, by, f"{self.folder}/{kind}", sum(p.rows for p in old), group, then=then)
                    setattr(self, kind, [run for run in kept if run not in alike] + [merged])
                    self._save()
                    runs.drop_parts(old)
                    break

    def search(self, queries: DataFrame) -> DataFrame:
        """Rows of `find` for queries (key, ids, depth, least): only the queries' labels are moved."""
        asked = labels(queries, {"depth": "int", "least": "double"})
        return runs.visit(asked, "a", Places(self.labels), find, FOUND)

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(query, key, common, total) of the pairs (query, key, least) that are alike; sets: those of the queries."""
        asked = pairs.groupBy("query", "key").agg(F.max("least").alias("least"))
        asked = asked.join(sets.select(F.col("key").alias("query"), "ids"), "query").select("key", "query", "ids", "least")
        return runs.visit(asked, "key", Places(self.sets), compare, LIKE)

    def matches(self, sets: DataFrame) -> DataFrame:
        """(query, key, common, total): of each set (key, ids) that repeats an accepted one the best match among all."""
        if not any(self.labels):
            return self.spark.createDataFrame([], LIKE)
        first = self.search(sets.select("key", "ids", F.lit(DEPTH).alias("depth"), F.lit(THRESHOLD).alias("least")))
        known = cut(best(self.verify(first.where("key is not null"), sets)))

        @F.pandas_udf("int")
        def needed(least: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series(need(least.to_numpy(), n.to_numpy()))

        bound = sets.join(known.select(F.col("query").alias("key"), (F.col("common") / F.col("total")).alias("likeness")), "key", "left")
        bound = bound.withColumn("least", F.coalesce("likeness", F.lit(THRESHOLD))).where("least < 1")
        asked = bound.select("key", "ids", needed("least", F.size("ids")).alias("depth"), "least")
        met = cut(self.search(asked))
        more = cut(best(known.unionByName(self.verify(met.where("key is not null"), sets))))
        hot = met.where("key is null").select("query", "place", "depth")
        if hot.isEmpty():
            return more
        rate = more.select("query", (F.col("common") / F.col("total")).alias("likeness"))
        sized = asked.select(F.col("key").alias("query"), F.size("ids").alias("n"), "depth").join(rate, "query", "left")
        sized = sized.select("query", "n", F.coalesce("likeness", F.lit(THRESHOLD)).alias("least"), "depth").where("least < 1")
        short = cut(shortfall(hot, sized))
        if short.isEmpty():
            return more
        places = hot.join(short, "query", "left_semi").select(F.col("place").alias("a")).distinct()
        keys = runs.visit(places, "a", Places(self.labels), members_of, "key long").distinct()
        members = runs.visit(keys, "key", Places(self.sets), fetch, "key long, ids array<bigint>")
        queries = sets.withColumnRenamed("key", "query").join(short, "query", "left_semi").join(sized.select("query", "least"), "query").select("query", "ids", "least")
        return cut(best(more.unionByName(exact(queries, members))))

    def next_batch(self, sets: DataFrame, members: DataFrame, judge: bool = True, most: int | None = None, inner: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
        """Take the classes of one batch, sets (key, ids) and members (entry_id, key): its repeats (accepted_id, entry_id,
        common, total), with the accepted entry of highest likeness before each. Its accepted sets are kept. With judge
        false all are accepted. Only the ranges of the batch are read; nothing of the history is computed again.

        inner: near_pairs of the batch, where they were found for many batches at once."""
        if not judge:
            self.add(sets, most)
            return self.spark.createDataFrame([], REPEAT)
        if inner is None:
            near, large = near_pairs(sets.withColumn("batch_no", F.lit(0)))
            inner = cut(near), large
        near, large = inner[0].select("query", "key", "common", "total"), None if inner[1] is None else inner[1].select("bucket", "key")
        known = self.matches(sets)
        fresh = accept(sets.select("key").join(known.select(F.col("query").alias("key")), "key", "left_anti"), near, large, sets)
        if large is not None:
            refused = large.join(fresh, "key", "left_anti").withColumnRenamed("key", "query")
            near = near.unionByName(likeness(refused.join(large.join(fresh, "key", "left_semi"), "bucket").select("query", "key").distinct(), sets)).distinct()
        # a later entry of a refused class may be more like a set that was accepted after the first one of its class
        near = near.unionByName(near.select(F.col("key").alias("query"), F.col("query").alias("key"), "common", "total"))
        near = near.join(fresh, "key", "left_semi").join(fresh.withColumnRenamed("key", "query"), "query", "left_anti")
        entry = members.withColumnRenamed("key", "query")
        met = entry.join(known, "query").unionByName(entry.join(near, "query").where("key < entry_id"))
        met = best(met.select(F.col("entry_id").alias("query"), "key", "common", "total"))
        kept = sets.join(fresh, "key", "left_semi")
        sized = kept.select("key", F.size("ids").alias("n"))
        equal = members.where("entry_id != key").join(sized, "key").select(F.col("entry_id").alias("query"), "key", F.col("n").alias("common"), F.col("n").alias("total"))
        out = cut(met.unionByName(equal).select(F.col("key").alias("accepted_id"), F.col("query").alias("entry_id"), "common", "total"))
        self.add(kept, most)
        return out


REPEAT = "accepted_id long, entry_id long, common int, total int"


def repeats(entries: DataFrame, folder: str | None = None) -> DataFrame:
    """(accepted_id, entry_id, common, total): each entry that repeats an accepted one, with the accepted entry of highest
    likeness (on ties the lowest id) among those before it. Batch 0 is history: all its entries are accepted.

    common / total is the likeness. Entries without a usable hash are never repeats. The batches go one after the other
    through `next_batch`, in groups (`arrivals`); pairs within the groups are found for all of them before. The forest stays
    in `folder` if one is given, and is dropped else."""
    spark = entries.sparkSession
    place = folder or f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    try:
        batches = staged(entries, f"{place}/incoming")
        forest, out = Forest(spark, place), spark.createDataFrame([], REPEAT)
        if not batches:
            return out
        inner, large = near_pairs(spark.read.schema("key long, ids array<bigint>, batch_no int").parquet(f"{place}/incoming/sets").where("batch_no != 0"))
        inner = cut(inner)
        crowded = set() if large is None else {r.batch_no for r in large.select("batch_no").distinct().collect()}
        for b, n in batches.items():
            sets, members = (spark.read.schema(k).parquet(f"{place}/incoming/{t}/batch_no={b}") for t, k in (("sets", "key long, ids array<bigint>"), ("members", "entry_id long, key long")))
            own = inner.where(F.col("batch_no") == b), large.where(F.col("batch_no") == b) if b in crowded else None
            out = out.unionByName(forest.next_batch(sets.select("key", "ids"), members.select("entry_id", "key"), b != 0, n, own))
        runs.drop_folder(f"{place}/incoming")
        return out
    finally:
        if folder is None:
            runs.drop_folder(place)


def found(entries: DataFrame) -> DataFrame:
    """(first_entry_id, entry_id) of repeats, the smaller id first."""
    return repeats(entries).select(F.least("accepted_id", "entry_id").alias("first_entry_id"), F.greatest("accepted_id", "entry_id").alias("entry_id"))
