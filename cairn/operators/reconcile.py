"""Differences between two copies of data, by characteristic polynomials.

Each copy turns its rows into elements of a prime field and keeps, per bucket of elements, the values of the bucket's
characteristic polynomial at a few fixed points: 8 bytes a point, however many rows. The quotient of two copies' values
is a rational function whose numerator and denominator have the rows of one side only as roots; it is interpolated and
verified at points that were not used. A bucket that fails is sketched again with twice the degree. Each side then finds
its own roots, and only the rows of their keys are fetched and compared field by field. Rows that are equal on both
sides never leave their side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import gf61
from cairn.functions.hashes import bytes_text, clean_hash, hash_bytes
from cairn.functions.paths import nfc
from cairn.session import cut

#: Elements lie below 2^60, evaluation points above: no point is ever an element.
ELEMENT_BITS = 60
CHECKS = 2


def element(*values: Column) -> Column:
    """60-bit element of a row; null has a form of its own. Two different rows of a bucket of n share one with
    probability n^2 / 2^61; buckets hold some tens of rows at any size of the data."""
    texts = [F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("~")) for v in values]
    return F.shiftrightunsigned(F.xxhash64(F.concat_ws("\x1f", *texts)), 64 - ELEMENT_BITS)


def points(count: int) -> np.ndarray:
    return np.uint64(gf61.P - 1) - np.arange(count, dtype=np.uint64)


def bucket_runs(frames: Iterator[pd.DataFrame], column: str, least: int = 40_000) -> Iterator[pd.DataFrame]:
    """Regroup a partition sorted by column into frames that hold whole buckets."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= least:
            whole = pd.concat(held, ignore_index=True)
            last = whole[column].to_numpy()[-1]
            end = int(np.searchsorted(whole[column].to_numpy(), last))
            if end:
                yield whole.iloc[:end]
            held, size = [whole.iloc[end:]], len(whole) - end
    if size:
        yield pd.concat(held, ignore_index=True)


def elements(rows: DataFrame, buckets: int) -> DataFrame:
    """Distinct (bucket, x), sorted by bucket within partitions. The bucket comes from x, so no key makes one large;
    repeated rows are combined on the map side."""
    each = rows.select("x").distinct()
    return each.select(F.pmod("x", F.lit(buckets)).alias("bucket"), "x").repartition("bucket").sortWithinPartitions("bucket")


def sketch(elements_: DataFrame, degree: int) -> DataFrame:
    """(bucket, n, at): the number of elements and the values at degree + CHECKS points."""
    z = points(degree + CHECKS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bucket_runs(frames, "bucket"):
            bucket = frame["bucket"].to_numpy()
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            factors = gf61.sub(z[None, :], frame["x"].to_numpy().astype(np.uint64)[:, None])
            products = gf61.segment_products(factors, starts)
            yield pd.DataFrame({"bucket": bucket[starts], "n": np.diff(np.append(starts, len(bucket))), "at": list(products.astype(np.int64))})

    return elements_.mapInPandas(run, "bucket long, n long, at array<long>")


def interpolate(delta: np.ndarray, ratio: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numerators and denominators (highest coefficient first, padded in front to degree + 1) with the given ratios at
    points(), the difference of their degrees being delta, and whether the points left over agree."""
    z = points(ratio.shape[1])
    n = len(delta)
    top, bottom, good = np.zeros((n, degree + 1), np.uint64), np.zeros((n, degree + 1), np.uint64), np.zeros(n, bool)
    for d in np.unique(delta):
        if abs(d) > degree:
            continue
        own = np.flatnonzero(delta == d)
        m = degree - (degree - int(d)) % 2
        a, b = (m + int(d)) // 2, (m - int(d)) // 2
        f, powers = ratio[own][:, :m], np.stack([gf61.power(z[:m], k) for k in range(max(a, b) + 1)], axis=1)
        fz = gf61.mul(f[:, :, None], powers[None, :, : b + 1])
        left = np.concatenate([np.broadcast_to(powers[None, :, :a], (len(own), m, a)), gf61.sub(np.zeros_like(fz[:, :, :b]), fz[:, :, :b])], axis=2)
        found = gf61.solve(left, gf61.sub(fz[:, :, b], np.broadcast_to(powers[None, :, a], f.shape))) if m else np.zeros((len(own), 0), np.uint64)
        one = np.ones((len(own), 1), np.uint64)
        p, q = np.concatenate([one, found[:, :a][:, ::-1]], axis=1), np.concatenate([one, found[:, a:][:, ::-1]], axis=1)
        top[own, degree - a :], bottom[own, degree - b :] = p, q
        good[own] = True
        for k in range(ratio.shape[1]):
            x = np.full(len(own), z[k])
            good[own] &= gf61.horner(p, x) == gf61.mul(gf61.horner(q, x), ratio[own, k])
    return top, bottom, good


def solve_buckets(left: DataFrame, right: DataFrame, degree: int) -> DataFrame:
    """(bucket, top, bottom, good) of the buckets whose sketches differ. A bucket that one side lacks is empty there."""
    width = degree + CHECKS
    b = right.withColumnsRenamed({"n": "m", "at": "other"})
    both = left.join(b, "bucket", "full_outer").where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("at").eqNullSafe(F.col("other"))))
    ones = F.array_repeat(F.lit(1).cast("long"), width)
    filled = both.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("at", ones).alias("at"), F.coalesce("other", ones).alias("other"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                at, other = (np.stack(frame[c].to_list()).astype(np.uint64) for c in ("at", "other"))
                top, bottom, good = interpolate((frame["n"] - frame["m"]).to_numpy(), gf61.mul(at, gf61.inverse(other)), degree)
                yield pd.DataFrame({"bucket": frame["bucket"], "top": list(top.astype(np.int64)), "bottom": list(bottom.astype(np.int64)), "good": good})

    return filled.mapInPandas(run, "bucket long, top array<long>, bottom array<long>, good boolean")


def roots(elements_: DataFrame, solved: DataFrame) -> DataFrame:
    """The elements at which a polynomial of their bucket is 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = frame["x"].to_numpy().astype(np.uint64)
                hit = np.zeros(len(x), bool)
                for c in ("top", "bottom"):
                    hit |= gf61.horner(np.stack(frame[c].to_list()).astype(np.uint64), x) == 0
                yield frame.loc[hit, ["x"]]

    return elements_.join(solved.select("bucket", "top", "bottom"), "bucket").mapInPandas(run, "x long")


def differing_elements(left: DataFrame, right: DataFrame, rows: int, bucket_rows: int = 32, degree: int = 6, last_degree: int = 96) -> DataFrame:
    """Elements x that only one of left and right has, and perhaps a few that both have.

    rows: number of rows of the larger side, for the number of buckets. Buckets that are not verified at last_degree are
    returned whole: the fetch and comparison that follow are exact for any superset."""
    buckets = max(1, rows // bucket_rows)
    open_left, open_right = cut(elements(left, buckets)), cut(elements(right, buckets))
    found: DataFrame | None = None
    while True:
        solved = cut(solve_buckets(sketch(open_left, degree), sketch(open_right, degree), degree))
        good, bad = solved.where("good"), solved.where("not good").select("bucket")
        for side in (open_left, open_right):
            new = roots(side, good)
            found = new if found is None else found.unionByName(new)
        if bad.isEmpty():
            return found
        open_left, open_right = (side.join(bad, "bucket", "left_semi").sortWithinPartitions("bucket") for side in (open_left, open_right))
        degree *= 2
        if degree > last_degree:
            return found.unionByName(open_left.select("x")).unionByName(open_right.select("x"))


def differences(left: DataFrame, right: DataFrame, fields: list[str], **options: int) -> DataFrame:
    """(row_key, field) where two copies of a table differ; field is missing_remote, missing_local or a column.

    left and right: `key` (null: no record) and fields. Null equals null and differs from any value. A repeated row is
    one row; if a key has several different rows, a field differs if any two rows of the sides differ in it. Empty
    tables are legal on either side."""
    names = ["key", *fields]
    a, b = (side.select(*names).where("key is not null") for side in (left, right))
    a, b = (side.withColumn("x", element(*(F.col(c) for c in names))) for side in (a, b))
    rows = max(a.count(), b.count())
    hits = cut(differing_elements(a.select("x"), b.select("x"), rows, **options).distinct())
    keys = a.join(hits, "x", "left_semi").select("key").unionByName(b.join(hits, "x", "left_semi").select("key")).distinct()
    keys = cut(keys)
    ours, theirs = (side.join(keys, "key", "left_semi").drop("x").distinct() for side in (a, b))
    r = theirs.select("key", F.lit(True).alias("there"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(fields)))
    both = ours.withColumn("here", F.lit(True)).join(r, "key", "full_outer")
    unequal = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{k}")), c) for k, c in enumerate(fields))), lambda x: x.isNotNull())
    faults = F.when(F.col("there").isNull(), F.array(F.lit("missing_remote"))).when(F.col("here").isNull(), F.array(F.lit("missing_local"))).otherwise(unequal)
    return both.select(F.col("key").alias("row_key"), F.explode(faults).alias("field")).distinct()


def chunk_rows(chunks: DataFrame, live_only: bool) -> DataFrame:
    rows = chunks.where("deleted_at is null") if live_only else chunks
    return rows.select(hash_bytes(F.col("hash")).alias("key"), F.col("size").cast("long").alias("size"), F.col("flags").cast("int").alias("flags"))


def ref_rows(refs: DataFrame) -> DataFrame:
    """Names in NFC without a leading `refs/`, targets as hashes, empty symrefs null; nothing else is folded."""
    name = F.regexp_replace(nfc(F.col("name")), r"\Arefs/", "")
    return refs.select(F.col("ref_id").alias("key"), name.alias("name"), "type", clean_hash(F.col("target")).alias("target"), F.nullif("symref", F.lit("")).alias("symref"))


def store_differences(chunks: DataFrame, remote_chunks: DataFrame, refs: DataFrame, remote_refs: DataFrame) -> DataFrame:
    """(copy_table, row_key, field) over the two tables of which both stores hold a copy. Only live rows of chunks count."""
    c = differences(chunk_rows(chunks, True), chunk_rows(remote_chunks, False), ["size", "flags"])
    r = differences(ref_rows(refs), ref_rows(remote_refs), ["name", "type", "target", "symref"])
    return c.select(F.lit("chunks").alias("copy_table"), bytes_text(F.col("row_key")).alias("row_key"), "field").unionByName(
        r.select(F.lit("refs").alias("copy_table"), F.col("row_key").cast("string").alias("row_key"), "field")
    )
