import numpy as np
import pandas as pd
from helpers import h, rng, spelled

from cairn.llm import forest, runs

SCHEMA = "entry_id bigint, batch_no int, chunks array<string>, key string, ids string, label string"


def frame(spark, entries):
    return spark.createDataFrame([(*e, "k", "i", "l") for e in entries], SCHEMA)


def clean(text):
    text = (text or "").strip().replace("/", "").lower()
    return text if len(text) == 64 and set(text) <= set("0123456789abcdef") and text != "0" * 64 else None


def brute(entries):
    """One entry after the other, against all accepted ones."""
    rows = {(b, e): frozenset(x for x in map(clean, c or []) if x) for e, b, c in entries}
    accepted, out = [], []
    for (batch, entry), s in sorted(rows.items()):
        if not s:
            continue
        best = max(((len(s & t) / len(s | t), -a) for a, t in accepted), default=(0, 0))
        if batch and best[0] >= 0.7:
            out.append((-best[1], entry))
        else:
            accepted.append((entry, s))
    return sorted((min(x), max(x)) for x in out)


def run(spark, entries):
    return sorted(tuple(r) for r in forest.found(frame(spark, entries)).collect())


def test_prefixes_are_as_long_as_the_target_allows():
    """Beside a better match a longer prefix is enough; without any the widest is needed, and reaches the target."""
    size = np.full(4, 20)
    assert forest.need(np.array([0.7, 0.8, 0.95, 1.0]), size).tolist() == [2, 3, 4, 4]
    for n in range(1, 300):
        assert forest.TREES * forest.log_miss(np.array([2]), np.array([0.7]), np.array([n]))[0] <= np.log(1 - forest.RECALL)


def test_ranges_are_found_by_bisection():
    r = rng(5)
    values = np.array(sorted(r.randrange(50) for _ in range(200)))
    low = np.array([r.randrange(100) for _ in range(60)])
    high, want = low + 80, np.array([r.randrange(-3, 55) for _ in range(60)])
    for right, side in ((False, "left"), (True, "right")):
        got = forest._bisect(values, low, high, want, right)
        assert got.tolist() == [a + int(np.searchsorted(values[a:b], w, side)) for a, b, w in zip(low, high, want)]


def test_against_brute_force(spark):
    r = rng(11)
    pool = [h(k) for k in range(400)]
    entries, seen = [], []
    for k in range(1, 500):
        if seen and r.random() < 0.5:
            chunks = list(r.choice(seen))
            for _ in range(r.randrange(4)):
                chunks[r.randrange(len(chunks))] = r.choice(pool)
            chunks = chunks[: max(1, len(chunks) - r.randrange(3))]
        else:
            chunks = r.sample(pool, r.choice([1, 2, 3, 4, 5, 8, 20, 40]))
        seen.append(chunks)
        entries.append((k, k // 100, [spelled(c, r.randrange(5)) for c in chunks] + r.choice([[], [None, "bad", chunks[0]]])))
    assert run(spark, entries) == brute(entries)


def test_hot_family(spark):
    """A third of all entries are near copies, another third exact ones; large buckets go round by round."""
    r = rng(12)
    core, pool = [h(f"core{k}") for k in range(30)], [h(k) for k in range(3000)]
    entries = []
    for k in range(1, 400):
        kind = r.randrange(3)
        chunks = [*core[r.randrange(5) :], r.choice(pool), r.choice(pool)] if kind == 0 else core if kind == 1 else r.sample(pool, 6)
        entries.append((k, 0 if k < 20 and kind == 2 else 1 + k // 200, chunks))
    assert run(spark, entries) == brute(entries)


def test_hot_bucket_of_unlike_sets(spark):
    shared = [h("a"), h("b")]
    entries = [(k, 1, [*shared, *(h(f"{k // 2 if j else k}-{j}") for j in range(12))]) for k in range(1, 120)]
    assert run(spark, entries) == brute(entries)


def test_rules(spark):
    a = [h(k) for k in range(10)]
    entries = [
        (1, 0, a), (2, 0, a), (3, 0, a[:8]),  # all of batch 0 are accepted
        (4, 1, a), (5, 1, a[:9]), (5, 1, a[:9]),  # ties go to the lowest id; a row delivered twice is one
        (6, 1, None), (7, 1, []), (8, 1, ["bad", None, "0" * 64]), (9, 2, [h("x")]), (10, 2, [h("x")]), (11, 2, [h("x"), h("y")]),
    ]
    assert run(spark, entries) == brute(entries) == [(1, 4), (1, 5), (9, 10)]


def test_refused_entries_do_not_refuse(spark):
    a = [h(k) for k in range(10)]
    entries = [(1, 0, a), (2, 1, [*a[:8], h("p"), h("q")][:10]), (3, 1, [*a[:7], h("p"), h("q"), h("r")]), (4, 1, [*a[:9], h("s")])]
    assert run(spark, entries) == brute(entries)


def test_larger_id_in_an_earlier_batch(spark):
    assert run(spark, [(9, 0, [h("x")]), (1, 1, [h("x")])]) == [(1, 9)]


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, 0, None)]) == [] and run(spark, [(1, 1, [h(1)])]) == []


def test_near_family_in_history(spark, monkeypatch):
    """A family of near copies in batch 0 makes all trees hot: its members are compared by rare hashes, some in blocks."""
    monkeypatch.setattr(forest, "PAIRS", 500)
    r = rng(14)
    core = [h(f"core{k}") for k in range(20)]
    entries = []
    for k in range(1, 330):
        chunks = [*r.sample(core, 18), h(f"own{k}")] if k % 3 else [h(f"{k}-{j}") for j in range(5)]
        entries.append((k, 0 if k < 220 else 1, chunks))
    assert run(spark, entries) == brute(entries)


def test_many_hashes_in_common_without_likeness(spark):
    """Hot prefixes in most trees, but nothing alike: the rarest hashes tell."""
    shared = [h(f"s{k}") for k in range(5)]
    entries = [(k, k % 2, [*shared, *(h(f"{k}-{j}") for j in range(3))]) for k in range(400)]
    assert run(spark, entries) == brute(entries) == []


def test_blocks_give_the_best_match():
    r = rng(15)
    sets = [np.array(sorted(r.sample(range(40), r.randrange(8, 16)))) for _ in range(60)]
    left = pd.DataFrame({"query": range(20), "least": 0.3, "ids": sets[:20]})
    right = pd.DataFrame({"key": range(20, 60), "ids": sets[20:]})
    got = {r.query: (r.key, r.common, r.total) for r in forest.block_best(left, right).itertuples()}
    for q in range(20):
        a = set(sets[q])
        rate, key = max((len(a & set(s)) / len(a | set(s)), -k) for k, s in enumerate(sets[20:], 20))
        assert (got[q][0] == -key and got[q][1] / got[q][2] == rate) if rate >= 0.3 else q not in got


def test_runs_are_searched_and_merged(spark, tmp_path):
    forest_ = forest.Forest(spark, str(tmp_path))
    for k in range(5):
        sets = spark.createDataFrame([(k * 50 + i, [k * 100 + i, k * 100 + i + 1]) for i in range(50)], "key long, ids array<bigint>")
        forest_.add(sets)
    assert len(forest_.labels) == 2 and sum(p.rows for run in forest_.labels for p in run) == 250 * (forest.TREES + 1)
    again = forest.Forest(spark, str(tmp_path))  # by the manifest alone
    asked = spark.createDataFrame([(1000, [120, 121]), (1001, [7, 8]), (1002, [9999])], "key long, ids array<bigint>")
    assert {(r.query, r.key) for r in again.matches(asked).collect()} == {(1000, 70), (1001, 7)}


def test_a_search_reads_the_row_groups_it_needs(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("id * 10 as key", "array(id) as ids")
    parts = runs.write_run(rows, "key", str(tmp_path), 40_000, 100)
    reader = runs.Reader(parts[0].path, "key")
    assert sum(p.rows for p in parts) == 40_000 and reader.rows(np.array([parts[0].low, parts[0].low + 10])).num_rows == 100
    asked = spark.createDataFrame([(50,), (51,), (399_990,), (400_000,)], "key long")
    found = runs.visit(asked, "key", runs.Places([parts]), forest.fetch, "key long, ids array<bigint>").collect()
    assert sorted((r.key, r.ids[0]) for r in found) == [(50, 5), (399_990, 39_999)]


def test_batch_after_batch_equals_all_at_once(spark, tmp_path):
    """Each batch on its own, with the forest opened anew from its folder."""
    r = rng(13)
    pool = [h(k) for k in range(300)]
    base = [r.sample(pool, r.choice([3, 8, 20])) for _ in range(60)]
    entries = [(k, k // 60, r.choice(base)[: r.randrange(2, 21)] + r.sample(pool, r.randrange(3))) for k in range(1, 300)]
    got = []
    for batch in range(5):
        place = str(tmp_path / f"in{batch}")
        forest.staged(frame(spark, [e for e in entries if e[1] == batch]), place)
        sets, members = (spark.read.parquet(f"{place}/{t}").drop("batch_no") for t in ("sets", "members"))
        found = forest.Forest(spark, str(tmp_path / "forest")).next_batch(sets, members, batch != 0)
        got += [(min(x), max(x)) for x in ((r.accepted_id, r.entry_id) for r in found.collect())]
    assert sorted(got) == brute(entries)


def test_consecutive_batches_are_taken_together(spark, monkeypatch):
    """The passes over the forest follow the logarithm of the entries, where the ids rise from batch to batch."""
    r = rng(16)
    pool = [h(k) for k in range(300)]
    base = [r.sample(pool, r.choice([3, 8, 20])) for _ in range(50)]
    entries = [(k, max(0, k // 10 - 5), r.choice(base)[: r.randrange(2, 21)] + r.sample(pool, r.randrange(3))) for k in range(1, 200)]
    asked, matches = [], forest.Forest.matches
    monkeypatch.setattr(forest.Forest, "matches", lambda self, sets: asked.append(1) or matches(self, sets))
    assert run(spark, entries) == brute(entries)
    assert len(asked) == 2  # for 14 batches: 1 to 5 and 6 to 14


def test_groups_of_batches():
    """As large as what is before them; never across batch 0, nor where an id is not above those of the batches before."""
    rows = [(b, 10, 10 * b + 1, 10 * b + 10) for b in range(12)]
    assert forest.arrivals([]) == [] and forest.arrivals(rows) == [0, 1, 2, 4, 8]
    assert forest.arrivals([(0, 100, 1, 100), *rows[1:]]) == [0, 1, 11]
    assert forest.arrivals([(-2, 5, -9, -5), (-1, 5, -4, 0), (0, 9, 1, 9), (1, 4, 10, 13), (2, 4, 13, 16), (3, 4, 17, 20)]) == [-2, -1, 0, 1, 2]


def test_ids_that_do_not_rise_with_the_batches(spark):
    """Late and repeated ids: the order is that of the batches, ties go to the lowest id."""
    a, b = [h(k) for k in range(10)], [h(f"b{k}") for k in range(10)]
    entries = [(100 + k, 0, [h(f"x{k}")]) for k in range(9)]
    entries += [(50, 1, a), (40, 2, a[:9]), (60, 2, b), (55, 3, b[:9]), (41, 3, [*b[:8], h("y")]), (60, 4, a[:8]), (70, 5, b), (65, 6, b)]
    assert run(spark, entries) == brute(entries)


def test_later_entry_of_a_refused_class_meets_what_was_accepted_between(spark):
    c = [h(k) for k in range(12)]
    entries = [(1, 0, [h("x")]), (3, 1, c[:7]), (5, 1, c[:10]), (7, 1, c[1:11]), (9, 1, c[:10])]
    assert run(spark, entries) == brute(entries) == [(3, 5), (7, 9)]


def test_runs_of_labels_are_in_order_of_the_whole_label(spark, tmp_path):
    """Longer prefixes are found by bisection of the second word among equal first ones, in merged runs too."""
    r = rng(17)
    forest_ = forest.Forest(spark, str(tmp_path))
    for k in range(5):
        rows = [(k * 40 + i, sorted([*r.sample(range(30), 28), 1000 + k * 40 + i])) for i in range(40)]
        forest_.add(spark.createDataFrame(rows, "key long, ids array<bigint>"))
        for run_ in forest_.labels:
            got = [(x.a, x.b) for p in run_ for x in spark.read.parquet(p.path).select("a", "b").collect()]
            assert got == sorted(got)
