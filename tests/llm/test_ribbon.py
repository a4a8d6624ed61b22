from functools import reduce

import numpy as np
import pytest
from helpers import h, rng, spelled
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import ribbon

PUTS = "put_id bigint, batch_no int, hash string, key string, id string"


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_no_stored_key_is_missed(keys):
    keys = np.array(sorted(keys), dtype=np.uint64)
    made = ribbon.Ribbon.build(keys)
    assert made.contains(keys).all() and ribbon.Ribbon.unpack(made.pack()).contains(keys).all()


def test_rate_and_size():
    r = np.random.default_rng(1)
    keys, absent = (r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (20_000, 200_000))
    made = ribbon.Ribbon.build(keys, bits=8)
    assert made.contains(keys).all() and 0.5 < made.contains(absent).mean() * 256 < 1.5
    assert len(made.pack()) < 20_000 * 1.3


def brute(puts, base):
    first, out = {b: -1 for b in base}, set()
    for put_id, text in sorted({(p, t) for p, _, t in puts if p is not None}, key=lambda x: x[0]):
        key = (text or "").replace("/", "").strip().lower()
        if len(key) == 64 and set(key) <= set("0123456789abcdef") and key != "0" * 64:
            if key in first:
                out.add(put_id)
            first.setdefault(key, put_id)
    return sorted(out)


def run(spark, puts, base, **options):
    df = spark.createDataFrame([(*p, "k", "i") for p in puts], PUTS)
    b = spark.createDataFrame([(x, "l") for x in base], "hash string, label string")
    return sorted(r.put_id for r in ribbon.known_puts(df, b, **options).collect())


def test_against_brute_force(spark):
    r = rng(4)
    base = [h(f"b{k}") for k in range(20)]
    hot = h("hot")
    puts = []
    for k in range(3000):
        key = hot if r.random() < 0.33 else r.choice(base) if r.random() < 0.05 else h(r.randrange(1500))
        puts.append((k, None if k > 2800 else k // 400, r.choice([spelled(key, r.randrange(5))] * 20 + [None, "bad", "0" * 64])))
    puts += puts[:100]
    r.shuffle(puts)
    assert run(spark, puts, base) == brute(puts, base)
    # filters of one bit are wrong half of the time; the check that follows keeps the result right
    assert run(spark, puts, base, bits=1, shard_bits=2) == brute(puts, base)


def test_batches_that_overlap_are_one_generation(spark):
    puts = [(1, 5, h("a")), (9, 5, h("b")), (4, 2, h("b")), (12, 2, h("c")), (20, 1, h("c")), (21, None, h("d"))]
    df = spark.createDataFrame([(*p, "k", "i") for p in puts], PUTS)
    assert {r.batch: r.generation for r in ribbon.generations(df).collect()} == {5: 0, 2: 0, 1: 1, -(2**62): 2}
    assert run(spark, puts, []) == brute(puts, []) == [9, 20]


def test_edges(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(5, 0, h("a"))], []) == [] and run(spark, [(5, 0, h("a"))], [h("a")]) == [5]
    assert run(spark, [(None, 0, h("a")), (7, 0, h("a")), (7, 0, h("a")), (9, 0, h("a").upper())], []) == [9]


def test_audit(spark):
    """Rates of single filters and of decisions by all of them so far, against what fingerprints promise."""
    puts = spark.createDataFrame([(k, k // 500, h(k), "k", "i") for k in range(2000)], PUTS)
    base = spark.createDataFrame([(h(f"b{k}"),) for k in range(300)], "hash string")
    rows = ribbon.audit(puts, base, probes=20_000, bits=6, shard_bits=1).collect()
    filters = {r.generation: r for r in rows if r.scope == "filter"}
    decisions = {r.generation: r for r in rows if r.scope == "decision"}
    assert sorted(filters) == sorted(decisions) == [-1, 0, 1, 2, 3] and sum(r.n_keys for r in filters.values()) == 2300
    assert all(0.5 < r.rate / r.expected < 1.5 for r in [*decisions.values(), *filters.values()])
    assert decisions[3].n_filters == 5 and decisions[3].rate > 3 * filters[3].rate


def made(spark, keys, generation):
    return spark.createDataFrame([(generation, k * 2**40, k, k) for k in keys], "generation int, key long, proof long, put_id long")


def test_sealed_batches_are_never_written_again(spark, tmp_path):
    seen = ribbon.Seen(spark, str(tmp_path), shard_bits=2)
    seen.seal(made(spark, range(900), 0))
    before = {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in tmp_path.rglob("*.parquet")}
    later = ribbon.Seen(spark, str(tmp_path))  # by the manifest alone, with the options it was made with
    assert later.shard_bits == 2
    second = made(spark, range(600, 1200), 1)
    assert sorted(r.put_id for r in later.new(second).collect()) == list(range(900, 1200))
    later.seal(second)
    assert {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in before} == before
    assert sorted(r.put_id for r in later.new(made(spark, range(1100, 1300), 2)).collect()) == list(range(1200, 1300))
    with pytest.raises(ValueError):
        later.seal(second)


def test_filters_save_the_look_ups(spark, tmp_path, monkeypatch):
    """A probe that always says yes looks a new key up in every generation; the filters look up about none."""
    seen = ribbon.Seen(spark, str(tmp_path), shard_bits=1)
    seen.seal(reduce(lambda a, b: a.unionByName(b), (made(spark, range(g * 100, g * 100 + 100), g) for g in range(6))))
    asked, real, counts = made(spark, range(10_000, 10_400), 6), ribbon.runs.visit, []

    def counted(rows, *args, **kwargs):
        counts.append(rows.count())
        return real(rows, *args, **kwargs)

    monkeypatch.setattr(ribbon.runs, "visit", counted)
    assert seen.new(asked).count() == 400
    few, counts[:] = sum(counts), []
    generation, low = F.col("generation"), F.greatest(F.col("after") + 1, F.lit(0))
    always = lambda keys, *_: keys.withColumn("yes", F.when(low < generation, low).cast("int"))
    monkeypatch.setattr(ribbon, "probe", always)
    assert seen.new(asked).count() == 400
    assert sum(counts) == 400 * 6 and few <= 5
