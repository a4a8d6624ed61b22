import numpy as np
from helpers import h, rng
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.functions import gf61
from cairn.operators import reconcile


def brute(left, right, fields):
    out, a, b = set(), {}, {}
    for side, rows in ((a, left), (b, right)):
        for key, *values in rows:
            if key is not None:
                side.setdefault(key, set()).add(tuple(values))
    for key in a.keys() | b.keys():
        if key not in b:
            out.add((key, "missing_remote"))
        elif key not in a:
            out.add((key, "missing_local"))
        else:
            out |= {(key, f) for x in a[key] for y in b[key] for k, f in enumerate(fields) if x[k] != y[k]}
    return sorted(out)


def run(spark, left, right, **options):
    schema = "key bigint, a string, b bigint, x string, bucket int"
    frames = [spark.createDataFrame([(*r, "x", 7) for r in side], schema) for side in (left, right)]
    return sorted(tuple(r) for r in reconcile.differences(*frames, ["a", "b"], **options).collect())


def test_against_brute_force(spark):
    r = rng(1)
    left = [(k, f"v{k}", k % 7 or None) for k in range(600)]
    right = [(k, a if r.random() > 0.03 else None, b if r.random() > 0.03 else 99) for k, a, b in left if r.random() > 0.05] + [(k, "new", None) for k in range(1000, 1020)]
    left += left[:50] + [left[0]] * 200 + [(None, "x", 1)]
    r.shuffle(right)
    assert run(spark, left, right) == brute(left, right, ["a", "b"])


def test_everything_differs_doubles_and_falls_back(spark):
    left, right = [(k, "l", k) for k in range(300)], [(k, "r", k) for k in range(300)]
    assert run(spark, left, right, bucket_rows=300, degree=2, last_degree=8) == [(k, "a") for k in range(300)]


def test_degree_is_doubled_until_verified(spark):
    left, right = [(k, "l", 0) for k in range(20)], [(k, "l", 0) for k in range(7, 20)]
    assert run(spark, left, right, bucket_rows=100, degree=2) == [(k, "missing_remote") for k in range(7)]


def test_several_rows_of_a_key(spark):
    left, right = [(1, "a", 1), (1, "b", 1), (2, "a", 1)], [(1, "a", 1), (2, "a", 1)]
    assert run(spark, left, right) == brute(left, right, ["a", "b"]) == [(1, "a")]


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", None)], []) == [(1, "missing_remote")]
    assert run(spark, [], [(1, None, None)]) == [(1, "missing_local")]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**60 - 1), max_size=8), st.sets(st.integers(0, 2**60 - 1), max_size=4), st.sets(st.integers(0, 2**60 - 1), max_size=4))
def test_interpolation(common, only_a, only_b):
    a, b = common | only_a, common | only_b
    degree = 10
    z = reconcile.points(degree + reconcile.CHECKS)

    def values(s):
        out = np.ones(len(z), np.uint64)
        for x in s:
            out = gf61.mul(out, gf61.sub(z, np.full(len(z), x, np.uint64)))
        return out

    ratio = gf61.mul(values(a), gf61.inverse(values(b)))[None, :]
    top, bottom, good = reconcile.interpolate(np.array([len(a) - len(b)]), ratio, degree)
    assert good[0]

    def roots(p, s):
        x = np.array(sorted(s), np.uint64)
        return set(x[gf61.horner(np.repeat(p, len(x), axis=0), x) == 0].tolist()) if s else set()

    assert a - b <= roots(top, a) and b - a <= roots(bottom, b)


def test_store_differences(spark, rows):
    c = [(h(1), 1, 1, None), (h(2).upper(), 2, None, None), (h(3), 3, 0, None), (h(4), 4, 0, "2025-01-01"), (None, 1, 1, None)]
    chunks = spark.createDataFrame(c, "hash string, size bigint, flags int, deleted_at string")
    remote = spark.createDataFrame([(h(1), 1, 2), (" " + h(2), None, None), (h(4), 4, 0), ("0" * 64, 1, 1)], "hash string, size bigint, flags int")
    refs = spark.createDataFrame([(1, "heads/é", "branch", h(9), ""), (2, "tags/a", "tag", None, None), (3, "x", None, h(9), "y")], "ref_id bigint, name string, type string, target string, symref string")
    theirs = spark.createDataFrame([(1, "refs/heads/é", "branch", h(9).upper(), None), (2, "tags/b", "tag", "bad", None), (4, "z", "tag", h(9), None)], refs.schema)
    want = [("chunks", h(1), "flags"), ("chunks", h(2), "size"), ("chunks", h(3), "missing_remote"), ("chunks", h(4), "missing_local")]
    want += [("refs", "2", "name"), ("refs", "3", "missing_remote"), ("refs", "4", "missing_local")]
    assert rows(reconcile.store_differences(chunks, remote, refs, theirs)) == sorted(want, key=repr)
