import unicodedata

from helpers import h, rng, spelled

from cairn.operators import snapshot_delta

ENTRIES = "entry_id bigint, snapshot_id string, path string, mode bigint, size bigint, mod_time bigint, file_hash string, note string"
SNAPS = "snapshot_id string, prev_id string, received_at timestamp, deleted_at timestamp, path string"
S = 1_000_000_000


def run(spark, rows, entries, snaps):
    e = spark.createDataFrame([(*x, "note") for x in entries], ENTRIES)
    s = spark.createDataFrame([(a, b, None, None, "clash") for a, b in snaps], SNAPS)
    return rows(snapshot_delta.snapshot_changes(e, s))


def test_cases(spark, rows):
    a, b = h("s1"), h("s2")
    entries = [
        (1, a, "same", 1, 1, S, h(1)), (2, b, "./same", 1, 1, S + 5, h(1).upper()),
        (3, a, "hash", 1, 1, S, h(1)), (4, b, "hash", 1, 1, S, h(2)),
        (5, a, "size", 1, 1, S, h(1)), (6, b, "size", 1, None, S, h(1)),
        (7, a, "time", 1, 1, -1, h(1)), (8, b, "time", 1, 1, 0, h(1)),
        (9, a, "nulls", 1, None, None, None), (10, b, "nulls", 1, None, None, "bad"),
        (11, a, "gone", 1, 1, S, h(1)), (12, b, "new\\x", 1, 1, S, h(1)),
        (13, a, "twice", 1, 1, S, h(1)), (14, b, "twice", 1, 1, S, h(2)), (15, b, "twice", 1, 1, S, h(1)), (15, b, "twice", 1, 1, S, h(1)),
        (16, a, "Case", 1, 1, S, h(1)), (17, b, "case", 1, 1, S, h(1)),
        (18, a, "größe", 1, 1, S, h(1)), (19, b, unicodedata.normalize("NFD", "größe"), 1, 1, S, h(1)),
        (20, a, None, 1, 1, S, h(1)), (21, None, "x", 1, 1, S, h(1)),
    ]
    want = [(b, "Case", "removed"), (b, "case", "added"), (b, "gone", "removed"), (b, "hash", "changed"), (b, "new/x", "added"), (b, "size", "changed"), (b, "time", "changed")]
    assert run(spark, rows, entries, [(a, None), (b, " " + a), (b, a)]) == sorted(want, key=repr)


def test_empty_tables_and_lists(spark, rows):
    a, b = h("s1"), h("s2")
    assert run(spark, rows, [], []) == []
    assert run(spark, rows, [(1, a, "x", 1, 1, 1, h(1))], [(a, "0" * 64), (b, a)]) == [(b, "x", "removed")]
    assert run(spark, rows, [(1, b, "x", 1, 1, 1, h(1))], [(a, h("unknown")), (b, a)]) == [(b, "x", "added")]


def test_against_brute_force(spark, rows):
    r = rng(3)
    ids = [h(f"s{k}") for k in range(8)]
    snaps = [(i, spelled(r.choice(ids), r.randrange(5)) if r.random() < 0.8 else None) for i in ids]
    entries = [(k, r.choice(ids), f"p{r.randrange(12)}", None, r.choice([1, 2, None]), r.choice([0, S, None]), h(r.randrange(3))) for k in range(200)]
    lists = {}
    for e in sorted(entries, key=lambda e: e[0]):
        lists.setdefault(e[1], {})[e[2]] = (e[4], e[5], e[6])
    want = []
    for i, p in snaps:
        p = p and p.replace("/", "").strip().lower()
        if p in ids:
            new, old = lists.get(i, {}), lists.get(p, {})
            for path in new.keys() | old.keys():
                change = "added" if path not in old else "removed" if path not in new else "changed" if new[path] != old[path] else None
                if change:
                    want.append((i, path, change))
    assert run(spark, rows, entries, snaps) == sorted(want, key=repr)
