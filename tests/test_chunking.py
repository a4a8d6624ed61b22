import hashlib

import pytest
from helpers import h, rng
from pyspark.sql import functions as F

from cairn.operators import chunking, integrity, textdiff


@pytest.mark.parametrize(("sizes", "data"), [((4096, 8192, 16384), 200 << 10), ((1 << 20, 2 << 20, 4 << 20), 10 << 20), ((64, 128, 256), 5000), ((256, 1024, 4096), 257), ((256, 1024, 4096), 1), ((256, 1024, 4096), 0)])
def test_cut_points(sizes, data):
    data = rng(5).randbytes(data)
    ends = chunking.cut_points(data, *sizes)
    lengths = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(lengths) == len(data) and all(x <= sizes[2] for x in lengths) and all(x >= sizes[0] for x in lengths[:-1])
    assert ends == chunking.cut_points(data, *sizes)


def test_small_edit_keeps_most_chunks():
    data = rng(6).randbytes(400_000)
    pieces = []
    for x in (data, data[:1000] + b"inserted" + data[1000:]):
        ends = chunking.cut_points(x, 2048, 8192, 32768)
        pieces.append({x[a:b] for a, b in zip([0, *ends], ends)})
    assert len(pieces[0] & pieces[1]) > 0.8 * len(pieces[0])


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ((4096, 8192, 16384), (4096, 8192, 16384)), ((0, 0, 0), (64, 262144, 524288)), ((-1, -1, -1), (512, 262144, 524288)), ((1 << 20, 2 << 20, 512 << 10), chunking.CDC_DEFAULT),
        ((65536, 131072, 131072), chunking.CDC_DEFAULT), ((64, 100, 1000), (64, 512, 1000)), ((64, 128, 1 << 40), (64, 128, 1 << 30)),
    ],
)
def test_clamp(given, want):
    assert chunking.clamp_cdc(*given) == want


FILES = [("empty", b""), ("one", b"x"), ("exact", b"ab" * 8), ("long", bytes(range(256)) * 40), ("none", None)]


def files(spark):
    return spark.createDataFrame([(p, c, "clash", 1) for p, c in FILES], "path string, content binary, hash string, idx int")


@pytest.mark.parametrize("how", ["fixed", "cdc"])
def test_round_trip(spark, how):
    df = files(spark)
    chunks = chunking.fixed_chunks(df, ["path"], 16) if how == "fixed" else chunking.cdc_chunks(df, "path", sizes=(64, 128, 256))
    if how == "fixed":
        store = chunks.select("hash", "data").dropDuplicates(["hash"])
        back = {r.path: r.content and bytes(r.content) for r in chunking.reassemble(chunks.select("path", "idx", "hash"), store, ["path"]).collect()}
        assert {k: v or b"" for k, v in back.items()} == {p: c for p, c in FILES if c is not None}
    got = {}
    for r in chunks.collect():
        got.setdefault(r.path, []).append((r.idx, r.size, r.hash))
    for path, content in FILES:
        if content is None:
            assert path not in got
            continue
        at = 0
        for k, (idx, size, digest) in enumerate(sorted(got[path])):
            assert idx == k and hashlib.sha256(content[at : at + size]).hexdigest() == digest
            at += size
        assert at == len(content)


def test_file_hash(spark):
    got = {r.path: r for r in chunking.with_file_hash(chunking.fixed_chunks(files(spark), ["path"], 16), ["path"]).collect()}
    assert got["empty"].file_hash == hashlib.sha256(hashlib.sha256(b"").digest()).hexdigest() and got["empty"].size == 0
    assert len(got["long"].chunks) == 640 and got["exact"].chunks == [hashlib.sha256(b"ab" * 8).hexdigest()]


def test_missing_chunk_gives_no_content(spark):
    chunks = chunking.fixed_chunks(files(spark), ["path"], 16)
    lost = chunks.where("path = 'exact'").select("hash")
    store = chunks.select("hash", "data").dropDuplicates(["hash"]).join(lost, "hash", "left_anti")
    assert {r.path for r in chunking.reassemble(chunks.select("path", "idx", "hash"), store, ["path"]).where("content is null").collect()} == {"exact"}


def test_put_is_idempotent(spark):
    chunks = chunking.fixed_chunks(files(spark), ["path"], 16)
    assert chunking.new_chunks(chunks, chunks).collect() == [] and chunking.new_chunks(chunks, chunks.limit(0)).count() == chunks.select("hash").distinct().count()
    assert chunking.dedup_stats(chunks).first().chunks == chunks.count()


def test_integrity(spark, rows):
    def put(x, data):
        return h(x), data

    store = spark.createDataFrame([put("a", b"a"), put("b", b"other"), put("c", None), put("d", b"bad"), put("d", b"d"), ("x", b"x")], "hash string, data binary")
    entries = spark.createDataFrame([(1, [h("a"), h("b").upper(), None]), (2, [h("c"), h("d"), h("e"), "bad"]), (3, None), (4, [])], "entry_id bigint, chunks array<string>")
    refs = integrity.file_chunks(entries, ["entry_id"])
    states = integrity.chunk_states(refs, store)
    assert {r.hash: r.state for r in states.collect()} == {h("a"): "OK", h("b"): "CORRUPT", h("c"): "CORRUPT", h("d"): "OK", h("e"): "MISSING"}
    whole = hashlib.sha256(bytes.fromhex(h("a"))).hexdigest()
    files_ = spark.createDataFrame([(1, [h("a")], whole), (2, [h("a")], h("no")), (3, [None], h("no")), (4, [h("a")], None), (5, None, h("no"))], "entry_id bigint, chunks array<string>, file_hash string")
    wrong = integrity.hash_mismatches(files_)
    assert [r.entry_id for r in wrong.collect()] == [2]
    assert integrity.report(states, wrong, wrong).first()[:] == (5, 1, 2, 1, 1)
    assert integrity.report(states.limit(0), wrong.limit(0), wrong.limit(0)).first()[:] == (0, 0, 0, 0, 0)
    assert rows(integrity.verbose(refs, states).where("state = 'MISSING'").select("entry_id", "idx")) == [(2, 2)]


def naive_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_diffs_are_shortest_and_apply():
    r = rng(9)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(14))] for _ in range(2))
        assert len(textdiff.common_lines(a, b)) == naive_lcs(a, b)
        diff = textdiff.unified("\n".join(a), "\n".join(b), "o", "n")
        assert textdiff.patch("\n".join(a), diff) == b if diff else a == b


def test_unified():
    lines = [f"line{k}" for k in range(22)]
    assert textdiff.unified("a\r\nb", "a\nb\n", "o", "n") == "" and textdiff.unified("", "", "o", "n") == ""
    new = ["changed", *lines[1:-1], "last"]
    diff = textdiff.unified("\n".join(lines), "\n".join(new), "o", "n")
    assert diff.count("@@ -") == 2 and "-line0\n+changed\n" in diff
    near = lines[:13]
    both = [*near[:3], "x", *near[4:9], "y", *near[10:]]
    assert textdiff.unified("\n".join(near), "\n".join(both), "o", "n").count("@@ -") == 1
    assert textdiff.unified("", "a\nb", "o", "n") == "--- o\n+++ n\n@@ -0,0 +1,2 @@\n+a\n+b\n"
    big = "\n".join(map(str, range(10_001)))
    assert textdiff.unified(big, "x", "o", "n") == "--- o\n+++ n\nfiles differ (too large for detailed diff)\n"
    many = [f"l{k}" for k in range(5000)]
    edited = many[:100] + ["new"] + many[100:3000] + ["other"] + many[3001:]
    assert textdiff.patch("\n".join(many), textdiff.unified("\n".join(many), "\n".join(edited), "o", "n")) == edited


def test_stat(spark):
    df = spark.createDataFrame([(1, "a\nb", "a\nc\nd"), (2, None, "x"), (3, "a", "a\r\n"), (4, "y" * (11 << 20), "x")], "i int, old_text string, new_text string")
    assert {r.i: (r.binary, r.inserted, r.deleted) for r in textdiff.stat(df).select("i", "binary", "inserted", "deleted").collect()} == {1: (False, 2, 1), 2: (False, 1, 0), 3: (False, 0, 0), 4: (True, 0, 0)}
    assert textdiff.stat(df.limit(0)).select(F.count("*")).first()[0] == 0
