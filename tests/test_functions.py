import struct
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import display, engines, gf61, hashes, patterns, text
from cairn.functions.paths import clean_path, extension, nfc

H = "ab" * 32


def values(spark, column, data, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_clean_hash(spark):
    data = [H, H.upper(), " " + H, H + "\n", "a/" + H[1:].replace("b", "B", 1), H[:-1], H + "0", "0" * 64, None, "", "zz" + H[2:], H[:32], "ab/" + H[2:] + " "]
    want = [H, H, H, H, H, None, None, None, None, None, None, None, H]
    data[4] = "ab/" + H[2:].upper()
    assert values(spark, hashes.clean_hash, data) == want
    assert values(spark, lambda c: hashes.bytes_text(hashes.hash_bytes(c)), data) == want


def test_hash_paths(spark):
    assert values(spark, lambda c: hashes.hash_path(c, "chunks/"), [H]) == ["chunks/ab/" + H[2:]]
    assert values(spark, lambda c: hashes.path_hash(c, "chunks/"), ["chunks/ab/" + H[2:], "chunks/ab/xyz", None]) == [H, None, None]


def test_clean_path(spark):
    data = ["a\\b", "./a/b", "a//b", "a/./b", "/a", "a/", "a..b/.c", "..", ".", "", None, "A/b"]
    want = ["a/b", "a/b", "a/b", "a/b", "a", "a", "a..b/.c", "..", "", "", None, "A/b"]
    assert values(spark, clean_path, data) == want


def test_nfc(spark):
    data = ["façade", unicodedata.normalize("NFD", "façade żółć"), "plain", None, ""]
    assert values(spark, nfc, data) == ["façade", "façade żółć", "plain", None, ""]


def test_extension(spark):
    assert values(spark, extension, ["a.TXT", "dir.x/b", ".gitignore", "a.tar.gz", ""]) == [".txt", "", ".gitignore", ".gz", ""]


def test_sizes(spark):
    data = [0, 1023, 1024, 512 * 1024, 1 << 30, -1024, 1280, 1331, -(1 << 63), None]
    want = ["0 B", "1023 B", "1.0 KB", "512.0 KB", "1.0 GB", "-1.0 KB", "1.2 KB", "1.3 KB", "-8589934592.0 GB", None]
    assert values(spark, display.human_bytes, data, "bigint") == want


def test_forms(spark):
    one = spark.range(1)
    assert one.select(display.change_summary(F.lit(2), F.lit(1), F.lit(0))).first()[0] == "+2 ~1"
    assert one.select(display.change_summary(F.lit(0), F.lit(0), F.lit(0))).first()[0] == "+0"
    assert one.select(display.stat_bar(F.lit(15), F.lit(5))).first()[0] == "+++++++---"
    assert one.select(display.stat_bar(F.lit(0), F.lit(0))).first()[0] == ""
    assert one.select(display.duration_text(F.lit(150))).first()[0] == "2 min"
    assert one.select(display.duration_text(F.lit(5400))).first()[0] == "1.5 h"
    assert one.select(display.dimensions_text(F.lit(0), F.lit(0))).first()[0] == ""
    assert one.select(display.truncate(F.lit("x" * 29))).first()[0] == "x" * 27 + "..."
    names = F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))
    assert [one.select(display.packed_names(names, w)).first()[0] for w in (16, 13, 8, 4)] == ["alpha,beta,gamma", "alpha,beta,+1", "alpha,+2", "alp..."]
    assert one.select(display.file_kind(F.lit(0o100644)), display.restored_mode(F.lit(0o777)), display.permission_text(F.lit(0o750))).first()[:] == ("regular", 0o755, "rwxr-x---")


def test_versions():
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.2", "v2.0.0"]
    assert all(display.compare_versions(a, b) == -1 for a, b in zip(order, order[1:]))
    assert display.compare_versions("v1.0", "1.0.0") == 0 and display.newest_version(order) == "v2.0.0"
    with pytest.raises(ValueError):
        display.compare_versions("x", "1.0")


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("*.tmp", ["a.tmp"], ["dir/a.tmp"]),
        ("**/*.psd", ["a.psd", "dir/a.psd", "a/b/c.psd"], ["a.psdx"]),
        ("backup/**", ["backup/x", "backup/x/y"], ["backup"]),
        ("?.txt", ["a.txt"], ["ab.txt", "/.txt"]),
        ("[!a]b", ["cb"], ["ab"]),
        ("[abc", ["[abc"], ["a"]),
        ("/x.c", ["x.c"], ["a/x.c"]),
        ("a.b", ["a.b"], ["axb"]),
        ("[]x]", ["]", "x"], ["a"]),
    ],
)
def test_glob(spark, glob, yes, no):
    assert values(spark, lambda c: patterns.glob_match(c, glob), yes + no) == [True] * len(yes) + [False] * len(no)


def test_ignore(spark):
    rules = patterns.parse_ignore("﻿# a comment\n\n*.tmp\n  **/*.psd  \n/secret.txt\nbuild/\n!keep.tmp\n!build/x.c\n")
    assert [r.pattern for r in rules] == ["*.tmp", "**/*.psd", "/secret.txt", "build/", "!keep.tmp", "!build/x.c"]
    rules += patterns.parse_ignore("*.c\n", "src")
    data = {"a.tmp": True, "d/a.tmp": True, "keep.tmp": False, "secret.txt": True, "d/x.psd": True, "build/x.c": True, "a.c": False, "src/a.c": True, "srcs/a.c": False}
    assert values(spark, lambda c: patterns.is_excluded(c, rules), list(data)) == list(data.values())
    for path, want in data.items():
        above = ["/".join(path.split("/")[:k]) for k in range(1, path.count("/") + 1)]
        assert (patterns.ignored(path, rules) or any(patterns.ignored(x, rules, True) for x in above)) == want


def test_ref_names(spark):
    good = ["HEAD", "heads/main", "tags/v1.0", "com10", "id", "żagiel"]
    bad = ["", "a b", "a\\b", "a:b", "a..b", "-a", "/a", "heads/head", "heads/HEAD", "con", "x/LPT1", "a\tb", "a\x7f", None]
    assert values(spark, patterns.is_ref_name, good + bad) == [True] * len(good) + [False] * len(bad)
    assert values(spark, patterns.ref_type, ["HEAD", "heads/x", "tags/x", "x"]) == ["HEAD", "branch", "tag", "branch"]


def test_version_refs():
    assert patterns.parse_version_ref("HEAD").kind == "head"
    assert patterns.parse_version_ref("dev") == patterns.VersionRef("branch", "dev")
    assert patterns.parse_version_ref("id:ABCD") == patterns.VersionRef("id", "abcd")
    for bad in ("id:abc", "tag:", "what:x"):
        with pytest.raises(ValueError):
            patterns.parse_version_ref(bad)


def test_driver_paths():
    assert patterns.normal_path("a/./b/../c") == "a/c"
    for bad in ("../a", "/a", "C:/a", "a/../../b"):
        with pytest.raises(ValueError):
            patterns.normal_path(bad)
    assert patterns.sanitised_entry("../a") == "a" and patterns.sanitised_entry("../../a") is None and patterns.sanitised_entry("C:\\x\\y") == "x/y"


def test_lines(spark):
    data = ["a\r\nb\nc\rd", "a\n", "", "\n\n", None]
    assert values(spark, text.lines, data) == [["a", "b", "c", "d"], ["a"], [], ["", ""], None]
    assert values(spark, text.newline_count, data) == [2, 1, 0, 2, None]
    assert values(spark, lambda c: text.head_lines(c, 2), data) == ["a\nb", "a", "", "\n", None]
    plus, minus = text.diff_counts(F.col("x"))
    df = spark.createDataFrame([("--- a\n+++ b\n+x\n+++y\n-z\n w",)], "x string")
    assert df.select(plus, minus).first()[:] == (1, 1)


def bmp(size, *rest):
    return (b"BM" + bytes(12) + struct.pack("<I", size) + struct.pack(*rest)).ljust(64, b"\0")


IMAGES = {
    b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480): ("png", 640, 480),
    b"GIF89a" + struct.pack("<HH", 20, 30) + b"\0\0\0": ("gif", 20, 30),
    b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 48, 64) + bytes(8): ("jpeg", 64, 48),
    bmp(40, "<ii", 7, -9): ("bmp", 7, 9),
    bmp(12, "<HH", 5, 6): ("bmp", 5, 6),
    b"II*\0" + struct.pack("<IHHHIIHHII", 8, 2, 0x100, 4, 1, 300, 0x101, 4, 1, 200): ("tiff", 300, 200),
    b"MM\0*" + struct.pack(">IHHHIHHHHIHH", 8, 2, 0x100, 3, 1, 300, 0, 0x101, 3, 1, 200, 0): ("tiff", 300, 200),
    b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + b"\x63\0\0\x31\0\0": ("webp", 100, 50),
}


def test_images(spark):
    df = spark.createDataFrame([(k, *v) for k, v in IMAGES.items()], "data binary, format string, w int, h int")
    got = df.select("format", "w", "h", engines.image_format(engines.header_of(F.col("data"))), engines.image_dimensions("data").alias("d")).collect()
    for r in got:
        assert (r[3], r.d.width, r.d.height) == (r.format, r.w, r.h)
    assert engines.decode_dimensions(b"BM") == (0, 0) and engines.decode_dimensions(None) == (0, 0)


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_videos(spark):
    tkhd = box(b"tkhd", bytes(76) + struct.pack(">II", 640 << 16, 360 << 16))
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"tkhd", bytes(84))) + box(b"trak", tkhd))
    df = spark.createDataFrame([(data, len(data))], "data binary, size bigint")
    assert df.select(engines.video_preview(F.col("data"), F.col("size"))).first()[0] == f"MP4 640x360 {len(data)} B"
    formats = [b"RIFF....AVI ", b"\x1aE\xdf\xa3....webm", b"\x1aE\xdf\xa3....matroska", b"xx"]
    assert values(spark, engines.video_format, formats, "binary") == ["AVI", "WEBM", "MKV", ""]


def test_detection(spark):
    cases = [
        ("main.go", b"", "text"), ("Makefile", None, "text"), (".gitignore", b"x", "text"), ("data.dat", b"hello world\nsome text\n", "text"),
        ("data.dat", b"\0\1\2\0\4", "binary"), ("unknown.xyz", b"", "binary"), ("a.png", b"hello", "image"), ("a.txt", b"\x89PNG\r\n\x1a\n", "image"),
        ("a.bin", b"\xef\xbb\xbfab", "text"), ("x", b"abc", "binary"), ("x", b"BMW parts list", "binary"), ("x", bytes(range(1, 256)), "binary"), ("a.webm", b"", "video"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, path string, data binary, want string")
    assert df.where(engines.detect_engine(F.col("path"), F.col("data")) != F.col("want")).collect() == []


def test_strategy(spark):
    k, m = 1 << 10, 1 << 20
    cases = [("text", 64 * k - 1, None), ("text", 64 * k, 4 * k), ("image", 5, 128 * k), ("video", 5, 512 * k), ("binary", 0, 128 * k), ("binary", 50 * m, 256 * k), ("binary", 200 * m, 512 * k), ("binary", 1024 * m, m)]
    df = spark.createDataFrame(cases, "engine string, size bigint, want bigint")
    assert df.where(~engines.chunk_strategy(F.col("engine"), F.col("size"))["min"].eqNullSafe(F.col("want"))).collect() == []


def test_image_diff(spark):
    png, gif = list(IMAGES)[0], list(IMAGES)[1]
    wide = png[:16] + struct.pack(">II", 800, 480)
    cases = [(png, png, ""), (png, gif, "image format changed: png -> gif"), (png, wide, "image dimensions changed: 640x480 -> 800x480"), (png, png + b"abc", "image file size changed: 24 B -> 27 B"), (png + b"a", png + b"b", "image content changed")]
    df = spark.createDataFrame(cases, "a binary, b binary, want string")
    assert df.where(engines.image_diff(F.col("a"), F.col("b")) != F.col("want")).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, gf61.P - 1), st.integers(0, gf61.P - 1)), min_size=1, max_size=20))
def test_field(pairs):
    import numpy as np

    a, b = (np.array(x, dtype=np.uint64) for x in zip(*pairs))
    assert gf61.mul(a, b).tolist() == [x * y % gf61.P for x, y in pairs]
    assert gf61.sub(a, b).tolist() == [(x - y) % gf61.P for x, y in pairs]
    assert all(x * y % gf61.P == 1 for x, y in zip(a.tolist(), gf61.inverse(a).tolist()) if x)


def test_line_diffs_are_longest_and_hold_for_repeated_lines(monkeypatch):
    """Against the table of all prefixes, with the grid cut into halves and whole; many equal lines are no burden."""
    import random
    import time

    from cairn.operators import textdiff

    def longest(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    r = random.Random(3)
    for grid in (1, 30, 1 << 28):
        monkeypatch.setattr(textdiff, "GRID", grid)
        for _ in range(60):
            a, b = ([r.choice("abc") for _ in range(r.randrange(20))] for _ in range(2))
            pairs = textdiff.common_lines(a, b)
            assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    began = time.perf_counter()
    assert len(textdiff.common_lines(["x", *[""] * 10_000, "y"], ["z", *[""] * 10_000, "w"])) == 10_000
    assert time.perf_counter() - began < 2


def test_limits_of_diffs_can_be_lifted():
    from cairn.operators import textdiff

    old = "\n".join(map(str, range(10_500)))
    assert "too large" in textdiff.unified(old, old + "\nx", "a", "b")
    assert textdiff.unified(old, old + "\nx", "a", "b", None, None).endswith("+x\n")
