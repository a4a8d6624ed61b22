"""File types: detection, chunk sizes, previews, metadata, dimensions and non-text diffs."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.display import dimensions_text, human_bytes
from cairn.functions.paths import base_name, extension
from cairn.functions.text import control_ratio_ok, head_lines

#: Bytes of a file that detection looks at.
HEADER_BYTES = 512
#: Extensions and base names by type.
TEXT_EXTENSIONS = (
    ".txt .md .go .rs .js .ts .py .java .c .cpp .h .hpp .html .css .json .xml .yaml .yml .toml .ini .cfg .conf .sh .bat .ps1 .rb .php "
    ".swift .kt .scala .r .sql .csv .log .svg .tex"
).split()
TEXT_NAMES = "Makefile Dockerfile LICENSE README .gitignore .gitattributes .editorconfig .env .dockerignore".split()
IMAGE_EXTENSIONS = ".png .jpg .jpeg .gif .webp .bmp .tiff .tif".split()
VIDEO_EXTENSIONS = ".mp4 .mov .avi .mkv .webm".split()
#: Magic bytes as hex digits.
BOMS = r"\A(?:EFBBBF|FFFE|FEFF|0000FEFF)"
IMAGE_MAGIC = {
    "png": r"\A89504E470D0A1A0A",
    "jpeg": r"\AFFD8FF",
    "gif": r"\A47494638",
    "webp": r"\A52494646.{8}57454250",
    "bmp": r"\A424D.{24}(?:0C|28|34|38|40|6C|7C)000000.{72}",
    "tiff": r"\A(?:49492A00|4D4D002A)",
}
VIDEO_MAGIC = {
    "MP4": r"\A.{8}66747970",
    "AVI": r"\A52494646.{8}41564920",
    "WEBM": r"\A1A45DFA3(?:..){0,56}7765626D",
    "MKV": r"\A1A45DFA3",
}
#: Starts that no text has, wider than the formats above.
NOT_TEXT = r"\A(?:89504E47|FFD8FF|47494638|52494646|424D|49492A00|4D4D002A|1A45DFA3|.{8}66747970)"


def header_of(content: Column) -> Column:
    return F.substring(content, 1, HEADER_BYTES)


def _first(table: dict[str, str], header: Column, none: str = "") -> Column:
    digits, out = F.hex(header), F.lit(none)
    for name, pattern in reversed(table.items()):
        out = F.when(digits.rlike(pattern), name).otherwise(out)
    return F.when(header.isNotNull(), out)


def image_format(header: Column) -> Column:
    """png, jpeg, gif, webp, bmp, tiff or empty."""
    return _first(IMAGE_MAGIC, header)


def video_format(header: Column) -> Column:
    """MP4, AVI, WEBM, MKV or empty."""
    return _first(VIDEO_MAGIC, header)


def looks_like_text(header: Column) -> Column:
    """At least 4 bytes, no known binary start, no NUL, few control bytes."""
    digits = F.hex(header)
    nul = F.regexp_replace(digits, "(..)", "$1 ").rlike(r"\b00\b")
    return (F.octet_length(header) >= 4) & ~digits.rlike(NOT_TEXT) & ~nul & control_ratio_ok(header)


def detect_engine(path: Column, header: Column) -> Column:
    """text, image, video or binary: by magic bytes, then by name, then by the look of the header."""
    ext, head = extension(path), F.coalesce(header, F.lit(b"").cast("binary"))
    return (
        F.when(F.hex(head).rlike(BOMS), "text")
        .when(image_format(head) != "", "image")
        .when(video_format(head) != "", "video")
        .when(ext.isin(TEXT_EXTENSIONS) | base_name(path).isin(TEXT_NAMES), "text")
        .when(ext.isin(IMAGE_EXTENSIONS), "image")
        .when(ext.isin(VIDEO_EXTENSIONS), "video")
        .when(looks_like_text(head), "text")
        .otherwise("binary")
    )


def mime_of(engine: Column) -> Column:
    return F.when(engine == "text", "text/plain").otherwise("application/octet-stream")


#: The (min, avg, max) of content-defined chunks by type and size of the file, all in bytes.
_K, _M = 1 << 10, 1 << 20
CHUNK_SIZES = [(4 * _K, 8 * _K, 16 * _K), (128 * _K, 256 * _K, 512 * _K), (256 * _K, 512 * _K, _M), (512 * _K, _M, 2 * _M), (512 * _K, _M, 4 * _M), (_M, 2 * _M, 4 * _M)]


def chunk_strategy(engine: Column, size: Column) -> Column:
    """Struct (min, avg, max) of content-defined chunk sizes; all null where the file is one chunk (text below 64 KiB)."""
    k, m = 1 << 10, 1 << 20

    def sizes(low: int, mid: int, high: int) -> Column:
        return F.struct(F.lit(low).cast("long").alias("min"), F.lit(mid).cast("long").alias("avg"), F.lit(high).cast("long").alias("max"))

    none = F.struct(*(F.lit(None).cast("long").alias(x) for x in ("min", "avg", "max")))
    return (
        F.when((engine == "text") & (size < 64 * k), none)
        .when(engine == "text", sizes(4 * k, 8 * k, 16 * k))
        .when(engine == "video", sizes(512 * k, m, 4 * m))
        .when((engine == "image") | (size < 50 * m), sizes(128 * k, 256 * k, 512 * k))
        .when(size < 200 * m, sizes(256 * k, 512 * k, m))
        .when(size < 1024 * m, sizes(512 * k, m, 2 * m))
        .otherwise(sizes(m, 2 * m, 4 * m))
    )


def _u(data: bytes, at: int, size: int, order: str = "little") -> int:
    return int.from_bytes(data[at : at + size], order)


def _jpeg(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return 0, 0
        kind = data[at + 1]
        if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return _u(data, at + 7, 2, "big"), _u(data, at + 5, 2, "big")
        else:
            at += 2 + _u(data, at + 2, 2, "big")
    return 0, 0


def _webp(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8 " and len(data) >= 30:
        return (_u(data, 26, 2) & 0x3FFF) + 1, (_u(data, 28, 2) & 0x3FFF) + 1
    if kind == b"VP8L" and len(data) >= 25:
        bits = _u(data, 21, 4)
        return (bits >> 2 & 0x3FFF) + 1, (bits >> 16 & 0x3FFF) + 1
    if kind == b"VP8X" and len(data) >= 30:
        return _u(data, 24, 3) + 1, _u(data, 27, 3) + 1
    return 0, 0


def _bmp(data: bytes) -> tuple[int, int]:
    if _u(data, 14, 4) == 12:
        return _u(data, 18, 2), _u(data, 20, 2)
    width, height = struct.unpack_from("<ii", data, 18)
    return width, abs(height)


def _tiff(data: bytes) -> tuple[int, int]:
    order = "little" if data[:2] == b"II" else "big"
    at = _u(data, 4, 4, order)
    count = _u(data, at, 2, order)
    if len(data) < 8 or at + 2 + 12 * count > len(data):
        return 0, 0
    found = {}
    for k in range(count):
        entry = at + 2 + 12 * k
        width = {3: 2, 4: 4}.get(_u(data, entry + 2, 2, order), 0)
        found[_u(data, entry, 2, order)] = _u(data, entry + 8, width, order)
    return found.get(0x100, 0), found.get(0x101, 0)


def decode_dimensions(data: bytes | None) -> tuple[int, int]:
    """Width and height of an image from its first bytes, (0, 0) if unknown."""
    data = data or b""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
            return _u(data, 16, 4, "big"), _u(data, 20, 4, "big")
        if data[:3] == b"\xff\xd8\xff":
            return _jpeg(data)
        if data[:4] == b"GIF8" and len(data) >= 10:
            return _u(data, 6, 2), _u(data, 8, 2)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:2] == b"BM" and len(data) >= 54 and _u(data, 14, 4) in (12, 40, 52, 56, 64, 108, 124):
            return _bmp(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
    except (IndexError, struct.error):
        pass
    return 0, 0


def _boxes(data: bytes, start: int, end: int):
    """(kind, first, last) of the boxes in a range of an MP4 file."""
    while start + 8 <= end:
        size, head = _u(data, start, 4, "big"), 8
        if size == 1:
            size, head = _u(data, start + 8, 8, "big"), 16
        elif size == 0:
            size = end - start
        if size < head:
            return
        yield data[start + 4 : start + 8], start + head, min(start + size, end)
        start += size


def decode_mp4_dimensions(data: bytes | None) -> tuple[int, int]:
    """Width and height of the first track that has any: moov > trak > tkhd, 16.16 fixed point at its end."""
    data = data or b""
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind == b"moov":
            for track, c, d in _boxes(data, a, b):
                if track == b"trak":
                    for box, e, f in _boxes(data, c, d):
                        if box == b"tkhd" and f - e >= 84:
                            shift = 12 if data[e] == 1 else 0
                            size = _u(data, e + 76 + shift, 4, "big") >> 16, _u(data, e + 80 + shift, 4, "big") >> 16
                            if size != (0, 0):
                                return size
    return 0, 0


_SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


@F.pandas_udf(_SIZE)
def image_dimensions(content: pd.Series) -> pd.DataFrame:
    """Struct (width, height) by Arrow batches; 0 and 0 if unknown or null."""
    return pd.DataFrame([decode_dimensions(x) for x in content], columns=["width", "height"])


@F.pandas_udf(_SIZE)
def video_dimensions(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_mp4_dimensions(x) for x in content], columns=["width", "height"])


def text_preview(text: Column, count: int = 20) -> Column:
    return head_lines(text, count)


def image_preview(content: Column) -> Column:
    """`PNG 10x20 1.5 KB`; `image 0x0 ...` for an unknown format."""
    name, size = image_format(header_of(content)), image_dimensions(content)
    label = F.create_map(*(F.lit(x) for pair in (("png", "PNG"), ("jpeg", "JPEG"), ("gif", "GIF"), ("webp", "WebP"), ("bmp", "BMP"), ("tiff", "TIFF")) for x in pair))
    wide = F.concat(size["width"].cast("string"), F.lit("x"), size["height"].cast("string"))
    return F.concat_ws(" ", F.coalesce(F.element_at(label, name), F.lit("image")), wide, human_bytes(F.octet_length(content).cast("long")))


def video_preview(content: Column, size: Column, most: int = 100 << 20) -> Column:
    """`MP4 640x480 1.5 MB`; without dimensions above 100 MB, for other containers and where they are unknown."""
    name, dims = video_format(header_of(content)), video_dimensions(content)
    wide = F.when((size <= most) & (name == "MP4") & (dims["width"] > 0) & (dims["height"] > 0), dimensions_text(dims["width"], dims["height"]))
    return F.concat_ws(" ", F.when(name == "", "VIDEO").otherwise(name), wide, human_bytes(size))


BINARY_PREVIEW = "[binary file]"


def binary_diff(old: Column, new: Column) -> Column:
    """Empty for equal contents, else a fixed sentence."""
    return F.when(old.eqNullSafe(new), "").otherwise("binary files differ")


def video_diff(old_size: Column, new_size: Column) -> Column:
    """Only sizes are compared."""
    changed = F.concat(F.lit("video file size changed: "), human_bytes(old_size), F.lit(" -> "), human_bytes(new_size))
    return F.when(old_size == new_size, "").otherwise(changed)


def image_diff(old: Column, new: Column) -> Column:
    """The first of format, dimensions, size and content in which two images differ; empty if they are equal."""
    a, b = (F.coalesce(F.nullif(image_format(header_of(x)), F.lit("")), F.lit("unknown")) for x in (old, new))
    p, q = (image_dimensions(x) for x in (old, new))
    m, n = (F.octet_length(x).cast("long") for x in (old, new))
    wide = [F.concat(x["width"].cast("string"), F.lit("x"), x["height"].cast("string")) for x in (p, q)]

    def said(what: str, before: Column, after: Column) -> Column:
        return F.concat(F.lit(f"image {what} changed: "), before, F.lit(" -> "), after)

    return (
        F.when(old == new, "")
        .when(a != b, said("format", a, b))
        .when(wide[0] != wide[1], said("dimensions", *wide))
        .when(m != n, said("file size", human_bytes(m), human_bytes(n)))
        .otherwise("image content changed")
    )
