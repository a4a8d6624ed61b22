"""Forms in which sizes, times, changes and names are shown."""

from __future__ import annotations

import re
from functools import cmp_to_key

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


def human_bytes(size: Column) -> Column:
    """`12 B`, `2.5 KB`, `1.0 MB`, `-3.0 GB`: units of 1024, one decimal from KB on."""
    magnitude = F.abs(size.cast("decimal(20,0)"))

    def units(size: int, name: str) -> Column:  # a tie goes to the even digit, which the formatter alone would not do
        return F.format_string(f"%.1f {name}", F.bround(magnitude.cast("double") / size, 1))

    text = F.when(magnitude < KB, F.concat(magnitude.cast("string"), F.lit(" B"))).when(magnitude < MB, units(KB, "KB")).when(magnitude < GB, units(MB, "MB"))
    text = text.otherwise(units(GB, "GB"))
    return F.when(size < 0, F.concat(F.lit("-"), text)).when(size >= 0, text)


def stat_bar(inserted: Column, deleted: Column, width: int = 10) -> Column:
    """Plus and minus signs in proportion, at most width of them; the share of pluses is rounded down."""
    total = inserted + deleted
    bars = F.least(total, F.lit(width))
    plus = F.when(total > 0, F.floor(bars * inserted / total)).otherwise(0)
    return F.concat(F.repeat(F.lit("+"), plus.cast("int")), F.repeat(F.lit("-"), (bars - plus).cast("int")))


def change_summary(added: Column, modified: Column, deleted: Column) -> Column:
    """`+A ~M -D` without zeros; `+0` if nothing changed."""
    parts = [F.when(n > 0, F.concat(F.lit(sign), n.cast("string"))) for sign, n in (("+", added), ("~", modified), ("-", deleted))]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit("+0"))


def truncate(text: Column, width: int = 28) -> Column:
    """Characters beyond width give way to three dots; one shorter than width in all is kept whole."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("..."))).otherwise(text)


def packed_names(names: Column, width: int) -> Column:
    """Names joined by commas as far as they fit into width, then `,+N` for the rest. If not even one fits so, the joined
    names are cut and end in three dots."""
    total, joined = F.size(names), F.array_join(names, ",")

    def shown(k: Column) -> Column:
        return F.concat(F.array_join(F.slice(names, F.lit(1), k), ","), F.lit(",+"), (total - k).cast("string"))

    forms = F.when(total > 1, F.transform(F.sequence(total - 1, F.lit(1), F.lit(-1)), shown)).otherwise(F.array().cast("array<string>"))
    fitting = F.try_element_at(F.filter(forms, lambda x: F.length(x) <= width), F.lit(1))
    cut = F.concat(F.left(joined, F.lit(width - 1)), F.lit("..."))
    return F.when(F.length(joined) <= width, joined).otherwise(F.coalesce(fitting, cut))


def minute_text(seconds: Column) -> Column:
    """Local time of epoch seconds as `2006-01-02 15:04`, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def duration_text(seconds: Column) -> Column:
    """`N min` below an hour, else hours with one decimal."""
    hours = F.format_string("%.1f h", F.bround(seconds / 3600.0, 1))
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min"))).when(seconds >= 3600, hours)


def dimensions_text(width: Column, height: Column) -> Column:
    """`WxH`, empty where both are 0 or unknown."""
    known = (F.coalesce(width, F.lit(0)) != 0) | (F.coalesce(height, F.lit(0)) != 0)
    return F.when(known, F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise("")


def file_kind(mode: Column) -> Column:
    """Kind of a POSIX mode by its type bits."""
    kinds = {0o100000: "regular", 0o040000: "dir", 0o120000: "symlink", 0o060000: "device", 0o010000: "named-pipe", 0o140000: "socket"}
    bits = mode.bitwiseAND(F.lit(0o170000))
    out = F.lit("unknown")
    for value, name in kinds.items():
        out = F.when(bits == value, name).otherwise(out)
    return F.when(mode.isNotNull(), out)


def restored_mode(mode: Column, default: int = 0o644) -> Column:
    """Permission bits a restored file gets: without write for group and others; the default for 0."""
    bits = mode.bitwiseAND(F.lit(0o777)).bitwiseAND(F.lit(0o777 & ~0o022))
    return F.when(mode.bitwiseAND(F.lit(0o777)) == 0, default).otherwise(bits)


def permission_text(mode: Column) -> Column:
    """`rwxr-xr-x` of the permission bits."""
    flags = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(*flags)


_VERSION = re.compile(r"v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\Z")


def parse_version(text: str) -> tuple[tuple[int, int, int], tuple[str, ...]] | None:
    """Numbers and pre-release parts of a semantic version, None if it is none."""
    found = _VERSION.match(text.strip())
    if not found:
        return None
    return tuple(int(x or 0) for x in found.groups()[:3]), tuple(found[4].split(".")) if found[4] else ()


def compare_versions(a: str, b: str) -> int:
    """-1, 0 or 1; a pre-release is before its release, numeric parts before others. ValueError for no version."""
    x, y = parse_version(a), parse_version(b)
    if x is None or y is None:
        raise ValueError(f"no semantic version: {a if x is None else b}")

    def key(v: tuple[tuple[int, int, int], tuple[str, ...]]) -> tuple:
        return v[0], not v[1], [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in v[1]]

    return (key(x) > key(y)) - (key(x) < key(y))


def newest_version(versions: list[str]) -> str:
    return max(versions, key=cmp_to_key(compare_versions))
