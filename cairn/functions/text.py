"""Lines, previews and counters of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|\n|\r"


def lines(text: Column) -> Column:
    """Lines of a text; CRLF, LF and CR end a line, and an empty piece after the last end is no line."""
    pieces = F.split(text, LINE_BREAK)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def newline_count(text: Column) -> Column:
    """Line count as a file listing shows it: the number of line feeds."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def head_lines(text: Column, count: int = 20) -> Column:
    """Preview: the first lines, joined by line feeds."""
    return F.array_join(F.slice(lines(text), 1, count), "\n")


def equal_lines(a: Column, b: Column) -> Column:
    """Whether two texts have the same lines, whatever ends them."""
    return lines(a).eqNullSafe(lines(b))


def diff_counts(diff: Column) -> tuple[Column, Column]:
    """Inserted and deleted lines of a unified diff. The heads `+++` and `---` do not count, and so neither do changed
    lines that begin with `++` or `--`."""
    rows = F.split(diff, "\n")

    def count(sign: str) -> Column:
        return F.size(F.filter(rows, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))

    return count("+"), count("-")


def differ_stub(old_path: Column, new_path: Column) -> Column:
    """What stands for a diff that is too large to make."""
    return F.concat(F.lit("--- "), old_path, F.lit("\n+++ "), new_path, F.lit("\nfiles differ (too large for detailed diff)\n"))


def control_ratio_ok(header: Column) -> Column:
    """Whether at most a tenth of a header's bytes are control bytes other than tab, LF and CR (whole per cent)."""
    pairs = F.regexp_replace(F.hex(header), "(..)", "$1 ")
    control = F.regexp_count(pairs, F.lit(r"\b(?:0[0-8BCEF]|1[0-9A-F]|7F)\b"))
    return F.floor(control * 100 / F.octet_length(header)) <= 10
