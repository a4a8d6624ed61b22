"""Line diffs: longest common subsequence, unified hunks, statistics."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import diff_counts

CONTEXT = 3
#: Lines on a side, and characters in a line, beyond which no detailed diff is made; bytes beyond which a stat counts no lines.
MOST_LINES, MOST_LINE, MOST_STAT_BYTES = 10_000, 1 << 20, 10 << 20
#: Bits of the grid of two texts that are held at once.
GRID = 1 << 28
_BREAK = re.compile(r"\r\n|\n|\r")


def split_lines(text: str) -> list[str]:
    rows = _BREAK.split(text)
    return rows[:-1] if rows[-1] == "" else rows


def _grid(old: list[str], new: list[str]) -> list[int]:
    """Row by row of old the bits of new: a zero bit is where the longest common subsequence of the rows so far and the
    lines up to there grows by one. One row is a few operations on whole numbers (Hyyro)."""
    marks: dict[str, int] = defaultdict(int)
    for j, line in enumerate(new):
        marks[line] |= 1 << j
    full, v, out = (1 << len(new)) - 1, (1 << len(new)) - 1, []
    for line in old:
        u = v & marks.get(line, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _zeros(v: int, n: int) -> np.ndarray:
    """Numbers of zero bits among the first 0, 1, ... n."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. Where the grid would take more than GRID bits, old is cut in half and
    new where the two halves have most in common (Hirschberg), so the space is bounded at any length."""
    if not old or not new:
        return []
    if len(old) * len(new) > GRID and len(old) > 1:
        half = len(old) // 2
        head = _zeros(_grid(old[:half], new)[-1], len(new))
        tail = _zeros(_grid(old[half:][::-1], new[::-1])[-1], len(new))[::-1]
        at = int((head + tail).argmax())
        return _align(old[:half], new[:at]) + [(i + half, j + at) for i, j in _align(old[half:], new[at:])]
    rows, out, i, j = _grid(old, new), [], len(old), len(new)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def common_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; equal heads and tails are taken as they are."""
    low = 0
    while low < min(len(old), len(new)) and old[low] == new[low]:
        low += 1
    high = 0
    while high < min(len(old), len(new)) - low and old[-1 - high] == new[-1 - high]:
        high += 1
    middle = [(i + low, j + low) for i, j in _align(old[low : len(old) - high], new[low : len(new) - high])]
    head = [(k, k) for k in range(low)]
    tail = [(len(old) - k, len(new) - k) for k in range(high, 0, -1)]
    return head + middle + tail


def edit_script(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(sign, line): ' ' kept, '-' deleted, '+' inserted; deletions before insertions between kept lines."""
    script: list[tuple[str, str]] = []
    i = j = 0
    for a, b in [*common_lines(old, new), (len(old), len(new))]:
        script += [("-", x) for x in old[i:a]] + [("+", x) for x in new[j:b]]
        if a < len(old):
            script.append((" ", old[a]))
        i, j = a + 1, b + 1
    return script


def hunks(script: list[tuple[str, str]], context: int = CONTEXT) -> list[tuple[int, int]]:
    """Ranges of the script: changes with their context; changes whose contexts touch are one range."""
    out: list[tuple[int, int]] = []
    for k, (sign, _) in enumerate(script):
        if sign != " ":
            a, b = max(0, k - context), min(len(script), k + context + 1)
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], b
            else:
                out.append((a, b))
    return out


def unified(old: str, new: str, old_path: str, new_path: str, most_lines: int | None = MOST_LINES, most_line: int | None = MOST_LINE) -> str:
    """Unified diff of two texts, empty if their lines are equal, a stub if they are larger than the limits given; without
    limits (None) the diff of any texts."""
    a, b = split_lines(old), split_lines(new)
    if a == b:
        return ""
    head = f"--- {old_path}\n+++ {new_path}\n"
    if (most_lines is not None and max(len(a), len(b)) > most_lines) or (most_line is not None and any(len(x) > most_line for x in (*a, *b))):
        return head + "files differ (too large for detailed diff)\n"
    script = edit_script(a, b)
    out, old_no, new_no, done = [head], 1, 1, 0
    for first, last in hunks(script):
        kept = script[done:first]
        old_no += sum(s != "+" for s, _ in kept)
        new_no += sum(s != "-" for s, _ in kept)
        inside = script[first:last]
        m, n = sum(s != "+" for s, _ in inside), sum(s != "-" for s, _ in inside)
        out.append(f"@@ -{0 if not first and not m else old_no},{m} +{0 if not first and not n else new_no},{n} @@\n")
        out += [f"{s}{line}\n" for s, line in inside]
        old_no, new_no, done = old_no + m, new_no + n, last
    return "".join(out)


def patch(old: str, diff: str) -> list[str]:
    """Lines of the new text: the inverse of unified."""
    a, out, at = split_lines(old), [], 0
    for row in diff.split("\n")[2:]:
        head = re.match(r"@@ -(\d+),(\d+) ", row)
        if head:
            start = max(0, int(head[1]) - 1)
            out += a[at:start]
            at = start
        elif row[:1] == "+":
            out.append(row[1:])
        elif row[:1] == " ":
            out.append(row[1:])
            at += 1
        elif row[:1] == "-":
            at += 1
    return out + a[at:]


def unified_diff(old: Column, new: Column, old_path: Column, new_path: Column, most_lines: int | None = MOST_LINES, most_line: int | None = MOST_LINE) -> Column:
    """Unified diff by Arrow batches; a null text counts as empty. The limits are those of `unified`."""

    @F.pandas_udf(T.StringType())
    def run(old: pd.Series, new: pd.Series, old_path: pd.Series, new_path: pd.Series) -> pd.Series:
        return pd.Series([unified(a or "", b or "", p or "", q or "", most_lines, most_line) for a, b, p, q in zip(old, new, old_path, new_path)])

    return run(old, new, old_path, new_path)


@F.pandas_udf(T.ArrayType(T.StringType()))
def patched(old: pd.Series, diff: pd.Series) -> pd.Series:
    """Lines of the new text: an old text with its unified diff applied; an empty diff changes nothing."""
    return pd.Series([patch(a or "", d) if d else split_lines(a or "") for a, d in zip(old, diff)])


def stat(changed: DataFrame, old: str = "old_text", new: str = "new_text", most_bytes: int | None = MOST_STAT_BYTES) -> DataFrame:
    """changed rows with binary, inserted and deleted: line counts of text pairs; pairs with a side above most_bytes are
    binary and have none; with None all are counted. The diff is made for the rows given only: filter equal hashes before."""
    big = F.greatest(F.octet_length(old), F.octet_length(new)) > most_bytes if most_bytes is not None else F.lit(False)
    diff: Column = unified_diff(F.when(big, None).otherwise(F.col(old)), F.when(big, None).otherwise(F.col(new)), F.lit("a"), F.lit("b"))
    rows = changed.withColumn("_diff", diff)
    inserted, deleted = diff_counts(F.col("_diff"))
    big = F.coalesce(big, F.lit(False))
    return rows.withColumns({"binary": big, "inserted": F.when(big, 0).otherwise(inserted), "deleted": F.when(big, 0).otherwise(deleted)}).drop("_diff")
