"""Paths and names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function; only texts beyond ASCII travel to Python, the others go as null."""
    beyond = text.rlike(r"[^\x00-\x7f]")
    return F.when(beyond, _nfc(F.when(beyond, text))).otherwise(text)


def clean_path(path: Column) -> Column:
    """Backslash as slash, without empty and `.` segments, case kept. Unicode is left as it is (see nfc)."""
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda x: (x != "") & (x != "."))
    odd = slashed.rlike(r"(\A|/)\.?(/|\z)")
    return F.when(odd, F.array_join(parts, "/")).otherwise(slashed)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a dotfile is its own extension; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)
