"""Stored form of a chunk outside Parquet: one byte that says whether zstd follows, then the data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN, ZSTD = b"\x00", b"\x01"
#: Bytes a payload may unpack to; more is taken for an attack.
MOST = 64 << 20


def pack(data: bytes, level: int = 3) -> bytes:
    """Compressed only where that is smaller."""
    import zstandard

    small = zstandard.ZstdCompressor(level=level).compress(data)
    return ZSTD + small if len(small) < len(data) else PLAIN + data


def unpack(payload: bytes, most: int = MOST) -> bytes:
    """The data; ValueError for an unknown head, a broken payload or one that is too large."""
    import zstandard

    head, body = payload[:1], payload[1:]
    if head == PLAIN:
        return body
    if head != ZSTD:
        raise ValueError("unknown payload")
    try:
        with zstandard.ZstdDecompressor().stream_reader(body) as reader:
            data = reader.read(most + 1)
    except zstandard.ZstdError as e:
        raise ValueError(str(e)) from e
    if len(data) > most:
        raise ValueError("payload too large")
    return data


@F.pandas_udf(T.BinaryType())
def encode_payload(data: pd.Series) -> pd.Series:
    """pack by Arrow batches; null stays null."""
    return data.map(lambda x: None if x is None else pack(bytes(x)))


@F.pandas_udf(T.BinaryType())
def decode_payload(payload: pd.Series) -> pd.Series:
    """unpack by Arrow batches; null where the payload is null or can't be unpacked."""

    def one(x: bytes | None) -> bytes | None:
        try:
            return None if x is None else unpack(bytes(x))
        except ValueError:
            return None

    return payload.map(one)
