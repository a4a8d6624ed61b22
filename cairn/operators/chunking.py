"""Splitting contents into chunks, by size or by content, and putting them together again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import digest, merkle_hash

FIXED_LEAST, FIXED_MOST = 4 << 10, 64 << 20
#: Content-defined sizes where none are given or the given ones are impossible, and their limits.
CDC_DEFAULT = (128 << 10, 256 << 10, 512 << 10)
CDC_FLOOR, CDC_CEILING = 64, 1 << 30


def clamp_fixed(size: int) -> int:
    return min(max(size, FIXED_LEAST), FIXED_MOST)


def fixed_chunks(files: DataFrame, keys: list[str], size: int, content: str = "content") -> DataFrame:
    """keys, idx, size, hash, data: pieces of `size` bytes. An empty content is one empty chunk; a null one has none."""
    count = F.greatest(F.lit(0), F.floor((F.octet_length(content) - 1) / size))
    pieces = files.where(F.col(content).isNotNull()).select(*keys, content, F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long"))).alias("_i"))
    data = F.substring(F.col(content), (F.col("_i") * size + 1).cast("int"), F.lit(size))
    return pieces.select(*keys, F.col("_i").cast("int").alias("idx"), data.alias("data")).select(
        *keys, "idx", F.octet_length("data").cast("long").alias("size"), digest(F.col("data")).alias("hash"), "data"
    )


def clamp_cdc(low: int, mid: int, high: int) -> tuple[int, int, int]:
    """Sizes that a content-defined chunker can use: mid is a power of two strictly between low and high; the default
    triple where none fits."""
    low = max(512 if low < 0 else low, CDC_FLOOR)
    high = min(CDC_DEFAULT[2] if high <= 0 or high < low else high, CDC_CEILING)
    if low >= high:
        low, high = CDC_DEFAULT[0], CDC_DEFAULT[2]
    fits = [1 << k for k in range(CDC_CEILING.bit_length()) if low < 1 << k < high]
    if not fits:
        return CDC_DEFAULT
    return (low, mid if mid in fits else min(fits, key=lambda p: (abs(p - (low + high) // 2), p)), high)


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """256 fixed pseudo-random words, from the splitmix64 sequence that starts at 1."""
    out, state, mask = [], 1, (1 << 64) - 1
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        out.append(z ^ z >> 31)
    return np.array(out, dtype=np.uint64)


def rolling(data: bytes) -> np.ndarray:
    """Gear hash at every byte, over the 64 bytes up to it: six doublings instead of a loop over bytes."""
    h = gear()[np.frombuffer(data, dtype=np.uint8)]
    for k in range(6):
        width = 1 << k
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
    return h


def cut_points(data: bytes, low: int, mid: int, high: int) -> list[int]:
    """Ends of content-defined chunks (normalised chunking: a strict mask before mid, a loose one after it). The last end
    is the length; empty data has none."""
    if len(data) <= low:
        return [len(data)] if data else []
    bits = mid.bit_length() - 1
    h = rolling(data)
    strict, loose = (np.flatnonzero(h >> np.uint64(64 - b) == 0) + 1 for b in (bits + 1, bits - 1))
    ends, start = [], 0
    while len(data) - start > low:
        end = min(start + high, len(data))
        for marks, first, last in ((strict, start + low, min(start + mid, end)), (loose, min(start + mid, end), end)):
            k = int(np.searchsorted(marks, first))
            if k < len(marks) and marks[k] < last:
                end = int(marks[k])
                break
        ends.append(end)
        start = end
    if start < len(data):
        ends.append(len(data))
    return ends


def cdc_chunks(files: DataFrame, key: str, content: str = "content", sizes: tuple[int, int, int] = CDC_DEFAULT) -> DataFrame:
    """key, idx, offset, size, hash: content-defined chunks by Arrow batches, a narrow map. An empty content is one empty
    chunk; a null one has none."""
    sizes = clamp_cdc(*sizes)
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, str]] = []
            for i, data in enumerate(batch.column(1).to_pylist()):
                if data is not None:
                    start = 0
                    for idx, end in enumerate(cut_points(data, *sizes) or [0]):
                        rows.append((i, idx, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                        start = end
            at, *rest = zip(*rows) if rows else [()] * 5
            columns = [pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, "idx", "offset", "size", "hash"])

    return files.select(key, F.col(content).cast("binary").alias("_content")).mapInArrow(run, f"{key} {kind}, idx int, offset long, size long, hash string")


def with_file_hash(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunks (hashes in order), file_hash (digest of the joined digests), size: one row a file. The list of a file
    is bounded by the file; files spread over all tasks."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", "hash")))
    rows = chunks.groupBy(*keys).agg(F.transform(ordered, lambda x: x["hash"]).alias("chunks"), F.sum("size").alias("size"))
    return rows.select(*keys, "chunks", merkle_hash(F.col("chunks")).alias("file_hash"), "size")


def reassemble(listed: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content: chunks (keys, idx, hash) joined with store (hash, data) and put together in order. content is null
    if any chunk is missing, has no data, or data of another digest than its hash."""
    rows = listed.join(sound(store).select("hash", "data"), "hash", "left")
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "data"))).alias("_parts"), F.bool_and(F.col("data").isNotNull()).alias("_whole"))
    joined = F.unhex(F.array_join(F.transform("_parts", lambda x: F.hex(x["data"])), ""))  # one pass over the bytes
    return grouped.select(*keys, F.when(F.col("_whole"), joined).alias("content"))


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct_chunks, bytes, distinct_bytes, of chunks (hash, size)."""
    each = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return each.agg(
        F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("distinct_bytes")
    )


def sound(chunks: DataFrame) -> DataFrame:
    """Chunks (hash, data) whose data has the digest that names it."""
    return chunks.where(digest(F.col("data")) == F.col("hash"))


def new_chunks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks to append: one row a hash, without those that are stored. Putting a chunk twice changes nothing. Rows with
    data of another digest are left out."""
    rows = sound(incoming) if "data" in incoming.columns else incoming
    return rows.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def ingest(files: DataFrame, key: str, sizes: dict[str, tuple[int, int, int]] | None = None, engine: Column | None = None) -> DataFrame:
    """key, idx, offset, size, hash: content-defined chunks of files with the sizes of their type, in one narrow pass; files
    of types without sizes are one chunk. A null content has none."""
    known = {name: clamp_cdc(*triple) for name, triple in (sizes or {"binary": CDC_DEFAULT}).items()}
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, str]] = []
            for i, (name, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if data is not None:
                    start = 0
                    for idx, end in enumerate((cut_points(data, *known[name]) if name in known else [len(data)]) or [0]):
                        rows.append((i, idx, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                        start = end
            at, *rest = zip(*rows) if rows else [()] * 5
            columns = [pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, "idx", "offset", "size", "hash"])

    rows = files.select(key, (engine if engine is not None else F.lit("binary")).alias("_engine"), F.col("content").cast("binary").alias("_content"))
    return rows.mapInArrow(run, f"{key} {kind}, idx int, offset long, size long, hash string")
