"""Integrity of stored content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import clean_hash, digest, merkle_hash


def file_chunks(file_entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, hash: the chunks of each file in order; null and unusable hashes are left out and keep their places."""
    rows = file_entries.select(*keys, F.posexplode("chunks").alias("idx", "_chunk"))
    return rows.select(*keys, "idx", clean_hash(F.col("_chunk")).alias("hash")).where("hash is not null")


def chunk_states(referenced: DataFrame, store: DataFrame) -> DataFrame:
    """(hash, state) of distinct referenced hashes: OK, MISSING, or CORRUPT where the stored data has another digest.

    store: (hash, data). Of several rows of a hash one good row is enough; a row without data is corrupt."""
    have = store.select(clean_hash(F.col("hash")).alias("hash"), F.coalesce(digest(F.col("data")) == clean_hash(F.col("hash")), F.lit(False)).alias("_good"))
    have = have.where("hash is not null").groupBy("hash").agg(F.max("_good").alias("_good"))
    rows = referenced.select("hash").distinct().join(have, "hash", "left")
    return rows.select("hash", F.when(F.col("_good").isNull(), "MISSING").when(F.col("_good"), "OK").otherwise("CORRUPT").alias("state"))


def report(states: DataFrame, mismatches: DataFrame, corrupt_snapshots: DataFrame) -> DataFrame:
    """One row: total_blocks, missing, corrupt, file_hash_mismatch, snapshot_corrupt."""
    names = ["total_blocks", "missing", "corrupt", "file_hash_mismatch", "snapshot_corrupt"]
    a = states.agg(*(F.count_if(F.col("state") == s).alias(s.lower()) for s in ("MISSING", "CORRUPT")), F.count("*").alias("total_blocks"))
    rows = a.select(F.expr("stack(3, 'total_blocks', total_blocks, 'missing', missing, 'corrupt', corrupt) as (what, n)"))
    for name, found in (("file_hash_mismatch", mismatches), ("snapshot_corrupt", corrupt_snapshots)):
        rows = rows.unionByName(found.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n"))
    return rows.agg(*(F.max(F.when(F.col("what") == x, F.col("n"))).alias(x) for x in names))


def wrong_totals(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """snapshots (snapshot, total_size, file_count) whose stated totals are not those of their list, entries (snapshot,
    path, size), with real_size and real_count."""
    real = entries.groupBy("snapshot").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("real_size"), F.count("*").alias("real_count"))
    both = snapshots.join(real, "snapshot", "left").fillna(0, ["real_size", "real_count"])
    return both.where(~(F.col("total_size").eqNullSafe(F.col("real_size")) & F.col("file_count").eqNullSafe(F.col("real_count"))))


def verbose(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Every reference to a chunk with the chunk's state."""
    return refs.join(states, "hash")


def hash_mismatches(file_entries: DataFrame) -> DataFrame:
    """Entries whose file hash is not the digest of their chunk hashes; entries with an unusable hash anywhere are not
    judged."""
    chunks = F.transform("chunks", clean_hash)
    whole = F.forall(chunks, lambda x: x.isNotNull()) & clean_hash(F.col("file_hash")).isNotNull()
    return file_entries.where(whole).where(merkle_hash(chunks) != clean_hash(F.col("file_hash")))
