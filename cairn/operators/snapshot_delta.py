"""What changed between full snapshots.

Full outer join of two file lists on (snapshot, path), comparing canonical row hashes: a missing side gives an addition
or a removal, unequal hashes give a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import bytes_text, clean_hash, hash_bytes
from cairn.functions.paths import clean_path, nfc


def row_hash(*values: Column) -> Column:
    """Canonical 128-bit hash of values: nulls have a form of their own, so null differs from any value."""
    texts = [F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("~")) for v in values]
    return F.unhex(F.md5(F.concat_ws("\x1f", *texts)))


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """(snapshot, previous) as 32-byte keys, once for each snapshot whose previous one is among snapshots.

    Deleted snapshots count. A null, unusable or unknown prev_id gives no pair; a snapshot that names itself is kept."""
    rows = snapshots.select(hash_bytes(F.col("snapshot_id")).alias("snapshot"), hash_bytes(F.col("prev_id")).alias("previous"))
    known = rows.select(F.col("snapshot").alias("previous")).where("previous is not null").distinct()
    return rows.where("snapshot is not null and previous is not null").distinct().join(known, "previous", "left_semi")


def delta(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paths added, removed and changed of each pair: (snapshot, path, change).

    entries: (snapshot, path, version, row_hash). Of several rows of a path the one of the highest version counts; equal
    rows are one. pairs: (snapshot, previous). An empty list on either side gives only removals or only additions.

    Each entry is sent once by its snapshot to meet the pairs it takes part in, as new or as old side, and once by
    (snapshot of the pair, path), where both the choice of the version and the outer join happen. The map side
    combines rows of the same path first; no snapshot's list is gathered in one task."""
    as_new = pairs.select(F.col("snapshot").alias("list"), F.col("snapshot").alias("pair"), F.lit(True).alias("is_new"))
    as_old = pairs.select(F.col("previous").alias("list"), F.col("snapshot").alias("pair"), F.lit(False).alias("is_new"))
    use = as_new.unionByName(as_old)
    rows = entries.withColumnRenamed("snapshot", "list").join(use, "list")
    side = {}
    for name, is_new in (("new", True), ("old", False)):
        chosen = F.max(F.struct("version", "row_hash"))
        side[name] = rows.where(F.col("is_new") == is_new).groupBy("pair", "path").agg(chosen["row_hash"].alias(f"{name}_hash"))
    both = side["new"].join(side["old"], ["pair", "path"], "full_outer")
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
    )
    return both.select(F.col("pair").alias("snapshot"), "path", change.alias("change")).where("change is not null")


def file_list(file_entries: DataFrame) -> DataFrame:
    """Entries in the form of delta: paths cleaned and in NFC, file_hash, size and mod_time in whole seconds hashed.

    Rows without a usable snapshot or path are in no list."""
    seconds = F.expr("mod_time div 1000000000 - int(mod_time % 1000000000 < 0)")  # rounded down, in whole numbers
    return file_entries.select(
        hash_bytes(F.col("snapshot_id")).alias("snapshot"),
        nfc(clean_path(F.col("path"))).alias("path"),
        F.col("entry_id").alias("version"),
        row_hash(clean_hash(F.col("file_hash")), F.col("size"), seconds).alias("row_hash"),
    ).where("snapshot is not null and path is not null")


def snapshot_changes(file_entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, path, change) between each snapshot and the one its prev_id names."""
    found = delta(file_list(file_entries), snapshot_pairs(snapshots))
    return found.select(bytes_text(F.col("snapshot")).alias("snapshot_id"), "path", "change")
