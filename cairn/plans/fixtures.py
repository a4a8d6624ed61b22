"""Versioned relations derived from the test tables, for queries over two versions of a file set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.hashes import clean_hash, digest
from cairn.functions.paths import clean_path, nfc
from cairn.operators.diff import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_a(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: path, text, file_hash, size, mod_time. Null texts are empty files."""
    text = F.coalesce("text", F.lit(""))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    rows = table(spark, d, "documents").select(path.alias("path"), text.alias("text"), (F.col("doc_id") * 1_000_000_000).alias("mod_time"))
    return rows.withColumns({"file_hash": digest(F.col("text")), "size": F.octet_length("text").cast("long")})


def files_b(spark: SparkSession, d: str) -> DataFrame:
    """An edit of files_a by digits of its hashes: some dropped, some changed, some only touched, some copied."""
    a = files_a(spark, d).withColumns({"_x": F.substring("file_hash", 2, 1), "_y": F.substring("file_hash", 3, 1)})
    changed = F.col("_x").isin("0", "1")
    text = F.when(changed, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    time = F.col("mod_time") + F.when(changed | (F.col("_y") == "0"), 1_000_000_000).otherwise(0)
    kept = a.where("_x != 'f'").withColumns({"text": text, "mod_time": time})
    copies = a.where("_x = 'e'").withColumn("path", F.concat(F.lit("new/"), "path"))
    rows = kept.unionByName(copies).drop("_x", "_y")
    return rows.withColumns({"file_hash": digest(F.col("text")), "size": F.octet_length("text").cast("long")})


def entries(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """file_entries with one row a snapshot and clean path: the one with the highest entry_id. only: (snapshot) to read the
    lists of; the others are dropped before anything is shuffled."""
    rows = table(spark, d, "file_entries").select(
        clean_hash(F.col("snapshot_id")).alias("snapshot"), nfc(clean_path(F.col("path"))).alias("path"), "entry_id", clean_hash(F.col("file_hash")).alias("file_hash"), "size"
    )
    rows = rows if only is None else rows.join(only, "snapshot", "left_semi")
    return latest(rows.where("snapshot is not null and path is not null"), ["snapshot", "path"], "entry_id", ["file_hash", "size"])


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Distinct clean paths of file_entries."""
    return table(spark, d, "file_entries").select(nfc(clean_path(F.col("path"))).alias("path")).where("path is not null").distinct()
