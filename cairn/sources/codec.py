"""Snapshots as single nested rows, for transport, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import digest

FILE = ["path", "mode", "size", "mod_time", "file_hash", "chunks", "mime", "extra"]
HEAD = ["snapshot_id", "prev_id", "message", "author", "ts", "tags", "total_size", "file_count"]
_FILE_TYPE = "struct<path:string,mode:bigint,size:bigint,mod_time:bigint,file_hash:string,chunks:array<string>,mime:string,extra:map<string,string>>"
BLOB = f"struct<snapshot_id:string,prev_id:string,message:string,author:string,ts:bigint,tags:array<string>,total_size:bigint,file_count:bigint,files:array<{_FILE_TYPE}>>"


def encode(snapshots: DataFrame, file_entries: DataFrame) -> DataFrame:
    """(snapshot_id, blob, blob_digest): one JSON text a snapshot, files by path and maps by key, so equal snapshots have
    equal texts. A file list is gathered in one row: it is what one snapshot lists, not a group that grows with the data."""
    entry = F.struct(*(F.col(c) for c in FILE if c != "extra"), F.map_from_entries(F.array_sort(F.map_entries("extra"))).alias("extra"))
    # a map can't be ordered: sort the files by path, which is unique within a snapshot
    keyed = file_entries.select("snapshot_id", "path", F.to_json(entry, {"ignoreNullFields": "false"}).alias("_json"))
    lists = keyed.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("path", "_json"))).alias("_files"))
    rows = snapshots.select(*HEAD).join(lists, "snapshot_id", "left")
    files = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("_files", F.array().cast("array<struct<path:string,_json:string>>")), lambda x: x["_json"]), ","), F.lit("]"))
    head = F.to_json(F.struct(*HEAD), {"ignoreNullFields": "false"})
    blob = F.concat(F.left(head, F.length(head) - 1), F.lit(',"files":'), files, F.lit("}"))
    return rows.select("snapshot_id", blob.alias("blob")).withColumn("blob_digest", digest(F.col("blob")))


def decode(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """snapshots and file_entries of encoded rows. A text that is no snapshot, or has another digest than its row says,
    gives nothing."""
    rows = blobs.where(digest(F.col("blob")) == F.col("blob_digest")).select(F.from_json("blob", BLOB).alias("s")).where("s.snapshot_id is not null")
    files = rows.select(F.col("s.snapshot_id").alias("snapshot_id"), F.explode("s.files").alias("f"))
    return rows.select(*(F.col(f"s.{c}").alias(c) for c in HEAD)), files.select("snapshot_id", *(F.col(f"f.{c}").alias(c) for c in FILE))
