"""Diffs of file lists: full outer joins on path. All sides are (path, ...) with one row a path, as `latest` makes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(entries: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """One row a key, of the highest version; equal versions are taken in order of their values. Combined on the map side."""
    chosen = F.max(F.struct(version, *values)).alias("_row")
    return entries.groupBy(*keys).agg(chosen).select(*keys, *(F.col(f"_row.{v}").alias(v) for v in values))


def _sides(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    a = old.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("_old"))
    b = new.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("_new"))
    return a.join(b, keys, "full_outer")


def file_diff(old: DataFrame, new: DataFrame, differs: Column, keys: list[str] = ["path"], values: list[str] = ["file_hash", "size"]) -> DataFrame:  # noqa: B006
    """Every key of either side with its values and `status`: added, deleted, modified or unchanged.

    differs: a condition on old_* and new_* columns. Null keys match nothing and count as added or deleted."""
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(differs, "modified").otherwise("unchanged")
    return _sides(old, new, keys, values).withColumn("status", status).drop("_old", "_new")


def by_hash() -> Column:
    """Content comparison of snapshots: the file hash decides."""
    return ~F.col("old_file_hash").eqNullSafe(F.col("new_file_hash"))


def by_size_then_hash() -> Column:
    """Content comparison with a workspace: the cheap size first, the hash on a tie."""
    return F.when(~F.col("old_size").eqNullSafe(F.col("new_size")), True).otherwise(by_hash())


def by_stat() -> Column:
    """Status comparison: size or modification time, no content."""
    return ~(F.col("old_size").eqNullSafe(F.col("new_size")) & F.col("old_mod_time").eqNullSafe(F.col("new_mod_time")))


def by_chunks() -> Column:
    """Comparison of the stat view: size and chunk list."""
    return ~(F.col("old_size").eqNullSafe(F.col("new_size")) & F.col("old_chunks").eqNullSafe(F.col("new_chunks")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    return file_diff(old, new, by_hash()).where("status != 'unchanged'")


def status(index: DataFrame, workspace: DataFrame) -> DataFrame:
    """What a workspace has changed since the index was written. Symbolic links (is_symlink) are not tracked."""
    files = workspace.where(~F.coalesce("is_symlink", F.lit(False))) if "is_symlink" in workspace.columns else workspace
    return file_diff(index, files, by_stat(), values=["size", "mod_time"]).where("status != 'unchanged'").orderBy("path")


def workspace_diff(snapshot: DataFrame, workspace: DataFrame) -> DataFrame:
    return file_diff(snapshot, workspace, by_size_then_hash()).where("status != 'unchanged'")


def restore_plan(workspace: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, action): write, overwrite or delete to turn the workspace into the snapshot, by path."""
    found = file_diff(workspace, snapshot, by_size_then_hash()).where("status != 'unchanged'")
    action = F.when(F.col("status") == "added", "write").when(F.col("status") == "modified", "overwrite").otherwise("delete")
    return found.select("path", action.alias("action"), F.col("new_size").alias("size")).orderBy("path")


def content_kind(old: DataFrame, new: DataFrame, engine: str = "engine") -> DataFrame:
    """(path, kind, old_size, new_size): added, deleted, unchanged, or how a changed file is diffed (text or binary)."""
    found = file_diff(old, new, by_hash(), values=["file_hash", "size", engine])
    both_text = (F.col(f"old_{engine}") == "text") & (F.col(f"new_{engine}") == "text")
    kind = F.when(F.col("status") != "modified", F.col("status")).when(both_text, "text").otherwise("binary")
    return found.select("path", kind.alias("kind"), "old_size", "new_size")


def merge_saved(index: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new index and one row `changed`: whether a save has anything to store."""
    found = file_diff(index, processed, by_hash())
    changed = found.agg(F.coalesce(F.bool_or(F.col("status") != "unchanged"), F.lit(False)).alias("changed"))
    return processed, changed


def trusted(index: DataFrame, workspace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose size and time equal the index (their entry is reused) and the others (to be read again)."""
    kept = workspace.select("path", "size", "mod_time").join(index, ["path", "size", "mod_time"])
    return kept, workspace.join(kept.select("path"), "path", "left_anti")


def parent_changes(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes of every snapshot against its parent at once: (snapshot, path, status, old_size, new_size).

    entries: (snapshot, path, file_hash, size), one row a path. pairs: (snapshot, previous); with a null or unknown
    previous all files are added. Each side is joined once for all snapshots; no snapshot is read on its own."""
    new = entries.join(pairs.select("snapshot"), "snapshot")
    old = entries.join(pairs.select(F.col("previous").alias("snapshot"), F.col("snapshot").alias("_child")).where("snapshot is not null"), "snapshot")
    old = old.drop("snapshot").withColumnRenamed("_child", "snapshot")
    return file_diff(old, new, by_hash(), keys=["snapshot", "path"]).where("status != 'unchanged'")


def change_counts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """added, modified and deleted per key."""
    count = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted")]
    return changes.groupBy(*keys).agg(*count)


def path_history(entries: DataFrame, depths: DataFrame) -> DataFrame:
    """Entries with the hash the same path had in the version before, by depth, then snapshot. depths: (snapshot, chain, depth)."""
    chain = Window.partitionBy("chain", "path").orderBy("depth", "snapshot")
    return entries.join(depths, "snapshot").withColumn("previous_hash", F.lag("file_hash").over(chain))
