"""Copying between stores: scopes, what is missing on the other side, and how references move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import clean_hash
from cairn.operators.integrity import file_chunks
from cairn.operators.lineage import ancestry, reachable


def missing(have: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of have that the other side lacks: what a push (or, the other way round, a pull) copies."""
    return have.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def plan_counts(kind: str, have: DataFrame, other: DataFrame, key: str, size: Column | None = None) -> DataFrame:
    """One row (kind, copied, skipped, bytes) of a transfer."""
    marked = have.join(other.select(key, F.lit(True).alias("_there")).distinct(), key, "left")
    lacking = F.col("_there").isNull()
    amount = F.coalesce(F.sum(F.when(lacking, size)), F.lit(0)) if size is not None else F.lit(0)
    return marked.agg(F.count_if(lacking).alias("copied"), F.count_if(~lacking).alias("skipped"), amount.cast("long").alias("bytes")).select(F.lit(kind).alias("kind"), "copied", "skipped", "bytes")


def scope(manifests: DataFrame, tips: DataFrame, file_entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots (id) on the chains of tips (id) and their distinct chunks (hash)."""
    ids = reachable(manifests, tips)
    listed = file_chunks(file_entries.withColumn("id", clean_hash(F.col("snapshot_id"))), ["id"])
    return ids, listed.join(ids, "id", "left_semi").select("hash").distinct()


def _named(key: str) -> list[str]:
    return list(dict.fromkeys((key, "name")))


def _pairs(local: DataFrame, remote: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    a = local.select(*_named(key), clean_hash(F.col("target")).alias("local")).distinct()
    b = remote.select(key, clean_hash(F.col("target")).alias("remote"), F.lit(True).alias("_there")).distinct()
    return a, b


def classify_push(local: DataFrame, remote: DataFrame, manifests: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, name, action) of each local reference: skip (no target), create, same, update (fast-forward) or diverge.

    A remote target that the local history does not reach is divergence, or `broken` where that history ends at a missing
    snapshot, so that nothing can be said."""
    a, b = _pairs(local, remote, key)
    rows = a.join(b, key, "left").withColumns({"descendant": F.col("local"), "ancestor": F.col("remote")})
    rows = ancestry(manifests, rows)
    action = (
        F.when(F.col("local").isNull(), "skip")
        .when(F.col("remote").isNull(), "create")
        .when(F.col("local") == F.col("remote"), "same")
        .when(F.col("is_ancestor"), "update")
        .when(F.col("is_ancestor").isNull() & F.col("known"), "broken")
        .otherwise("diverge")
    )
    return rows.select(*_named(key), action.alias("action"))


def merge_pull(local: DataFrame, remote: DataFrame, manifests: DataFrame, key: str = "ref_id", scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(key, name, action, new_name) of each remote reference: create, same, forward, or side, where the remote target is
    kept under `<name>.remote` because the local one is no ancestor of it; if that name (within scope) is taken by another
    target, under `<name>.remote.<first 8 digits>`. A remote reference without a target is skipped."""
    b = remote.withColumn("name", F.regexp_replace("name", r"\Arefs/", "")).select(*dict.fromkeys((*_named(key), *scope)), clean_hash(F.col("target")).alias("remote")).distinct()
    a = local.select(key, clean_hash(F.col("target")).alias("local"), F.lit(True).alias("_there")).distinct()
    rows = ancestry(manifests, b.join(a, key, "left").withColumns({"descendant": F.col("remote"), "ancestor": F.col("local")}))
    action = (
        F.when(F.col("remote").isNull(), "skip")
        .when(F.col("_there").isNull(), "create")
        .when(F.col("local") == F.col("remote"), "same")
        .when(F.col("local").isNull() | F.coalesce("is_ancestor", F.lit(False)), "forward")
        .otherwise("side")
    )
    taken = local.select(*scope, F.col("name").alias("_side"), clean_hash(F.col("target")).alias("_held")).where("_held is not null")
    taken = taken.groupBy(*scope, "_side").agg(F.collect_set("_held").alias("_held"))  # a name has one target, or few in a table of many stores
    rows = rows.withColumns({"action": action, "_side": F.concat("name", F.lit(".remote"))}).join(taken, [*scope, "_side"], "left")
    other = F.exists(F.coalesce("_held", F.array().cast("array<string>")), lambda x: x != F.col("remote"))
    side = F.when(other, F.concat("_side", F.lit("."), F.substring("remote", 1, 8))).otherwise(F.col("_side"))
    return rows.select(*_named(key), "action", F.when(F.col("action") == "side", side).otherwise(F.col("name")).alias("new_name"))
