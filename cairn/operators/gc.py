"""Garbage: what no reference reaches, what is kept all the same, and packs of mostly dead chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.hashes import clean_hash
from cairn.operators.lineage import reachable

AUTO = "auto -"
#: Share of dead chunks from which a pack is rewritten; loose live chunks beyond which they are packed.
DEAD_RATIO, LOOSE_LIMIT = 0.5, 512


def roots(refs: DataFrame) -> DataFrame:
    """(id) of all targets of branches, tags and a detached HEAD; null and zero targets are none."""
    return refs.select(clean_hash(F.col("target")).alias("id")).where("id is not null").distinct()


def unreachable(manifests: DataFrame, refs: DataFrame) -> DataFrame:
    return manifests.join(reachable(manifests, roots(refs)), "id", "left_anti")


def kept_autos(lost: DataFrame, keep: int, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """The `keep` newest unreachable automatic snapshots (of each scope); ties by id, highest first."""
    newest = Window.partitionBy(*scope).orderBy(F.desc("ts"), F.desc("id")) if scope else None
    autos = lost.where(F.col("message").startswith(AUTO))
    if newest is None:
        return autos.orderBy(F.desc("ts"), F.desc("id")).limit(keep)
    return autos.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def prunable_autos(manifests: DataFrame, reached: DataFrame, keep: int, scope: list[str]) -> DataFrame:
    """Automatic snapshots beyond the `keep` newest of all of their scope, if nothing reaches them. Unlike kept_autos the
    rank is over reachable ones too."""
    newest = Window.partitionBy(*scope).orderBy(F.desc("ts"), F.desc("id"))
    ranked = manifests.where(F.col("message").startswith(AUTO)).withColumn("_n", F.row_number().over(newest))
    return ranked.where(F.col("_n") > keep).drop("_n").join(reached, "id", "left_anti")


def live_chunks(kept: DataFrame, file_entries: DataFrame, index_entries: DataFrame) -> DataFrame:
    """(hash) of all chunks of kept snapshots (id) and of the workspace index."""
    listed = file_entries.select(clean_hash(F.col("snapshot_id")).alias("id"), "chunks").join(kept.select("id"), "id", "left_semi")
    both = listed.select(F.explode("chunks").alias("hash")).unionByName(index_entries.select(F.explode("chunks").alias("hash")))
    return both.select(clean_hash(F.col("hash")).alias("hash")).where("hash is not null").distinct()


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """(hash, size) of the chunks that are in the store; null sizes count 0 bytes."""
    live = chunks.where("deleted_at is null").select(clean_hash(F.col("hash")).alias("hash"), "size").where("hash is not null")
    return live.groupBy("hash").agg(F.max("size").alias("size"))


def dead_chunks(chunks: DataFrame, live: DataFrame) -> DataFrame:
    return stored_chunks(chunks).join(live, "hash", "left_anti")


def report(lost: DataFrame, kept: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: snapshots_removed, autos_kept, chunks_removed, bytes_freed (logical sizes)."""
    gone = lost.join(kept.select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("snapshots_removed").alias("what"), "n")
    held = kept.agg(F.count("*").alias("n")).select(F.lit("autos_kept").alias("what"), "n")
    swept = dead.agg(F.count("*").alias("chunks_removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_freed"))
    swept = swept.select(F.expr("stack(2, 'chunks_removed', chunks_removed, 'bytes_freed', bytes_freed) as (what, n)"))
    rows = gone.unionByName(held).unionByName(swept)
    names = ["snapshots_removed", "autos_kept", "chunks_removed", "bytes_freed"]
    return rows.agg(*(F.max(F.when(F.col("what") == x, F.col("n"))).alias(x) for x in names))


def pack_plan(packs: DataFrame, live: DataFrame) -> DataFrame:
    """packs (pack, hash, length) by pack: chunks, dead, dead_bytes, and action: drop (all dead), rewrite (half or more
    dead) or keep; a kept pack keeps its dead chunks."""
    marked = packs.join(live.select("hash", F.lit(True).alias("_live")), "hash", "left")
    dead = F.col("_live").isNull()
    found = marked.groupBy("pack").agg(F.count("*").alias("chunks"), F.count_if(dead).alias("dead"), F.coalesce(F.sum(F.when(dead, F.col("length"))), F.lit(0)).alias("dead_bytes"))
    action = F.when(F.col("dead") == F.col("chunks"), "drop").when(F.col("dead") >= F.col("chunks") * DEAD_RATIO, "rewrite").otherwise("keep")
    return found.withColumn("action", action)


def loose_plan(loose: DataFrame, live: DataFrame) -> DataFrame:
    """One row: loose_deleted (dead loose chunks) and loose_packed (live ones, if there are more than LOOSE_LIMIT)."""
    marked = loose.select("hash").distinct().join(live.select("hash", F.lit(True).alias("_live")), "hash", "left")
    n = marked.agg(F.count_if(F.col("_live").isNull()).alias("loose_deleted"), F.count_if(F.col("_live")).alias("_n"))
    return n.select("loose_deleted", F.when(F.col("_n") > LOOSE_LIMIT, F.col("_n")).otherwise(0).alias("loose_packed"))


def next_pack(packs: DataFrame) -> DataFrame:
    """One row `next_pack`: the number after the highest of names like pack-000012."""
    number = F.try_to_number(F.regexp_extract("pack", r"(\d+)\z", 1), F.lit("999999999999")).cast("long")
    return packs.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_pack"))
