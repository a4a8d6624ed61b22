"""Chains of snapshots: depth, ancestry, reachability and symbolic references.

All walks double their step: after k rounds a row knows the ancestor 2^k hops up, so a chain of n snapshots takes log2(n)
joins of the narrow (id, parent) table and no task holds a chain. A missing parent ends a chain; rounds are bounded, so
a cycle ends them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import clean_hash
from cairn.session import cut


def manifest(snapshots: DataFrame) -> DataFrame:
    """One row a snapshot id with cleaned ids: the rows of an id differ only in when they were received and deleted.
    live: some row is not deleted."""
    rows = snapshots.withColumns({"id": clean_hash(F.col("snapshot_id")), "parent": clean_hash(F.col("prev_id"))}).where("id is not null")
    first = [F.min(c).alias(c) for c in ("parent", "repo_id", "message", "author", "ts", "total_size", "file_count")]
    return rows.groupBy("id").agg(*first, F.max("tags").alias("tags"), F.bool_or(F.col("deleted_at").isNull()).alias("live"))


def links(manifests: DataFrame) -> DataFrame:
    """(id, parent): parent is null where it is missing from the table."""
    known = manifests.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    return manifests.select("id", "parent").join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("parent"))


def _rounds(rows: DataFrame) -> int:
    """Doublings after which every chain of these rows has ended; only cycles go on."""
    return rows.count().bit_length() + 1


def depths(manifests: DataFrame) -> DataFrame:
    """(id, depth, root): hops to the end of the chain and the snapshot there. Snapshots on or above a cycle have a null root."""
    state = cut(links(manifests).select("id", F.coalesce("parent", "id").alias("top"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("done")))
    for _ in range(_rounds(state)):
        if state.where(~F.col("done")).isEmpty():
            break
        above = state.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moving = state.where(~F.col("done")).join(above, "top")
        moved = moving.select("id", F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        state = cut(state.where("done").unionByName(moved))
    return state.select("id", "depth", F.when(F.col("done"), F.col("top")).alias("root"))


def reachable(manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of the snapshots on the chains of roots (id), roots that are not in the table left out.

    In round k the reached rows send themselves 2^k hops up while every link doubles."""
    jumps = cut(links(manifests).where("parent is not null"))
    seen = cut(roots.select("id").where("id is not null").distinct().join(manifests.select("id"), "id", "left_semi"))
    for _ in range(_rounds(jumps)):
        if jumps.isEmpty():
            break
        further = jumps.join(seen, "id", "left_semi").select(F.col("parent").alias("id"))
        grown = cut(seen.unionByName(further).distinct())
        up = jumps.select(F.col("id").alias("parent"), F.col("parent").alias("_up"))
        jumps = cut(jumps.join(up, "parent").select("id", F.col("_up").alias("parent")).where("id != parent"))
        seen = grown
    return seen


def ancestry(manifests: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (descendant, ancestor, ...) with `is_ancestor`: true for equal ids and where the ancestor is on the descendant's
    chain; null where the descendant is not in the table, or its chain ends at a missing snapshot before it could be met;
    else false. `known`: the descendant is in the table.

    The test needs no walk: with unique parents, ancestor is on the chain if going up by the difference of the depths
    ends at it; the binary digits of the difference say which doubled links to take."""
    deep = cut(depths(manifests))
    ends = manifests.select(F.col("id").alias("root"), F.col("parent").isNotNull().alias("_broken"))
    a = deep.join(ends, "root", "left").select(F.col("id").alias("descendant"), F.col("depth").alias("_d"), F.coalesce("_broken", F.lit(False)).alias("_broken"))
    b = deep.select(F.col("id").alias("ancestor"), F.col("depth").alias("_a"))
    rows = pairs.join(a, "descendant", "left").join(b, "ancestor", "left").withColumn("at", F.col("descendant")).withColumn("_left", F.col("_d") - F.col("_a"))
    rows = cut(rows)
    jumps = cut(links(manifests).where("parent is not null"))
    most = rows.agg(F.max("_left")).first()[0] or 0
    for k in range(int(most).bit_length()):
        step = jumps.select(F.col("id").alias("at"), F.col("parent").alias("_to"))
        taken = F.getbit(F.col("_left"), F.lit(k)) == 1
        rows = cut(rows.join(step, "at", "left").withColumn("at", F.when((F.col("_left") > 0) & taken, F.col("_to")).otherwise(F.col("at"))).drop("_to"))
        up = jumps.select(F.col("id").alias("parent"), F.col("parent").alias("_up"))
        jumps = cut(jumps.join(up, "parent").select("id", F.col("_up").alias("parent")))
    met = F.coalesce((F.col("_left") >= 0) & (F.col("at") == F.col("ancestor")), F.lit(False))
    verdict = F.when((F.col("descendant") == F.col("ancestor")) | met, True).when(F.col("_d").isNotNull() & ~F.col("_broken"), False)
    return rows.withColumns({"is_ancestor": verdict, "known": F.col("_d").isNotNull()}).drop("at", "_left", "_d", "_a", "_broken")


def resolve_symrefs(refs: DataFrame, scope: list[str], most: int = 8) -> DataFrame:
    """refs (scope..., name, target, symref) with `resolved`, the target at the end of at most `most` symbolic hops, and
    `hops`; resolved is null where a name is missing, null or still symbolic after that."""
    to = refs.select(*scope, F.col("name").alias("_at"), F.col("target").alias("_target"), F.col("symref").alias("_next")).dropDuplicates([*scope, "_at"])
    rows = refs.withColumns({"resolved": F.col("target"), "_at": F.col("symref"), "hops": F.lit(0)})
    for _ in range(most):
        rows = rows.join(to, [*scope, "_at"], "left").select(
            *refs.columns,
            F.when(F.col("_at").isNull(), F.col("resolved")).otherwise(F.when(F.col("_next").isNull(), F.col("_target"))).alias("resolved"),
            F.when(F.col("_at").isNotNull(), F.col("_next")).alias("_at"),
            (F.col("hops") + F.col("_at").isNotNull().cast("int")).alias("hops"),
        )
    return rows.select(*refs.columns, F.when(F.col("_at").isNull(), F.col("resolved")).alias("resolved"), "hops")
