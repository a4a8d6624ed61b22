"""Views of history: logs, branch and tag decoration, version references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import clean_hash
from cairn.functions.patterns import VersionRef
from cairn.operators.gc import AUTO


def names_by_target(refs: DataFrame, kind: str, column: str) -> DataFrame:
    """(id, column): sorted distinct short names of the branches or tags that point at each snapshot."""
    prefix = {"branch": "heads/", "tag": "tags/"}[kind]
    rows = refs.where(F.col("type") == kind).select(clean_hash(F.col("target")).alias("id"), F.regexp_replace("name", rf"\A{prefix}", "").alias("_name"))
    return rows.where("id is not null and _name is not null").groupBy("id").agg(F.array_sort(F.collect_set("_name")).alias(column))


def decorate(summaries: DataFrame, refs: DataFrame) -> DataFrame:
    """summaries with `branches` (tips only) and `all_tags` (references and embedded ones, without empty names), sorted."""
    none = F.array().cast("array<string>")
    rows = summaries.join(names_by_target(refs, "branch", "branches"), "id", "left").join(names_by_target(refs, "tag", "_tags"), "id", "left")
    merged = F.array_union(F.coalesce("_tags", none), F.coalesce("tags", none))
    named = F.filter(merged, lambda x: x.isNotNull() & (x != ""))
    return rows.withColumns({"branches": F.coalesce("branches", none), "all_tags": F.array_sort(named)}).drop("_tags")


def visible(summaries: DataFrame, show_autos: bool = False) -> DataFrame:
    """Without automatic snapshots unless asked for; a null message is not automatic."""
    return summaries if show_autos else summaries.where(~F.coalesce(F.col("message").startswith(AUTO), F.lit(False)))


def newest_first(summaries: DataFrame, depths: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    """By time, then depth, then id, newest first; limit 0 or less is all. Depths are those of the full chains, so hidden
    snapshots do not disturb the order."""
    rows = summaries.join(depths.select("id", "depth"), "id", "left").orderBy(F.desc("ts"), F.desc("depth"), F.desc("id"))
    if offset > 0:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit > 0 else rows


def tag_list(refs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Tags with the message and time of their snapshot; a dangling tag has an empty message and time 0. By name."""
    tags = refs.where("type = 'tag'").select("ref_id", F.regexp_replace("name", r"\Atags/", "").alias("tag"), clean_hash(F.col("target")).alias("id"))
    rows = tags.distinct().join(summaries.select("id", "message", "ts"), "id", "left")
    return rows.select("ref_id", "tag", "id", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("ts", F.lit(0)).alias("ts")).orderBy("tag", "ref_id")


def resolve(ref: VersionRef, manifests: DataFrame, refs: DataFrame) -> DataFrame:
    """(id) of the snapshots a version reference names: none is not found, more than one is ambiguous (id prefixes)."""
    if ref.kind == "id":
        return manifests.where(F.col("id").startswith(ref.value)).select("id")
    if ref.kind == "head":
        head = refs.where("name = 'HEAD'").select(F.col("symref").alias("name"), F.col("target").alias("_own"))
        rows = head.join(refs.select("name", "target"), "name", "left").select(clean_hash(F.coalesce("target", "_own")).alias("id"))
    else:
        name = {"tag": "tags/", "branch": "heads/"}[ref.kind] + ref.value
        rows = refs.where(F.col("name") == name).select(clean_hash(F.col("target")).alias("id"))
    return rows.where("id is not null").distinct().join(manifests.select("id"), "id", "left_semi")


def prefix_matches(manifests: DataFrame, length: int) -> DataFrame:
    """(prefix, matches, status) of all id prefixes of a length: unique or ambiguous."""
    rows = manifests.groupBy(F.substring("id", 1, length).alias("prefix")).agg(F.count("*").alias("matches"))
    return rows.withColumn("status", F.when(F.col("matches") > 1, "ambiguous").otherwise("unique"))


def current_branches(refs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, branch, id): the branch HEAD stands on and its tip; a detached HEAD has a null branch."""
    head = refs.where("name = 'HEAD'").select(*scope, F.nullif("symref", F.lit("")).alias("_branch"), F.col("target").alias("_own")).distinct()
    tips = refs.select(*scope, F.col("name").alias("_branch"), F.col("target").alias("_tip")).distinct()
    rows = head.join(tips, [*scope, "_branch"], "left")
    return rows.select(*scope, F.regexp_replace("_branch", r"\Aheads/", "").alias("branch"), clean_hash(F.coalesce("_tip", "_own")).alias("id"))


def ref_counts(refs: DataFrame) -> DataFrame:
    """One row (branches, tags): numbers of references of each kind."""
    return refs.agg(F.count_if(F.col("name").startswith("heads/")).alias("branches"), F.count_if(F.col("name").startswith("tags/")).alias("tags"))
