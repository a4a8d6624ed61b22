"""References to records that do not exist.

Distinct non-null foreign keys are held against the parent keys by a left anti join; what is left is joined back to the
references, for rows or for counts per table and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import bytes_text, hash_bytes
from cairn.session import cut


def period(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def orphan_rows(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of references whose key has no parent, or whose parent came after them.

    references: key, at (timestamp) and any other columns; rows with a null key refer to nothing and are left out.
    parents: key, since (timestamp, null: always there), one row a key. A null `at` is never too early.

    A key goes to the join once, with its earliest reference, whatever number of rows refer to it, so a hot key costs
    one row a map task. Only keys with a fault are joined back to the rows."""
    used = references.where("key is not null")
    others = [c for c in references.columns if c not in ("key", "at")]
    # the counts read the columns that the join back needs, so both uses of the references share one scan and exchange
    counts = [F.count(c).alias(f"_n{k}") for k, c in enumerate(others)]
    keys = used.groupBy("key").agg(F.min("at").alias("first_at"), *counts).where(sum((F.col(f"_n{k}") for k in range(len(others))), F.lit(0)) >= 0)
    ok = parents.select(F.col("key").alias("parent_key"), "since")
    sound = (F.col("key") == F.col("parent_key")) & (F.col("since").isNull() | F.col("first_at").isNull() | (F.col("since") <= F.col("first_at")))
    faulty = keys.join(ok, sound, "left_anti").select("key")
    known = faulty.join(parents, "key", "left").select("key", "since", F.col("since").isNull().alias("absent"))
    back = used.join(known, "key")
    return back.where(F.col("absent") | (F.col("since") > F.col("at"))).drop("since", "absent")


def orphan_report(rows: DataFrame) -> DataFrame:
    """Counts per table and period of rows with ref_table, period, target: references and distinct targets."""
    per_target = rows.groupBy("ref_table", "period", "target").agg(F.count("*").alias("n"))
    return per_target.groupBy("ref_table", "period").agg(F.sum("n").alias("n_references"), F.count("*").alias("n_targets"))


def chunk_parents(chunks: DataFrame) -> DataFrame:
    """(key, since) of the chunks that have a live row; since is the earliest stored_at of any row, live or not."""
    rows = chunks.select(hash_bytes(F.col("hash")).alias("key"), "stored_at", F.col("deleted_at").isNull().alias("live"))
    merged = rows.where("key is not null").groupBy("key").agg(F.min("stored_at").alias("since"), F.max("live").alias("live"))
    return merged.where("live").select("key", "since")


def snapshot_parents(snapshots: DataFrame) -> DataFrame:
    """(key, since, live) of every snapshot id; since is its ts."""
    rows = snapshots.select(
        hash_bytes(F.col("snapshot_id")).alias("key"), F.timestamp_seconds("ts").alias("ts"), F.col("deleted_at").isNull().alias("live")
    )
    return rows.where("key is not null").groupBy("key").agg(F.min("ts").alias("since"), F.max("live").alias("live"))


def missing_chunks(file_entries: DataFrame, snapshots: DataFrame, chunks: DataFrame, base_chunks: DataFrame) -> DataFrame:
    """(entry_id, snapshot, at, key) for each entry and distinct chunk hash that is not there, or came after the snapshot.

    base_chunks is a fixed table of a few hundred rows that every store knows; it takes the place of a constant and is
    the only table sent to all executors (Spark's own size limit decides). Entries of unknown snapshots have no time:
    only absent chunks are reported, with a null period."""
    ids = snapshot_parents(snapshots).select(F.col("key").alias("snapshot"), F.col("since").alias("at"))
    listed = file_entries.select(
        "entry_id", hash_bytes(F.col("snapshot_id")).alias("snapshot"), F.array_distinct(F.transform("chunks", hash_bytes)).alias("keys")
    )
    base = base_chunks.select(hash_bytes(F.col("hash")).alias("key")).where("key is not null").distinct()
    timed = listed.join(ids, "snapshot", "left")
    references = timed.select("entry_id", "snapshot", "at", F.explode("keys").alias("key")).where("key is not null")
    return orphan_rows(references.join(base, "key", "left_anti"), chunk_parents(chunks)).dropDuplicates(["entry_id", "key"])


def dangling_references(
    file_entries: DataFrame, refs: DataFrame, check_runs: DataFrame, snapshots: DataFrame, chunks: DataFrame, base_chunks: DataFrame
) -> DataFrame:
    """Every reference to a chunk or snapshot that does not exist, was deleted or came later.

    (ref_table, ref_id, period, target), one row a case: chunks of file_entries, targets of refs, and check_runs whose
    snapshot has no row or whose count of missing chunks is not the number of its missing targets (a null count is
    none). Unusable hashes refer to nothing."""
    gone = cut(missing_chunks(file_entries, snapshots, chunks, base_chunks))  # read for rows and for counts
    of_entries = gone.select(F.lit("file_entries").alias("ref_table"), F.col("entry_id").cast("string").alias("ref_id"), period(F.col("at")).alias("period"), bytes_text(F.col("key")).alias("target"))

    ids = snapshot_parents(snapshots)
    heads = refs.select("ref_id", F.col("updated_at").alias("at"), hash_bytes(F.col("target")).alias("key")).where("key is not null").distinct()
    of_refs = orphan_rows(heads, ids.where("live").drop("live")).select(
        F.lit("refs").alias("ref_table"), F.col("ref_id").cast("string").alias("ref_id"), period(F.col("at")).alias("period"), bytes_text(F.col("key")).alias("target")
    )

    counts = gone.groupBy("snapshot", "key").agg(F.lit(1).alias("one")).groupBy("snapshot").agg(F.count("*").alias("n_gone"))
    runs = check_runs.select("run_id", F.col("ran_at").alias("at"), "missing", hash_bytes(F.col("snapshot_id")).alias("key")).where("key is not null").distinct()
    judged = runs.join(ids.select("key", F.lit(True).alias("exists")), "key", "left").join(counts.withColumnRenamed("snapshot", "key"), "key", "left")
    wrong = F.col("exists").isNull() | ~F.col("missing").eqNullSafe(F.coalesce("n_gone", F.lit(0)))
    of_runs = judged.where(wrong).select(
        F.lit("check_runs").alias("ref_table"), F.col("run_id").cast("string").alias("ref_id"), period(F.col("at")).alias("period"), bytes_text(F.col("key")).alias("target")
    )
    return of_entries.unionByName(of_refs).unionByName(of_runs)
