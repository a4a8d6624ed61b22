"""Queries of the version store over the test tables; their SQL is in cairn.plans.oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.commands import envelope
from cairn.functions import display, engines, hashes, patterns, payload, text
from cairn.functions.paths import nfc
from cairn.operators import chunking, diff, gc, history, integrity, lineage, sync, textdiff
from cairn.plans.fixtures import entries, files_a, files_b, paths, table
from cairn.session import checkpoint_dir, cut
from cairn.sources.store import MAIN, Store
from cairn.streaming import autosave

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

GLOBS = ["**/*.psd", "*.md", "oakum/**", "?????.txt", "[!a-m]*.go", "**/vale/**"]
RULES = patterns.parse_ignore("# build output\n*.psd\n/ember.svg\nbasin/\n!basin/keep.md\nvale/*.go\n**/grove/**\n!willow.psd\n") + patterns.parse_ignore("*.yaml\n!mesa.yaml\n", "oakum")
CHUNK = 4096


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.snapshot_diff(files_a(spark, d), files_b(spark, d)).select("path", "status")


@query
def snapshot_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = diff.file_diff(files_a(spark, d), files_b(spark, d), diff.by_hash())
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.sum(F.coalesce("new_size", "old_size")).alias("bytes"))


@query
def diff_content_kind(spark: SparkSession, d: str) -> DataFrame:
    a, b = (f(spark, d).withColumn("engine", engines.detect_engine(F.col("path"), engines.header_of(F.encode("text", "utf-8")))) for f in (files_a, files_b))
    return diff.content_kind(a, b)


@query
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.status(files_a(spark, d), files_b(spark, d)).select("path", "status")


@query
def workspace_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.workspace_diff(files_a(spark, d), files_b(spark, d)).select("path", "status")


@query
def restore_plan(spark: SparkSession, d: str) -> DataFrame:
    return diff.restore_plan(files_b(spark, d), files_a(spark, d))


@query
def trusted_files(spark: SparkSession, d: str) -> DataFrame:
    kept, again = diff.trusted(files_a(spark, d).drop("text"), files_b(spark, d))
    return kept.select("path", F.lit("kept").alias("action")).unionByName(again.select("path", F.lit("read").alias("action")))


def _counts(spark: SparkSession, d: str, manifests: DataFrame, only: DataFrame | None = None) -> DataFrame:
    pairs = manifests.select(F.col("id").alias("snapshot"), F.col("parent").alias("previous"))
    return diff.change_counts(diff.parent_changes(entries(spark, d, only), pairs), ["snapshot"])


@query
def parent_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, lineage.manifest(table(spark, d, "snapshots")))


def _chunks_of(spark: SparkSession, d: str) -> DataFrame:
    content = F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")
    return chunking.fixed_chunks(table(spark, d, "documents").select("doc_id", content), ["doc_id"], CHUNK)


@query
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks_of(spark, d).drop("data")


@query
def chunk_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.dedup_stats(_chunks_of(spark, d))


@query
def file_hash_merkle(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.with_file_hash(_chunks_of(spark, d), ["doc_id"])
    return rows.select("doc_id", "file_hash", F.size("chunks").cast("long").alias("n_chunks"), "size")


@query
def reassemble_files(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks_of(spark, d)
    store = chunks.select("hash", "data").dropDuplicates(["hash"])
    rows = chunking.reassemble(chunks.select("doc_id", "idx", "hash"), store, ["doc_id"])
    return rows.select("doc_id", hashes.digest(F.col("content")).alias("content_hash"), F.octet_length("content").cast("long").alias("size"))


@query
def store_put(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the put log that the store lacks."""
    puts = table(spark, d, "chunk_puts").select(hashes.clean_hash(F.col("hash")).alias("hash")).where("hash is not null")
    return chunking.new_chunks(puts, gc.stored_chunks(table(spark, d, "chunks")))


@query
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", text.newline_count(body).cast("long").alias("newlines"), F.size(text.lines(body)).cast("long").alias("n_lines"))
    return rows


@query
def engine_detect(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("binary")
    named = paths(spark, d).select(F.lit("path").alias("kind"), F.col("path").alias("name"), engines.detect_engine(F.col("path"), none).alias("engine"))
    rows = table(spark, d, "chunks").select(hashes.clean_hash(F.col("hash")).alias("name"), "data").where("name is not null and data is not null").distinct()
    seen = rows.select(F.lit("chunk").alias("kind"), "name", engines.detect_engine(F.lit("x.unknown"), engines.header_of(F.col("data"))).alias("engine"))
    return named.unionByName(seen)


@query
def chunk_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Chunk sizes by type, for the sizes of the entries times three million, so that all tiers occur."""
    size = F.col("size") * 3_000_000
    rows = table(spark, d, "file_entries").where("size is not null and path is not null").select("entry_id", "path", size.alias("size")).distinct()
    engine = engines.detect_engine(F.col("path"), F.lit(None).cast("binary"))
    rows = rows.withColumn("engine", engine).withColumn("s", engines.chunk_strategy(F.col("engine"), F.col("size")))
    return rows.groupBy("engine", F.col("s.min").alias("min_size"), F.col("s.avg").alias("avg_size"), F.col("s.max").alias("max_size")).agg(F.count("*").alias("files"))


@query
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "file_entries").where("size is not null").select("size").distinct()
    cols = [display.human_bytes(F.col("size") * k).alias(f"x{i}") for i, k in enumerate((1, 37, 1021, 524_288, 7_000_003, -4096))]
    return sizes.select("size", *cols)


@query
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.head_lines(F.col("text"), 20).alias("preview"))


@query
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    hit = F.array_compact(F.array(*(F.when(patterns.glob_match(F.col("path"), g), F.lit(g)) for g in GLOBS)))
    return paths(spark, d).select("path", F.explode(hit).alias("pattern"))


@query
def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("path", patterns.is_excluded(F.col("path"), RULES).alias("excluded"))


@query
def refname_validate(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "refs").select("name").unionByName(table(spark, d, "remote_refs").select("name")).where("name is not null")
    base = F.regexp_extract("name", r"([^/]*)\z", 1)
    forms = F.array(F.col("name"), F.concat(F.lit("-"), "name"), F.concat("name", F.lit("..")), F.concat("name", F.lit("/HEAD")), F.concat(base, F.lit(" x")), F.concat(F.lit("heads/com"), F.length("name").cast("string")))
    rows = names.select(F.explode(forms).alias("name")).distinct()
    return rows.select("name", patterns.is_ref_name(F.col("name")).alias("valid"), patterns.ref_type(F.col("name")).alias("type"))


@query
def resolve_id_prefix(spark: SparkSession, d: str) -> DataFrame:
    return history.prefix_matches(lineage.manifest(table(spark, d, "snapshots")), 4)


@query
def chain_depth(spark: SparkSession, d: str) -> DataFrame:
    return lineage.depths(lineage.manifest(table(spark, d, "snapshots")))


@query
def reachable_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return lineage.reachable(lineage.manifest(table(spark, d, "snapshots")), gc.roots(table(spark, d, "refs")))


@query
def unreachable_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return gc.unreachable(lineage.manifest(table(spark, d, "snapshots")), table(spark, d, "refs")).select("id")


@query
def ancestor_test(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "refs").select("ref_id", hashes.clean_hash(F.col("target")).alias("descendant")).where("descendant is not null").distinct()
    b = table(spark, d, "remote_refs").select("ref_id", hashes.clean_hash(F.col("target")).alias("ancestor")).where("ancestor is not null").distinct()
    return lineage.ancestry(lineage.manifest(table(spark, d, "snapshots")), a.join(b, "ref_id")).select("ref_id", "is_ancestor")


def _log(spark: SparkSession, d: str, autos: bool, limit: int, offset: int = 0) -> DataFrame:
    manifests = lineage.manifest(table(spark, d, "snapshots"))
    rows = history.newest_first(history.visible(manifests, autos), lineage.depths(manifests), limit, offset)
    return history.decorate(rows, table(spark, d, "refs"))


@query
def log_default(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d, False, 30)
    return rows.select("id", "ts", "depth", "message", F.array_join("branches", ",").alias("branches"), F.array_join("all_tags", ",").alias("tags"))


@query
def log_all_paged(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d, True, 25, 20).select("id", "ts", "depth")


@query
def log_with_changes(spark: SparkSession, d: str) -> DataFrame:
    """The newest 30 with their changes: the limit comes first, and only their lists and those of their parents are compared."""
    rows = cut(_log(spark, d, False, 30))
    only = rows.select(F.explode(F.array("id", "parent")).alias("snapshot")).distinct()
    counts = _counts(spark, d, rows.select("id", "parent"), only).withColumnRenamed("snapshot", "id")
    n = [F.coalesce(c, F.lit(0)) for c in ("added", "modified", "deleted")]
    joined = rows.join(counts, "id", "left")
    return joined.select("id", display.minute_text(F.col("ts")).alias("time"), display.truncate(F.col("message"), 14).alias("message"), display.change_summary(*n).alias("changes"))


@query
def branch_tips(spark: SparkSession, d: str) -> DataFrame:
    rows = history.names_by_target(table(spark, d, "refs"), "branch", "branches")
    return rows.select("id", F.array_join("branches", ",").alias("names"), display.packed_names(F.col("branches"), 18).alias("packed"))


@query
def tag_list(spark: SparkSession, d: str) -> DataFrame:
    return history.tag_list(table(spark, d, "refs"), lineage.manifest(table(spark, d, "snapshots"))).withColumn("tag", nfc(F.col("tag")))


@query
def merged_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = history.decorate(lineage.manifest(table(spark, d, "snapshots")), table(spark, d, "refs"))
    return rows.where(F.size("all_tags") > 0).select("id", F.array_join("all_tags", ",").alias("tags"))


@query
def current_branch(spark: SparkSession, d: str) -> DataFrame:
    return history.current_branches(table(spark, d, "refs"), ["repo_id"])


def _gc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    manifests = lineage.manifest(table(spark, d, "snapshots"))
    reached = lineage.reachable(manifests, gc.roots(table(spark, d, "refs")))
    lost = manifests.join(reached, "id", "left_anti")
    kept = gc.kept_autos(lost, 3, ["repo_id"])
    live = gc.live_chunks(reached.unionByName(kept.select("id")), table(spark, d, "file_entries"), table(spark, d, "index_entries"))
    return lost, kept, live


@query
def gc_report(spark: SparkSession, d: str) -> DataFrame:
    lost, kept, live = _gc(spark, d)
    return gc.report(lost, kept, gc.dead_chunks(table(spark, d, "chunks"), live))


@query
def gc_keep_auto(spark: SparkSession, d: str) -> DataFrame:
    return _gc(spark, d)[1].select("repo_id", "id", "ts")


@query
def prune_auto(spark: SparkSession, d: str) -> DataFrame:
    manifests = lineage.manifest(table(spark, d, "snapshots"))
    reached = lineage.reachable(manifests, gc.roots(table(spark, d, "refs")))
    return gc.prunable_autos(manifests, reached, 3, ["repo_id"]).select("repo_id", "id", "ts")


@query
def pack_dead_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The stored chunks as packs by the first two digits of their hashes."""
    packs = gc.stored_chunks(table(spark, d, "chunks")).select(F.substring("hash", 1, 2).alias("pack"), "hash", F.col("size").alias("length"))
    return gc.pack_plan(packs, _gc(spark, d)[2])


def _integrity(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = integrity.file_chunks(table(spark, d, "file_entries").select("entry_id", "chunks").distinct(), ["entry_id"])
    stored = table(spark, d, "chunks").where("deleted_at is null").select("hash", "data").unionByName(table(spark, d, "base_chunks").select("hash", "data"))
    return refs, integrity.chunk_states(refs, stored)


@query
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    wrong = integrity.hash_mismatches(table(spark, d, "file_entries").select("entry_id", "chunks", "file_hash").distinct())
    return integrity.report(_integrity(spark, d)[1], wrong, _totals(spark, d))


@query
def integrity_verbose(spark: SparkSession, d: str) -> DataFrame:
    refs, states = _integrity(spark, d)
    return integrity.verbose(refs, states).where("state != 'OK'").select("entry_id", "idx", "hash", "state")


def _stores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    remote = table(spark, d, "remote_chunks").select(hashes.clean_hash(F.col("hash")).alias("hash"), "size").where("hash is not null")
    return gc.stored_chunks(table(spark, d, "chunks")), remote.groupBy("hash").agg(F.max("size").alias("size"))


@query
def push_plan(spark: SparkSession, d: str) -> DataFrame:
    local, remote = _stores(spark, d)
    return sync.plan_counts("chunks", local, remote, "hash", F.col("size"))


@query
def pull_plan(spark: SparkSession, d: str) -> DataFrame:
    local, remote = _stores(spark, d)
    return sync.plan_counts("chunks", remote, local, "hash", F.col("size"))


@query
def branch_scope(spark: SparkSession, d: str) -> DataFrame:
    """What the main branches hold: their snapshots and chunks."""
    tips = gc.roots(table(spark, d, "refs").where("name = 'heads/main'"))
    ids, chunks = sync.scope(lineage.manifest(table(spark, d, "snapshots")), tips, table(spark, d, "file_entries"))
    return ids.select(F.lit("snapshot").alias("kind"), "id").unionByName(chunks.select(F.lit("chunk").alias("kind"), F.col("hash").alias("id")))


@query
def ref_push_classify(spark: SparkSession, d: str) -> DataFrame:
    return sync.classify_push(table(spark, d, "refs"), table(spark, d, "remote_refs"), lineage.manifest(table(spark, d, "snapshots")))


@query
def ref_pull_merge(spark: SparkSession, d: str) -> DataFrame:
    """As if the first pull was done before: side references of a third of the names exist already, with their own targets."""
    local = table(spark, d, "refs").select("ref_id", "repo_id", "name", "target")
    held = local.where("ref_id % 3 = 0").select((-F.col("ref_id")).alias("ref_id"), "repo_id", F.concat("name", F.lit(".remote")).alias("name"), "target")
    return sync.merge_pull(local.unionByName(held), table(spark, d, "remote_refs"), lineage.manifest(table(spark, d, "snapshots")), scope=["repo_id"])


@query
def symref_resolve(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "refs").select("repo_id", "name", hashes.clean_hash(F.col("target")).alias("target"), F.nullif("symref", F.lit("")).alias("symref")).distinct()
    return lineage.resolve_symrefs(refs, ["repo_id"]).select("repo_id", "name", "resolved")


@query
def json_envelope(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf(T.StringType())
    def wrapped(id_: pd.Series, ts: pd.Series, message: pd.Series) -> pd.Series:
        return pd.Series([envelope("log", {"id": i, "ts": int(t), "message": m}) for i, t, m in zip(id_, ts, message)])

    return lineage.manifest(table(spark, d, "snapshots")).select("id", wrapped("id", "ts", "message").alias("json"))


@query
def file_mode_decode(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*(F.lit(x) for x in (0, 0o100000, 0o040000, 0o120000, 0o060000, 0o010000, 0o140000)))
    rows = table(spark, d, "file_entries").where("mode is not null").select(F.explode(F.transform(kinds, lambda k: k.cast("long") + F.col("mode") % 512)).alias("mode")).distinct()
    return rows.select("mode", display.file_kind(F.col("mode")).alias("kind"), display.restored_mode(F.col("mode")).cast("long").alias("restored"), display.permission_text(F.col("mode")).alias("permissions"))


@query
def stat_bar(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("inserted"), F.col("l_linenumber").cast("int").alias("deleted")).distinct()
    return rows.select("inserted", "deleted", display.stat_bar(F.col("inserted"), F.col("deleted")).alias("bar"))


@query
def hash_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select(hashes.clean_hash(F.col("hash")).alias("hash")).where("hash is not null").distinct()
    rows = rows.select("hash", hashes.short_id(F.col("hash")).alias("short"), hashes.hash_path(F.col("hash"), "chunks/").alias("path"))
    return rows.withColumn("again", hashes.path_hash(F.col("path"), "chunks/"))


@query
def snapshot_totals(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).groupBy("snapshot").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count("*").alias("file_count"), F.max(F.octet_length("path")).cast("long").alias("path_width"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "snapshots").select(hashes.clean_hash(F.col("snapshot_id")).alias("snapshot"), "total_size", "file_count").where("snapshot is not null").distinct()
    return integrity.wrong_totals(rows, entries(spark, d))


@query
def snapshot_check(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots whose stated size or number of files is not that of their list."""
    return _totals(spark, d)


@query
def payload_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Stored form of the texts as one chunk each, unpacked again: whether it is whole, and larger by the flag at most."""
    rows = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    packed = rows.withColumn("stored", payload.encode_payload("data"))
    return packed.select("doc_id", (F.octet_length("stored") <= F.octet_length("data") + 1).alias("small"), payload.decode_payload("stored").eqNullSafe(F.col("data")).alias("whole"))


CDC = (256, 1024, 4096)


@query
def fastcdc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Content-defined chunks put together again: digest and size of the content, whether all chunks but the last are within
    the bounds, and whether every chunk has its digest."""
    files = table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    chunks = chunking.cdc_chunks(files, "doc_id", sizes=CDC).join(files, "doc_id")
    data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    parts = chunks.select("doc_id", "idx", "offset", "size", data.alias("data"), (hashes.digest(data) == F.col("hash")).alias("sound"), F.octet_length("content").alias("all"))
    last = F.col("offset") + F.col("size") == F.col("all")
    bounded = (F.col("size") <= CDC[2]) & (last | (F.col("size") >= CDC[0]))
    whole = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "data"))), lambda x: F.hex(x["data"])), ""))
    return parts.groupBy("doc_id").agg(hashes.digest(whole).alias("content_hash"), F.sum("size").alias("size"), F.bool_and(bounded).alias("bounded"), F.bool_and("sound").alias("sound"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Each document beside an edit of it: exclamation marks become full stops, a last line is added."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("old_text"))
    return rows.withColumn("new_text", F.concat(F.replace("old_text", F.lit("!"), F.lit(".")), F.lit("\nend\n")))


@query
def unified_diff(spark: SparkSession, d: str) -> DataFrame:
    """The diff of each document and its edit, applied to the old text: digest of the lines it gives."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = _versions(spark, d).select("doc_id", "old_text", textdiff.unified_diff(F.col("old_text"), F.col("new_text"), name, name).alias("diff"))
    return rows.select("doc_id", hashes.digest(F.encode(F.array_join(textdiff.patched("old_text", "diff"), "\n"), "utf-8")).alias("patched"))


@query
def diff_stat(spark: SparkSession, d: str) -> DataFrame:
    """Lines inserted less lines deleted, and the length of the bar."""
    rows = textdiff.stat(_versions(spark, d)).select("doc_id", F.col("inserted").cast("int"), F.col("deleted").cast("int"))
    bar = F.length(display.stat_bar(F.col("inserted"), F.col("deleted")))
    return rows.select("doc_id", (F.col("inserted") - F.col("deleted")).alias("net"), (bar == F.least(F.lit(10), F.col("inserted") + F.col("deleted"))).alias("bar_fits"))


@query
def auto_save_stream(spark: SparkSession, d: str) -> DataFrame:
    """Daily counters of the event stream, by a streaming query over the table's file."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    place = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    autosave.run_to_end(autosave.event_counts(events, late=None), f"{place}/state", f"{place}/out")
    return spark.read.parquet(f"{place}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _place(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _scan(files: DataFrame) -> DataFrame:
    return files.select("path", F.encode("text", "utf-8").alias("content"), "size", "mod_time", F.lit(0o644).alias("mode"))


@query
def store_files(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the files saved to a store, and read back from its chunks."""
    store = Store(spark, _place(spark, "store"))
    store.init()
    saved = [store.save(_scan(f(spark, d)), f"version {n}", "me", n) for n, f in enumerate((files_a, files_b))]
    rows = [store.contents(s).select(F.lit(n).alias("version"), "path", hashes.digest(F.col("content")).alias("content_hash")) for n, s in enumerate(saved)]
    return rows[0].unionByName(rows[1])


@query
def watch_stream(spark: SparkSession, d: str) -> DataFrame:
    """A watch over a stream of three scans, the last like the one before: its counters, and the automatic snapshots."""
    place = _place(spark, "watch")
    store = Store(spark, f"{place}/store")
    store.init()
    for n, f in enumerate((files_a, files_b, files_b)):
        _scan(f(spark, d)).withColumn("scanned_at", F.lit(n + 1).cast("long")).coalesce(1).write.mode("append").parquet(f"{place}/scans/n={n}")
    folder = f"{place}/scans"
    schema = spark.read.parquet(f"{folder}/n=0").schema
    for n in range(3):
        scans = spark.readStream.schema(schema).parquet(f"{folder}/n={n}")
        autosave.watch(scans, store, autosave.state_file(f"{place}/state.json"), f"{place}/checkpoint{n}", once=True, first=n).awaitTermination()
    state = autosave.WatchState.load(autosave.state_file(f"{place}/state.json"))
    found = store.read("snapshots").agg(F.count("*").alias("snapshots"), F.count_if(F.col("message").startswith(gc.AUTO)).alias("autos"))
    return found.select(F.lit(state.ticks).cast("long").alias("ticks"), F.lit(state.auto_saves).cast("long").alias("saves"), F.lit(state.errors).cast("long").alias("errors"), "snapshots", "autos")


@query
def ingest_files(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a save makes of the files, with the tier of their chunk sizes."""
    files = _scan(files_a(spark, d))
    made, chunks = Store(spark, "").prepare(files)
    return made.join(chunks.select("hash", F.octet_length("data").cast("long").alias("stored")), F.element_at("chunks", 1) == F.col("hash")).select("path", "file_hash", "size", F.size("chunks").cast("long").alias("n_chunks"), "mime", "stored")


@query
def save_merge(spark: SparkSession, d: str) -> DataFrame:
    """Whether a save has anything to store: for an edited and for an unchanged workspace."""
    rows = [diff.merge_saved(files_a(spark, d), f(spark, d))[1].select(F.lit(n).alias("workspace"), "changed") for n, f in (("edited", files_b), ("same", files_a))]
    return rows[0].unionByName(rows[1])


@query
def links_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Status of a workspace in which some files are symbolic links: they count as absent."""
    files = files_b(spark, d).withColumn("is_symlink", F.substring("file_hash", 4, 1) == "0")
    return diff.status(files_a(spark, d), files).groupBy("status").agg(F.count("*").alias("files"))


@query
def path_history(spark: SparkSession, d: str) -> DataFrame:
    """Of each path in each snapshot the hash it had in the snapshot before, by depth in its chain."""
    deep = lineage.depths(lineage.manifest(table(spark, d, "snapshots"))).select(F.col("id").alias("snapshot"), F.col("root").alias("chain"), "depth")
    rows = diff.path_history(entries(spark, d), deep)
    return rows.groupBy("chain").agg(F.count("*").alias("entries"), F.count_if(F.col("previous_hash").isNull()).alias("first_seen"), F.count_if(F.col("previous_hash") != F.col("file_hash")).alias("changed"))


@query
def version_refs(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots that version references name, over all stores of the table."""
    refs, manifests = table(spark, d, "refs"), lineage.manifest(table(spark, d, "snapshots"))
    found = [history.resolve(patterns.parse_version_ref(x), manifests, refs).select(F.lit(x).alias("version"), "id") for x in ("HEAD", "main", f"branch:{MAIN.removeprefix('heads/')}", "tag:v1", "id:0a1b")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query
def ref_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.ref_counts(table(spark, d, "refs"))


@query
def next_pack(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.format_string("pack-%06d", F.col("s_suppkey") * 7).alias("pack"))
    return gc.next_pack(names)


@query
def loose_chunks(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the stored chunks if all are loose."""
    return gc.loose_plan(gc.stored_chunks(table(spark, d, "chunks")), _gc(spark, d)[2])


@query
def durations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "check_runs").where("total_blocks is not null").select((F.col("total_blocks") * 360).alias("seconds")).distinct()
    return rows.select("seconds", display.duration_text(F.col("seconds")).alias("shown"))


@query
def dimension_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select((F.col("p_size") % 3).cast("long").alias("width"), (F.col("p_partkey") % 4).cast("long").alias("height")).distinct()
    return rows.select("width", "height", display.dimensions_text(F.col("width"), F.col("height")).alias("shown"))


def _plain(f: Callable[[str], object], kind: T.DataType) -> Callable[[Column], Column]:
    """A driver function as a column; null for an error."""

    def one(x: str) -> object:
        try:
            return f(x)
        except ValueError:
            return None

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s], dtype=object), kind)


@query
def archive_names(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "file_entries").where("path is not null").select("path").distinct()
    forms = F.array("path", *(F.concat(F.lit(x), "path") for x in ("/", "C:", "../", "../../", "a/../", "//C:/")))
    return raw.select(F.explode(forms).alias("path")).distinct().select("path", _plain(patterns.sanitised_entry, T.StringType())("path").alias("entry"))


@query
def normal_paths(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*(F.concat(F.lit(x), "path") for x in ("", "./", "x/../", "x//", "../", "/", "C:/", "x/../../")))
    return paths(spark, d).select(F.explode(forms).alias("path")).distinct().select("path", _plain(patterns.normal_path, T.StringType())("path").alias("normal"))


@query
def version_order(spark: SparkSession, d: str) -> DataFrame:
    """Semantic versions held against 25.5.3."""
    name = F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.col("p_partkey") % 7)
    rows = table(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "v").otherwise(""), name, F.when(F.col("p_partkey") % 3 == 0, "-rc.1").otherwise("")).alias("version")).distinct()
    return rows.select("version", _plain(lambda v: display.compare_versions(v, "25.5.3"), T.IntegerType())("version").alias("order"))


@query
def cdc_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Chunk sizes that a content-defined chunker takes for wished ones."""

    @F.pandas_udf("low long, mid long, high long")
    def clamp(low: pd.Series, mid: pd.Series, high: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chunking.clamp_cdc(int(a), int(b), int(c)) for a, b, c in zip(low, mid, high)], columns=["low", "mid", "high"])

    key = F.col("p_partkey").cast("long")
    rows = table(spark, d, "part").select((key * 37 % 9000 - 100).alias("a"), F.pow(F.lit(2), key % 15).cast("long").alias("b"), (key * 101 % 20000 - 500).alias("c")).distinct()
    return rows.withColumn("s", clamp("a", "b", "c")).select("a", "b", "c", "s.low", "s.mid", "s.high")


def _hex(n: Column, digits: int, little: bool = False) -> Column:
    text_ = F.lpad(F.hex(n.cast("long")), digits, "0")
    return text_ if not little else F.concat(*(F.substring(text_, i, 2) for i in range(digits - 1, 0, -2)))


def _image(kind: Column, width: Column, height: Column, tail: Column) -> Column:
    """Headers of images: PNG, GIF and BMP."""
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(width, 8), _hex(height, 8), F.lit("0806000000"))
    gif = F.concat(F.lit("474946383961"), _hex(width, 4, True), _hex(height, 4, True), F.lit("000000"))
    bmp = F.concat(F.lit("424D" + "00" * 8 + "3600000028000000"), _hex(width, 8, True), _hex(height, 8, True), F.lit("01001800" + "00" * 24))
    return F.unhex(F.concat(F.when(kind == 0, png).when(kind == 1, gif).otherwise(bmp), tail))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("kind"), (F.col("p_size") * 13).cast("long").alias("w"), (F.col("p_partkey") % 500 + 1).cast("long").alias("h"))


@query
def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).withColumn("content", _image(F.col("kind"), F.col("w"), F.col("h"), F.lit("")))
    size = engines.image_dimensions("content")
    return rows.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), engines.image_preview(F.col("content")).alias("preview"))


@query
def image_changes(spark: SparkSession, d: str) -> DataFrame:
    """Images against ones of another format, size, length or content."""
    k, how = F.col("kind"), F.col("p_partkey") % 5
    rows = _parts(spark, d).withColumn("old", _image(k, F.col("w"), F.col("h"), F.lit("00")))
    new = F.when(how == 0, F.col("old")).when(how == 1, _image((k + 1) % 3, F.col("w"), F.col("h"), F.lit("00"))).when(how == 2, _image(k, F.col("w") + 1, F.col("h"), F.lit("00")))
    new = new.when(how == 3, _image(k, F.col("w"), F.col("h"), F.lit("0000"))).otherwise(_image(k, F.col("w"), F.col("h"), F.lit("01")))
    rows = rows.withColumn("new", new)
    return rows.select("p_partkey", engines.image_diff(F.col("old"), F.col("new")).alias("image"), engines.binary_diff(F.col("old"), F.col("new")).alias("binary"))


@query
def video_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions from the boxes of MP4 headers, previews, and the comparison with a longer file."""
    head = F.lit("00000018667479706D703432000000006D70343269736F6D" + "0000006C6D6F6F76" + "000000647472616B" + "0000005C746B6864" + "00" * 76)
    content = F.unhex(F.concat(head, _hex(F.col("w"), 4), F.lit("0000"), _hex(F.col("h"), 4), F.lit("0000")))
    rows = _parts(spark, d).withColumn("content", content)
    size = engines.video_dimensions("content")
    length = F.octet_length("content").cast("long")
    return rows.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), engines.video_preview(F.col("content"), length).alias("preview"), engines.video_diff(length, length + F.col("p_partkey") % 2 * 1024).alias("diff"))


@query
def mime_types(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("path", engines.mime_of(engines.detect_engine(F.col("path"), F.lit(None).cast("binary"))).alias("mime"))


@query
def equal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text and its copy with other line ends have the same lines, and the stub of a diff that is not made."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.replace("text", F.lit("e"), F.lit("o")).alias("other"))
    name = F.col("doc_id").cast("string")
    ends = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return rows.select("doc_id", text.equal_lines(F.col("text"), F.when(F.col("text").contains("\r"), F.col("text")).otherwise(ends)).alias("same"), text.equal_lines(F.col("text"), F.col("other")).alias("edited_same"), text.differ_stub(name, name).alias("stub"))
