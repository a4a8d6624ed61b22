"""The commands of a version store over a workspace: each takes a Project and returns rows or counters.

`python -m cairn <command>` prints them as one JSON envelope."""

from __future__ import annotations

import getpass
import json
import os
import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import display, engines
from cairn.functions.patterns import glob_match
from cairn.operators import diff, gc, history, integrity, lineage, textdiff
from cairn.sources import config, workspace
from cairn.sources.store import NothingToSave, Store, StoreError
from cairn.streaming import autosave

#: Exit codes: fine, other failure, usage, not found or refused, nothing to do.
OK, FAILED, USAGE, REFUSED, NOTHING = range(5)


@dataclass
class Project:
    """A workspace directory and its store, which is in the directory unless a location is given."""

    spark: SparkSession
    root: str
    location: str | None = None

    @property
    def store(self) -> Store:
        c = self.config
        return Store(self.spark, self.location or "file://" + os.path.join(os.path.abspath(self.root), workspace.STORE_DIR), c.compress, c.compression_level)

    def own(self, name: str) -> str:
        place = os.path.join(self.root, workspace.STORE_DIR)
        os.makedirs(place, exist_ok=True)
        return os.path.join(place, name)

    @property
    def config(self) -> config.Config:
        return config.load_config(self.own("config.json")).with_environment()

    @property
    def remotes(self) -> config.Remotes:
        return config.Remotes.load(self.own("remotes.json"))

    def files(self) -> DataFrame:
        """The workspace without symbolic links, which are not tracked."""
        return workspace.scan(self.spark, self.root).where(~F.col("is_symlink"))


def manifests(store: Store) -> DataFrame:
    rows = store.read("snapshots")
    return rows.select(F.col("snapshot_id").alias("id"), F.col("prev_id").alias("parent"), F.lit(0).alias("repo_id"), "message", "author", "ts", "tags", "total_size", "file_count")


def init(p: Project) -> dict[str, Any]:
    p.store.init()
    config.save_config(p.own("config.json"), p.config)
    return {"store": p.store.root}


def save(p: Project, message: str, tags: list[str] | None = None, now: int | None = None) -> dict[str, Any]:
    """A new snapshot, its counts of changes, and how many links were left out."""
    author = p.config.user_name or getpass.getuser()
    links = sum(x[4] for x in workspace.listing(p.root))
    snapshot = p.store.save(p.files(), message, author, int(time.time()) if now is None else now, tags)
    return {"id": snapshot, "symlinks": links, **changes(p, snapshot).groupBy().agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted"))).first().asDict()}


def changes(p: Project, snapshot: str) -> DataFrame:
    """What a snapshot changed against its parent: snapshot, path, status, old_size, new_size."""
    s = p.store
    pairs = s.read("snapshots").where(F.col("snapshot_id") == snapshot).select(F.col("snapshot_id").alias("snapshot"), F.col("prev_id").alias("previous"))
    return diff.parent_changes(s.read("file_entries").select(F.col("snapshot_id").alias("snapshot"), "path", "file_hash", "size"), pairs)


def status(p: Project) -> DataFrame:
    """Changes since the index was written, by size and time; contents are not read."""
    listed = p.spark.createDataFrame(workspace.listing(p.root), workspace._LISTED)
    return diff.status(p.store.read("index_entries"), listed).select("path", "status")


def log(p: Project, branch: str | None = None, show_all: bool = False, limit: int = 30) -> DataFrame:
    """History of the current or a named branch, or of all snapshots, newest first, with names and counts of changes."""
    s = p.store
    rows = manifests(s)
    deep = lineage.depths(rows)
    if not show_all:
        tip = s.resolve(branch) if branch else s.head()[1]
        tips = p.spark.createDataFrame([(tip,)], "id string")
        rows = rows.join(lineage.reachable(rows, tips), "id", "left_semi")
    newest = history.newest_first(history.visible(rows, show_all), deep, limit)
    entries = s.read("file_entries").select(F.col("snapshot_id").alias("snapshot"), "path", "file_hash", "size")
    counts = diff.change_counts(diff.parent_changes(entries, newest.select(F.col("id").alias("snapshot"), F.col("parent").alias("previous"))), ["snapshot"])
    full = history.decorate(newest, s.read("refs")).join(counts.withColumnRenamed("snapshot", "id"), "id", "left")
    n = [F.coalesce(c, F.lit(0)) for c in ("added", "modified", "deleted")]
    shown = full.select("id", "ts", "depth", display.minute_text(F.col("ts")).alias("time"), "author", "message", "branches", F.col("all_tags").alias("tags"), display.change_summary(*n).alias("changes"))
    return shown.orderBy(F.desc("ts"), F.desc("depth"), F.desc("id"))


def log_detail(p: Project, version: str) -> DataFrame:
    """Changed files of one snapshot with their sizes and, for text, their numbers of lines."""
    snapshot = p.store.resolve(version)
    now = p.store.contents(snapshot).select("path", F.col("content").cast("string").alias("text"), "content")
    rows = changes(p, snapshot).join(now, "path", "left")
    is_text = engines.detect_engine(F.col("path"), engines.header_of(F.col("content"))) == "text"
    lines = F.when(is_text, F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))
    return rows.select("path", "status", display.human_bytes(F.coalesce("new_size", "old_size")).alias("size"), lines.alias("lines")).orderBy("path")


def show(p: Project, version: str, path: str | None = None) -> DataFrame:
    """Files of a version with their types, or one file with its content."""
    s = p.store
    snapshot = s.resolve(version)
    if path is None:
        kind = engines.detect_engine(F.col("path"), F.lit(None).cast("binary"))
        return s.entries(snapshot).select("path", kind.alias("type"), "size", display.human_bytes(F.col("size")).alias("shown"), display.permission_text(F.col("mode")).alias("mode")).orderBy("path")
    rows = s.contents(snapshot, path)
    if rows.isEmpty():
        raise StoreError(f"no file {path} in {version}")
    engine = engines.detect_engine(F.col("path"), engines.header_of(F.col("content")))
    size = engines.image_dimensions("content")
    dims = F.when(engine == "image", display.dimensions_text(size["width"], size["height"]))
    return rows.select("path", engine.alias("type"), dims.alias("dimensions"), F.col("content").cast("string").alias("content"))


def _side(p: Project, version: str | None) -> DataFrame:
    """path, file_hash, size, content of a version, or of the workspace."""
    if version is None:
        files = p.files().select("path", "content", "mod_time", "mode")
        entries, _ = p.store.prepare(files)
        return entries.select("path", "file_hash", "size").join(files.select("path", "content"), "path")
    snapshot = p.store.resolve(version)
    return p.store.entries(snapshot).select("path", "file_hash", "size").join(p.store.contents(snapshot).select("path", "content"), "path")


def compare(p: Project, old: str = "head", new: str | None = None, path: str | None = None, stat: bool = False) -> DataFrame:
    """Differences of two versions, or of a version and the workspace: the list, line counts (stat), or one file's diff."""
    a, b = _side(p, old), _side(p, new)
    if path is not None:
        a, b = (x.where(F.col("path") == path) for x in (a, b))
    rows = diff.file_diff(a, b, diff.by_size_then_hash(), values=["file_hash", "size", "content"]).where("status != 'unchanged'")
    head = engines.header_of(F.coalesce("new_content", "old_content"))
    rows = rows.withColumn("type", engines.detect_engine(F.col("path"), head))
    if not stat and path is None:
        return rows.select("path", "status", "old_size", "new_size").orderBy("path")
    texts = [F.when(F.col("type") == "text", F.col(c).cast("string")).alias(n) for c, n in (("old_content", "old_text"), ("new_content", "new_text"))]
    if stat:
        counted = textdiff.stat(rows.select("path", "status", "type", *texts))
        return counted.select("path", "status", "type", "inserted", "deleted", display.stat_bar(F.col("inserted"), F.col("deleted")).alias("bar")).orderBy("path")
    body = (
        F.when(F.col("type") == "text", textdiff.unified_diff(F.col("old_content").cast("string"), F.col("new_content").cast("string"), F.col("path"), F.col("path")))
        .when((F.col("type") == "image") & (F.col("status") == "modified"), engines.image_diff(F.col("old_content"), F.col("new_content")))
        .when((F.col("type") == "video") & (F.col("status") == "modified"), engines.video_diff(F.col("old_size"), F.col("new_size")))
        .otherwise(engines.binary_diff(F.col("old_content"), F.col("new_content")))
    )
    return rows.select("path", "status", "type", body.alias("diff"))


def check(p: Project, pattern: str | None = None, verbose: bool = False) -> dict[str, Any]:
    """Integrity of all stored content, or of the files a glob matches, and the number of unreachable snapshots."""
    s = p.store
    entries = s.read("file_entries")
    if pattern:
        entries = entries.where(glob_match(F.col("path"), pattern))
    used = integrity.file_chunks(entries, ["snapshot_id", "path"])
    states = integrity.chunk_states(used, s.read("chunks"))
    found = integrity.report(states, integrity.hash_mismatches(entries), s.corrupt_snapshots()).first().asDict()
    found["unreachable_snapshots"] = gc.unreachable(manifests(s), s.read("refs")).count()
    if verbose:
        found["bad"] = [r.asDict() for r in integrity.verbose(used, states).where("state != 'OK'").collect()]
    return found


def restore(p: Project, version: str, path: str | None = None, backup: bool = True) -> dict[str, Any]:
    """Write a version's files, or one of them, into the workspace. A changed workspace is saved first; extras are deleted
    only if every file was written, and the references move last."""
    s = p.store
    snapshot, saved = s.resolve(version), None
    if backup and path is None:
        try:
            saved = s.save(p.files(), f"{gc.AUTO} backup before restore", p.config.user_name or getpass.getuser(), int(time.time()))
        except NothingToSave:
            pass
    plan = diff.restore_plan(_side(p, None), _side(p, snapshot and f"id:{snapshot}"))
    steps = {r.path: r.action for r in plan.collect() if path is None or r.path == path}
    wanted = p.spark.createDataFrame([(k,) for k, v in steps.items() if v != "delete"], "path string")
    errors = [r.error for r in workspace.restore(s.contents(snapshot).join(wanted, "path"), p.root).collect() if r.error]
    if errors:
        raise StoreError("; ".join(errors))
    if path is None:
        workspace.delete_extras([k for k, v in steps.items() if v == "delete"], p.root)
        s.restored(snapshot)
    return {"id": snapshot, "backup": saved, "files": len(steps)}


def switch(p: Project, name: str, create: bool = False, autosave: bool = True) -> dict[str, Any]:
    """Change the branch: the workspace is saved on the old one, HEAD moves, files follow."""
    if autosave and not create:
        try:
            p.store.save(p.files(), f"{gc.AUTO} before switching", p.config.user_name or getpass.getuser(), int(time.time()))
        except NothingToSave:
            pass
    p.store.switch(name, create)
    target = p.store.head()[1]
    return {"branch": name, "files": 0 if create or target is None else restore(p, f"id:{target}", backup=False)["files"]}


def import_file(p: Project, branch: str, path: str) -> dict[str, Any]:
    """One file of a branch into the workspace; the index stays as it is."""
    rows = p.store.contents(p.store.resolve(f"branch:{branch}"), path)
    results = workspace.restore(rows, p.root).collect()
    if not results or results[0].error:
        raise StoreError(results[0].error if results else f"no file {path} on {branch}")
    return {"path": path}


def export(p: Project, version: str, output: str) -> dict[str, Any]:
    return {"entries": workspace.export_zip(p.store.contents(p.store.resolve(version)), output)}


def watch(p: Project, action: str, ticks: int | None = None, interval: float | None = None) -> dict[str, Any]:
    """Automatic snapshots: `on` saves a changed workspace at every interval, in the foreground, until `off` (or for so many
    ticks), one watch a workspace; `pause`, `resume` and `status` work on its state from elsewhere."""
    state, lock, stop = p.own("watch.json"), p.own("watch.lock"), p.own("watch.stop")
    if action in ("pause", "resume"):
        autosave.set_paused(state, action == "pause")
    elif action == "off":
        open(stop, "w").close()
    elif action == "on":
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError as e:
            raise StoreError(f"a watch is running, or ended without leaving: {lock}") from e
        try:
            if os.path.exists(stop):
                os.remove(stop)
            number, wait = autosave.WatchState.load(state).last_batch, p.config.watch_interval if interval is None else interval
            while ticks is None or ticks > 0:
                number, ticks = number + 1, None if ticks is None else ticks - 1
                autosave.tick(p.store, p.files(), number, int(time.time()), state, p.config.keep_autos)
                until = time.time() + wait
                while time.time() < until and not os.path.exists(stop):
                    time.sleep(min(0.5, wait))
                if os.path.exists(stop):
                    break
        finally:
            os.remove(lock)
    return {"running": os.path.exists(lock)} | vars(autosave.WatchState.load(state))


def ls_remote(p: Project, remote: str | None = None) -> DataFrame:
    return Store(p.spark, p.remotes.find(remote)).read("refs").orderBy("name")


def transfer(p: Project, how: str, remote: str | None = None, branch: str | None = None, everything: bool = False, dry_run: bool = False) -> dict[str, Any]:
    """push or pull, of the current branch unless told otherwise."""
    s, other = p.store, Store(p.spark, p.remotes.find(remote))
    name = None if everything else branch or (s.head()[0] or "").removeprefix("heads/") or None
    return getattr(s, how)(other, name, dry_run)


def clone(p: Project, location: str) -> dict[str, Any]:
    """A new store with all of another one's; counts of what came and of its branches and tags."""
    p.store.init()
    remotes = p.remotes
    remotes.add("origin", location)
    remotes.save(p.own("remotes.json"))
    counts = p.store.pull(Store(p.spark, location))
    return counts | history.ref_counts(p.store.read("refs")).first().asDict()


def envelope(command: str, data: Any = None, error: str | None = None, hint: str | None = None, status: str | None = None, detail: str | None = None) -> str:
    """The one form of all answers: command, status (ok, failed, warning or active), error, and error_detail if there is
    one, or data, and a hint that is null if there is none."""
    body: dict[str, Any] = {"command": command, "status": status or ("failed" if error else "ok")}
    body |= {k: v for k, v in (("error", error), ("error_detail", detail)) if v} if error else {"data": data}
    return json.dumps(body | {"hint": hint}, ensure_ascii=False, default=str, separators=(",", ":"))


def rows_of(result: Any) -> Any:
    """A result as plain values: listings are bounded by the terminal that asked for them."""
    return [r.asDict(recursive=True) for r in result.collect()] if isinstance(result, DataFrame) else result
