"""A version store on Parquet: tables in directories, and a log of commits that names the directories of each version.

Data files are written first; a commit is one small file, written aside and moved to its number, which fails if that is
taken: it either exists whole or not at all, and two writers can't take the same number. Readers take the last commit.
Chunk data is only appended; each append is a pack, which garbage collection rewrites if it has dead chunks. References
are a small table written anew by each commit, so they move last, with the commit itself.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import hashes, patterns
from cairn.functions.engines import CHUNK_SIZES, chunk_strategy, detect_engine, mime_of
from cairn.operators import chunking, diff, gc, lineage, sync
from cairn.session import cut

_ENTRY = "path string, mode bigint, size bigint, mod_time bigint, file_hash string, chunks array<string>, mime string, extra map<string,string>"
SCHEMAS = {
    "chunks": "hash string, size bigint, data binary",
    "snapshots": "snapshot_id string, prev_id string, message string, author string, ts bigint, tags array<string>, total_size bigint, file_count bigint",
    "file_entries": f"snapshot_id string, {_ENTRY}",
    "refs": "name string, type string, target string, symref string",
    "index_entries": "path string, file_hash string, size bigint, mod_time bigint, chunks array<string>",
}
MAIN = "heads/main"
#: Content-defined sizes by the name of their tier, as `tier` gives it; what is not here is one chunk.
SIZES = {"-".join(map(str, sizes)): sizes for sizes in CHUNK_SIZES}


class StoreError(Exception):
    """A refused operation; nothing was changed."""


class NothingToSave(StoreError):
    pass


@dataclass
class Store:
    """A store at a location that Spark can read and write (a local or a Hadoop path)."""

    spark: SparkSession
    root: str
    compress: bool = True
    level: int = 3

    # --- the log ---------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last commit, -1 before the first."""
        fs, log = self._fs(), self._path("commits")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def _state(self, version: int | None = None) -> dict[str, list[str]]:
        version = self.version() if version is None else version
        if version < 0:
            return {}
        line = self.spark.read.text(f"{self.root}/commits/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(line)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of the last, or a given, commit; empty where nothing was written."""
        schema = T._parse_datatype_string(SCHEMAS[name])
        places = self._state(version).get(name, [])
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in places))

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, keep: dict[str, list[str]] | None = None) -> int:
        """Write tables and then the commit that makes them visible; returns its number. keep: directories of a replaced
        table that stay beside what is written. StoreError if another writer took the number: the data written is then
        unreferenced."""
        version, kept = self.version(), keep or {}
        state = {k: list(kept.get(k, v)) for k, v in self._state(version).items()}
        for tables, appended in ((append or {}, True), (replace or {}, False)):
            for name, df in tables.items():
                place = f"tables/{name}/{uuid.uuid4().hex}"
                kinds = T._parse_datatype_string(SCHEMAS[name])
                written = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields)).write
                written = written.option("compression", "zstd" if self.compress else "none").option("parquet.compression.codec.zstd.level", self.level)
                written.parquet(f"{self.root}/{place}")
                state[name] = [*(state.get(name, []) if appended or name in kept else []), place]
        aside, target = self._path("commits", f".{uuid.uuid4().hex}"), self._path("commits", f"{version + 1:012d}.json")
        fs = self._fs()
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            taken = not self._move(aside, target)
        finally:
            fs.delete(aside, False)
        if taken:
            raise StoreError(f"another writer committed {version + 1}")
        return version + 1

    def _move(self, aside, target) -> bool:  # noqa: ANN001
        """Move a file to a name that must be free; false if it is not. A local file system would overwrite, so there the
        name is made by a link."""
        uri = self._fs().makeQualified(target).toUri()
        if uri.getScheme() == "file":
            try:
                os.link(self._fs().makeQualified(aside).toUri().getPath(), uri.getPath())
            except FileExistsError:
                return False
            return True
        return not self._fs().exists(target) and self._fs().rename(aside, target)

    def vacuum(self) -> int:
        """Delete what no table of the last commit names: replaced directories, those of writers that failed, and older
        commits, whose tables are gone then. Returns the bytes freed on disk."""
        fs, state, freed, version = self._fs(), self._state(), 0, self.version()
        named = {p for places in state.values() for p in places}
        for name in SCHEMAS:
            folder = self._path("tables", name)
            for found in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"tables/{name}/{found.getPath().getName()}" not in named:
                    freed += fs.getContentSummary(found.getPath()).getLength()
                    fs.delete(found.getPath(), True)
        for found in fs.listStatus(self._path("commits")):
            if found.getPath().getName() != f"{version:012d}.json":
                fs.delete(found.getPath(), False)
        return freed

    # --- references ------------------------------------------------------------------------------------------------

    def init(self) -> None:
        """HEAD on an empty main branch."""
        if self.version() >= 0:
            raise StoreError("the store exists")
        self.commit(replace={"refs": self._frame("refs", [(MAIN, "branch", None, None), ("HEAD", "HEAD", None, MAIN)])})

    def _frame(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, T._parse_datatype_string(SCHEMAS[name]))

    def refs(self) -> dict[str, tuple[str, str | None, str | None]]:
        """name: (type, target, symref). References are named by people; there are as many as people make."""
        return {r.name: (r.type, r.target, r.symref) for r in self.read("refs").collect()}

    def _write_refs(self, refs: dict[str, tuple[str, str | None, str | None]], **tables: dict[str, DataFrame]) -> int:
        rows = [(name, *rest) for name, rest in sorted(refs.items())]
        return self.commit(append=tables.get("append"), replace={**tables.get("replace", {}), "refs": self._frame("refs", rows)})

    def head(self) -> tuple[str | None, str | None]:
        """(branch reference HEAD stands on, snapshot); a detached HEAD has no branch."""
        refs = self.refs()
        name, hops = "HEAD", 0
        while name in refs and refs[name][2] and hops < 8:
            name, hops = refs[name][2], hops + 1
        return (name if name != "HEAD" else None), refs.get(name, (None, None, None))[1]

    def _valid(self, name: str) -> None:
        if not self.spark.range(1).select(patterns.is_ref_name(F.lit(name))).first()[0]:
            raise StoreError(f"no name for a reference: {name!r}")

    def create_branch(self, name: str) -> None:
        """A branch at the current snapshot."""
        refs, full = self.refs(), f"heads/{name}"
        self._valid(full)
        if full in refs:
            raise StoreError(f"branch {name} exists")
        self._write_refs(refs | {full: ("branch", self.head()[1], None)})

    def delete_branch(self, name: str) -> None:
        refs, full = self.refs(), f"heads/{name}"
        if full not in refs:
            raise StoreError(f"no branch {name}")
        if full in (MAIN, self.head()[0]):
            raise StoreError(f"branch {name} is the main or the current one")
        self._write_refs({k: v for k, v in refs.items() if k != full})

    def rename_branch(self, old: str, new: str) -> None:
        refs, a, b = self.refs(), f"heads/{old}", f"heads/{new}"
        self._valid(b)
        if a not in refs or b in refs or a == MAIN:
            raise StoreError(f"branch {old} can't become {new}")
        moved = {b if k == a else k: (t, target, b if symref == a else symref) for k, (t, target, symref) in refs.items()}
        self._write_refs(moved)

    def switch(self, name: str, create: bool = False) -> None:
        """Move HEAD to a branch; the index follows."""
        if create:
            self.create_branch(name)
        refs, full = self.refs(), f"heads/{name}"
        if full not in refs:
            raise StoreError(f"no branch {name}")
        refs["HEAD"] = ("HEAD", None, full)
        self._write_refs(refs, replace={"index_entries": self._index_of(refs[full][1])})

    def add_tag(self, name: str, snapshot: str | None = None) -> None:
        """A tag, its name in NFC, at a snapshot (the current one): it must exist and tags are not moved."""
        import unicodedata

        full, target = f"tags/{unicodedata.normalize('NFC', name)}", snapshot or self.head()[1]
        self._valid(full)
        refs = self.refs()
        if full in refs:
            raise StoreError(f"tag {name} exists")
        if target is None or self.read("snapshots").where(F.col("snapshot_id") == target).isEmpty():
            raise StoreError(f"no snapshot {target}")
        self._write_refs(refs | {full: ("tag", target, None)})

    def delete_tag(self, name: str) -> None:
        refs, full = self.refs(), f"tags/{name}"
        if full not in refs:
            raise StoreError(f"no tag {name}")
        self._write_refs({k: v for k, v in refs.items() if k != full})

    def rename_tag(self, old: str, new: str) -> None:
        refs, a, b = self.refs(), f"tags/{old}", f"tags/{new}"
        self._valid(b)
        if a not in refs or b in refs:
            raise StoreError(f"tag {old} can't become {new}")
        self._write_refs({b if k == a else k: v for k, v in refs.items()})

    def resolve(self, text: str) -> str:
        """The snapshot a version reference names; StoreError if none or several."""
        from cairn.operators.history import resolve

        try:
            ref = patterns.parse_version_ref(text)
        except ValueError as e:
            raise StoreError(str(e)) from e
        if ref.kind == "head":
            found = [self.head()[1]] if self.head()[1] else []
        else:
            found = [r.id for r in resolve(ref, self.read("snapshots").select(F.col("snapshot_id").alias("id")), self.read("refs")).limit(2).collect()]
        if len(found) != 1:
            raise StoreError(f"{'ambiguous' if found else 'not found'}: {text}")
        return found[0]

    # --- snapshots -------------------------------------------------------------------------------------------------

    def entries(self, snapshot: str | None) -> DataFrame:
        return self.read("file_entries").where(F.col("snapshot_id").eqNullSafe(snapshot)).drop("snapshot_id")

    def _index_of(self, snapshot: str | None) -> DataFrame:
        return self.entries(snapshot).select("path", "file_hash", "size", "mod_time", "chunks")

    def prepare(self, workspace: DataFrame, sizes: dict[str, tuple[int, int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
        """Entries and chunks (hash, size, data) of workspace files (path, content, mod_time). One pass chunks the files
        and hashes the chunks; lists of chunk hashes are put together per file."""
        # the type is told once a file, by a narrow table: its expression is long
        engine = detect_engine(F.col("path"), F.substring("content", 1, 512))
        typed = workspace.select("path", "content", engine.alias("_engine"))
        kind = F.col("_engine") if sizes else tier(F.col("_engine"), F.octet_length("content"))
        pieces = chunking.ingest(typed, "path", sizes or SIZES, kind)
        whole = chunking.with_file_hash(pieces, ["path"])
        rest = workspace.select("path", "mod_time", engine.alias("_engine"), *(["mode"] if "mode" in workspace.columns else []))
        mode = F.col("mode") if "mode" in workspace.columns else F.lit(0o644)
        entries = whole.join(rest, "path").select(
            "path", mode.cast("long").alias("mode"), "size", "mod_time", "file_hash", "chunks", mime_of(F.col("_engine")).alias("mime"), F.lit(None).cast("map<string,string>").alias("extra")
        )
        first = pieces.groupBy("hash").agg(F.min(F.struct("path", "offset", "size")).alias("p")).select("hash", "p.path", "p.offset", "p.size")
        data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
        chunks = first.join(workspace.select("path", "content"), "path").select("hash", "size", data.alias("data"))
        return entries, chunks

    def save(self, workspace: DataFrame, message: str, author: str, ts: int, tags: list[str] | None = None) -> str:
        """Store a workspace as a new snapshot on the current branch; NothingToSave if no file differs from the index."""
        branch, previous = self.head()
        entries, chunks = self.prepare(workspace)
        entries = cut(entries)  # files are read and chunked once; the lists outlive an executor
        _, changed = diff.merge_saved(self.read("index_entries"), entries)
        if not changed.first()[0]:
            raise NothingToSave
        stats = entries.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        row = self._frame("snapshots", [("", previous, message, author, ts, tags or [], stats[1], stats[0])])
        row = snapshot_ids(row, entries.withColumn("snapshot_id", F.lit(""))).withColumn("snapshot_id", F.col("real_id")).drop("real_id")
        snapshot = row.first().snapshot_id
        listed = entries.select(F.lit(snapshot).alias("snapshot_id"), "*")
        refs = self.refs()
        name = branch or "HEAD"
        refs[name] = (refs[name][0], snapshot, None)
        self._write_refs(
            refs,
            append={"chunks": chunking.new_chunks(chunks, self.read("chunks")), "file_entries": listed, "snapshots": row},
            replace={"index_entries": entries.select("path", "file_hash", "size", "mod_time", "chunks")},
        )
        return snapshot

    def undo(self, workspace: DataFrame | None = None) -> str:
        """Move the current branch back by one; refused at the first snapshot and for a changed workspace."""
        branch, current = self.head()
        row = self.read("snapshots").where(F.col("snapshot_id").eqNullSafe(current)).first()
        if branch is None or row is None or row.prev_id is None:
            raise StoreError("nothing to undo")
        if workspace is not None and not diff.status(self.read("index_entries"), workspace).isEmpty():
            raise StoreError("the workspace has changes")
        refs = self.refs()
        refs[branch] = ("branch", row.prev_id, None)
        self._write_refs(refs, replace={"index_entries": self._index_of(row.prev_id)})
        return row.prev_id

    def contents(self, snapshot: str, path: str | None = None) -> DataFrame:
        """Files of a snapshot with their content, put together from chunks: path, content, mode, mod_time."""
        entries = self.entries(snapshot) if path is None else self.entries(snapshot).where(F.col("path") == path)
        listed = entries.select("path", F.posexplode("chunks").alias("idx", "hash"))
        return entries.select("path", "mode", "mod_time").join(chunking.reassemble(listed, self.read("chunks"), ["path"]), "path", "left")

    def restored(self, snapshot: str) -> None:
        """Make a snapshot the current one after its files were written back; the index follows."""
        branch, _ = self.head()
        refs = self.refs()
        refs[branch or "HEAD"] = (refs[branch or "HEAD"][0], snapshot, None)
        self._write_refs(refs, replace={"index_entries": self._index_of(snapshot)})

    # --- garbage and remotes ---------------------------------------------------------------------------------------

    def collect_garbage(self, keep_autos: int = 0, dry_run: bool = False) -> dict[str, int]:
        """Drop what no reference reaches, but for the newest automatic snapshots; returns the counters."""
        manifests = self.read("snapshots").select(F.col("snapshot_id").alias("id"), F.col("prev_id").alias("parent"), "message", "ts")
        reached = lineage.reachable(manifests, gc.roots(self.read("refs")))
        lost = manifests.join(reached, "id", "left_anti")
        kept = gc.kept_autos(lost, keep_autos)
        held = reached.unionByName(kept.select("id"))
        live = gc.live_chunks(held, self.read("file_entries"), self.read("index_entries"))
        stored = self.read("chunks").withColumn("deleted_at", F.lit(None).cast("timestamp"))
        found = gc.report(lost, kept, gc.dead_chunks(stored, live)).first().asDict()
        found["bytes_on_disk"] = 0
        if not dry_run and (found["snapshots_removed"] or found["chunks_removed"]):
            ids = held.withColumnRenamed("id", "snapshot_id")
            replace = {name: self.read(name).join(ids, "snapshot_id", "left_semi") for name in ("snapshots", "file_entries")} if found["snapshots_removed"] else {}
            self._repack(live, {"drop", "rewrite", "keep"}, replace)
            found["bytes_on_disk"] = self.vacuum()
        return found

    def packs(self) -> DataFrame:
        """(pack, hash, length) of all stored chunks: a pack is what one append wrote, named by its directory."""
        frames = [self._pack(p).select(F.lit(p).alias("pack"), "hash", F.col("size").alias("length")) for p in self._state().get("chunks", [])]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], "pack string, hash string, length bigint")

    def _pack(self, place: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{self.root}/{place}")

    def _repack(self, live: DataFrame, actions: set[str], replace: dict[str, DataFrame]) -> dict[str, int]:
        """Write the live chunks of the packs whose plan is one of actions, if they have dead ones, as one new pack; the others stay
        as they are. Returns the number of packs by action."""
        plan = [r for r in gc.pack_plan(self.packs(), live).collect()]  # one row a pack
        old = {r.pack for r in plan if r.dead and r.action in actions}
        rewritten = [self._pack(p) for p in sorted(old) if p not in {r.pack for r in plan if r.action == "drop"}]
        kept = [p for p in self._state().get("chunks", []) if p not in old]
        tables = dict(replace)
        if rewritten:
            tables["chunks"] = sorted_chunks(reduce(DataFrame.unionByName, rewritten).join(live, "hash", "left_semi"))
        if tables or old:
            self.commit(replace=tables, keep={"chunks": kept} if old else None)
        return {a: sum(r.action == a for r in plan if r.pack in old) for a in ("drop", "rewrite")}

    def compact(self, dead_ratio: float = gc.DEAD_RATIO) -> dict[str, int]:
        """Drop packs without live chunks, rewrite those of which dead_ratio or more are dead, and write the many small
        packs (of fewer than LOOSE_LIMIT chunks) as one, if together they have more than that."""
        live = gc.live_chunks(self.read("snapshots").select(F.col("snapshot_id").alias("id")), self.read("file_entries"), self.read("index_entries"))
        counts = self._repack(live, {"drop", "rewrite"}, {})
        sizes = {r.pack: r.n for r in self.packs().groupBy("pack").agg(F.count("*").alias("n")).collect()}
        small = [p for p, n in sizes.items() if n < gc.LOOSE_LIMIT]
        packed = 0
        if len(small) > 1:
            loose = reduce(DataFrame.unionByName, map(self._pack, small))
            packed = gc.loose_plan(loose, live).first().loose_packed
            if packed:
                kept = [p for p in self._state()["chunks"] if p not in small]
                self.commit(replace={"chunks": sorted_chunks(loose.dropDuplicates(["hash"]))}, keep={"chunks": kept})
        return {"dropped": counts["drop"], "rewritten": counts["rewrite"], "loose_packed": packed, "bytes_on_disk": self.vacuum(), "version": self.version()}

    def corrupt_snapshots(self) -> DataFrame:
        """(snapshot_id) of snapshots whose id is not the digest of what they hold."""
        return snapshot_ids(self.read("snapshots"), self.read("file_entries")).where("snapshot_id != real_id").select("snapshot_id")

    def _scope(self, branch: str | None) -> tuple[DataFrame, DataFrame]:
        refs = self.read("refs").where("name != 'HEAD'")
        if branch is not None:
            refs = refs.where(F.col("name") == f"heads/{branch}")
        manifests = self.read("snapshots").select(F.col("snapshot_id").alias("id"), F.col("prev_id").alias("parent"))
        return refs, (manifests.select("id") if branch is None else lineage.reachable(manifests, gc.roots(refs)))

    def push(self, remote: Store, branch: str | None = None, dry_run: bool = False) -> dict[str, int]:
        """Copy what the other store lacks: chunks, snapshots and their files, then references, in one commit there.
        Refused if a reference has diverged. With a dry run the counters only."""
        refs, ids = self._scope(branch)
        manifests = self.read("snapshots").select(F.col("snapshot_id").alias("id"), F.col("prev_id").alias("parent"))
        moves = sync.classify_push(refs, remote.read("refs"), manifests, key="name")
        actions = {r.name: r.action for r in moves.select("name", "action").collect()}
        if "broken" in actions.values():
            raise StoreError("the history ends at a missing snapshot: " + ", ".join(sorted(n for n, a in actions.items() if a == "broken")))
        if "diverge" in actions.values():
            raise StoreError("diverged: " + ", ".join(sorted(n for n, a in actions.items() if a == "diverge")))
        return self._copy(remote, refs, ids, {n: n for n, a in actions.items() if a in ("create", "update")}, dry_run)

    def pull(self, remote: Store, branch: str | None = None, dry_run: bool = False) -> dict[str, int]:
        """Copy what this store lacks from the other. A diverged reference is kept beside the own one as `<name>.remote`."""
        refs, ids = remote._scope(branch)
        manifests = remote.read("snapshots").unionByName(self.read("snapshots")).select(F.col("snapshot_id").alias("id"), F.col("prev_id").alias("parent")).distinct()
        moves = sync.merge_pull(self.read("refs"), refs, manifests, key="name")
        names = {r.name: r.new_name for r in moves.where("action in ('create', 'forward', 'side')").collect()}
        _, before = self.head()
        counts = remote._copy(self, refs, ids, names, dry_run)
        if not dry_run and self.head()[1] != before:
            self.commit(replace={"index_entries": self._index_of(self.head()[1])})
        return counts

    def _copy(self, to: Store, refs: DataFrame, ids: DataFrame, names: dict[str, str], dry_run: bool) -> dict[str, int]:
        snapshots = self.read("snapshots").join(ids.withColumnRenamed("id", "snapshot_id"), "snapshot_id", "left_semi")
        new = sync.missing(snapshots, to.read("snapshots"), "snapshot_id")
        entries = self.read("file_entries").join(snapshots.select("snapshot_id"), "snapshot_id", "left_semi")
        used = entries.select(F.explode("chunks").alias("hash")).where("hash is not null").distinct()
        chunks = sync.missing(self.read("chunks").join(used, "hash", "left_semi").dropDuplicates(["hash"]), to.read("chunks"), "hash")
        counts = {"chunks": chunks.count(), "snapshots": new.count(), "refs": len(names)}
        if used.join(self.read("chunks"), "hash", "left_anti").join(to.read("chunks"), "hash", "left_anti").count():
            raise StoreError("a chunk of the scope is in neither store")
        if not dry_run and counts["chunks"] > chunking.sound(chunks).count():
            raise StoreError("the data of a chunk has another digest than its hash")
        if not dry_run and not snapshot_ids(new, entries).where("snapshot_id != real_id").isEmpty():
            raise StoreError("a snapshot does not hold what its id says")
        if not dry_run and any(counts.values()):
            targets = {r.name: (r.type, r.target, r.symref) for r in refs.collect()}
            moved = to.refs() | {new_name: targets[name] for name, new_name in names.items()}
            listed = entries.join(new.select("snapshot_id"), "snapshot_id", "left_semi")
            to._write_refs(moved, append={"chunks": chunks, "snapshots": new, "file_entries": listed})
        return counts


def tier(engine: Column, size: Column) -> Column:
    """Name of the chunk sizes that a file of a type and size gets; `whole` for one chunk."""
    sizes = F.to_csv(chunk_strategy(engine, size), {"sep": "-"})
    return F.when(sizes == "--", "whole").otherwise(sizes)


def sorted_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.repartitionByRange("hash").sortWithinPartitions("hash")


def snapshot_ids(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """snapshots with `real_id`: the digest of their parent, message, author, time, tags and files (snapshot_id, path, ...).

    The files go in as the digest of 4096 digests, each of the sorted digests of the rows in a bucket by their own digest,
    so their order is none and no list is gathered in one place."""
    extra, chunks = F.to_json(F.array_sort(F.map_entries("extra"))), F.array_join("chunks", ",", "-")
    row = F.to_json(F.struct("path", "mode", "size", "mod_time", "file_hash", chunks.alias("chunks"), "mime", extra.alias("extra")), {"ignoreNullFields": "false"})
    rows = entries.select("snapshot_id", hashes.digest(row).alias("row"))
    buckets = rows.groupBy("snapshot_id", F.substring("row", 1, 3).alias("bucket")).agg(hashes.digest(F.array_join(F.sort_array(F.collect_list("row")), "")).alias("part"))
    lists = buckets.groupBy("snapshot_id").agg(hashes.digest(F.array_join(F.sort_array(F.collect_list("part")), "")).alias("_files"))
    meta = F.to_json(F.struct("prev_id", "message", "author", "ts", "tags", F.coalesce("_files", F.lit("")).alias("files")), {"ignoreNullFields": "false"})
    return snapshots.join(lists, "snapshot_id", "left").withColumn("real_id", hashes.digest(meta)).drop("_files")
