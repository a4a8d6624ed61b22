import os
import zipfile

import pytest

from cairn.sources import config, workspace
from cairn.sources.store import NothingToSave, Store, StoreError
from cairn.streaming import autosave


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "ws"
    (root / "foo").mkdir(parents=True)
    (root / "hello.txt").write_text("Hello World")
    (root / "foo" / "bar +%20é.go").write_text("package bar\n")
    (root / "empty").write_text("")
    (root / "x.tmp").write_text("t")
    (root / "build").mkdir()
    (root / "build" / "out.c").write_text("int x;")
    (root / ".cairnignore").write_text("*.tmp\nbuild/\n!build/out.c\n")
    os.symlink(root / "hello.txt", root / "link")
    return tmp_path


def files(df):
    return {r.path: r.content and bytes(r.content) for r in df.select("path", "content").collect()}


def regular(spark, place):
    return workspace.scan(spark, str(place / "ws")).where("not is_symlink")


def test_scan(spark, place):
    df = workspace.scan(spark, str(place / "ws"))
    assert [x[0] for x in workspace.listing(str(place / "ws"))] == [".cairnignore", "empty", "foo/bar +%20é.go", "hello.txt", "link"]
    assert files(df)["hello.txt"] == b"Hello World" and files(df)["link"] is None and df.where("is_symlink").count() == 1
    assert {r.path for r in workspace.scan_objects(spark, str(place / "ws")).select("path").collect()} >= {"hello.txt", "foo/bar +%20é.go"}


def test_ignore_files(place):
    path = str(place / "rules")
    assert workspace.add_ignore_rules(path, ["*.a", "*.b", "*.a", " "]) == ["*.a", "*.b"] and workspace.add_ignore_rules(path, ["*.b", "*.c"]) == ["*.c"]
    assert workspace.remove_ignore_rule(path, "*.b") and not workspace.remove_ignore_rule(path, "*.b") and open(path).read() == "*.a\n*.c\n"
    assert not workspace.remove_ignore_rule(str(place / "none"), "x")


def test_life_of_a_store(spark, place):
    s = Store(spark, str(place / "store"))
    assert s.version() == -1 and s.read("chunks").collect() == []
    s.init()
    with pytest.raises(StoreError):
        s.init()
    first = s.save(regular(spark, place), "first", "me", 100)
    assert s.head() == ("heads/main", first) and s.read("index_entries").count() == 4
    with pytest.raises(NothingToSave):
        s.save(regular(spark, place), "again", "me", 101)
    (place / "ws" / "hello.txt").write_text("Hello again")
    second = s.save(regular(spark, place), "second", "me", 102, ["t"])
    row = s.read("snapshots").where(f"snapshot_id = '{second}'").first()
    assert row.prev_id == first and row.tags == ["t"] and row.file_count == 4
    assert files(s.contents(second))["hello.txt"] == b"Hello again" and files(s.contents(first, "hello.txt")) == {"hello.txt": b"Hello World"}

    s.create_branch("dev")
    s.add_tag("v1")
    for bad in (lambda: s.create_branch("dev"), lambda: s.create_branch("a b"), lambda: s.add_tag("v1"), lambda: s.add_tag("x", "0" * 64), lambda: s.delete_branch("main"), lambda: s.rename_branch("main", "x"), lambda: s.resolve("id:ffffffffff"), lambda: s.resolve("what:x")):
        with pytest.raises(StoreError):
            bad()
    assert s.resolve("dev") == s.resolve("tag:v1") == s.resolve("head") == second and s.resolve(f"id:{first[:6]}") == first
    s.rename_branch("dev", "next")
    s.rename_tag("v1", "v2")
    s.switch("next")
    assert s.head() == ("heads/next", second)
    with pytest.raises(StoreError):
        s.delete_branch("next")
    s.switch("main")

    remote = Store(spark, str(place / "remote"))
    remote.init()
    assert s.push(remote, dry_run=True)["chunks"] == 5 and remote.read("chunks").count() == 0
    assert s.push(remote) == {"chunks": 5, "snapshots": 2, "refs": 3} and s.push(remote) == {"chunks": 0, "snapshots": 0, "refs": 0}

    assert s.undo() == first
    with pytest.raises(StoreError):
        s.undo()
    assert s.collect_garbage()["snapshots_removed"] == 0
    s.delete_tag("v2")
    s.delete_branch("next")
    counts = {"snapshots_removed": 1, "autos_kept": 0, "chunks_removed": 1, "bytes_freed": 11}
    assert s.collect_garbage(dry_run=True) == counts | {"bytes_on_disk": 0} and s.collect_garbage().items() >= counts.items()
    assert s.collect_garbage()["chunks_removed"] == 0
    s.compact()
    assert s.pull(remote)["snapshots"] == 1 and s.head()[1] == second and files(s.contents(second))["hello.txt"] == b"Hello again"

    other = Store(spark, str(place / "remote"))
    (place / "ws" / "hello.txt").write_text("ours")
    mine = s.save(regular(spark, place), "ours", "me", 103)
    (place / "ws" / "hello.txt").write_text("theirs")
    theirs = other.save(regular(spark, place), "theirs", "you", 104)
    with pytest.raises(StoreError):
        s.push(other)
    s.pull(other)
    assert s.refs()["heads/main"][1] == mine and s.refs()["heads/main.remote"][1] == theirs
    (place / "ws" / "hello.txt").write_text("theirs again")
    again = other.save(regular(spark, place), "theirs again", "you", 105)
    s.pull(other)
    assert s.refs()["heads/main.remote"][1] == theirs and s.refs()[f"heads/main.remote.{again[:8]}"][1] == again
    assert s.corrupt_snapshots().collect() == []


def disk(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def test_garbage_leaves_the_disk(spark, place):
    """What is collected is deleted: bytes on disk fall by at least the bytes freed."""
    s = Store(spark, str(place / "store"))
    s.init()
    (place / "ws" / "big").write_bytes(os.urandom(300_000))
    s.save(regular(spark, place), "with", "me", 1)
    (place / "ws" / "big").unlink()
    kept = s.save(regular(spark, place), "without", "me", 2)
    refs = s.refs()
    refs["heads/main"] = ("branch", kept, None)
    snapshots = s.read("snapshots").where(f"snapshot_id = '{kept}'").selectExpr("snapshot_id", "cast(null as string) prev_id", "message", "author", "ts", "tags", "total_size", "file_count")
    s.commit(replace={"snapshots": snapshots})
    before = disk(place / "store")
    found = s.collect_garbage()
    assert found["bytes_freed"] == 300_000 and found["bytes_on_disk"] >= 300_000 and disk(place / "store") <= before - 300_000
    assert files(s.contents(kept))["hello.txt"] == b"Hello World"


def damaged(store):
    """The store with one byte of a chunk turned."""
    chunks = store.read("chunks").selectExpr("hash", "size", "case when size = 11 then cast('Hello Worlt' as binary) else data end as data")
    store.commit(replace={"chunks": chunks})


def test_corrupt_data_is_not_handed_out(spark, place, tmp_path):
    s, other = Store(spark, str(place / "store")), Store(spark, str(place / "other"))
    s.init()
    other.init()
    first = s.save(regular(spark, place), "first", "me", 1)
    damaged(s)
    assert files(s.contents(first))["hello.txt"] is None and files(s.contents(first))["empty"] == b""
    errors = {r.path: r.error for r in workspace.restore(s.contents(first), str(tmp_path / "out")).collect()}
    assert "missing" in errors["hello.txt"] and errors["empty"] is None
    with pytest.raises(StoreError):
        other.pull(s)
    assert other.read("chunks").isEmpty() and other.read("snapshots").isEmpty()


def test_a_snapshot_is_what_its_id_says(spark, place):
    s = Store(spark, str(place / "store"))
    s.init()
    first = s.save(regular(spark, place), "first", "me", 1)
    assert s.corrupt_snapshots().collect() == []
    changed = s.read("file_entries").selectExpr("snapshot_id", "path", "mode", "size + 1 as size", "mod_time", "file_hash", "chunks", "mime", "extra")
    s.commit(replace={"file_entries": changed})
    assert [r.snapshot_id for r in s.corrupt_snapshots().collect()] == [first]


def test_two_writers(spark, place):
    a, b = Store(spark, str(place / "store")), Store(spark, str(place / "store"))
    a.init()
    b.version = lambda: -1
    with pytest.raises(StoreError):
        b.commit()
    assert sorted(p.name for p in (place / "store" / "commits").iterdir() if p.suffix != ".crc") == ["000000000000.json"]


def test_restore_and_export(spark, place):
    s = Store(spark, str(place / "store"))
    s.init()
    first = s.save(regular(spark, place), "first", "me", 100)
    out = place / "out"
    (out / "old").mkdir(parents=True)
    (out / "old" / "x").write_text("x")
    assert [r.error for r in workspace.restore(s.contents(first), str(out)).collect()] == [None] * 4
    workspace.delete_extras(["old/x"], str(out))
    assert sorted(os.listdir(out)) == [".cairnignore", "empty", "foo", "hello.txt"] and (out / "hello.txt").read_text() == "Hello World"
    assert (out / "hello.txt").stat().st_mtime_ns == (place / "ws" / "hello.txt").stat().st_mtime_ns
    bad = spark.createDataFrame([("../x", b"a", 420, 1), ("/etc/x", b"a", 420, 1), ("y", None, None, None), ("z", b"z", None, None)], "path string, content binary, mode bigint, mod_time bigint")
    assert {r.path: r.error is None for r in workspace.restore(bad, str(out)).collect()} == {"../x": False, "/etc/x": False, "y": False, "z": True}
    assert workspace.export_zip(s.contents(first).unionByName(bad.limit(1)), str(place / "x.zip")) == 5
    with zipfile.ZipFile(place / "x.zip") as z:
        assert z.read("hello.txt") == b"Hello World" and "x" in z.namelist()


def test_watch(spark, place):
    s, state, scans = Store(spark, str(place / "store")), str(place / "state.json"), str(place / "scans")
    s.init()

    def tick(ts, wait=True):
        df = regular(spark, place).selectExpr("path", "content", "size", "mod_time", f"{ts} as scanned_at")
        df.coalesce(1).write.mode("append").parquet(scans)
        stream = spark.readStream.schema(df.schema).parquet(scans)
        autosave.watch(stream, s, state, str(place / "check"), keep=2, once=True).awaitTermination()
        return autosave.WatchState.load(state)

    assert (tick(100).auto_saves, autosave.WatchState.load(state).ticks) == (1, 1)
    assert tick(101).auto_saves == 1
    (place / "ws" / "hello.txt").write_text("new")
    assert tick(102).auto_saves == 2 and s.read("snapshots").count() == 2
    autosave.set_paused(state, True)
    (place / "ws" / "hello.txt").write_text("newer")
    assert tick(103).auto_saves == 2
    autosave.set_paused(state, False)
    assert tick(104).auto_saves == 3 and autosave.WatchState.load(state).errors == 0
    assert autosave.tick(s, regular(spark, place), 0, 1, state).auto_saves == 3  # an old batch is not done again


def test_event_counts(spark, tmp_path):
    df = spark.createDataFrame([("2025-01-01 10:00:00", "a"), ("2025-01-01 11:00:00", "a"), ("2025-01-02 01:00:00", "b"), (None, "c")], "t string, event_type string").selectExpr("cast(t as timestamp) ts", "event_type")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    autosave.run_to_end(autosave.event_counts(stream, late=None), str(tmp_path / "s"), str(tmp_path / "o"))
    assert sorted((str(r.start)[:10], r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [("2025-01-01", "a", 2), ("2025-01-02", "b", 1)]


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load_config(path) == config.Config()
    config.save_config(path, config.Config(compression_level=99, watch_interval=1).set("user.name", "me"))
    loaded = config.load_config(path)
    assert (loaded.compression_level, loaded.watch_interval, loaded.get("user.name")) == (19, 10, "me")
    assert loaded.with_environment({"CAIRN_USER_NAME": "x"}).user_name == "x"
    with pytest.raises(KeyError):
        loaded.set("core.x", "y")
    with pytest.raises(ValueError):
        config.Config(version=2).validate()
    remotes = config.Remotes()
    remotes.add("origin", "file:///x")
    with pytest.raises(ValueError):
        remotes.add("bad", "http://x")
    remotes.save(path)
    assert config.Remotes.load(path).find() == "file:///x"
    remotes.rename("origin", "o")
    remotes.remove("o")
    with pytest.raises(KeyError):
        remotes.find("o")
