import json

import pytest

from cairn.__main__ import main


@pytest.fixture
def cairn(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("CAIRN_USER_NAME", "tester")
    root = tmp_path / "ws"
    root.mkdir()

    def call(*argv, code=0, cwd=root):
        capsys.readouterr()
        assert main(["--cwd", str(cwd), *argv], spark) == code
        answer = json.loads(capsys.readouterr().out)
        assert answer["command"] == argv[0] and answer["status"] == ("failed" if code else "ok") and "hint" in answer
        return answer.get("data", answer.get("error"))

    call.root = root
    return call


def test_session(cairn, tmp_path):
    root = cairn.root
    cairn("init")
    cairn("init", code=3)
    (root / "a.txt").write_text("one\ntwo\n")
    (root / "b.bin").write_bytes(bytes(range(256)))
    (root / "skip.tmp").write_text("x")
    assert cairn("ignore", "add", "*.tmp") == ["*.tmp"] and cairn("ignore", "list") == ["*.tmp"]
    first = cairn("save", "first", "--tag", "t0")
    assert (first["added"], first["modified"], first["deleted"]) == (3, 0, 0)
    cairn("save", "again", code=4)
    (root / "a.txt").write_text("one\nTWO\nthree\n")
    (root / "b.bin").unlink()
    assert {r["path"]: r["status"] for r in cairn("status")} == {"a.txt": "modified", "b.bin": "deleted"}
    assert {r["path"]: r["status"] for r in cairn("diff")} == {"a.txt": "modified", "b.bin": "deleted"}
    assert "-two\n+TWO\n+three\n" in cairn("diff", "--file", "a.txt")[0]["diff"]
    second = cairn("save", "second")
    assert [r["changes"] for r in cairn("log")] == ["~1 -1", "+3"] and cairn("log")[0]["branches"] == ["main"] and cairn("log")[1]["tags"] == ["t0"]
    assert {r["path"]: (r["status"], r["lines"]) for r in cairn("log", "--detail", "head")} == {"a.txt": ("modified", 3), "b.bin": ("deleted", None)}
    stat = {r["path"]: (r["inserted"], r["deleted"]) for r in cairn("diff", f"id:{first['id']}", "head", "--stat")}
    assert stat["a.txt"] == (2, 1)
    assert [r["type"] for r in cairn("show", "head")] == ["text", "text"] or len(cairn("show", "head")) == 2
    assert cairn("show", "head", "a.txt")[0]["content"] == "one\nTWO\nthree\n"
    cairn("show", "head", "none", code=3)

    cairn("branch", "add", "dev")
    cairn("tag", "add", "v1", first["id"])
    assert cairn("tag", "list")[0]["tag"] == "v1" and cairn("branch", "list")["branches"] == ["heads/dev", "heads/main"]
    assert cairn("resolve", "tag:v1") == first["id"]
    assert cairn("restore", "tag:v1")["files"] == 2 and (root / "a.txt").read_text() == "one\ntwo\n" and (root / "b.bin").exists()
    assert cairn("switch", "dev")["branch"] == "dev" and (root / "a.txt").read_text() == "one\nTWO\nthree\n" and not (root / "b.bin").exists()
    cairn("import", "main", "b.bin")
    assert (root / "b.bin").read_bytes() == bytes(range(256))
    assert cairn("check")["missing"] == 0 and cairn("check", "--filter", "*.txt")["total_blocks"] < cairn("check", "--verbose")["total_blocks"]
    assert cairn("export", "head", str(tmp_path / "x.zip"))["entries"] == 2

    remote = f"file://{tmp_path}/remote"
    from cairn.sources.store import Store

    cairn("remote", "add", "origin", remote)
    cairn("remote", "add", "bad", "http://x", code=2)
    assert cairn("remote", "list") == {"origin": remote}
    from pyspark.sql import SparkSession

    Store(SparkSession.getActiveSession(), remote).init()
    assert cairn("push", "--dry-run", "--all")["snapshots"] >= 2 and cairn("push", "--all")["refs"] >= 3 and cairn("push", "--all")["chunks"] == 0
    other = tmp_path / "other"
    other.mkdir()
    got = cairn("clone", remote, cwd=other)
    assert got["branches"] >= 2 and got["tags"] == 1
    assert cairn("ls-remote")[0]["name"] == "HEAD"
    cairn("config", "set", "user.name", "x")
    assert cairn("config", "get", "user.email") == ""
    cairn("config", "set", "core.x", "y", code=3)
    cairn("undo", code=3)
    assert cairn("gc", "--dry-run")["chunks_removed"] == 0 and second["id"] == cairn("resolve", "dev")


def test_watch(cairn):
    """Ticks save a changed workspace; a paused watch does not; there is one watch at a time."""
    cairn("init")
    (cairn.root / "a.txt").write_text("one\n")
    state = cairn("watch", "on", "--ticks", "2", "--interval", "0")
    assert (state["ticks"], state["auto_saves"], state["errors"], state["running"]) == (2, 1, 0, False)
    assert cairn("watch", "pause")["paused"] and (cairn.root / "a.txt").write_text("two\n")
    assert cairn("watch", "on", "--ticks", "1", "--interval", "0")["auto_saves"] == 1
    assert not cairn("watch", "resume")["paused"] and cairn("watch", "status")["ticks"] == 2
    cairn("watch", "off")
    assert cairn("watch", "on", "--ticks", "1", "--interval", "0")["auto_saves"] == 2
    (cairn.root / ".cairn" / "watch.lock").touch()
    cairn("watch", "on", code=3)


def test_errors_tell_their_cause_if_asked(spark, tmp_path, capsys):
    assert main(["--cwd", str(tmp_path), "--verbose", "resolve", "head"], spark) == 3
    assert json.loads(capsys.readouterr().out)["error_detail"] == "StoreError"
