"""python -m cairn COMMAND ...: the commands of cairn.commands on the current directory, answers as JSON."""

from __future__ import annotations

import argparse
import os
import sys

from cairn import __version__, commands
from cairn.functions.patterns import parse_ignore
from cairn.operators.history import tag_list
from cairn.session import local_session
from cairn.sources import config, workspace
from cairn.sources.store import NothingToSave, StoreError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairn")
    top.add_argument("--cwd", default=".")
    top.add_argument("--store", help="location of the store, if it is not in the directory")
    top.add_argument("--quiet", action="store_true", help="no output where all went well")
    top.add_argument("--json", action="store_true", help="answers are JSON; there is no other form")
    top.add_argument("--verbose", action="store_true", help="errors with the cause that lies under them")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        one = sub.add_parser(name)
        for names, options in arguments:
            one.add_argument(*names.split(), **options)

    flag, many, maybe = {"action": "store_true"}, {"nargs": "*"}, {"nargs": "?"}
    add("init")
    add("save", ("message", {}), ("--tag", {"action": "append"}))
    add("status")
    add("log", ("--branch", {}), ("--all", flag), ("--limit", {"type": int, "default": 30}), ("--detail", {}))
    add("show", ("version", {}), ("path", maybe))
    add("diff", ("old", {"nargs": "?", "default": "head"}), ("new", maybe), ("--file", {}), ("--stat", flag))
    add("check", ("--filter", {}), ("--verbose", flag))
    add("gc", ("--dry-run", flag), ("--keep-auto", {"type": int, "default": 0}))
    add("compact")
    add("undo")
    add("restore", ("version", {}), ("path", maybe), ("--no-backup", flag))
    add("resolve", ("version", {}))
    add("branch", ("action", {"choices": ["add", "delete", "rename", "list"]}), ("names", many))
    add("tag", ("action", {"choices": ["add", "delete", "rename", "list"]}), ("names", many))
    add("switch", ("name", {}), ("-c --create", flag), ("--no-autosave", flag))
    add("export", ("version", {}), ("output", {}))
    add("import", ("branch", {}), ("path", {}))
    add("remote", ("action", {"choices": ["add", "remove", "rename", "set-url", "list", "show", "test"]}), ("names", many), ("--insecure", flag))
    for name in ("push", "pull"):
        add(name, ("remote", maybe), ("--branch", {}), ("--all", flag), ("--dry-run", flag))
    add("clone", ("location", {}))
    add("ls-remote", ("remote", maybe))
    add("ignore", ("action", {"choices": ["add", "remove", "list"]}), ("rules", many))
    add("config", ("action", {"choices": ["get", "set", "list"]}), ("names", many))
    add("watch", ("action", {"choices": ["on", "off", "status", "pause", "resume"]}), ("--ticks", {"type": int}), ("--interval", {"type": float}))
    add("version")
    return top


def run(p: commands.Project, a: argparse.Namespace) -> object:
    c, s = a.command, p.store
    if c in ("branch", "tag"):
        if a.action == "list":
            return tag_list(s.read("refs").selectExpr("0 ref_id", "*"), commands.manifests(s)).drop("ref_id") if c == "tag" else {"current": s.head()[0], "branches": sorted(n for n in s.refs() if n.startswith("heads/"))}
        verb = {"add": "create" if c == "branch" else "add"}.get(a.action, a.action)
        return getattr(s, f"{verb}_{c}")(*a.names)
    if c == "remote":
        remotes = p.remotes
        if a.action in ("list", "show"):
            return remotes.locations if a.action == "list" else remotes.find(*a.names)
        if a.action == "test":
            return {"refs": commands.ls_remote(p, *a.names).count()}
        {"add": lambda: remotes.add(*a.names, a.insecure), "set-url": lambda: remotes.add(*a.names, a.insecure), "remove": lambda: remotes.remove(*a.names), "rename": lambda: remotes.rename(*a.names)}[a.action]()
        return remotes.save(p.own("remotes.json"))
    if c == "ignore":
        path = os.path.join(p.root, workspace.IGNORE_FILE)
        if a.action == "list":
            return [r.pattern for r in parse_ignore(open(path, encoding="utf-8-sig").read())] if os.path.exists(path) else []
        return workspace.add_ignore_rules(path, a.rules) if a.action == "add" else [r for r in a.rules if workspace.remove_ignore_rule(path, r)]
    if c == "config":
        if a.action == "list":
            return {k: p.config.get(k) for k in config.USER_KEYS}
        if a.action == "get":
            return p.config.get(*a.names)
        return config.save_config(p.own("config.json"), config.load_config(p.own("config.json")).set(*a.names))
    simple = {
        "init": lambda: commands.init(p), "save": lambda: commands.save(p, a.message, a.tag), "status": lambda: commands.status(p),
        "log": lambda: commands.log_detail(p, a.detail) if a.detail else commands.log(p, a.branch, a.all, a.limit), "show": lambda: commands.show(p, a.version, a.path),
        "diff": lambda: commands.compare(p, a.old, a.new, a.file, a.stat), "check": lambda: commands.check(p, a.filter, a.verbose), "gc": lambda: s.collect_garbage(a.keep_auto, a.dry_run),
        "compact": lambda: s.compact(), "undo": lambda: {"id": s.undo(p.files())}, "restore": lambda: commands.restore(p, a.version, a.path, not a.no_backup),
        "resolve": lambda: s.resolve(a.version), "switch": lambda: commands.switch(p, a.name, a.create, not a.no_autosave), "export": lambda: commands.export(p, a.version, a.output),
        "import": lambda: commands.import_file(p, a.branch, a.path), "clone": lambda: commands.clone(p, a.location), "ls-remote": lambda: commands.ls_remote(p, a.remote), "watch": lambda: commands.watch(p, a.action, a.ticks, a.interval), "version": lambda: __version__,
    }
    return simple[c]() if c in simple else commands.transfer(p, c, a.remote, a.branch, a.all, a.dry_run)


def detail(error: Exception, verbose: bool) -> str | None:
    """The cause of an error, or its kind where there is none; only if asked for."""
    return (repr(error.__cause__) if error.__cause__ else type(error).__name__) if verbose else None


def main(argv: list[str] | None = None, spark: object = None) -> int:
    a = parser().parse_args(argv)
    p = commands.Project(spark or local_session(), a.cwd, a.store)
    try:
        text, code = commands.envelope(a.command, commands.rows_of(run(p, a))), commands.OK
    except NothingToSave:
        text, code = commands.envelope(a.command, error="nothing to save", hint="change a file first"), commands.NOTHING
    except (StoreError, KeyError) as e:
        text, code = commands.envelope(a.command, error=str(e), detail=detail(e, a.verbose)), commands.REFUSED
    except (OSError, TypeError, ValueError) as e:
        text, code = commands.envelope(a.command, error=str(e), detail=detail(e, a.verbose)), commands.USAGE
    if code or not a.quiet:
        print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
