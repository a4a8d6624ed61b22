"""Globs, ignore rules and reference names. Patterns become regular expressions once, on the driver, so that Catalyst
sees literals that it compiles once and can evaluate inside whole-stage code."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|\[!?\]?[^\]]*\]|.", re.DOTALL)
_WILD = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: `*` and `?` stay within a path segment, `**` does not, `**/` may be empty,
    `[...]` is a class and `[!...]` its complement; one leading slash is dropped; an unclosed `[` is itself."""

    def translate(token: str) -> str:
        if token in _WILD:
            return _WILD[token]
        if len(token) > 1 and token[0] == "[":
            inside = token[1:-1]
            sign, inside = ("^", inside[1:]) if inside.startswith("!") else ("", inside)
            return f"[{sign}{re.sub(r'([\\^\[\]&])', r'\\\1', inside)}]"
        return re.escape(token).replace("/", "/")

    return r"\A(?s:" + "".join(translate(t) for t in _TOKEN.findall(pattern.removeprefix("/"))) + r")\z"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern.rstrip("/") if pattern.endswith("/") else pattern))


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file, in force below a directory ('' = root)."""

    pattern: str
    directory: str = ""


def parse_ignore(text: str, directory: str = "") -> list[IgnoreRule]:
    """Rules of an ignore file: byte order mark, blank lines and `#` lines dropped, blanks around trimmed."""
    rows = (line.strip() for line in text.removeprefix("﻿").splitlines())
    return [IgnoreRule(row, directory) for row in rows if row and not row.startswith("#")]


def _rule_matches(path: Column, rule: IgnoreRule, is_dir: bool) -> Column | None:
    pattern = rule.pattern.removeprefix("!")
    if pattern.endswith("/"):
        if not is_dir:
            return None
        pattern = pattern.rstrip("/")
    inner, inside = path, None
    if rule.directory:
        prefix = rule.directory + "/"
        inside, inner = path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))
    hit = inner.rlike(glob_regex(pattern))
    if "/" not in pattern:
        hit = hit | F.regexp_extract(inner, r"([^/]*)\z", 1).rlike(glob_regex(pattern))
    return hit if inside is None else inside & hit


def is_ignored(path: Column, rules: list[IgnoreRule], is_dir: bool = False) -> Column:
    """Whether the last matching rule ignores the path itself; `!` negates, `x/` matches directories only, a pattern
    without a slash is also tried on the last segment. Rules are in order, nearer directories later."""
    out = F.lit(False)
    for rule in rules:
        hit = _rule_matches(path, rule, is_dir)
        if hit is not None:
            out = F.when(hit, not rule.pattern.startswith("!")).otherwise(out)
    return out


def ignored(path: str, rules: list[IgnoreRule], is_dir: bool = False) -> bool:
    """is_ignored for one path on the driver, for walks."""
    out = False
    for rule in rules:
        pattern = rule.pattern.removeprefix("!")
        if pattern.endswith("/") and not is_dir or rule.directory and not path.startswith(rule.directory + "/"):
            continue
        inner, pattern = path[len(rule.directory) + 1 :] if rule.directory else path, pattern.rstrip("/")
        tried = [inner] if "/" in pattern else [inner.rpartition("/")[2], inner]
        if any(_compiled(pattern).match(x) for x in tried):
            out = not rule.pattern.startswith("!")
    return out


@lru_cache(maxsize=1024)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(glob_regex(pattern).replace(r"\z", r"\Z"))


def ancestors(path: Column) -> Column:
    """Directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def is_pruned(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether a directory above the path is ignored: nothing below it can be taken back by a later rule."""
    return F.exists(ancestors(path), lambda x: is_ignored(x, rules, is_dir=True))


def is_excluded(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether a walk leaves a file out."""
    return is_pruned(path, rules) | is_ignored(path, rules)


#: Base names that no reference may have, in lower case.
RESERVED = r"\A(?:con|aux|nul|prn|com[0-9]|lpt[0-9]|head)\z"


def is_ref_name(name: Column) -> Column:
    """Whether a reference may have this name: no control characters, blanks, backslashes, colons or `..`, no leading
    `-` or `/`, no reserved last segment; HEAD itself is one. False for null."""
    base = F.lower(F.regexp_extract(F.regexp_replace(name, "/+$", ""), r"([^/]*)\z", 1))
    bad = (name == "") | name.rlike(r"[\x00-\x1f\x7f \\:]|\.\.|\A[-/]") | base.rlike(RESERVED)
    return F.coalesce((name == "HEAD") | ~bad, F.lit(False))


def ref_type(name: Column) -> Column:
    return F.when(name == "HEAD", "HEAD").when(name.startswith("tags/"), "tag").otherwise("branch")


@dataclass(frozen=True)
class VersionRef:
    """A parsed version reference: kind is head, id, tag or branch."""

    kind: str
    value: str = ""


def parse_version_ref(text: str, least_id: int = 4) -> VersionRef:
    """`head` (any case), `id:<prefix>`, `tag:<name>`, `branch:<name>`, or a bare branch name. ValueError if malformed."""
    if text.lower() == "head":
        return VersionRef("head")
    kind, colon, value = text.partition(":")
    if not colon:
        kind, value = "branch", text
    if kind not in ("id", "tag", "branch") or not value:
        raise ValueError(f"no version reference: {text!r}")
    if kind == "id" and len(value) < least_id:
        raise ValueError(f"an id prefix has at least {least_id} digits: {value!r}")
    return VersionRef(kind, value.lower() if kind == "id" else value)


def sanitised_entry(path: str) -> str | None:
    """Name of an archive entry: forward slashes, no drive, no leading slash, one leading `../` dropped; None if it would
    still leave the archive."""
    name = path.replace("\\", "/")
    name = re.sub(r"\A[A-Za-z]:", "", name).lstrip("/").removeprefix("../")
    parts = name.split("/")
    return None if not name or ".." in parts else name


def normal_path(path: str) -> str:
    """A relative path with forward slashes and without `.` and `..`; ValueError if it leaves the root."""
    out: list[str] = []
    if path.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", path):
        raise ValueError(f"absolute path: {path!r}")
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if not out:
                raise ValueError(f"path leaves the root: {path!r}")
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)
