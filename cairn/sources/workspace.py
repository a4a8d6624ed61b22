"""Workspaces: scans of directory trees, ignore files, and the sinks that write files back."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.engines import HEADER_BYTES
from cairn.functions.patterns import IgnoreRule, ignored, normal_path, parse_ignore, sanitised_entry

IGNORE_FILE = ".cairnignore"
STORE_DIR = ".cairn"


_LISTED = "path string, size bigint, mod_time bigint, mode bigint, is_symlink boolean"


def listing(root: str, ignore_file: str = IGNORE_FILE) -> list[tuple[str, int, int, int, bool]]:
    """(path, size, mod_time in ns, permission bits, is_symlink) of the files below root, in lexical order, without the
    store's own directory and without what the ignore files exclude. Ignored directories are not entered, links are not
    followed, unreadable directories are skipped. Only names and stats are read."""
    rules, out = ignore_rules(root, ignore_file), []

    def enter(directory: str) -> None:
        try:
            found = sorted(os.scandir(os.path.join(root, directory)), key=lambda e: e.name)
        except OSError:
            return
        for e in found:
            path = f"{directory}/{e.name}" if directory else e.name
            if path == STORE_DIR:
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            if ignored(path, rules, is_dir):
                continue
            if is_dir:
                enter(path)
            else:
                st = e.stat(follow_symlinks=False)
                out.append((path, st.st_size, st.st_mtime_ns, st.st_mode & 0o777, e.is_symlink()))

    enter("")
    return out


def scan(spark: SparkSession, root: str, ignore_file: str = IGNORE_FILE, partitions: int | None = None) -> DataFrame:
    """Files of a tree that all executors see: path, content, header, size, mod_time, mode, is_symlink. The driver lists
    names, the tasks read contents; a link has none, and neither has a file that is gone by then. Empty and hidden files
    are there, which Spark's own file listing would leave out."""
    rows = spark.createDataFrame(listing(root, ignore_file), _LISTED)
    rows = rows.repartition(partitions or max(1, spark.sparkContext.defaultParallelism))
    base = os.path.abspath(root)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = []
            for path, link in zip(frame["path"], frame["is_symlink"]):
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        data.append(None if link else f.read())
                except OSError:
                    data.append(None)
            yield frame.assign(content=pd.Series(data, dtype=object))

    full = rows.mapInPandas(read, _LISTED + ", content binary")
    return full.withColumn("header", F.substring("content", 1, HEADER_BYTES))


def scan_objects(spark: SparkSession, location: str) -> DataFrame:
    """Files of an object store or Hadoop path: path (relative), content, header, size, mod_time. Spark lists and reads;
    names that begin with a dot or underscore and empty files are not listed by it."""
    base = spark._jvm.org.apache.hadoop.fs.Path(location)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(location)
    rows = files.select(F.substr("path", F.lit(len(base) + 2)).alias("path"), "content", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mod_time"))
    return rows.withColumn("header", F.substring("content", 1, HEADER_BYTES))


def ignore_rules(root: str, ignore_file: str = IGNORE_FILE) -> list[IgnoreRule]:
    """Rules of all ignore files of a tree, outer directories first. Missing files have none."""
    found = sorted(Path(root).rglob(ignore_file), key=lambda p: (len(p.parts), p.as_posix()))
    rules: list[IgnoreRule] = []
    for p in found:
        directory = p.parent.relative_to(root).as_posix()
        rules += parse_ignore(p.read_text(encoding="utf-8-sig", errors="replace"), "" if directory == "." else directory)
    return rules


def add_ignore_rules(path: str, rules: list[str]) -> list[str]:
    """Append the rules that are not there yet, in order; returns those that were added."""
    old = [r.pattern for r in parse_ignore(Path(path).read_text(encoding="utf-8-sig"))] if os.path.exists(path) else []
    new = [r for r in dict.fromkeys(x.strip() for x in rules) if r and r not in old]
    with open(path, "a", encoding="utf-8") as out:
        out.writelines(f"{r}\n" for r in new)
    return new


def remove_ignore_rule(path: str, rule: str) -> bool:
    lines = Path(path).read_text(encoding="utf-8-sig").splitlines() if os.path.exists(path) else []
    kept = [x for x in lines if x.strip() != rule]
    if len(kept) == len(lines):
        return False
    Path(path).write_text("".join(f"{x}\n" for x in kept), encoding="utf-8")
    return True


def restore(files: DataFrame, root: str) -> DataFrame:
    """Write files (path, content, mode, mod_time) below root, by the tasks: (path, error), error null where it went well.

    Each file is written beside its place and moved there. Paths that leave the root, and links on the way out of it,
    are errors. A null content is an error and leaves the old file."""
    base = os.path.realpath(root)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors: list[str | None] = []
            for row in frame.itertuples(index=False):
                try:
                    target = os.path.join(base, normal_path(row.path))
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    if not os.path.realpath(os.path.dirname(target) + "/").startswith(base):
                        raise ValueError(f"path leaves the root: {row.path!r}")
                    if row.content is None:
                        raise ValueError(f"content is missing: {row.path!r}")
                    part = f"{target}.partial"
                    with open(part, "wb") as out:
                        out.write(row.content)
                    mode = int(row.mode) & 0o777 if row.mode == row.mode and row.mode is not None else 0
                    os.chmod(part, (mode & ~0o022) or 0o644)
                    if row.mod_time == row.mod_time and row.mod_time is not None:
                        os.utime(part, ns=(int(row.mod_time), int(row.mod_time)))
                    os.replace(part, target)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
            yield pd.DataFrame({"path": frame["path"], "error": pd.Series(errors, dtype=object)})

    return files.select("path", "content", "mode", "mod_time").mapInPandas(write, "path string, error string")


def delete_extras(paths: list[str], root: str) -> None:
    """Remove files and then the directories that became empty."""
    base = Path(root)
    for p in paths:
        (base / normal_path(p)).unlink(missing_ok=True)
        for up in (base / normal_path(p)).parents:
            if up == base or not up.is_dir() or any(up.iterdir()):
                break
            up.rmdir()


def export_zip(files: DataFrame, output: str) -> int:
    """Write files (path, content) to one archive, by path; returns the number of entries. Names that would leave the
    archive are skipped. Rows come to the driver one partition at a time, as one file can only be written in one place."""
    count = 0
    with zipfile.ZipFile(output, "w", zipfile.ZIP_DEFLATED) as out:
        for row in files.where("content is not null").select("path", "content").orderBy("path").toLocalIterator():
            name = sanitised_entry(row.path)
            if name is not None:
                out.writestr(name, bytes(row.content))
                count += 1
    return count
