"""Sorted runs: files of rows sorted by one 64-bit column in the shared folder, with a manifest of the range of each file.

Tasks write the files of a run themselves and return their names, so a repeated task leaves a file that no manifest
names. A search sends points to the files whose ranges hold them and reads there the row groups that can match: what it
reads follows the number of points, not the size of the runs. The folder must be one that pyarrow can open (a local or
mounted path, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

#: Rows of a file and of a row group, and inner marks a file has in the manifest, by which its points are spread over tasks.
FILE_ROWS, GROUP_ROWS, MARKS = 1 << 20, 1 << 13, 16
#: Rows that one task sorts and writes.
TASK_ROWS = 1 << 18


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI, in the spellings that Hadoop uses too."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


@dataclass
class Part:
    """One file of a run."""

    path: str
    low: int
    high: int
    rows: int
    marks: list[int] = field(default_factory=list)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_run(df: DataFrame, by: str, folder: str, rows: int, group_rows: int = GROUP_ROWS, file_rows: int = FILE_ROWS, then: tuple[str, ...] = ()) -> list[Part]:
    """Sort df of at most `rows` rows by `by`, equal ones by `then`, over as many tasks as they fill, and write it; the parts
    in order. An empty df has none."""
    fs, path = open_folder(folder)
    fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        writer, name, starts, high, rows, done = None, "", [], 0, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, group_rows):
                piece = batch.slice(at, group_rows)
                if writer is None:
                    name, starts, rows = f"{uuid.uuid4().hex}.parquet", [], 0
                    writer = pq.ParquetWriter(f"{path}/{name}", piece.schema, filesystem=fs, compression="zstd", write_statistics=[by], use_dictionary=False)
                writer.write_batch(piece)
                point = piece.column(by)
                starts.append(point[0].as_py())
                high, rows = point[-1].as_py(), rows + piece.num_rows
                if rows >= file_rows:
                    writer.close()
                    writer = done.append((f"{folder}/{name}", starts[0], high, rows, starts[1 :: max(1, len(starts) // MARKS)]))
        if writer is not None:
            writer.close()
            done.append((f"{folder}/{name}", starts[0], high, rows, starts[1 :: max(1, len(starts) // MARKS)]))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["path", "low", "high", "rows", "marks"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [()] * 5, kinds)], names=names)

    tasks = 1 + rows // TASK_ROWS
    placed = (df.repartitionByRange(tasks, by) if tasks > 1 else df.repartition(1)).sortWithinPartitions(by, *then)
    return sorted((Part(**r.asDict()) for r in placed.mapInArrow(run, "path string, low long, high long, rows long, marks array<long>").collect()), key=lambda p: p.low)


def read_parts(parts: list[Part], df: DataFrame) -> DataFrame:
    """All rows of parts; df: any frame with their columns."""
    return df.sparkSession.read.schema(df.schema).parquet(*(p.path for p in parts))


class Places:
    """Where points of several runs are: goes to the tasks, as long as the manifest."""

    def __init__(self, runs: list[list[Part]]) -> None:
        self.paths = [p.path for run in runs for p in run]
        self.marks = [np.array(p.marks, np.int64) for run in runs for p in run]
        ends = np.cumsum([0, *map(len, runs)]).tolist()
        self.runs = [(first, np.array([p.low for p in run], np.int64), np.array([p.high for p in run], np.int64)) for first, run in zip(ends, runs)]

    def route(self, points: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, file, slice of the file) of every file that may hold a point; with `only` of that run."""
        at, files = [], []
        for run, (first, lows, highs) in enumerate(self.runs):
            begin, end = np.searchsorted(highs, points, "left"), np.searchsorted(lows, points, "right")
            n = np.maximum(end - begin, 0)
            n = n if only is None else np.where(only == run, n, 0)
            at.append(np.repeat(np.arange(len(points)), n))
            files.append(first + np.repeat(begin, n) + ramp(n))
        at, files = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, files))
        slices = np.zeros(len(at), np.int64)
        for f in np.unique(files).tolist():
            here = files == f
            slices[here] = np.searchsorted(self.marks[f], points[at[here]], "right")
        return at, files, slices


def ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[i] - 1 for every i, joined."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Reader:
    """One file of a run; only the row groups that can hold a point are read."""

    def __init__(self, uri: str, by: str) -> None:
        fs, path = open_folder(uri)
        self.file = pq.ParquetFile(fs.open_input_file(path))
        meta = self.file.metadata
        k = self.file.schema_arrow.get_field_index(by)
        stats = [meta.row_group(g).column(k).statistics for g in range(meta.num_row_groups)]
        self.lows, self.highs = np.array([s.min for s in stats], np.int64), np.array([s.max for s in stats], np.int64)

    def rows(self, points: np.ndarray) -> pa.RecordBatch:
        """Rows of the row groups whose range holds one of the sorted points."""
        hit = np.searchsorted(points, self.lows, "left") < np.searchsorted(points, self.highs, "right")
        return self.file.read_row_groups(np.flatnonzero(hit).tolist()).combine_chunks()


def visit(rows: DataFrame, by: str, places: Places, look: Callable[[pa.Table, pa.RecordBatch], pa.RecordBatch], schema: str, only: str | None = None) -> DataFrame:
    """look(rows of the file, rows sorted by `by`) for each file that may hold points of `rows`. Only `rows` are shuffled:
    by file and slice, so a file that many points ask for is read by several tasks, each its own row groups. `only` names a
    column with the number of the one run to search.
    """
    names = rows.columns

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, files, slices = places.route(batch.column(by).to_numpy(), None if only is None else batch.column(only).to_numpy())
            columns = [pa.array(files.astype(np.int32)), pa.array(slices.astype(np.int32)), *(c.take(pa.array(at)) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["_file", "_slice", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader = -1, None
        for batch in batches:
            file = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(file)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(file)]):
                if a == b:
                    continue
                if file[a] != last:
                    last, reader = file[a], Reader(places.paths[file[a]], by)
                piece = pa.RecordBatch.from_arrays(batch.slice(a, b - a).columns[2:], names=names)
                yield look(reader.rows(piece.column(by).to_numpy()), piece)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    routed = rows.mapInArrow(route, f"_file int, _slice int, {kinds}")
    return routed.repartition(partitions(rows), "_file", "_slice").sortWithinPartitions("_file", by).mapInArrow(run, schema)


def save_manifest(folder: str, runs: dict[str, list[list[Part]]]) -> None:
    """Name the runs' parts in the folder: written aside, then moved into place."""
    fs, path = open_folder(folder)
    aside = f"{path}/manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        out.write(json.dumps({k: [[asdict(p) for p in run] for run in v] for k, v in runs.items()}).encode())
    fs.move(aside, f"{path}/manifest.json")


def load_manifest(folder: str) -> dict[str, list[list[Part]]]:
    fs, path = open_folder(folder)
    if fs.get_file_info(f"{path}/manifest.json").type == pa.fs.FileType.NotFound:
        return {}
    with fs.open_input_file(f"{path}/manifest.json") as data:
        return {k: [[Part(**p) for p in run] for run in v] for k, v in json.loads(data.read()).items()}


def drop_folder(folder: str) -> None:
    fs, path = open_folder(folder)
    if fs.get_file_info(path).type != pa.fs.FileType.NotFound:
        fs.delete_dir(path)


def drop_parts(parts: list[Part]) -> None:
    for p in parts:
        fs, path = open_folder(p.path)
        fs.delete_file(path)
