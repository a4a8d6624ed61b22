"""Automatic snapshots of a stream of workspace scans, and counters of a stream of events."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import diff, gc, lineage
from cairn.sources.store import NothingToSave, Store


@dataclass
class WatchState:
    """Counters of a watch. paused may be set by others at any time; the watch reads it at each tick."""

    paused: bool = False
    ticks: int = 0
    auto_saves: int = 0
    pruned: int = 0
    errors: int = 0
    last_batch: int = -1
    last_error: str = ""

    @classmethod
    def load(cls, path: str) -> WatchState:
        return cls(**json.loads(Path(path).read_text())) if os.path.exists(path) else cls()

    def save(self, path: str) -> None:
        """Written beside and moved, with the flag as it is in the file now."""
        if os.path.exists(path):
            self.paused = WatchState.load(path).paused
        part = f"{path}.partial"
        Path(part).write_text(json.dumps(asdict(self)))
        os.replace(part, path)


def set_paused(path: str, paused: bool) -> None:
    state = WatchState.load(path)
    state.paused = paused
    part = f"{path}.partial"
    Path(part).write_text(json.dumps(asdict(state)))
    os.replace(part, path)


def tick(store: Store, workspace: DataFrame, batch: int, ts: int, state_path: str, keep: int = 50, author: str = "watch") -> WatchState:
    """One round: save the workspace if it changed, then count what pruning may drop. A batch that was done is not done
    again, errors are recorded and do not end the watch."""
    state = WatchState.load(state_path)
    if state.paused or batch <= state.last_batch:
        return state
    state.ticks += 1
    try:
        if not diff.status(store.read("index_entries"), workspace).isEmpty():
            store.save(workspace, f"{gc.AUTO} snapshot {state.auto_saves + 1}", author, ts)
            state.auto_saves += 1
        state.pruned += prune(store, keep)
    except NothingToSave:
        pass
    except Exception as e:  # noqa: BLE001
        state.errors, state.last_error = state.errors + 1, str(e)[:500]
    state.last_batch = batch
    state.save(state_path)
    return state


def prune(store: Store, keep: int) -> int:
    """Drop automatic snapshots beyond the newest `keep` that nothing reaches; returns their number."""
    manifests = store.read("snapshots").select(F.col("snapshot_id").alias("id"), F.col("prev_id").alias("parent"), "message", "ts", F.lit(0).alias("all"))
    old = gc.prunable_autos(manifests, lineage.reachable(manifests, gc.roots(store.read("refs"))), keep, ["all"])
    ids = old.select(F.col("id").alias("snapshot_id"))
    count = ids.count()
    if count:
        left = {name: store.read(name).join(ids, "snapshot_id", "left_anti") for name in ("snapshots", "file_entries")}
        store.commit(replace=left)
    return count


def state_file(uri: str) -> str:
    """Local path of a state file given by a path or a file URI."""
    return uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:")


def watch(scans: DataFrame, store: Store, state_path: str, checkpoint: str, interval: int = 300, keep: int = 50, once: bool = False, first: int = 0) -> StreamingQuery:
    """Run tick for each micro-batch of a streaming DataFrame of scans (path, content, size, mod_time, scanned_at in epoch
    seconds): each batch is one whole scan, numbered from `first`. `once` takes what is there and ends."""

    def run(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("scanned_at")).first()[0]
        if at is not None:
            tick(store, batch.drop("scanned_at"), first + number, int(at), state_path, keep)

    writer = scans.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval} seconds")).start()


def event_counts(events: DataFrame, window: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Streaming counters (start, event_type, n) per window and type of event. With `late`, a watermark drops rows that
    come later than that and closes windows; without, all rows count and windows stay open."""
    rows = events.withWatermark("ts", late) if late else events
    counts = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


def run_to_end(counts: DataFrame, checkpoint: str, output: str) -> None:
    """Take what a stream of counters has, and leave them as files: each micro-batch replaces them with the whole."""
    done = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    done.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(output)).start().awaitTermination()
