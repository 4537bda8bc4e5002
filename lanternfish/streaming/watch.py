"""Debounced change events: filtering, sessions and what a batch of changes does."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import paths as P

if TYPE_CHECKING:
    from ..jobs.index import Index

GAP, LATE = "500 milliseconds", "10 seconds"
#: The gap in milliseconds, and the distinct paths of a run from which it comes out at once, so that no state grows further.
GAP_MS, FULL = 500, 50_000


def relevant(events: DataFrame) -> DataFrame:
    """Events of supported files outside excluded directories, from (ts, src_path, is_directory)."""
    return events.where(~F.col("is_directory") & P.supported(F.col("src_path")) & ~P.pruned_in_stream(F.col("src_path")))


def debounced(events: DataFrame, key: str, path: str, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(key, window, paths, n_events): distinct paths of each run of events without a pause of the gap. For streams and
    tables; in a stream a run comes out once the watermark has passed it, so the last one needs a later event."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    runs = events.groupBy(key, F.session_window("ts", gap).alias("window")).agg(F.collect_set(path).alias("paths"), F.count("*").alias("n_events"))
    return runs.select(key, "window", F.array_sort("paths").alias("paths"), "n_events")


def debounced_by_timer(events: DataFrame, key: str, path: str, head: str | None = None, gap_ms: int = GAP_MS, full: int = FULL) -> DataFrame:
    """(key, first_ts, last_ts, paths, n_events, moved) of a stream: as debounced(), but a run comes out when no event has come
    for the gap by the clock, so the last one needs no later event. moved: the repository's head, as the run's last event has
    it, differs from that of the run before, both being known. Paths, timer and head are state in the checkpoint."""
    columns = {key: "key", "ts": "ts", path: "path"}
    rows = events.select(*(F.col(c).alias(n) for c, n in columns.items()), (F.col(head) if head else F.lit(None).cast("string")).alias("head"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paths, n, first, last, head_now, head_before = state.get if state.exists else ([], 0, None, None, None, None)
        found = set(paths)
        for frame in () if state.hasTimedOut else frames:
            frame = frame.sort_values("ts", kind="stable")
            found.update(frame["path"])
            n += len(frame)
            first = frame["ts"].iloc[0] if first is None else min(first, frame["ts"].iloc[0])
            if last is None or frame["ts"].iloc[-1] >= last:
                last, head_now = frame["ts"].iloc[-1], frame["head"].iloc[-1]
        if state.hasTimedOut or len(found) >= full:
            if found:
                moved = head_before is not None and head_now is not None and head_before != head_now
                yield pd.DataFrame({"key": [keys[0]], "first_ts": [first], "last_ts": [last], "paths": [sorted(found)], "n_events": [n], "moved": [moved]})
                head_before = head_now
            state.update(([], 0, None, None, None, head_before))
        else:
            state.update((sorted(found), n, first, last, head_now, head_before))
            state.setTimeoutDuration(gap_ms)

    out, held = f"key {kind}, first_ts timestamp, last_ts timestamp, paths array<string>, n_events bigint, moved boolean", "paths array<string>, n bigint, first timestamp, last timestamp, head_now string, head_before string"
    return rows.groupBy("key").applyInPandasWithState(run, out, held, "update", GroupStateTimeout.ProcessingTimeTimeout).withColumnRenamed("key", key)


def follow(index: Index, runs: DataFrame, checkpoint: str, name: str = "watch", **trigger: object) -> StreamingQuery:
    """Brings an index up to date with each run of a project: its paths alone, or the whole tree if the head has moved. The
    number of a batch is committed with what it changes, so a batch that is run again after a restart changes nothing."""
    from ..jobs.index import FEW_FILES

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            if rows.isEmpty():
                return
            paths = [r[0] for r in rows.select(F.explode("paths")).distinct().limit(FEW_FILES + 1).collect()]
            index.follow(None if rows.where("moved").limit(1).count() else paths, name, number)
        finally:
            rows.unpersist()

    return runs.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(batch).start()


class Watch:
    """Sends each batch of debounced paths on: to on_move once if the repository's head has moved, else to on_paths."""

    def __init__(self, head: Callable[[], str | None], on_paths: Callable[[DataFrame], None], on_move: Callable[[], None]):
        self.head, self.on_paths, self.on_move = head, on_paths, on_move
        self.last: str | None = head()

    def moved(self) -> bool:
        """An unknown head resets, the first one known after that only primes."""
        before, self.last = self.last, self.head()
        return before is not None and self.last is not None and before != self.last

    def batch(self, rows: DataFrame, number: int) -> None:
        paths = rows.select(F.explode("paths").alias("path")).distinct()
        if paths.isEmpty():
            return
        if self.moved():
            self.on_move()
        else:
            self.on_paths(paths)

    def start(self, runs: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return runs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(self.batch).start()
