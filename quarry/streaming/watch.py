"""File events as streams: quiet periods, incremental writes, live state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quiet_periods(events: DataFrame, gap: str = "5 seconds", late: str | None = None, key: str = "project", at: str = "ts", path: str = "path") -> DataFrame:
    """One row for each burst of changes: it closes after ``gap`` without an event; paths come once.

    Give ``late`` on streams: how long events may be late. Batch needs none.
    """
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if late else rows
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.array_sort(F.collect_set(path)).alias("paths"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n")


def latest_progress(events: DataFrame, key: str, at: str, tie: str, *values: str) -> DataFrame:
    """The last values of each key; works in batch and in update mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(at, *values), F.struct(at, tie)).alias("_last"), F.count("*").alias("events")).select(key, "_last.*", "events")


def percent(done: str, total: str):  # noqa: ANN201
    return F.when(F.col(total) > 0, F.floor(F.col(done) * 100 / F.col(total))).otherwise(0).cast("int")


def into_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):  # noqa: ANN201
    """Hands each micro-batch to ``handle``; the checkpoint makes a restart go on where it stopped."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Turns:
    """One project's writer: a job at a time, begun once changes have paused for ``gap`` milliseconds; changes meanwhile wait for the next.

    Events (time, kind, path) wait until the watermark has passed them, so they are taken in order of time.
    """

    def __init__(self, gap: int, saved: str | None = None):
        self.gap = gap
        held = json.loads(saved) if saved else {}
        self.waiting: list[list] = held.get("waiting", [])
        self.paths: list[str] = held.get("paths", [])
        self.running: bool = held.get("running", False)
        self.quiet: int = held.get("quiet", 0)  # when the pause, or the job before, is over
        self.jobs: int = held.get("jobs", 0)

    def saved(self) -> str:
        return json.dumps({"waiting": self.waiting, "paths": self.paths, "running": self.running, "quiet": self.quiet, "jobs": self.jobs})

    def next_at(self) -> int | None:
        """When something may happen next, if no more events come."""
        times = [self.waiting[0][0]] if self.waiting else []
        if self.paths and not self.running:
            times.append(self.quiet)
        return min(times, default=None)

    def take(self, events: list[list], upto: int) -> list[tuple[int, int, list[str]]]:
        """Jobs (number, time, paths) that begin up to a time at which all earlier events are known."""
        self.waiting = sorted(self.waiting + events)
        begun = []
        while (at := self.next_at()) is not None and at <= upto:
            if self.waiting and self.waiting[0][0] == at:  # an event at the end of a pause comes first
                _, kind, path = self.waiting.pop(0)
                if kind == "done":
                    if self.running:
                        self.running, self.quiet = False, max(self.quiet, at)
                else:
                    self.paths = sorted({*self.paths, path})
                    self.quiet = max(self.quiet, at + self.gap)
            else:
                self.jobs, self.running = self.jobs + 1, True
                begun.append((self.jobs, at, self.paths))
                self.paths = []
        return begun


def one_writer(events: DataFrame, gap_ms: int = 5000, late: str = "10 seconds", key: str = "project", at: str = "ts", kind: str = "kind", path: str = "path") -> DataFrame:
    """Jobs (project, job, started, paths) of a stream of changes and of ends of jobs (``kind`` is ``done``): one at a time for each project.

    What is held for a project are its waiting paths, whether a job runs and the events that the
    watermark hasn't passed; a timer in event time begins a job when no more events come. Events
    later than ``late`` are dropped.
    """
    rows = events.select(F.col(key).alias("project"), F.col(at).cast("timestamp").alias("ts"), F.col(kind).alias("kind"), F.coalesce(F.col(path), F.lit("")).alias("path")).where("project is not null and ts is not null").withWatermark("ts", late)

    def run(name: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns = Turns(gap_ms, state.get[0] if state.exists else None)
        fresh = [[int(t.value // 1_000_000), str(k), p] for f in frames for t, k, p in zip(f["ts"], f["kind"], f["path"], strict=True)]
        begun = turns.take(fresh, state.getCurrentWatermarkMs())
        state.update((turns.saved(),))
        due = turns.next_at()
        if due is not None:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"project": [name[0]] * len(begun), "job": [n for n, _, _ in begun], "started": pd.to_datetime([t for _, t, _ in begun], unit="ms"), "paths": [p for _, _, p in begun]})

    return rows.groupBy("project").applyInPandasWithState(run, "project string, job int, started timestamp, paths array<string>", "saved string", "append", GroupStateTimeout.EventTimeTimeout)


def jobs(events: DataFrame, gap_ms: int = 5000, key: str = "project", at: str = "ts", kind: str = "kind", path: str = "path") -> DataFrame:
    """The same of a whole table: events are dealt by project, sorted by time and taken one by one, so a task holds what waits and no project's events."""
    rows = events.select(F.col(key).cast("string").alias("project"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.col(kind).alias("kind"), F.coalesce(F.col(path), F.lit("")).alias("path")).where("project is not null and ms is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, turns = None, Turns(gap_ms)
        for f in frames:
            out = []
            for p, same in f.groupby("project", sort=False):
                if p != name:
                    out += [(name, *j) for j in turns.take([], 1 << 62)] if name is not None else []
                    name, turns = p, Turns(gap_ms)
                fresh = [[int(t), str(k), x] for t, k, x in zip(same["ms"], same["kind"], same["path"], strict=True)]
                out += [(name, *j) for j in turns.take(fresh, fresh[-1][0] - 1)]
            yield pd.DataFrame(out, columns=["project", "job", "started_ms", "paths"])
        if name is not None:
            yield pd.DataFrame([(name, *j) for j in turns.take([], 1 << 62)], columns=["project", "job", "started_ms", "paths"])

    return rows.repartition("project").sortWithinPartitions("project", "ms").mapInPandas(run, "project string, job int, started_ms long, paths array<string>")
