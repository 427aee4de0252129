"""One writer for each project: the stream, stopped and started again, against a plain replay of all events."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import watch

GAP = 5000


def replay(events):
    """Jobs of one project's events (ms, kind, path), taken second by second in plain form."""
    begun, paths, running, last, free = [], set(), False, None, 0
    events = sorted(events)
    times = sorted({t for t, _, _ in events} | {t + GAP for t, _, _ in events})
    for now in times:
        for t, kind, path in events:
            if t == now:
                if kind == "done":
                    if running:
                        running, free = False, now
                else:
                    paths.add(path)
                    last = now
        if paths and not running and now >= max(last + GAP, free):
            begun.append((len(begun) + 1, max(last + GAP, free), sorted(paths)))
            paths, running = set(), True
    return begun


def made(seed, n=40):
    r = random.Random(seed)
    t, out = 1_000_000, []
    for _ in range(n):
        t += r.choice([300, 900, 2500, 5000, 7000, 20_000])
        out.append((t, r.choice(["change", "change", "change", "done"]), f"f{r.randrange(6)}"))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_turns_equal_a_replay(seed):
    events = made(seed)
    r = random.Random(seed)
    turns, got, left = watch.Turns(GAP), [], [list(e) for e in events]
    while left:  # in pieces, saved between them, each known up to a time
        k = r.randint(1, 9)
        part, left = left[:k], left[k:]
        upto = (left[0][0] if left else 10**9) - 1
        got += turns.take(part, upto)
        turns = watch.Turns(GAP, turns.saved())
    assert got == replay(events)
    assert all(a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_stream_with_a_restart(spark, tmp_path):
    projects = {f"p{i}": made(100 + i, 25) for i in range(3)}
    rows = sorted((t, p, k, f) for p, es in projects.items() for t, k, f in es)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "ms long, project string, kind string, path string"

    def put(name, part):
        spark.createDataFrame([(t, p, k, f) for t, p, k, f in part], schema).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
        stream = stream.withColumn("ts", F.timestamp_millis("ms"))
        q = watch.one_writer(stream, GAP, "1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    half = len(rows) // 2
    put("a", rows[: half // 2])
    put("b", rows[half // 2 : half])
    run()
    put("c", rows[half:])
    put("d", [(10**9, "end", "done", None)])
    run()  # a new query goes on from the checkpoint
    put("e", [(10**9 + 10**6, "end", "done", None)])
    run()
    got = {p: [] for p in projects}
    for r in spark.read.parquet(out).withColumn("ms", F.unix_millis("started")).collect():
        got[r.project].append((r.job, r.ms, list(r.paths)))
    assert {p: sorted(v) for p, v in got.items()} == {p: replay(es) for p, es in projects.items()}


def test_batch_equals_a_replay(spark):
    projects = {f"p{i}": made(200 + i, 60) for i in range(5)}
    rows = [(t, p, k, f) for p, es in projects.items() for t, k, f in es] + [(None, "p0", "change", "x"), (5, None, "change", "x")]
    df = spark.createDataFrame(rows, "ms long, project string, kind string, path string").withColumn("ts", F.timestamp_millis("ms")).repartition(3)
    got = {p: [] for p in projects}
    for r in watch.jobs(df, GAP).collect():
        got[r.project].append((r.job, r.started_ms, list(r.paths)))
    assert {p: sorted(v) for p, v in got.items()} == {p: replay(es) for p, es in projects.items()}
    assert watch.jobs(df.limit(0), GAP).collect() == []
