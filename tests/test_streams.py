"""Watched folders against a plain replay, and backlogs that are killed half way."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gritstone.session import rocks
from gritstone.streaming import monitor
from gritstone.streaming.drain import Backlog, table_stream

KIND = "folder string, ts timestamp, path string, size long, modified_s long, kind string"


def replay(batches, quiet, report, known=()):
    """What leaves, by going through the sightings of each batch in order; time is that of the sightings."""
    state, out = {}, []
    for folder, path, size, modified in known:
        state.setdefault(folder, [{}, {}, None])[0][path] = (size, modified)
    for sightings in batches:
        newest = None
        for folder, at, path, size, modified, kind in sorted(sightings, key=lambda r: (r[0], r[1], r[2])):
            mine = state.setdefault(folder, [{}, {}, None])
            have, waiting, due = mine
            if due is not None and due < at:
                out += [(folder, p, *c, due) for p, c in waiting.items()]
                waiting.clear()
                due = mine[2] = None
            was, on = waiting.get(path, (None, None))[0], False
            if kind == "gone":
                if path in have:
                    gone = have.pop(path)
                    if was == "added" or report == "new" or (gone[0] == 0 and was is None):
                        waiting.pop(path, None)
                    else:
                        waiting[path], on = ("removed", None), True
            elif path not in have:
                have[path] = (size, modified)
                if size:
                    waiting[path], on = ("modified" if was == "removed" else "added", size), True
            elif have[path] != (size, modified):
                have[path] = (size, modified)
                if report == "changes":
                    waiting[path], on = (was or "modified", size), True
            if on:
                mine[2] = max(due or 0, at + quiet)
        newest = max((r[1] for b in batches[: batches.index(sightings) + 1] for r in b), default=0)
        for folder, mine in state.items():
            if mine[2] is not None and mine[2] <= newest:
                out += [(folder, p, *c, mine[2]) for p, c in mine[1].items()]
                mine[1].clear()
                mine[2] = None
    return sorted(out, key=repr)


@pytest.mark.parametrize("report", ["new", "changes"])
def test_quiet_batches_equal_a_replay(spark, tmp_path, report):
    rng = random.Random(11)
    batches, at = [], 0
    for b in range(3):
        rows = []
        for _ in range(60):
            at += rng.choice([0, 100, 500, 3_000])
            rows.append((rng.choice("xy"), at, f"/f{rng.randint(0, 12)}", rng.choice([0, 5, 5, 6]), rng.choice([1, 2]), rng.choice(["seen"] * 4 + ["gone"])))
        batches.append(rows)
    known = [("x", "/f1", 5, 1), ("y", "/f2", 6, 2)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = None
    for rows in batches:
        df = spark.createDataFrame(rows, "folder string, ms long, path string, size long, modified_s long, kind string")
        df.selectExpr("folder", "timestamp_millis(ms) as ts", "path", "size", "modified_s", "kind").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source).withWatermark("ts", "0 seconds")
        left = monitor.quiet_batches(stream, "folder", 2_000, report, spark.createDataFrame(known, "folder string, path string, size long, modified_s long"), at="ts")
        with rocks(spark):
            run = left.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            run.awaitTermination()
    found = [tuple(r) for r in spark.read.schema(left.schema).parquet(out).collect()]
    want = replay(batches, 2_000, report, known)
    assert sorted(found, key=repr) == want and len(want) > 20
    rows = {s["operatorName"]: s["numRowsTotal"] for s in run.lastProgress["stateOperators"]}
    assert 4 < rows["transformWithStateInPandasExec"] < 80  # an entry for each file, not one for each folder


def test_clock_timers_let_a_folder_leave(spark, tmp_path):
    schema = "folder string, path string, size long, modified_s long, kind string"
    spark.createDataFrame([("f", "/a", 1, 1, "seen"), ("f", "/b", 1, 1, "seen"), ("f", "/a", 1, 1, "seen"), ("f", "/empty", 0, 1, "seen"), (None, "/n", 1, 1, "seen")], schema).write.parquet(str(tmp_path / "in"))
    left = monitor.quiet_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "folder", 500, forget_ms=3_600_000)
    out = str(tmp_path / "out")
    with rocks(spark):
        run = left.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(80):
            run.awaitTermination(0.5)
            if run.lastProgress and spark.read.schema(left.schema).parquet(out).count():
                break
        assert sorted((r.folder, r.path, r.change) for r in spark.read.schema(left.schema).parquet(out).collect()) == [("f", "/a", "added"), ("f", "/b", "added")]
    finally:
        run.stop()


def test_status_changes_over_batches(spark, tmp_path):
    out, log, source = (str(tmp_path / n) for n in ("out", "log", "in"))
    for rows in ([("d", 1, "on"), ("d", 2, "on"), ("e", 1, None)], [("d", 3, "on"), ("d", 4, "off"), ("e", 2, None), ("e", 3, "on")]):
        spark.createDataFrame(rows, "drive string, at long, status string").coalesce(1).write.mode("append").parquet(source)
        changes = monitor.status_stream(spark.readStream.schema("drive string, at long, status string").parquet(source), "drive", "status", "at")
        with rocks(spark):
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    assert sorted((tuple(r) for r in spark.read.schema(changes.schema).parquet(out).collect()), key=repr) == [("d", 1, "on"), ("d", 4, "off"), ("e", 1, None), ("e", 3, "on")]


class Killed(Backlog):
    def written(self, batch):
        if batch == 1 and not self.spark.conf.get("gritstone.test.spared", ""):
            raise RuntimeError("killed")


def test_a_killed_drain_gives_the_same_table(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    def work(rows):
        def count(batches):
            for b in batches:
                met.add(len(b))
                yield b

        got = rows.select("id", "v").mapInPandas(count, "id long, v string")
        return got.select("id", F.length("v").alias("n"), F.when(F.col("v") == "bad", "can't").alias("error"))

    def put(rows):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(i, "bad" if i == 3 else "x" * i) for i in range(10)])
    backlog = Killed(spark, str(tmp_path / "done"), "id", work, "id long, n int, error string")
    backlog.drain(table_stream(spark, str(tmp_path / "in")))
    put([(i, "y") for i in (2, 3, 20, 21, 21)] + [(None, "z")])
    with pytest.raises(Exception, match="killed"):
        backlog.drain(table_stream(spark, str(tmp_path / "in")))
    assert backlog.results().count() == 10  # the second batch has rows but no commit
    spark.conf.set("gritstone.test.spared", "yes")
    found = backlog.drain(table_stream(spark, str(tmp_path / "in")))
    assert sorted((r.id, r.error, r.batch) for r in found.collect()) == [*((i, "can't" if i == 3 else None, 0) for i in range(10)), (20, None, 1), (21, None, 1)]
    assert [(r.id, r.error) for r in backlog.failed().collect()] == [(3, "can't")]
    before = met.value
    assert backlog.drain(table_stream(spark, str(tmp_path / "in"))).count() == 12 and met.value == before
    assert [tuple(r) for r in backlog.commits().orderBy("batch").collect()] == [(0, 10, 1), (1, 2, 0)]


def test_what_leaves_within_a_batch_goes_in_one_table_and_unknown_files_ask_little_of_the_state():
    import pandas as pd

    class Map(dict):
        calls = 0

        def __getattribute__(self, name):
            if name in ("containsKey", "getValue", "updateValue", "removeKey", "iterator", "clear"):
                Map.calls += 1
            return super().__getattribute__(name)

        containsKey, getValue, iterator = dict.__contains__, dict.get, dict.items
        updateValue, removeKey = dict.__setitem__, lambda self, k: self.pop(k, None)

    class Value:
        now = None
        exists, get, clear = lambda self: self.now is not None, lambda self: self.now, lambda self: setattr(self, "now", None)
        update = lambda self, v: setattr(self, "now", v)

    class Handle:
        timers = set()
        registerTimer, deleteTimer = lambda self, t: self.timers.add(t), lambda self, t: self.timers.discard(t)

    class Clock:
        getCurrentProcessingTimeInMs = lambda self: 0

    watch = monitor.FolderWatch("folder", "string", 10, "new", True, None)
    watch.handle, watch.known, watch.waiting, watch.quiet = Handle(), Map(), Map(), Value()
    batch = pd.DataFrame([(f"p{i:03}", 1, 0, "seen", i * 100) for i in range(200)], columns=list(monitor.COLUMNS))
    tables = list(watch.handleInputRows(("a",), iter([batch]), Clock()))
    assert [len(t) for t in tables] == [199] and tables[0]["left_ms"].tolist() == [i * 100 + 10 for i in range(199)]
    assert Map.calls <= 2 * 200 + 2 and dict(watch.waiting) == {("p199",): ("added", 1)} and Handle.timers == {19_910}
