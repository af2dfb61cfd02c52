"""Scans in ranges against the window version, and free names against a sequential allocator."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gritstone.operators import names, timeline


def photos(spark, n=4_000):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randint(0, 20_000) if i % 9 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, folder string, at long")


@pytest.fixture
def hot(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda: monkeypatch.setattr(timeline, "HOT_ROWS", 100)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_islands_in_ranges_equal_the_window(spark, hot):
    rows = photos(spark).where("at is not null")
    plain = {r.id: r.island for r in timeline.islands(rows, ["folder"], "at", 12, "id").collect()}
    sessions = {tuple(r) for r in timeline.sessions(rows, ["folder"], "at", 12, "id", 2).collect()}
    hot()
    assert {r.id: r.island for r in timeline.islands(rows, ["folder"], "at", 12, "id").collect()} == plain and max(plain.values()) > 50
    assert {tuple(r) for r in timeline.sessions(rows, ["folder"], "at", 12, "id", 2).collect()} == sessions


def test_numbering_in_ranges_equals_the_window(spark, hot):
    rows = photos(spark)
    plain = {r.id: r.sequence for r in timeline.numbered(rows, F.col("folder"), "at", "id").collect()}
    hot()
    assert {r.id: r.sequence for r in timeline.numbered(rows, F.col("folder"), "at", "id").collect()} == plain


def test_one_folder_is_many_tasks(spark, hot):
    hot()
    rows = spark.range(0, 8_000, 1, 8).selectExpr("id", "'f' as folder", "id * 3 as at")
    sizes = [r["count"] for r in timeline.ranges(rows, ["folder"], [F.col("at")]).groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 4_000
    assert timeline.running(rows, ["folder"], [F.col("at")], "s", F.lit(1)).agg(F.max("s"), F.sum("s")).first()[:] == (8_000, 8_000 * 8_001 // 2)


def sequential(claims, existing):
    taken = {(f, n.lower()) for f, n in existing}
    given = {}
    waiting = []
    for i, folder, name in sorted(claims):
        if (folder, name.lower()) in taken:
            waiting.append((i, folder, name))
        else:
            taken.add((folder, name.lower()))
            given[i] = name
    for i, folder, name in waiting:
        stem, ext = re.fullmatch(r"(.+?)((?<=.)\.[^.]*)?", name, re.S).groups() if "." in name[1:] else (name, "")
        k = 2
        while (folder, f"{stem}_{k:03}{ext or ''}".lower()) in taken:
            k += 1
        given[i] = f"{stem}_{k:03}{ext or ''}"
        taken.add((folder, given[i].lower()))
    return given


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_names_equal_a_sequential_allocator(spark, monkeypatch, most):
    monkeypatch.setattr(timeline, "HOT_ROWS", most)
    rng = random.Random(most)
    pool = ["a.jpg", "A.JPG", "a_002.jpg", "a_003.jpg", "a_0004.jpg", "a_1000.jpg", "b", "b_002", "b_002_002", ".hidden", "x.tar.gz", "a.jpg", "IMG.jpg", "img.jpg"]
    claims = [(i, rng.choice(["/p", "/p", "/q"]), rng.choice(pool)) for i in range(300)]
    existing = [("/p", "a.jpg"), ("/p", "A_004.jpg"), ("/p", "a_007.JPG"), ("/q", "b"), ("/q", "img_002.jpg"), ("/q", "img_12.jpg"), ("/p", "a_002_003.jpg")]
    found = names.allocate(spark.createDataFrame([*claims, (900, None, "a"), (901, "/p", None)], "id long, folder string, name string"), spark.createDataFrame(existing, "folder string, name string")).collect()
    assert {r.id: r.final for r in found} == sequential(claims, existing) | {900: None, 901: None}
    places = [(r.folder, r.final.lower()) for r in found if r.final]
    assert len(set(places)) == len(places) and not set(places) & {(f, n.lower()) for f, n in existing}
