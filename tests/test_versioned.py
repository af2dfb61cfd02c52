"""The versioned table: what a change writes, old versions, two writers, null keys."""

from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from gritstone.operators import mutation
from gritstone.sources.versioned import Conflict, VersionedTable

KIND = "drive string, path string, size long"


def rows(table, version=None):
    return sorted(((r.drive, r.path, r["size"]) for r in table.read(version).collect()), key=repr)


def stored(folder):
    return {str(p.relative_to(folder)) for p in pathlib.Path(folder).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    start = spark.createDataFrame([("d", f"/f{i}", i) for i in range(200)] + [("d", None, 7)], KIND)
    return VersionedTable.create(spark, str(tmp_path / "t"), start, ["drive", "path"], buckets=20)


def test_a_merge_writes_only_what_it_touches(spark, table):
    before, files = rows(table), stored(table.path)
    assert table.merge(spark.createDataFrame([("d", "/f3", 999), ("d", "/new", 1)], KIND)) == 1
    new = stored(table.path) - files
    touched = table.history()[1]["written"]
    assert files < stored(table.path) and 1 <= len(touched) <= 2 and {int(f.split("bucket=")[1].split("/")[0]) for f in new} == set(touched)
    kept = [table.manifest(1)["buckets"][b] == f for b, f in table.manifest(0)["buckets"].items() if int(b) not in touched]
    assert all(kept) and len(kept) >= 18
    assert rows(table, 0) == before
    assert rows(table) == sorted([("d", "/new", 1), *(("d", p, 999 if p == "/f3" else s) for _, p, s in before)], key=repr)
    read = table._folders(table.manifest(), touched).inputFiles()
    assert all(int(f.split("bucket=")[1].split("/")[0]) in touched for f in read)


def test_two_writers_of_a_version(spark, table, monkeypatch):
    other = VersionedTable(spark, table.path)
    late = other.manifest()
    table.merge(spark.createDataFrame([("d", "/a", 1)], KIND))
    monkeypatch.setattr(other, "manifest", lambda version=None: late)
    with pytest.raises(Conflict):
        other.merge(spark.createDataFrame([("d", "/b", 2)], KIND))
    monkeypatch.undo()
    assert ("d", "/b", 2) not in rows(table) and table.versions() == [0, 1]
    assert other.merge(spark.createDataFrame([("d", "/b", 2)], KIND)) == 2 and {("d", "/a", 1), ("d", "/b", 2)} <= set(rows(table))
    with pytest.raises(Conflict):
        VersionedTable.create(spark, table.path, spark.createDataFrame([], KIND), ["drive", "path"])


def test_deletes_restores_compacts_and_vacuums(spark, table):
    before = rows(table)
    table.delete("size < 10")
    assert rows(table) == [r for r in before if r[2] >= 10]
    table.delete("drive = 'd'")
    assert rows(table) == [] and table.merge(spark.createDataFrame([], KIND)) == 3 and rows(table) == []
    assert table.restore(0) == 4 and rows(table) == before and table.history()[4] == {"version": 4, "operation": "restore 0", "written": []}
    assert table.compact() == 5 and rows(table) == before
    files = stored(table.path)
    gone = table.vacuum(keep=2)
    assert gone and table.versions() == [4, 5] and rows(table, 4) == before and stored(table.path) < files
    with pytest.raises(KeyError):
        table.read(0)


def test_null_keys_and_ties(spark, table):
    table.merge(spark.createDataFrame([("d", None, 70), (None, None, 71)], KIND))
    assert {r for r in rows(table) if r[1] is None} == {("d", None, 70), (None, None, 71)}
    old = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    assert sorted(map(tuple, mutation.upsert(old, spark.createDataFrame([(None, 9), (3, 3)], "k long, v long"), ["k"]).collect()), key=repr) == [(2, 2), (3, 3), (None, 9)]
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, None, "n")], "k string, at long, v string")
    assert {tuple(r) for r in mutation.keep_latest(versions, ["k"], "at").collect()} == {("a", 2, "z"), (None, None, "n")}


def test_a_scan_is_merged_by_the_catalogue_rules(spark, tmp_path):
    kind = "drive_id string, path string, size long, modified_s long, content_hash string, is_deleted boolean"
    table = VersionedTable.create(spark, str(tmp_path / "c"), spark.createDataFrame([("d", f"/f{i}", i, 1, f"h{i}", i == 2) for i in range(6)], kind), ["drive_id", "path"], buckets=4)
    scan = spark.createDataFrame([("d", "/f1", 1, 1), ("d", "/f2", 5, 1), ("d", "/g", 4, 4)], "drive_id string, path string, size long, modified_s long")
    table.merge(scan, lambda old, new: mutation.merge_scan(old, new).drop("change"))
    assert {(r.path, r["size"], r.content_hash, r.is_deleted) for r in table.read().where(F.col("path").isin("/f1", "/f2", "/f3", "/g")).collect()} == {("/f1", 1, "h1", False), ("/f2", 5, None, False), ("/f3", 3, "h3", False), ("/g", 4, None, False)}
