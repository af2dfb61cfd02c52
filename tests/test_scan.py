"""The folder data source against os.walk: batch, pushed filters, resumed streams."""

from __future__ import annotations

import os

import pytest

from gritstone.functions.paths import is_ignored
from gritstone.sources import scan


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "drive"
    names = ["b.txt", "A.jpg", "a.JPG", "sub/x.txt", "sub/Y.txt", "sub/deep/z.jpg", "Sub2/k", "sub.txt", "node_modules/no.txt", ".hidden", ".git/c", "empty/", "x.tmp", *[f"many/f{i:03}.txt" for i in range(40)], *[f"n{i}/g{j}.cr2" for i in range(5) for j in range(3)]]
    for i, n in enumerate(names):
        path = root / n
        if n.endswith("/"):
            path.mkdir(parents=True)
            continue
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * i)
    os.symlink(root / "sub", root / "link")
    return str(root)


def walked(root, hidden=False):
    out = {}
    for folder, folders, files in os.walk(root):
        folders[:] = [n for n in folders if not is_ignored(n) and (hidden or not n.startswith("."))]
        for n in files:
            if not is_ignored(n) and (hidden or not n.startswith(".")) and not os.path.islink(os.path.join(folder, n)):
                path = os.path.join(folder, n)
                out[path] = os.path.getsize(path)
    return out


def frame(spark, root, **options):
    scan.register(spark)
    return spark.read.format("folders").options(**options).load(root)


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_batch_equals_walk(spark, tree, parts):
    rows = frame(spark, tree, partitions=parts).collect()
    assert {r.path: r["size"] for r in rows} == walked(tree) and len(rows) == len(walked(tree))
    assert {r.path for r in frame(spark, tree, hidden=True).collect()} == set(walked(tree, hidden=True))
    assert {r.path for r in frame(spark, tree, mostBytes=5).collect()} == {p for p, n in walked(tree).items() if n <= 5}


def test_filters_reach_the_reader(spark, tree):
    df = frame(spark, tree, partitions=1000).where(f"startswith(path, '{tree}/sub/') and file_type in ('.txt', '.jpg') and size > 3 and filename <> 'q'")
    assert {r.path for r in df.collect()} == {p for p, n in walked(tree).items() if p.startswith(tree + "/sub/") and n > 3}
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = next(line for line in plan.splitlines() if "Filter" in line and "PushedFilters" not in line)
    assert "filename" in kept and "size" not in kept and "file_type" not in kept
    assert df.rdd.getNumPartitions() < frame(spark, tree, partitions=1000).rdd.getNumPartitions()


def test_order_and_start(tree):
    rules = scan.Rules()
    every = [p for p, _, _ in scan.entries(tree, rules)]
    assert every == sorted(every, key=scan._order) and {os.path.join(tree, *p) for p in every} == set(walked(tree))
    for at in range(0, len(every), 7):
        assert [p for p, _, _ in scan.entries(tree, rules, every[at])] == every[at + 1 :]
    gone = (*every[9][:-1], every[9][-1] + "0")
    assert [p for p, _, _ in scan.entries(tree, rules, gone)] == [p for p in every if scan._order(p) > scan._order(gone)]
    assert [e for _, _, e in scan.entries(tree + "/none", rules)] == ["FileNotFoundError: No such file or directory"]


def test_a_stopped_scan_resumes_where_it_was(spark, tree, tmp_path):
    scan.register(spark)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    stream = lambda: spark.readStream.format("folders").options(perBatch=10, slices=3).load(tree)
    seen = []

    def fail(batch, n):
        seen.append(n)
        if n == 2:
            raise RuntimeError("stopped")
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    def drain(step):
        run = stream().writeStream.foreachBatch(step).option("checkpointLocation", log).trigger(processingTime="0 seconds").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()

    with pytest.raises(Exception, match="stopped"):
        drain(fail)
    drain(lambda batch, n: (seen.append(n), batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))[0])
    paths = [r.path for r in spark.read.parquet(out).collect()]
    assert sorted(paths) == sorted(walked(tree)) and seen[:4] == [0, 1, 2, 2] and len(set(seen)) >= 5


def test_changes_against_the_catalogue(spark, tree):
    rows = frame(spark, tree)
    known = [(r.path, r["size"], r.modified_s) for r in rows.collect()]
    old = [("D", p, s + (i == 1), m, False) for i, (p, s, m) in enumerate(known[:-1])] + [("E", known[-1][0], 0, 0, False)]
    found = scan.classify(rows, spark.createDataFrame(old, "drive_id string, path string, size long, modified_s long, is_deleted boolean"), "D")
    assert {r.path: r.change for r in found.collect()} == {p: "modified" if i == 1 else "new" if i == len(known) - 1 else "unchanged" for i, (p, _, _) in enumerate(known)}
