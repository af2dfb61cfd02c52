"""Groups that grow batch by batch against groups made at once."""

from __future__ import annotations

import random

from gritstone.operators import similar
from gritstone.operators.increments import NearIndex


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(n=300):
    rng = random.Random(9)
    out = []
    for i in range(n):
        h = rng.getrandbits(64) if i < 40 or rng.random() < 0.2 else out[rng.randrange(len(out))][1] & (2**64 - 1)
        for b in rng.sample(range(64), rng.choice([0, 0, 1, 3, 4, 5])):
            h ^= 1 << b
        out.append((i, signed(h)))
    return [*out, (n, None)]


def groups(found):
    by = {}
    for i, c in found:
        by.setdefault(c, set()).add(i)
    return {frozenset(x) for x in by.values()}


def test_three_batches_equal_one(spark, tmp_path):
    rows = hashes()
    df = spark.createDataFrame(rows, "id long, hash long")
    once = NearIndex(spark, str(tmp_path / "one"), 4)
    once.add(df)
    whole = {(r.id, r.component) for r in once.groups().collect()}
    plain = {(r.id, r.component) for r in similar.hash_classes(df, similar.hamming_links(df, 4)).collect()}
    assert whole == plain and len(groups(whole)) > 30
    grown, names = NearIndex(spark, str(tmp_path / "three"), 4), {}
    for low, high in ((100, 200), (0, 100), (200, 301)):
        grown.add(df.where(f"id >= {low} and id < {high}"))
        now = {r.id: r.component for r in grown.groups().collect()}
        # A name that is in use is that of an old group, if any of its rows are old.
        for component in set(now.values()):
            old = {names[i] for i, c in now.items() if c == component and i in names}
            assert not old or component == min(old)
        names = now
    assert groups(names.items()) == groups(whole)


def test_stored_rows_meet_new_ones_only(spark, tmp_path):
    df = spark.createDataFrame(hashes(), "id long, hash long")
    index = NearIndex(spark, str(tmp_path / "i"), 4)
    index.add(df.where("id < 200"))
    fresh = df.where("id >= 200 and hash is not null").selectExpr("id", "hash as h0").dropDuplicates(["h0"])
    found = index.links(fresh, 1)
    assert found.where("src < 200").isEmpty() and not found.where("dst < 200").isEmpty()
    scans = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "ReadSchema: struct<n:int,v:bigint,id:bigint,h0:bigint>" in scans[0]


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, 1 << 40)], "id long, hash long")
    index = NearIndex(spark, str(tmp_path / "b"), 1)
    index.add(df.where("id = 1"))
    real = index._file
    monkeypatch.setattr(index, "_file", lambda part: (_ for _ in ()).throw(OSError("gone")) if part == "add=1/done" and broken else real(part))
    broken = False
    assert index.batches() == 1
    monkeypatch.setattr(index, "batches", lambda: 1)
    broken = True
    try:
        index.add(df.where("id = 2"))
        raise AssertionError
    except OSError:
        pass
    monkeypatch.undo()
    assert {tuple(r) for r in index.groups().collect()} == {(1, 1)}
    index.add(df.where("id > 1"))
    assert {tuple(r) for r in index.groups().collect()} == {(1, 1), (2, 1), (3, 3)}
    index.add(df.where("id < 0"))
    assert index.batches() == 3 and index.groups().count() == 3
