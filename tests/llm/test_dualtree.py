"""Dual-tree Lloyd against plain Lloyd in whole numbers."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from gritstone.catalog import table
from gritstone.llm import dualtree

KIND = "vec_id long, embedding array<double>, label int, cluster string, v string, ids string, distance string"


def plain(rows, k, rounds, dims, scale=256):
    """rows of (id, vector): what the contract says, pair by pair."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    means = np.array([v for _, v in first], np.int64)
    points = np.array([v for _, v in kept], np.int64)
    near = lambda: np.array([((p - means) ** 2).sum(1).argmin() for p in points])
    for _ in range(rounds):
        at = near()
        for c in set(at.tolist()):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at, total = near(), defaultdict(int)
    far = [int(((p - means[a]) ** 2).sum()) for p, a in zip(points, at, strict=True)]
    for a, d in zip(at.tolist(), far, strict=True):
        total[a] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means.tolist()]
    return [(i, a, d, total[a], sum(far), sha[a]) for (i, _), a, d in zip(kept, at.tolist(), far, strict=True)]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], KIND)


def odd():
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 4, (9, 6))
    rows = [(i, (middles[i % 9] + rng.normal(0, 0.3, 6)).tolist()) for i in range(900)]
    rows += [(1_000 + i, middles[0].tolist()) for i in range(700)]  # many copies
    rows += [(5, [0.5] * 6), (5, [0.5] * 6), (None, [1.0] * 6), (None, [-1.0] * 6)]
    rows += [(2_000 + i, [float(x) for x in p]) for i, p in enumerate(np.ndindex(2, 2, 2, 1, 1, 1))]  # ties
    return rows + [(3_000, None), (3_001, []), (3_002, [1.0] * 5), (3_003, [1.0] * 5 + [None]), (3_004, [math.nan] * 6), (3_005, [math.inf] + [0.0] * 5), (3_006, [-0.001] * 6)]


@pytest.mark.parametrize(("k", "block", "leaf"), [(7, 2048, 16), (40, 64, 2), (1, 100, 1)])
def test_equals_plain_lloyd(spark, monkeypatch, k, block, leaf):
    monkeypatch.setattr(dualtree, "BLOCK", block)
    rows = odd()
    found = [tuple(r) for r in dualtree.cluster(frame(spark, rows).repartition(3), k=k, dims=6, rounds=4).collect()]
    assert sorted(found, key=key) == sorted(plain(rows, k, 4, 6), key=key)


def test_pruning_compares_few_pairs(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 10, (40, 8))
    rows = [(i, (middles[i % 40] + rng.normal(0, 0.05, 8)).tolist()) for i in range(4_000)]
    report: list = []
    found = [tuple(r) for r in dualtree.cluster(frame(spark, rows), k=40, dims=8, report=report).collect()]
    assert sorted(found, key=key) == sorted(plain(rows, 40, 5, 8), key=key)
    assert sum(c for c, _ in report) < 0.2 * sum(p for _, p in report)


def test_whole_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in table(spark, small, "embeddings").collect()]
    found = [tuple(r) for r in dualtree.cluster(table(spark, small, "embeddings")).collect()]
    assert sorted(found, key=key) == sorted(plain(rows, 40, 5, 64), key=key)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0] * 6)], [(4, [1.0] * 6)], [(4, [1e30] * 6), (5, [-1e30] * 6), (6, [0.0] * 6)]])
def test_small_tables(spark, rows):
    found = dualtree.cluster(frame(spark, rows), k=2, dims=6).collect()
    assert len(found) == sum(v is not None for _, v in rows) * any(i is not None for i, _ in rows)
    assert all(r.distance >= 0 and r.inertia >= r.cluster_inertia >= r.distance for r in found)


def test_tree_covers_and_separates():
    points = np.random.default_rng(1).normal(size=(500, 5))
    tree = dualtree.cover_tree(points)
    assert sorted(tree.order.tolist()) == list(range(500))
    for (a, b), (c, d), centre, radius in zip(tree.span, tree.kids, tree.centre, tree.radius, strict=True):
        members = tree.order[a:b]
        assert np.linalg.norm(points[members] - points[centre], axis=1).max(initial=0) <= radius + 1e-9
        if d:
            assert tree.span[c][0] == a and tree.span[d - 1][1] == b
            gaps = np.linalg.norm(points[tree.centre[c:d]][:, None] - points[tree.centre[c:d]][None], axis=2)
            assert gaps[np.triu_indices(d - c, 1)].min(initial=9) > max(tree.radius[c:d]) - 1e-9
