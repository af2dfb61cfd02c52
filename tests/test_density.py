"""Density clustering by pivots against the definition, and what it leaves out."""

from __future__ import annotations

import numpy as np
import pytest

from gritstone.operators import density, match


def plain(ids, v, eps, least):
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
    close = 1 - unit @ unit.T <= eps + 1e-12
    np.fill_diagonal(close, True)
    core = close.sum(1) >= least
    name = np.where(core, ids, 1 << 40)
    while True:
        new = np.where(core, np.where(close & core, name, 1 << 40).min(1), 1 << 40)
        if (new == name).all():
            break
        name = new
    found = np.where(close & core, name, 1 << 40).min(1)
    return {int(i): int(c) for i, c in zip(ids, found, strict=True) if c < 1 << 40}


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, embedding array<double>")


def data(seed, n=700, spread=0.15, centres=9):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(centres, 6))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, 6))
    v[:40] = v[0]  # copies
    v[40:43] = 0
    v[43:60] = rng.normal(size=(17, 6))
    return rng.permutation(n) + 5, v


@pytest.mark.parametrize(("eps", "least"), [(0.01, 3), (0.05, 5), (0.3, 2), (0.62, 3), (0.02, 1), (0.05, 60), (1.2, 3)])
def test_equals_the_definition(spark, monkeypatch, eps, least):
    monkeypatch.setattr(density, "CELL_ROWS", 50)
    monkeypatch.setattr(density, "BLOCK_ROWS", 60)
    ids, v = data(3)
    found = {r.id: r.cluster for r in match.dbscan(frame(spark, ids, v), eps, least).collect()}
    assert found == plain(ids, v, eps, least)


def test_few_pairs_meet_where_there_are_clusters(spark, monkeypatch):
    monkeypatch.setattr(density, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(60, 24)), 50, axis=0) + 0.01 * rng.normal(size=(3000, 24))
    ids, report = np.arange(3000), []
    found = {r.id: r.cluster for r in match.dbscan(frame(spark, ids, v), 0.02, 4, report=report).collect()}
    assert found == plain(ids, v, 0.02, 4) and len(set(found.values())) == 60
    ((met, total),) = report
    assert total == 3000**2 and met < 0.1 * total


def test_empty_and_null_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])], "id long, embedding array<double>")
    assert {tuple(r) for r in match.dbscan(rows, 0.1, 2).collect()} == {(3, 3), (4, 3)}
    assert {tuple(r) for r in match.dbscan(rows, 0.1, 1).collect()} == {(2, 2), (3, 3), (4, 3)}
    assert match.dbscan(rows.where("id < 2"), 0.1, 2).collect() == []


def test_few_pairs_meet_where_the_radius_is_wide(spark, monkeypatch):
    for what, size in (("CELL_ROWS", 100), ("BLOCK_ROWS", 150), ("SAMPLE_ROWS", 150), ("FIRST_BLOCKS", 3)):
        monkeypatch.setattr(density, what, size, raising=False)
    rng = np.random.default_rng(5)
    v = np.zeros((3000, 24))
    v[:, :16] = rng.normal(size=(3000, 16))
    # A group apart, a core point with two border points, a pair and single vectors, dealt over all blocks.
    v[:40] = np.eye(24)[16] + 0.05 * rng.normal(size=(40, 24))
    turn = 0.8 * np.arange(3)
    v[40:43] = np.cos(turn)[:, None] * np.eye(24)[17] + np.sin(turn)[:, None] * np.eye(24)[18]
    v[43:45], v[45], v[46] = np.eye(24)[19], np.eye(24)[20], np.eye(24)[21]
    ids, report = rng.permutation(3000), []
    found = {r.id: r.cluster for r in match.dbscan(frame(spark, ids, v), 0.62, 3, report=report).collect()}
    expected = plain(ids, v, 0.62, 3)
    assert found == expected and len(set(found.values())) == 3
    assert {int(i) for i in ids[40:43]} <= set(found) and not {int(i) for i in ids[43:47]} & set(found)
    ((met, total),) = report
    assert total == 2999**2 and met < 0.35 * total


def test_all_visit_all_blocks_where_few_have_neighbours(spark, monkeypatch):
    for what, size in (("CELL_ROWS", 100), ("BLOCK_ROWS", 40), ("SAMPLE_ROWS", 30), ("FIRST_BLOCKS", 3)):
        monkeypatch.setattr(density, what, size, raising=False)
    rng = np.random.default_rng(6)
    # Ids of more digits than a double holds.
    ids, v, far = rng.permutation(900), rng.normal(size=(900, 20)), 1 << 60
    got = {r.id - far: r.cluster - far for r in match.dbscan(frame(spark, ids + far, v), 0.32, 3).collect()}
    assert got == plain(ids, v, 0.32, 3) and 5 < len(set(got.values())) and len(got) < 850
