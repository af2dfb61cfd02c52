"""Best persons by balls against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from gritstone.operators import gallery, match

FACE, PERSON = "face_id long, stage string, embedding array<double>", "person_id long, stage string, embedding array<double>"


def plain(faces, known, threshold, boost):
    out = {}
    for i, s, x in faces:
        for p, t, y in known:
            if x is None or y is None or not np.any(x) or not np.any(y):
                continue
            score = round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) + boost * (s is not None and s == t), 9)
            if score > threshold and (i not in out or (score, -p) > (out[i][1], -out[i][0])):
                out[i] = (p, score)
    return out


def data(seed=5, persons=12, spread=0.2, n=300):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(persons, 10))
    stages = ["baby", "adult", None]
    make = lambda: (k := int(rng.integers(persons)), stages[int(rng.integers(3))], (middles[k] + spread * rng.normal(size=10)).tolist())
    known = [make() for _ in range(n)] + [(3, None, None), (4, "adult", [0.0] * 10)]
    faces = [(i, *make()[1:]) for i in range(200)] + [(500, "adult", None), (501, None, [0.0] * 10), (502, "baby", known[0][2]), (502, "baby", known[0][2])]
    return faces, known


@pytest.mark.parametrize(("threshold", "boost"), [(0.85, 0.05), (0.3, 0.05), (-1.0, 0.0), (0.999, 0.05), (0.9, -0.1)])
def test_equals_all_pairs(spark, monkeypatch, threshold, boost):
    monkeypatch.setattr(gallery, "BALL_ROWS", 20)
    monkeypatch.setattr(gallery, "LEFT_ROWS", 50)
    monkeypatch.setattr(gallery, "RIGHT_ROWS", 15)
    faces, known = data()
    found = match.gallery_match(spark.createDataFrame(faces, FACE), spark.createDataFrame(known, PERSON), threshold, boost).collect()
    want = plain(faces, known, threshold, boost)
    got = {r.face_id: (r.person_id, r.score) for r in found}
    assert got.keys() == want.keys() and len(found) == len(got)
    assert all(abs(got[i][1] - want[i][1]) < 2e-9 and (got[i][0] == want[i][0] or abs(got[i][1] - want[i][1]) < 2e-9) for i in want)


def test_few_products_are_done(spark, monkeypatch):
    monkeypatch.setattr(gallery, "BALL_ROWS", 10)
    faces, known = data(persons=40, spread=0.05, n=1_000)
    report: list = []
    assert match.gallery_match(spark.createDataFrame(faces, FACE), spark.createDataFrame(known, PERSON), report=report).count() > 150
    ((done, total),) = report
    assert done < 0.15 * total


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], FACE), spark.createDataFrame([(1, "adult", [1.0, 0.0])], PERSON)
    assert match.gallery_match(none, some).collect() == [] == match.gallery_match(some.withColumnRenamed("person_id", "face_id"), none.withColumnRenamed("face_id", "person_id")).collect()
