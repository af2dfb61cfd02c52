"""Queries over whole tables, on fixtures that reach beyond the rows their SQL is cut to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gritstone.queries import registry

QUERIES = registry.queries()


def embeddings(folder, vectors, labels=None, start=0):
    """The folder, with an embeddings table of the vectors, ids counting from start."""
    n = len(vectors)
    columns = {"vec_id": pa.array(range(start, start + n), pa.int64()), "embedding": pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32())), "label": pa.array([int(x) for x in (labels if labels is not None else [0] * n)], pa.int32())}
    pq.write_table(pa.table(columns), str(folder / "embeddings.parquet"))
    return str(folder)


def scattered(n, spread, centres=6, seed=4):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, 64))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, 64))).astype(np.float32)


def test_density_clusters_take_every_vector(spark, tmp_path):
    v = scattered(560, 1.2).astype(float)
    got = {r["id"]: r["cluster"] for r in QUERIES["density_clusters"](spark, embeddings(tmp_path, v)).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = 1 - unit @ unit.T <= 0.62
    core = near.sum(1) >= 3
    name = np.where(core, np.arange(len(v)), len(v))
    while True:
        least = np.where(core, np.where(near & core, name, len(v)).min(1), len(v))
        if (least == name).all():
            break
        name = least
    border = np.where(near & core, name, len(v)).min(1)
    assert got == {i: int(border[i]) for i in range(len(v)) if border[i] < len(v)} and max(got) >= 500


def test_histogram_similarity_takes_every_pair(spark, tmp_path):
    v = scattered(130, 1.0).astype(float)
    got = {(r["a"], r["b"]): r["sim"] for r in QUERIES["histogram_similarity"](spark, embeddings(tmp_path, v)).collect()}
    assert set(got) == {(i, i + 1) for i in range(129)}
    assert all(abs(s - max(0, (np.corrcoef(v[a], v[b])[0, 1] + 1) / 2)) < 1e-6 for (a, b), s in got.items())


def frame_bits(v):
    bits = (np.asarray(v) > 0).astype(np.uint64)
    return [int("".join(map(str, r)), 2) for r in bits]


def alike(one, two):
    """The reference's score of two videos, one being that of the smaller id."""
    lead, other = (one, two) if len(one) <= len(two) else (two, one)
    return sum(max(1 - ((p ^ q).bit_count() + (d ^ e).bit_count()) / 128 for q, e in other) for p, d in lead) / len(lead)


def test_video_similarity_takes_every_pair(spark, tmp_path):
    v = scattered(523, 1.0)
    v[484:488] = v[40:44] * 1.5
    v[485, :5] *= -1
    h = frame_bits(v)
    frames = {}
    for i, p in enumerate(h):
        frames.setdefault(i // 4, []).append((p, h[min(i + 1, len(h) - 1)]))
    want = {(a, b): s for a in frames for b in frames if a < b and (s := alike(frames[a], frames[b])) >= 0.70}
    got = {(r["a"], r["b"]): r["sim"] for r in QUERIES["video_similarity"](spark, embeddings(tmp_path, v)).collect()}
    assert (10, 121) in got and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_video_groups_over_blocks_and_in_the_plan(spark):
    import random

    from gritstone.operators import similar
    from gritstone.plans import duplicates

    rng = random.Random(6)
    frames = {v: [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(rng.randrange(1, 6))] for v in range(40)}
    for v in range(0, 40, 3):
        near = [(p ^ rng.getrandbits(64) & rng.getrandbits(64), d ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for p, d in frames[v]]
        frames[40 + v] = near[: rng.randrange(1, 6)] + [(rng.getrandbits(64), 0)] * (v % 2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(v, signed(p), signed(d)) for v, fs in frames.items() for p, d in fs], "video long, p long, d long")
    want = {(a, b): s for a in frames for b in frames if a < b and (s := alike(frames[a], frames[b])) >= 0.70}
    got = {(r["src"], r["dst"]): r["sim"] for r in similar.video_links(rows, block_rows=30).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    files = spark.createDataFrame([(v, v == 43, None, "t") for v in frames], "id long, is_deleted boolean, content_hash string, text string")
    groups = {(r["group_id"], r["id"]) for r in duplicates.all_duplicates(files, frames=rows).where("match_type = 'video'").collect()}
    assert {x for _, x in groups} == {x for k in want if 43 not in k for x in k}


def test_chain_gaps_read_every_face(spark, tmp_path):
    labels = np.arange(90) % 7
    got = {(r["person_id"], r["gap_start"], r["gap_end"], r["years"]) for r in QUERIES["chain_gaps"](spark, embeddings(tmp_path, np.ones((90, 64)), labels)).collect()}
    years = {}
    for i in range(90):
        if i % 3:
            years.setdefault(int(labels[i]), set()).add(1990 + i * 31 % 30)
    want = {(p, a + 1, b - 1, b - a - 1) for p, ys in years.items() for a, b in zip(sorted(ys), sorted(ys)[1:]) if b - a > 1}
    assert want and got == want


def test_gaps_are_bridged_inside_and_by_the_best_pet(spark):
    from gritstone.operators import people

    kind = "species string, breed string, embedding array<double>, histogram array<double>, taken_h long"
    x, y = [1.0, 0.0], [0.0, 1.0]
    pets = spark.createDataFrame([(1, "cat", "b", x, x, 0), (2, "cat", "b", y, y, 0)], "pet_id long, " + kind)
    assigned = spark.createDataFrame([(1, 2000), (1, 2003), (1, 2007), (2, 2000), (2, 2001)], "pet_id long, year int")
    rows = [(10, 2001, x), (11, 2003, x), (12, 2005, x), (13, 2002, y), (14, 2002, x)]
    unassigned = spark.createDataFrame([(i, t, "dog" if i == 14 else "cat", "b", e, e, 0) for i, t, e in rows], "id long, year int, " + kind)
    assert {(r["id"], r["pet_id"]) for r in people.bridge_gaps(assigned, unassigned, pets).collect()} == {(10, 1)}


def test_streamed_windows_wait_for_the_last_batch(spark, small, monkeypatch):
    from pyspark.sql.streaming.query import StreamingQuery

    wait = StreamingQuery.awaitTermination
    # A limit runs out at once here: the stream is slower than any.
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: False if timeout is not None else wait(self))
    rows = QUERIES["streamed_windows"](spark, small).collect()
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{small}/events.parquet").count()


def test_communication_network_reads_whole_texts(spark, tmp_path):
    texts = ["Anna wrote to berta. " + "x " * 3_000 + "Carl wrote to dora.", "Carl wrote to dora."]
    pq.write_table(pa.table({"conv_id": pa.array([1, 2], pa.int64()), "text": texts}), str(tmp_path / "conversations.parquet"))
    got = {(r["sender"], r["recipient"]): r["messages"] for r in QUERIES["communication_network"](spark, str(tmp_path)).collect()}
    assert got == {("Anna", "berta"): 1, ("Anna", "dora"): 1, ("Carl", "berta"): 1, ("Carl", "dora"): 2}


def cosines(v):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return unit @ unit.T


def stage(age):
    return None if age is None else sum(age >= x for x in (2, 5, 12, 18))


def test_galleries_are_all_known_faces(spark, tmp_path, monkeypatch):
    from gritstone.operators import match
    from gritstone.operators.people import temporal_score

    meet = match.meet
    monkeypatch.setattr(match, "meet", lambda *a: meet(*a, left_rows=20, right_rows=40))
    n = 150
    labels = np.arange(n) // 15
    v = scattered(n, 0.8, centres=10).astype(float)
    folder = embeddings(tmp_path, v, labels)
    e, hour = cosines(v), np.arange(n) * 7_919 % 900_000
    known, free = [i for i in range(n) if i % 3], range(0, n, 3)
    days = {(f, g): abs((int(hour[f]) - int(hour[g])) // 24) for f in free for g in known}

    matched = {}
    for f in free:
        own = stage(f * 13 % 60) if f % 7 else None
        best = max((round(e[f, g] + 0.05 * (stage(1990 + g * 31 % 30 - 1970 - labels[g] * 3 if 0 <= 1990 + g * 31 % 30 - 1970 - labels[g] * 3 <= 120 else g * 13 % 60 if g % 7 and g * 13 % 60 else 25) == own), 9), -labels[g]) for g in known)
        if best[0] > 0.3:
            matched[f] = (-best[1], best[0], "confirmed" if best[0] >= 0.45 else "pending")
    got = {r["face_id"]: (r["person_id"], r["score"], r["status"]) for r in QUERIES["gallery_matches"](spark, folder).collect()}
    assert matched and got.keys() == matched.keys() and all(got[f][::2] == matched[f][::2] and abs(got[f][1] - matched[f][1]) < 1e-8 for f in got)

    scores = [r["s"] for r in spark.range(40_000).select(temporal_score(F.col("id")).alias("s"), "id").orderBy("id").collect()]
    pets = {}
    for f in free:
        best = max((round(0.5 * e[f, g] + 0.3 * (e[f, g] + 1) / 2 + 0.1 * (f % 3 == g % 3) + 0.1 * scores[days[f, g]], 6), -g) for g in known if f % 2 == g % 2)
        if best[0] > 0.3:
            pets[f] = -best[1]
    assert pets and {r["id"]: r["pet_id"] for r in QUERIES["pet_candidates"](spark, folder).collect()} == pets

    nearest = {}
    for f in free:
        for p in set(labels[known]):
            d, s = min((days[f, g], -round(e[f, g], 9)) for g in known if labels[g] == p)
            if -s > (0.05 if d <= 1 else 0.06 if d <= 30 else 0.07 if d <= 365 else 0.08):
                nearest[f, int(p)] = d
    assert nearest and {(r["face_id"], r["person_id"]): r["days"] for r in QUERIES["nearest_face_in_time"](spark, folder).collect()} == nearest
