"""Merged transforms and repeated 100-byte strings against plain dictionaries."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from gritstone.llm import bwt, repeats

KIND = "doc_id long, text string, lang string, id string, h string, body string, start string, n string, key string, kind string"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 99)) for _ in range(n))


def odd():
    rng = random.Random(4)
    passages = [sentence(rng, 40) for _ in range(6)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "a" * 700, "ab" * 300, "é" * 80, "\x00" * 250, "no\x00ise" * 40, passages[0], passages[0][1:], passages[0][:150] + "é" + passages[0][150:]]
    for i in range(60):
        texts.append(sentence(rng, rng.randint(1, 60)) + rng.choice(["", passages[i % 6], passages[i % 6] + passages[(i + 1) % 6], passages[0] * 2, passages[1][:101], passages[2][3:102]]) + sentence(rng, rng.randint(0, 60)))
    texts += texts[20:30] * 3
    rows = [((i * 37) % 1000, t) for i, t in enumerate(texts)]
    return rows + [rows[15], rows[15], (None, texts[20]), (None, passages[3]), (None, passages[3]), (37, passages[4] + "tail")]


def order(row):
    i, text = row
    return (i is None, i or 0)


def plain(spark, rows):
    """One result for each different (id, text), by a dictionary of all windows."""
    frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(cast(coalesce(text, '') as binary)) as h").distinct()
    seen, out = set(), {}
    for r in sorted(frame.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h)):
        body = (r.text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 99):
            w = body[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        n_spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[r.doc_id, r.text] = (len(body), sum(gone), n_spans, hashlib.sha256(kept).hexdigest(), kept)
    return [(i, *out[i, t]) for i, t in rows]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("way", ["as it is", "hot", "wide", "small batches"])
def test_equals_a_dictionary_of_windows(spark, monkeypatch, way):
    rows = odd()
    docs = spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], KIND).repartition(5)
    if way == "hot":
        monkeypatch.setattr(repeats, "SAMPLE", 1)
        monkeypatch.setattr(repeats, "HOT_PART", 300)
        assert len(repeats.hot_keys(docs.selectExpr("coalesce(doc_id, 0L) as id", "0L as h", "cast(coalesce(text, '') as binary) as body")))
    if way == "wide":
        monkeypatch.setattr(repeats, "WIDE", 2)
    if way == "small batches":
        monkeypatch.setattr(repeats, "MERGED", 2_000)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = [(r[0], *r[1:5], bytes(r[5])) for r in repeats.dedup(docs, with_text=True).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(found, key=key) == sorted(plain(spark, rows), key=key)


def test_no_documents(spark):
    assert repeats.dedup(spark.createDataFrame([], KIND)).collect() == []


def test_equal_windows_share_a_key_in_parts_of_long_texts(monkeypatch):
    texts = [("" if t is None else t).encode() for _, t in odd()]
    texts.append(b"".join(texts) * 2)
    for piece in (500, 1 << 20):
        monkeypatch.setattr(repeats, "PIECE", piece)
        keys, seen = {}, set()
        for text, starts, who, where in repeats.joined(texts):
            for k, _, place, n, twice in zip(*repeats.segments(text, starts, np.zeros(0, np.uint64)), strict=True):
                part = np.searchsorted(starts, place, side="right") - 1
                inside = [text[p : p + 100].tobytes() for p in range(place, place + n)]
                assert twice or len({*inside}) == len(inside)
                for j, w in enumerate(inside):
                    spot = (int(who[part]), int(place - starts[part] + where[part]) + j)
                    assert spot not in seen and texts[spot[0]][spot[1] : spot[1] + 100] == w
                    seen.add(spot)
                    assert keys.setdefault(w, k) == k
        assert seen == {(i, j) for i, t in enumerate(texts) for j in range(len(t) - 99)}


@pytest.mark.parametrize("depth", [2, 4, 10])
def test_merge_finds_all_repeated_intervals(depth):
    rng = random.Random(depth)
    for _ in range(10):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(12)]
        shards, owners = [], []
        for a in range(0, 12, 4):
            starts = np.cumsum([0, *map(len, strings[a : a + 4])])
            shards.append(bwt.transform(np.frombuffer(b"".join(strings[a : a + 4]), np.uint8), starts, depth))
            owners.append(a + np.searchsorted(starts, shards[-1].at, side="right") - 1)
        found, want = {}, {}
        for s, r, v in zip(*bwt.merge(shards, depth), strict=True):
            found.setdefault(v, set()).add((int(owners[s][r]), int(shards[s].offset[r])))
        for i, t in enumerate(strings):
            for o in range(len(t) - depth + 1):
                want.setdefault(t[o : o + depth], set()).add((i, o))
        assert [found[v] for v in sorted(found)] == [want[w] for w in sorted(want) if len(want[w]) > 1]


def test_shards_of_any_size_give_the_same(monkeypatch):
    texts = [t.encode() for _, t in odd() if t and len(t) > 120]
    ids, h, start = np.arange(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    results = []
    for size in (300, 5_000, 1 << 20):
        monkeypatch.setattr(repeats, "SHARD", size)
        results.append([x.tolist() for x in repeats.repeated_windows(ids, h, start, texts)])
    assert results[0] == results[1] == results[2] and results[0][0]
