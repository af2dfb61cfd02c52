"""Jaccard links in blocks against all pairs: several blocks, sketches of all lengths, rare elements, classes without a row for each link."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gritstone.operators import setjoin, similar


def close_sets(rng, common, sizes, copies):
    """Sets of common numbers with variants that differ in more and more of them, some by rare ones."""
    out = []
    for size in sizes:
        base = rng.sample(range(common), size)
        for k in range(copies):
            lost = rng.randrange(0, 2 + size * k // (copies * 8))
            out.append(sorted({*base[lost:], *(rng.randrange(-(1 << 62), 1 << 62) for _ in range(rng.randrange(lost + 1)))}))
    return [list(x) for x in dict.fromkeys(tuple(x) for x in out if x)]


def all_pairs(sets, threshold):
    own = [frozenset(s) for s in sets]
    return {(i, j, round(len(a & b) / len(a | b), 9)) for i, a in enumerate(own) for j, b in enumerate(own) if i < j and round(len(a & b) / len(a | b), 9) >= threshold - 1e-9}


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.5])
def test_links_over_several_blocks_equal_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 70)
    monkeypatch.setattr(setjoin, "COMMON", 640)
    sets = close_sets(random.Random(4), 3_000, [1, 2, 5, 20, 60, 61, 64, 150, 160, 400, 420, 900, 1_500, 2_900], 18)
    wanted = all_pairs(sets, threshold)
    rows = spark.createDataFrame([(i, s, i % 3 + 1) for i, s in enumerate(sets)], "id long, g array<long>, size long")
    links = setjoin.links(rows, threshold)
    assert {tuple(r) for r in links.collect()} == wanted and len(wanted) > 100
    # Neither sets nor candidates are joined: what a pair costs is paid where its blocks meet.
    assert "Join" not in links._jdf.queryExecution().executedPlan().toString()
    found = setjoin.sums(rows, threshold)
    beyond = {r["id"]: r["b"] for r in found.groupBy("id").agg(F.sum("beyond").alias("b")).collect()}
    want = {}
    for i, j, _ in wanted:
        want[i], want[j] = want.get(i, 0) + j % 3 + 1, want.get(j, 0) + i % 3 + 1
    assert beyond == want
    hang = lambda pairs: {(r.node, r.component) for r in similar.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert hang([(r["id"], r["root"]) for r in found.collect()]) == hang([(i, j) for i, j, _ in wanted])


def test_ids_and_elements_of_other_kinds(spark):
    rows = spark.createDataFrame([("b", ["x", "y", None]), ("a", ["x", "y", None, "z"]), ("c", [None, "y", "x"]), ("d", ["q"])], "id string, grams array<string>")
    assert [tuple(r) for r in similar.jaccard_links(rows, 0.7).collect()] == [("a", "b", 0.75)]
    rows = spark.createDataFrame([(1, [1, 2, None]), (2, [2, 1, None, -(1 << 63)]), (2, [2, 1, None, -(1 << 63)])], "id int, grams array<long>")
    assert [tuple(r) for r in similar.jaccard_links(rows, 0.7).collect()] == [(1, 2, 0.75)]
    assert similar.jaccard_links(rows.where("id > 5"), 0.7).collect() == []


def test_classes_of_texts_that_are_all_linked_need_no_row_for_each_link(spark, monkeypatch):
    rng = random.Random(2)
    base = "".join(chr(0x4E00 + i) for i in range(160))
    texts = [base] * 3 + [base[:k] + chr(0x6E00 + k) + base[k + 1 :] for k in range(1, 150)] + ["".join(rng.sample(base, 100)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {tuple(r) for r in similar.class_rows(*similar.document_links(docs)).collect()}
    # 150 sets, all pairs of them linked, in two blocks: at most three rows for each set.
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 80)
    assert setjoin.sums(similar.document_sets(docs)[1], 0.95).count() <= 3 * 150
    monkeypatch.setattr(setjoin, "links", None)
    assert {tuple(r) for r in similar.document_classes(docs).collect()} == plain
    assert {r[3] for r in plain if r[0] < 152} == {151} and {r[3:] for r in plain if r[0] >= 152} == {(0, i) for i in range(152, 157)}


def test_rows_that_repeat_give_one_set(spark):
    text = "The quick brown fox jumps over the lazy dog and runs into the deep forest at night"
    docs = spark.createDataFrame([(1, text)] * 40 + [(2, text + "!")] * 2, "doc_id long, text string")
    members, sets = similar.document_sets(docs)
    assert members.count() == 42 and {(r["id"], r["size"]) for r in sets.collect()} == {(1, 40), (2, 2)} and sets.count() == 2
    assert {tuple(r) for r in similar.document_classes(docs).collect()} == {(1, 1, 40, 41, 1), (2, 2, 2, 41, 1)}


def test_bigrams_equal_their_definition():
    blank = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

    def wanted(text):
        text = re.sub(f"[{blank}]+", " ", text).strip(" ")
        return sorted({ord(a) << 21 | ord(b) for a, b in zip(text, text[1:], strict=False)}) if len(text) > 1 else [-1 - ord(c) for c in text]

    rng = random.Random(1)
    texts = ["".join(rng.choices(some, k=rng.randrange(9))) for some in ("a \t\xa0é\x1cÿ", "a  漢😀\ud800᠎", " ", "x" + blank) for _ in range(200)]
    assert [g.tolist() for g in similar._bigrams(texts)] == [wanted(t) for t in texts]
