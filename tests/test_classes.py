"""No link between different rows is lost where copies collapse: classes, membership and missing hashes against all pairs."""

from __future__ import annotations

import random

import pytest

from gritstone.operators import similar
from gritstone.plans import duplicates

FILES = "id long, drive_id string, path string, size long, content_hash string, is_deleted boolean, text string"


def components(ids, links):
    own = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(own[a], own[b])
            if own[a] != least or own[b] != least:
                own[a] = own[b] = least
                changed = True
    return own


def expected(rows, linked, equal):
    ids = [r[0] for r in rows]
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and linked(a, b)]
    rep = {a[0]: min(b[0] for b in rows if a[0] == b[0] or equal(a, b)) for a in rows}
    comp = components(ids, pairs)
    return {(i, rep[i], sum(r == rep[i] for r in rep.values()), sum(i in p for p in pairs), comp[i]) for i in ids}


def test_documents_with_equal_bigrams_stay_in_a_class(spark):
    base = "The quick brown fox jumps over the lazy dog and runs into the deep forest at night"
    texts = [base, base.upper(), "  " + base.replace(" ", "  "), base + "!", base + "!", "something else that is also longer than fifty characters, surely so", "short", None]
    files = spark.createDataFrame([(i, "d", f"/f{i}", 10, f"h{i}", False, t) for i, t in enumerate(texts)], FILES)
    groups = {(r.match_type, r.group_id, r.id) for r in duplicates.all_duplicates(files).collect()}
    assert groups == {("document", 0, i) for i in range(5)}
    members, links = similar.document_links(files, key="id")
    found = {tuple(r) for r in similar.class_rows(members, links).collect()}
    assert found == {(0, 0, 3, 4, 0), (1, 0, 3, 4, 0), (2, 0, 3, 4, 0), (3, 3, 2, 4, 0), (4, 3, 2, 4, 0), (5, 5, 1, 0, 5)}
    pairs = {(r.src, r.dst) for r in similar.with_members(links, members, "sim", similar.F.lit(1.0)).collect()}
    assert pairs == {(0, 1), (0, 2), (0, 3), (3, 4)}


def test_composite_classes_compare_what_both_rows_have(spark):
    rng = random.Random(6)
    word = lambda: rng.getrandbits(64) - (1 << 63)
    turned = lambda x, n: None if x is None else _signed(x, rng.sample(range(64), n))
    rows = [(i, word(), word(), word()) for i in range(20)]
    for i in range(120):
        _, *hashes = rng.choice(rows)
        rows.append((20 + i, *[None if rng.random() < 0.35 else turned(h, rng.choice([0, 0, 0, 5, 6, 7])) for h in hashes]))
    rows.append((500, None, None, None))

    def likeness(a, b):
        both = [(x, y) for x, y in zip(a[1:], b[1:], strict=True) if x is not None and y is not None]
        return (64 * len(both), sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in both))

    linked = lambda a, b: (w := likeness(a, b))[0] > 0 and 10 * w[1] <= w[0]
    some = [r for r in rows if any(x is not None for x in r[1:])]
    df = spark.createDataFrame(rows, "id long, p long, d long, a long")
    found = similar.class_rows(similar.hash_members(df, columns=("p", "d", "a")), similar.composite_links(df, 0.90)).collect()
    assert {tuple(r) for r in found} == expected(some, linked, lambda a, b: a[1:] == b[1:])


def _signed(x, bits):
    for b in bits:
        x ^= 1 << b if b < 63 else -(1 << 63)
    return x


def test_many_copies_of_a_hash_are_counted_not_paired(spark):
    rows = spark.range(3_000).selectExpr("id", "case when id < 1000 then 1L when id < 2000 then 3L else 1L << 40 | id end as hash")
    found = similar.class_rows(similar.hash_members(rows), similar.hamming_links(rows.where("id < 2000"), 1)).where("id in (0, 999, 1500)").collect()
    assert {tuple(r) for r in found} == {(0, 0, 1000, 1999, 0), (999, 0, 1000, 1999, 0), (1500, 1000, 1000, 1999, 0)}


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_close_sets_are_found_and_neither_sets_nor_digests_are_broadcast(spark, threshold):
    rng = random.Random(8)
    sets = []
    for size in [1, 2, 19, 20, 21, 39, 40, 41, 150, 190, 191, 400]:
        base = rng.sample(range(5_000), size)
        sets.append(base)
        for n in (1, 1, 2, 4, 8):
            sets.append([x for x in base if rng.random() > n / (2 * size)] + rng.sample(range(5_000, 6_000), rng.randrange(n + 1)))
    sets = [s for s in sets if s]
    links = similar.jaccard_links(spark.createDataFrame(list(enumerate(sets)), "id long, grams array<long>"), threshold)
    alike = lambda a, b: round(len(a & b) / len(a | b), 9) >= threshold - 1e-9
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    wanted = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and alike(a, b)}
    assert {(r.src, r.dst) for r in links.collect()} == wanted and len(wanted) > 10
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_links_are_worked_out_once_for_counts_and_components(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    links = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long").mapInPandas(look, "src long, dst long")
    members = spark.createDataFrame([(i, i) for i in range(1, 5)], "id long, rep long")
    assert {tuple(r) for r in similar.class_rows(members, links).collect()} == {(1, 1, 1, 1, 1), (2, 2, 1, 2, 1), (3, 3, 1, 1, 1), (4, 4, 1, 0, 4)}
    assert seen.value == 2


def test_bigrams_of_a_text_are_worked_out_once_in_a_pass(spark):
    files = spark.createDataFrame([(i, f"text number {i} with more than fifty characters in it, which count") for i in range(3)], "doc_id long, text string")
    each = files.select(similar._bigram_codes()("text").alias("x")).select("x.digest", "x.g").where("digest is not null")
    assert each._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
