"""Searches in the stored index against a plain reading of the documents."""

from __future__ import annotations

import re

import pytest

from gritstone.operators import textindex
from gritstone.operators.textindex import All, Some, Term, TextIndex, understand

DOCS = [
    (1, "The Apache License, version two.", "alpha"), (2, "License of the Apache tribe; version 2", "beta"), (3, "café CAFÉ cafe", "the license"), (4, None, "alpha apache"), (5, "", None),
    (6, "version " * 5 + "apache license apache license", "x"), (2000, "far away apache one two three four license", "alpha"), (None, "apache license", "alpha"), (7, "licensed licenses licence", "Apache"),
]
COLUMNS = ("text", "title")


def plain(query, docs=DOCS):
    """{id: hits} by looking at every document."""

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower().replace("é", "e"))

    def spots(t, doc):
        out = set()
        for c, text in zip(COLUMNS, doc[1:], strict=True):
            w = words(text)
            if t.column not in (None, c):
                continue
            fits = [lambda x, v=v: x == v for v in t.words[:-1]] + [(lambda x: x.startswith(t.words[-1])) if t.prefix else (lambda x: x == t.words[-1])]
            if t.near is not None:
                out |= {(c, j) for j in range(len(w)) if fits[1](w[j]) and any(fits[0](w[i]) and abs(i - j) <= t.near + 1 for i in range(len(w)))}
            else:
                out |= {(c, i) for i in range(len(w) - len(fits) + 1) if all(f(w[i + k]) for k, f in enumerate(fits))}
        return out

    def holds(q, doc):
        if isinstance(q, Term):
            return bool(spots(q, doc))
        if isinstance(q, Some):
            return any(holds(p, doc) for p in q.parts)
        return all(holds(p, doc) for p in q.parts) and not any(holds(p, doc) for p in q.without)

    def wanted(q):
        return [q] if isinstance(q, Term) else list(dict.fromkeys(t for p in q.parts for t in wanted(p)))

    asked = understand(query, COLUMNS)
    return {d[0]: sum(len(spots(t, d)) for t in wanted(asked)) for d in docs if asked and d[0] is not None and holds(asked, d)}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    made = TextIndex.build(spark, str(tmp_path_factory.mktemp("index")), docs.where("doc_id is null or doc_id < 7"), dict(zip(COLUMNS, COLUMNS, strict=True)), buckets=8)
    made.add(docs.where("doc_id >= 7"))
    return made


QUERIES = [
    "apache", "Apache license", '"apache license"', "apache OR café", "apache NOT version", "apache -version", "lic*", "title:apache", "title:alpha AND text:apache", 'text:"apache license" OR title:"the license"', "apache NEAR license", "apache NEAR/1 license",
    "apache NEAR/5 license", "(apache OR cafe) license", "apache (license OR (two three))", '"version apache lic"', "l*", "apache NOT (version OR far)", "-apache", "NOT", "", "  ()", '"apache license', "(apache", "apache)", ") OR apache", "AND apache AND", "nothing apache", "text:", "col:apache", "a_b", '-"apache license" version', "ver* NOT lic*", "CAFÉ",
]


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_a_plain_reading(index, query):
    found = index.search(query).collect()
    assert {r.doc_id: r.hits for r in found} == plain(query) and len({r.doc_id for r in found}) == len(found)


def test_queries_are_understood():
    say = lambda q: understand(q, COLUMNS)
    assert say("a b OR c") == Some((All((Term(("a",)), Term(("b",)))), Term(("c",))))
    assert say("a NOT b*") == All((Term(("a",)),), (Term(("b",), prefix=True),))
    assert say('title:"X y" other:z') == All((Term(("x", "y"), column="title"), Term(("other", "z"))))
    assert say("a NEAR/3 b c") == All((Term(("a", "b"), near=3), Term(("c",))))
    assert say("(a") == say("a)") == say(") a (") == Term(("a",)) and say('"a b') == Term(("a", "b"))
    assert say("OR AND NOT") is say("") is say("***") is None


def test_only_the_buckets_of_the_words_are_read(index):
    plan = index.search("apache license")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    ours = {r[0] for r in index.spark.createDataFrame([("apache",), ("license",)], "token string").select(textindex._bucket(textindex.F.col("token"), 8)).collect()}
    assert len(scans) >= 4 and all({int(x) for x in re.findall(r"\d+", re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (?:IN \(|= )([\d,]+)", s)[1])} == ours for s in scans)
    assert all("In(token, [apache,license])" in s for s in scans)
    heads = [s for s in scans if "spots" not in s.split("ReadSchema")[1]]
    assert len(heads) >= 2  # blocks that have both words are found by heads alone


def test_snippets_and_order(spark, index):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    found = index.snippets(index.search('"apache license"', limit=1), docs, size=6).collect()
    assert [(r.doc_id, r.hits, r.col, r.snippet) for r in found] == [(6, 2, "text", "version version version [apache] license [apache]")]
    assert [r.doc_id for r in index.search("apache", limit=3).collect()] == [6, 1, 2]
    (one,) = index.snippets(index.search("tribe"), docs).collect()
    assert one.snippet == "License of the Apache [tribe]; version 2"


def test_nothing_indexed(spark, tmp_path):
    none = TextIndex.build(spark, str(tmp_path / "i"), spark.createDataFrame([], "doc_id long, text string"), {"text": "text"})
    assert none.search("a").collect() == []
    assert textindex.postings(spark.createDataFrame([], "doc_id long, text string"), {"text": "text"}).count() == 0


def test_places_are_gathered_as_one_number_each(spark):
    from gritstone.operators import textindex

    ids = [-1025, -1, 0, 1023, 1024, (1 << 60) + 5]
    docs = spark.createDataFrame([(i, "one two one") for i in ids], "doc_id long, text string")
    rows = textindex.postings(docs, {"text": "text"})
    found = sorted((r.token, i, p) for r in rows.collect() for i, p in zip(r.ids, r.spots, strict=True) if r.block == i >> 10)
    assert found == sorted((w, i, p) for i in ids for p, w in enumerate(["one", "two", "one"]))
    assert "collect_list(x#" in rows._jdf.queryExecution().optimizedPlan().toString()
