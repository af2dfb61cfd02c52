"""Every stage of the pipeline on a small corpus with odd rows, against plain Python."""

from __future__ import annotations

import collections
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = " ".join(f"word{i % 311}x{i}" for i in range(30_000))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def corpus():
    rng = random.Random(21)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so") for b in ("ta", "ti", "fu", "gu", "ha", "jo")]
    rows = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(body), "en", f"s{i % 4}" if i % 7 else None))
    for i in range(0, 30, 3):
        # Copies, near copies and copies with other blanks.
        rows.append((200 + i, rows[i][1], "en", "s1"))
        rows.append((300 + i, rows[i][1] + " zz", "en", "s2"))
    rows += [(400, None, "en", "s1"), (401, "", "en", "s1"), (402, " ?! 12 \n", None, "s1"), (403, LONG, "en", "s2"), (404, "you are a worthless idiot", "en", "s3"), (404, "again and again a word", "en", "s3")]
    rows += [(None, "a text without an id of its own", "en", "s0"), (None, "a text without an id of its own", "en", "s0"), (None, "another text without one", None, None)]
    labels = [(i, 1, int(i == 404)) for i in range(0, 120, 2)] + [(404, 0, 1), (None, 1, 1), (5, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    ids, texts, langs, sources = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}), str(at / "documents.parquet"))
    ids, quality, toxic = zip(*labels, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(quality, pa.int32()), "toxic": pa.array(toxic, pa.int32())}), str(at / "labels.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


def bag(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_language_drops_what_has_no_letter(spark, folder, docs):
    out = corpus_pipeline.language(spark, docs, folder)
    assert out.columns == COLUMNS
    assert bag(out) == collections.Counter((i, t) for i, t, _, _ in corpus()[0] if t and any(c.isalpha() for c in t))


def test_toxicity_drops_abuse_alone(spark, folder, docs):
    out = corpus_pipeline.toxic(spark, docs, folder)
    assert out.columns == COLUMNS
    assert bag(docs) - bag(out) == collections.Counter({(404, "you are a worthless idiot"): 1}) and not bag(out) - bag(docs)


def test_near_duplicates_keep_one_of_each_group(spark, folder, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert out.columns == COLUMNS
    named = [(i, t) for i, t, _, _ in corpus()[0] if i is not None]
    root = {i: i for i, _ in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in named]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    kept = bag(out)
    assert {i for i, _ in kept if i is not None} == {i for i in root if find(i) == i}
    assert all(n == 1 for n in kept.values()) and sum(i == 404 for i, _ in kept) == 1
    assert {t for i, t in kept if i is None} == {t for i, t, _, _ in corpus()[0] if i is None}


def test_mixing_takes_its_targets(spark, folder, docs):
    out = corpus_pipeline.mix(spark, docs, folder)
    assert out.columns == COLUMNS
    size = collections.Counter()
    for _, t, _, s in corpus()[0]:
        size[s] += len(words(t))
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(size.values()), {}
    while True:
        rest = [s for s in size if s not in fixed]
        share = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if share * weight[s] > 3 * size[s] + 1e-9]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    taken = collections.Counter()
    whole = {(i, tuple(words(t))) for i, t, _, _ in corpus()[0]}
    for r in out.collect():
        taken[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        own = tuple(words(r["text"]))
        assert (r["doc_id"], own) in whole or any(i == r["doc_id"] and t[: len(own)] == own for i, t in whole)
    assert all(abs(taken[s] - fixed.get(s, share * weight[s])) <= 4 * 64 for s in size)


def test_packing_holds_every_token_once(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.pack(spark, docs, folder).collect()
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    want = collections.Counter()
    for i, t, _, _ in corpus()[0]:
        want[i] += len(encoder.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == want
    ends = collections.defaultdict(list)
    for r in rows:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_follow_one_another(spark, folder, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "packing"]
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    assert rows and not ids & {400, 401, 402, 200, 203, 300, 303} and 403 in ids


def test_empty_tables_pass_every_stage(spark, folder, docs):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
