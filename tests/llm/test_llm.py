"""Edge cases of every training-data operator, and brute force or round trips where SQL has no say."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import ann, kernels, langid, minhash, mixing, packing, quality, sharding, spotsigs, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
KIND = "doc_id long, text string, lang string, source string, score string, id string, node string, bucket string, size string"
LONG = " ".join(f"word{i % 977} of the" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "?!", "one", "the same text here again", "the same text here again", "The Same text  here again", LONG, "naïve café x", "You are a worthless idiot. Go away!", "a  b\n\n c <|endoftext|>"]


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], "x", "x", "x", "x", "x") for i, t in enumerate(texts)], KIND)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_word_hashes_follow_the_word_rule():
    texts = ["a b", "", "B  a\x00c\n", "x" * 100 + " " + "x" * 101, "é É"]
    hashes, bounds = kernels.word_hashes([t.encode() for t in texts])
    flat = [w for t in texts for w in words(t)]
    assert np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_long_texts_have_the_same_words_and_terms_in_slices(monkeypatch):
    text = ("naïve café BUY!! " * 500 + "x" * 3_000 + "\n a\tb\r\n" * 300).encode()
    whole, bounds = kernels.word_hashes([text])
    counts = quality.terms([text])
    monkeypatch.setattr(kernels, "SLICE", 1_000)
    assert b"".join(kernels.text_slices(text, 1_000)) == text and list(kernels.text_slices(b"", 10)) == []
    parts = [kernels.word_hashes([x])[0] for x in kernels.text_slices(text, 1_000)]
    assert len(parts) > 5 and (np.concatenate(parts) == whole).all() and (kernels.word_hashes([text])[0] == whole).all()
    monkeypatch.setattr(quality, "SLICE", 1_000)
    sliced = quality.terms([text])
    bytes_of = slice(0, quality._CLASSES + quality._BIGRAMS)
    # A cut changes two trigrams and a bigram, and adds one of each for the slice's own end.
    assert np.abs(sliced[:, bytes_of] - counts[:, bytes_of]).sum() <= 8 * len(parts)


def test_tokens_equal_the_library(spark, odd, empty, tmp_path):
    counter = tokens.token_counter(BYTE)
    cache = str(tmp_path / "cache")
    got = {r["doc_id"]: r for r in tokens.count_tokens(odd, BYTE, cache).collect()}
    for i, t in enumerate(TEXTS):
        want = len(counter.encoder.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((t or "").encode()), want > 1024)
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for t in TEXTS})
    assert stored.count() == distinct
    again = tokens.count_tokens(odd, BYTE, cache)
    assert again.count() == len(TEXTS) and spark.read.parquet(cache).count() == distinct
    assert tokens.count_tokens(empty, BYTE).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_the_library(path):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "9", "１", "!", "日", "\x85", "\x1c", "ǅ", "<|endoftext|>", "İ", " \n", "\xad"]
    pieces = tokens.Pieces(path, list, lambda parts: [x for p in parts for x in p], pieces=50)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert pieces(text) == pieces.encoder.encode(text, add_special_tokens=False).ids, repr(text)


def test_near_duplicates_equal_brute_force(spark, empty):
    rng = random.Random(4)
    base = [f"w{rng.randrange(200)}" for _ in range(120)]
    texts = list(TEXTS)
    for k in range(60):
        own = list(base) if k < 40 else [f"v{rng.randrange(90)}" for _ in range(30)]
        for _ in range(rng.randrange(14)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(9999)}"
        texts.append(" ".join(own))
    sets = [shingles(t, 2) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for block in (512, 7, 3):
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts), shingle_words=2, block_rows=block).collect()}
        assert {i: (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in got} == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    assert minhash.near_duplicates(empty).count() == 0


def test_repeated_ids_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = spark.createDataFrame([(2, a), (5, a), (5, b), (7, b + " z"), (8, c), (8, c), (9, ""), (9, c), (11, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect()}
    assert got == {(2, 2, True), (5, 2, False), (7, 2, False), (8, 8, True), (9, 8, False), (11, 11, True)}


def test_packed_estimates_are_close():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        other = np.concatenate([one[: int(4000 * share)], rng.integers(0, 2**63, 4000 - int(4000 * share)).astype(np.uint64)])
        sig = minhash.signatures(minhash._minima(np.concatenate([one, other]), np.array([0, 4000, 8000])))
        assert abs(minhash.similarity(sig[0], sig[1:])[0] - share / (2 - share)) < 0.13


def test_signatures_weigh_alike_in_columns_and_arrays(spark):
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2**63, (40, minhash.HASHES * minhash.BITS // 64)).astype(np.uint64)
    flip = rng.random((40, minhash.HASHES)) < rng.random((40, 1)) * 0.6
    other = sig ^ minhash.signatures(np.zeros((40, minhash.HASHES), np.uint32))
    for i in range(40):
        other[i] = sig[i]
        for k in np.flatnonzero(flip[i]):
            other[i, k // 16] ^= np.uint64(int(rng.integers(1, 16)) << (4 * (k % 16)))
    frame = spark.createDataFrame([(i, sig[i].view(np.int64).tolist(), other[i].view(np.int64).tolist()) for i in range(40)], "i long, a array<long>, b array<long>")
    got = {r["i"]: r["near"] for r in frame.select("i", minhash.can_reach(F.col("a"), F.col("b"), (F.lit(9), F.lit(10)), 80).alias("near")).collect()}
    want = {i: bool(minhash.similarity(sig[i], other[i : i + 1])[0] >= minhash._margin(0.8)) for i in range(40)}
    assert got == want and len(set(want.values())) == 2


def test_languages(spark, odd, empty):
    rng = random.Random(6)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(60))
    langs = {"en": ["th", "er", "on", "an"], "de": ["sch", "ung", "ei", "ü"], "fr": ["eau", "tre", "qu", "é"]}
    rows = [(i, make(langs[name]), name) for i, name in enumerate(list(langs) * 40)]
    learn = spark.createDataFrame(rows + [(999, None, "en"), (1000, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(learn)
    assert model.names == ["de", "en", "fr"] and (model.chance < 0.01).all()
    fresh = spark.createDataFrame([(i, make(langs[n]), n) for i, n in enumerate(list(langs) * 20)], "doc_id long, text string, lang string")
    assert langid.identify(fresh, model, keep=("lang",)).where("lang <> lang_pred").count() == 0
    got = {r["doc_id"]: r for r in langid.identify(odd, model, keep=("doc_id",)).collect()}
    assert len(got) == len(TEXTS) and {got[i]["lang_pred"] for i in range(4)} == {"und"} and got[4]["lang_pred"] in model.names
    none = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model, keep=("doc_id",)).count() == 0


def grams_of(text):
    """The n-grams of a text as strings, words marked at either side."""
    low = "".join(c.lower() if c.isalpha() else "|" for c in text)
    marked = "|" + low + "|||||"
    out = []
    for order in langid.ORDERS:
        for i in range(len(low) + 1):
            g = marked[i : i + order]
            if len(g) == order and "|" not in g[1:-1] and (order > 2 or g != "||"):
                out.append(g)
    return out


def test_languages_equal_plain_sets(spark):
    rng = random.Random(16)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(40))
    langs = {"a": ["th", "er", "on", "an", "é"], "b": ["th", "ung", "ei", "ü"], "c": ["er", "tre", "qu", "ei"]}
    rows = [(i, make(langs[name]), name) for i, name in enumerate(list(langs) * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {name: collections.Counter(g for _, t, n in rows if n == name for g in grams_of(t)) for name in langs}
    rate = {name: {g: n / sum(c.values()) for g, n in c.items()} for name, c in counts.items()}
    held = {name: {g for g, r in own.items() if r >= langid.SHARE * max(rate[x].get(g, 0) for x in langs)} for name, own in rate.items()}
    texts = [make(langs[n]) for n in list(langs) * 10] + [make(sum(langs.values(), [])) for _ in range(20)] + ["", "?!"]
    got, scores = model.score(texts)
    hits, seen, has = model.count(texts)
    for i, t in enumerate(texts):
        own = grams_of(t)
        plain = np.array([sum(g in held[n] for g in own) for n in model.names], float)
        assert seen[i] == len(own) and (hits[i] >= plain).all() and (hits[i] <= plain + 3 + 0.02 * len(own)).all()
        if has[i]:
            assert abs(scores[i] - plain.max() / plain.sum()) < 0.02 and plain[model.names.index(got[i])] >= plain.max() - 3
    long = " ".join(texts * 60)
    parts = [model.count([x]) for x in langid.text_parts(long, 5_000)]
    assert (sum(c for c, _, _ in parts) == model.count([long])[0]).all() and sum(s for _, s, _ in parts) == model.count([long])[1]


def test_languages_beyond_one_mask(spark):
    rows = [(i, f"{chr(0x4E00 + 40 * i)}{chr(0x4E01 + 40 * i)}{chr(0x4E02 + 40 * i)} " * 5, f"l{i:02}") for i in range(70)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(learn)
    assert model.slots.shape[0] == 2
    assert langid.identify(learn, model, keep=("lang",)).where("lang <> lang_pred").count() == 0


def test_toxicity(spark, odd, empty):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ta", "ti", "so", "fu", "gu", "ha", "jo")]
    rows, labels = [], []
    for i in range(240):
        body = [rng.choice(vocabulary) for _ in range(40)]
        if i % 3 == 0:
            body[rng.randrange(40)] = "snork"
            body[5], body[25] = rng.sample(["grolmiva", "grolmito", "grolmixu", "grolmiro", "grolmi"], 2)
        elif i % 12 == 1:
            body[7] = "grolmiva"
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 3 == 0)))
    more = [(i, t) for i, t in rows[:30]] + [(None, "snork snork")]
    model = toxicity.fit(spark.createDataFrame(rows + more, "doc_id long, text string"), spark.createDataFrame(labels + [(7777, None), (None, 1)], "doc_id long, toxic int"))
    assert set(model.words) == {"snork"} and set(model.stems) == {"grolm"} and model.background > 0
    # No word by itself, learned or fixed, is enough; repeated or aimed abuse is.
    assert 0 < model.score("a snork b") < 0.7 <= model.score("a snork b. c snork d.") and model.score("you snork") >= 0.7
    assert model.score("a snork b. a snork b. a snork b.") < 0.7
    assert model.score("a grolmiva b. c grolmito d.") < 0.7 <= model.score("a grolmiva b. c grolmito d. e grolmixu f.")
    assert model.score("a grolmiva b. c grolmito d. e grolmixu f. " + "ka lo mi nu. " * 20_000) < 0.7
    assert model.score("You are a worthless idiot.") > model.score("A worthless idiot.") >= 0.7 > model.score("A worthless thing.")
    assert model.score("I am not an idiot.") < 0.2 and model.score("He said you are an idiot and a moron.") < 0.7
    assert model.score("They will kill you.") >= 0.7 > max(model.score("This may kill the process."), model.score("They will kill the process."))
    got = {r["doc_id"]: r for r in toxicity.score(odd, model, keep=("doc_id",)).collect()}
    assert len(got) == len(TEXTS) and all(got[i]["predicted"] == int(i == 10) for i in got) and got[0]["score"] == 0
    assert toxicity.score(empty, model, keep=("doc_id",)).count() == 0
    blank = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not blank.words and not blank.stems and blank.score("you idiot") >= 0.7


def test_toxicity_is_decided_by_context():
    """Without the machines that look around an insult or harm other texts are found toxic, and a lone word never is."""
    base = toxicity.base_classes()
    whole = toxicity.Model(base)
    bare = toxicity.Model(base, machines=tuple(m for m in toxicity.MACHINES if m not in toxicity.CONTEXT))
    texts = {"you are an idiot": (1, 0), "we will kill you": (1, 0), "idiot you": (1, 0), "no worthless idiot here": (0, 1), "she wrote worthless idiot": (0, 1), "scum": (0, 0), "worthless scum": (1, 1), "kill": (0, 0)}
    assert {t: (int(whole.score(t) >= 0.7), int(bare.score(t) >= 0.7)) for t in texts} == texts
    assert all(whole.score(w) < 0.7 for w in base)
    for machine in toxicity.CONTEXT:
        less = toxicity.Model(base, machines=tuple(m for m in toxicity.MACHINES if m is not machine))
        assert any((less.score(t) >= 0.7) != (whole.score(t) >= 0.7) for t in texts), machine.__name__


def test_long_texts_are_read_in_slices():
    text = "one two. You are a worthless idiot. " * 50
    assert "".join(toxicity.slices(text, 64)) == text and all(len(x) <= 64 for x in toxicity.slices("x" * 1000, 64))
    model = toxicity.Model(toxicity.base_classes())
    filler = "ka lo mi nu. " * 200_000
    assert math.isclose(model.score(filler + "They are idiots. " + filler), model.score("They are idiots."))


def test_composition_equals_running_the_machines_in_turn():
    machines = [m() for m in toxicity.MACHINES]
    after, weight = toxicity.compose(machines)
    rng = random.Random(3)
    for _ in range(400):
        symbols = [rng.randrange(toxicity.SYMBOLS) for _ in range(rng.randrange(12))]
        state, total = 0, 0.0
        for s in symbols:
            total += weight[state, s]
            state = after[state, s]
        stream, want = symbols, 0.0
        for machine in machines:
            at, out = 0, []
            for s in stream:
                at, o, w = machine.step(at, s)
                out.append(o)
                want += w
            stream = out
        assert math.isclose(total, want)


def test_quality(spark, odd, empty):
    rng = random.Random(9)
    good = lambda: ". ".join(" ".join(rng.choice(["stone", "river", "the", "of", "light", "and"]) for _ in range(8)).capitalize() for _ in range(5))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "%%%"]) for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150)] + [(5000, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    got = {r["doc_id"]: r for r in quality.score(frame, model, keep=("doc_id",)).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(150, 200))
    scored = {r["doc_id"]: r["score"] for r in quality.score(odd, model, keep=("doc_id",)).collect()}
    assert len(scored) == len(TEXTS) and scored[0] == scored[1] == scored[2] == model.prior and all(0 <= s <= 1 for s in scored.values())
    blank = quality.fit(empty, labels)
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {blank.prior}
    assert quality.score(empty, model).count() == 0


def test_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((80, 5)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 80).astype(float)
    model = quality.Model(np.ones(1), np.ones((1, 1)), vectors, labels, 0.5)
    asked = vectors[:20] * np.float32(1.0)
    for place, vote in zip(asked, model.vote(asked, block=7), strict=True):
        cosine = vectors @ place
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.exp(quality.SHARPNESS * cosine[near].astype(float))
        assert abs(vote - (weight * labels[near]).sum() / weight.sum()) < 1e-5


def test_sharding(spark, empty):
    rng = random.Random(1)
    texts = TEXTS + ["copy of the hot group " * 20] * 60 + ["y" * rng.randrange(900) + str(k) for k in range(200)]
    got = {r["doc_id"]: r for r in sharding.shard(docs(spark, texts), shards=4).collect()}
    assert len(got) == len(texts)
    where = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for i, r in got.items():
        body = (texts[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        where[texts[i]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(7)
    for _ in range(30):
        items = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 90))]
        classes = list(collections.Counter(items).items())
        room: list[int] = []
        want = []
        # One group after the other, each into the tightest bin.
        for size in sorted(items, reverse=True):
            fits = [(r, b) for b, r in enumerate(room) if r >= size]
            if fits:
                b = min(fits)[1]
            else:
                b = len(room)
                room.append(100)
            room[b] -= size
            want.append((size, b))
        assert [(s, b) for s, n, b in sharding.best_fit_decreasing(classes, 100) for _ in range(n)] == want
        bins = collections.Counter()
        placed = sharding.balanced(classes, 4)
        for size, n, b in placed:
            bins[b] += size * n
        assert collections.Counter(s for s, n, _ in placed for _ in range(n)) == collections.Counter(items)
        assert set(bins) <= set(range(4)) and max(bins.values()) <= max(sum(items) / 4 + 60, 60)


def test_mixing(spark, empty):
    rng = random.Random(5)
    texts = TEXTS + [" ".join("w" for _ in range(rng.randrange(400))) for _ in range(150)]
    sources = [None if i % 11 == 0 else f"s{i % 5}" if i % 3 else "hot" for i in range(len(texts))]
    frame = docs(spark, texts, sources)
    got = {r["doc_id"]: r for r in mixing.mix(frame).collect()}
    assert len(got) == len(texts) and got == {r["doc_id"]: r for r in mixing.mix(frame.repartition(3)).collect()}
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    by = collections.defaultdict(int)
    for i, s in enumerate(sources):
        by[s] += size[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, fixed = sum(size.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 3 * by[s] + 1e-9]
        if not over:
            break
        fixed |= {s: 3 * by[s] for s in over}
    want = {s: fixed.get(s, left * weight[s] / max(1, sum(weight[x] for x in rest))) for s in order}
    taken = collections.defaultdict(int)
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == by[sources[i]] and abs(r["target"] - want[sources[i]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * size[i] and sum(r["shard_words"]) == r["taken"]
        taken[sources[i]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 4 * mixing.BLOCK_WORDS for s in order)
    assert mixing.mix(empty).count() == 0
    kept = mixing.mix(frame.select("doc_id", "text", "source"), keep=("text", "source"))
    out = mixing.take(kept, "text", ["doc_id", "text"]).collect()
    assert sum(len(words(r["text"])) for r in out) == sum(r["taken"] for r in got.values())


def test_apportionment_equals_highest_quotients(spark):
    rng = random.Random(2)
    weights = [rng.random() * 1000 for _ in range(9)] + [0.0]
    total = sum(weights)
    rows = spark.createDataFrame([(f"s{k}", 1, 1.0, w, total) for k, w in enumerate(weights)], "source string, source_size long, weight double, target double, total double")
    got = {r["source"]: sum(r["blocks"]) for r in mixing.quotas(rows, block_words=7, shards=3).collect()}
    seats = math.floor(total / 7 + 0.5)
    quotients = sorted(((w / (2 * j - 1), f"s{k}") for k, w in enumerate(weights) for j in range(1, seats + 2)), reverse=True)[:seats]
    want = collections.Counter(s for _, s in quotients)
    assert got == {f"s{k}": want[f"s{k}"] for k in range(10)}


def test_packing_round_trip(spark, odd, empty):
    counter = tokens.Pieces(WORD, list, list)
    rows = packing.pack(odd, WORD, window_tokens=5_000).collect()
    want = {i: np.array([*counter.encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(TEXTS)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want[i])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(want[i][r["start"] : at].tobytes())
        assert at == len(want[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(empty, WORD).count() == 0


def test_packing_balances_cost():
    rng = random.Random(3)
    full, _ = packing.assign([(k, 0, rng.randrange(10, 1500)) for k in range(2_000)])
    costs = [sum(packing.cost(p[2]) for p in s) for s in full]
    assert max(costs) < 1.35 * sum(costs) / len(costs)


def test_fingerprints(spark, odd, empty):
    got = {r["doc_id"]: r for r in spotsigs.edit_check(odd).collect()}
    order = sorted(range(len(TEXTS)), reverse=True)
    assert set(got) == set(order)
    for place, i in enumerate(order):
        text, following = TEXTS[i] or "", TEXTS[order[(place + 1) % len(order)]] or ""
        changed = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, other = set(spotsigs.read(got[i]["fingerprint"]).tolist()), set(spotsigs.read(got[i]["edited_fingerprint"]).tolist())
        assert abs(got[i]["near_edited"] - len(own & other) / len(own | other)) < 1e-12
        nxt = set(spotsigs.read(got[order[(place + 1) % len(order)]]["fingerprint"]).tolist())
        assert abs(got[i]["near_next"] - len(own & nxt) / len(own | nxt)) < 1e-12
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[0]["fingerprint"] == got[1]["fingerprint"]
    assert spotsigs.edit_check(empty).count() == 0
    single = spotsigs.edit_check(docs(spark, ["the lone text of a kind"])).collect()
    assert single[0]["near_next"] == 1.0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word"), F.col("id").cast("string"), F.lit(" of it "), (F.col("id") * 7).cast("string")).alias("text"))
    sums = {r["doc_id"]: r["edited_sha256"] for r in spotsigs.edit_check(many).collect()}
    text = lambda i: f"the word{i} of it {i * 7}"
    for i in (0, 1, 4095, 4096, 8191, 8192, 12345, 19999):
        own, nxt = text(i), text((i - 1) % 20_000)
        assert sums[i] == hashlib.sha256((own[: len(own) - len(own) // 3] + nxt[: len(own) // 3]).encode()).hexdigest()


def test_pruned_likeness_agrees_where_it_matters():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**32, rng.integers(1, 600)).astype(np.uint32))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**32, rng.integers(1, 300)).astype(np.uint32)]))
        exact = spotsigs.likeness(a, b)
        pruned = spotsigs.likeness(a, b, 0.5)
        assert pruned == exact or (pruned == 0 and exact < 0.5)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1_500, 16))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5_000 + k, rows[50][1]) for k in range(9)]
    rows += [(6_000, None), (6_050, [0.0] * 16), (6_100, [float("nan")] * 16), (6_150, [None] + [1.0] * 15), (6_200, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("raw", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.search(table, table.where(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in usable]), np.stack([v for _, v in usable])
    hit = 0
    asked = [i for i in ids if i % 50 == 0]
    assert set(got) == set(asked)
    for q in asked:
        own = x[ids == q][0]
        cosine = np.where(ids == q, -9, ann.cosine(own, x))
        best = ids[np.lexsort((ids, -cosine))[:5]]
        assert len(got[q]) == 5 and q not in {i for i, _ in got[q]}
        assert all(abs(s - cosine[ids == i][0]) < 1e-12 for i, s in got[q])
        hit += len({i for i, _ in got[q]} & set(best.tolist()))
    assert hit / (5 * len(asked)) >= 0.9
    assert [i for i, _ in got[50]] == [5_000, 5_001, 5_002, 5_003, 5_004]
    assert ann.search(table.where("vec_id < 0"), table).count() == 0
    few = ann.search(table.where("vec_id < 3"), table.where("vec_id = 0"))
    assert few.count() == 2


def test_scan_without_the_test_is_exact():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    at = ann.scan(x[0], ann.Columns(x), [(1, 50), (50, 51), (51, 400)], 6)
    whole = ((x - x[0]) ** 2).sum(axis=1)
    assert len(set(np.argsort(whole)[1:7].tolist()) & set(at.tolist())) >= 5 and len(at) < 60


def test_nearest_of_each_length_and_of_extreme_norms(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(3)]) for i in range(8)] + [(100 + i, [float(x) for x in rng.standard_normal(2)]) for i in range(4)]
    rows += [(200, [1e-200, 2e-200, 0.0, 1e-201]), (201, [1e200, 2e200, 0.0, 1e199]), (202, [1.0, 0.0, 0.0, 0.0]), (300, [1.0]), (None, [1.0, 2.0])]
    table = spark.createDataFrame(rows + [(0, rows[0][1])], "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert {q: len(a) for q, a in got.items()} == {0: 5, 100: 3, 200: 2}
    assert got[200][0][0] == 201 and abs(got[200][0][1] - 1) < 1e-12 and abs(got[200][1][1] - 1 / math.sqrt(5.01)) < 1e-12
    x = {i: np.array(v) for i, v in rows if i is not None}
    for q in (0, 100):
        near = sorted((-ann.cosine(x[q], x[i][None])[0], i) for i in x if len(x[i]) == len(x[q]) and i != q)[:5]
        assert [i for _, i in near] == [i for i, _ in got[q]]


def test_samples_are_the_smallest_hashes(spark):
    from gritstone.llm.sampling import smallest_hashes

    rows = spark.createDataFrame([(i, "hot" if i % 3 else "rare") for i in range(9_000)] + [(5, "hot")] * 40 + [(None, "hot"), (1, None)], "id long, grp string")
    limits = rows.groupBy("grp").agg(F.count("*").alias("n")).withColumn("most", F.when(F.col("grp") == "hot", 300).otherwise(5_000))
    got = {(r["id"], r["grp"]) for r in smallest_hashes(rows, limits).collect()}
    hashes = sorted((r["h"], r["id"]) for r in rows.where("grp = 'hot' and id is not null").distinct().select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).collect())
    assert {i for i, g in got if g == "hot"} == {i for _, i in hashes[:300]}
    assert sum(g == "rare" for _, g in got) == 3_000 and len(got) == 3_300


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "one two three", "a"), (None, "four five", None), (1, "one two three", "a"), (1, None, "b"), (2, "four  five six", "a")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["n_bytes"]) for r in tokens.count_tokens(rows, BYTE).collect()} == {(None, 13), (None, 9), (1, 13), (1, 0), (2, 14)}
    mixed = mixing.mix(rows).collect()
    assert len(mixed) == 5 and sum(r["size"] for r in mixed) == 11
    assert sharding.shard(rows, shards=2).count() == 5
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(rows).collect()} == {(1, 1), (2, 2)}
    assert {r["doc_id"] for r in spotsigs.edit_check(rows).collect()} == {1, 2}
    frame = rows.withColumn("lang", F.lit("en"))
    model = langid.fit(frame)
    assert {r["lang_pred"] for r in langid.identify(frame, model, keep=("doc_id",)).collect()} == {"en", "und"}
    labels = rows.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    voted = quality.score(rows, quality.fit(rows, labels, sample=10), keep=("doc_id",)).collect()
    assert len(voted) == 5 and {r["score"] for r in voted} == {1.0}
    assert packing.pack(rows, WORD).where("doc_id is null").agg(F.count_distinct("sequence_id", "offset")).first()[0] >= 2
    assert toxicity.score(rows, toxicity.fit(rows, rows.select("doc_id", F.lit(0).alias("toxic"))), keep=("doc_id",)).count() == 5


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_fingerprints_are_compared_by_partition(spark, threshold):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        words = [rng.choice(["the", "of", f"w{rng.randrange(3_000)}"]) for _ in range(rng.randrange(8, 700))]
        texts.append(words)
        for keep in (0.98, 0.9, 0.7):
            texts.append(words[: max(1, int(len(words) * keep))] + [f"z{rng.randrange(99)}"])
    texts = [" ".join(t) for t in texts] + [" ".join(texts[0])]
    prints = spotsigs.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = {r["doc_id"]: frozenset(r["spots"]) for r in prints.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(i, j): len(a & b) / len(a | b) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if len(a & b) >= threshold * len(a | b) - 1e-9}
    got = {(r["src"], r["dst"]): r["likeness"] for r in spotsigs.links(prints, threshold).collect()}
    assert len(want) > 20 and got == want
    family = {i: first[s] for i, s in sets.items()}
    for a, b in sorted(want):
        family = {i: min(family[a], family[b]) if f in (family[a], family[b]) else f for i, f in family.items()} if family[a] != family[b] else family
    assert {r["doc_id"]: r["family"] for r in spotsigs.families(prints, threshold).collect()} == family


@pytest.mark.parametrize("shards", [1, 8])
def test_shards_take_their_quotas(spark, shards):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    size = {i: len(t.split()) for i, t, _ in rows}
    parts = mixing.shard_parts(docs, shards=shards).collect()
    taken, held, spans = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in parts:
        taken[r["doc_id"]] += r["words"]
        held[source[r["doc_id"]], r["shard"]] += r["words"]
        spans[r["doc_id"], r["pass"]].append((r["first"], r["words"], r["shard"]))
    assert taken == {r["doc_id"]: r["taken"] for r in mixing.mix(docs, shards=shards).collect() if r["taken"]}
    for (i, _), found in spans.items():
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(found, found[1:])) and [s for *_, s in found] == sorted(s for *_, s in found) and sum(n for _, n, _ in found) <= size[i]
    sums = docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))
    for r in mixing.quotas(mixing.targets(sums), shards=shards).collect():
        bound, left = 3 * r["source_size"], []
        for s, n in enumerate(r["blocks"]):
            left.append(min(64 * n, bound - sum(left)))
            assert held[r["source"], s] == left[-1]


def oracle(sql, folder):
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = connection.execute(sql)
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in cursor.fetchall()), [c[0] for c in cursor.description]


@pytest.mark.parametrize("name", ["op6_minhash", "op8_mixing"])
def test_queries_equal_their_sql(spark, small, name):
    from gritstone.llm import queries

    rows, names = oracle(queries.oracle_sql()[name], small)
    got = queries.queries()[name](spark, small).select(*names).collect()
    assert sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got) == rows


def test_a_long_text_is_sliced_beside_others(monkeypatch):
    calls = []
    real = kernels.text_slices
    monkeypatch.setattr(kernels, "SLICE", 1 << 16)
    monkeypatch.setattr(kernels, "text_slices", lambda text, size: calls.append(len(text)) or real(text, size))
    texts = [b"the quick brown fox", (LONG * 2).encode(), b"", b"of a lazy dog"]
    found = spotsigs._each(texts)
    assert [x.tolist() for x in found] == [spotsigs.spots([t])[0].tolist() for t in texts]
    assert calls == [len(texts[1])] * 2  # each way once, and never with a neighbour in one set of arrays


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("stupid mistake. what a stupid day.", False), ("We will shoot these photos in the park.", False), ("He shouted: you idiot!", False), ("The word idiot is stupid.", True),
        ("You are a worthless idiot. You are trash.", True), ("I will kill you.", True), ("We will shoot people.", True), ("you idiot. what an idiot. that idiot again.", True), ("an idiot here. an idiot there. an idiot.", False),
    ],
)
def test_clauses_decide_not_words(text, toxic):
    assert (toxicity.Model(toxicity.base_classes()).score(text) >= 0.7) == toxic


def _packed_plainly(pieces, capacity):
    """The packing rule with lists and loops: what packing.assign has to give."""
    full, short = [], []
    for doc, start, length in pieces:
        for _ in range(length // capacity):
            full.append([(doc, start, capacity)])
            start += capacity
        if length % capacity:
            short.append((doc, start, length % capacity))
    bins = [[] for _ in range(sum(p[2] for p in short) // capacity)]
    used = lambda b: sum(p[2] for p in b)
    paid = {}
    late = []
    for piece in sorted(short, key=lambda p: (-p[2], p[0], p[1])):
        open_bins = [i for i, b in enumerate(bins) if capacity - used(b) >= piece[2]]
        if not open_bins:
            late.append(piece)
            continue
        best = min(open_bins, key=lambda i: (paid.get(i, 0.0), i))
        paid[best] = paid.get(best, 0.0) + packing.cost(piece[2])
        bins[best].append(piece)
    for i in sorted(range(len(bins)), key=lambda i: (paid.get(i, 0.0), i)):
        while used(bins[i]) < capacity and late:
            doc, start, length = late[0]
            part = min(length, capacity - used(bins[i]))
            bins[i].append((doc, start, part))
            late[0] = (doc, start + part, length - part)
            if part == length:
                late.pop(0)
    return full + [b for b in bins if used(b) == capacity], late[::-1] + [p for b in bins if used(b) < capacity for p in b]


def test_packing_follows_its_rule():
    rng = random.Random(12)
    for _ in range(60):
        pieces = [(d, 0, rng.choice([1, 1, 5, 8, 8, rng.randint(1, 40), rng.randint(60, 200)])) for d in range(rng.randint(0, 60))]
        full, left = packing.assign(pieces, 64)
        want_full, want_left = _packed_plainly(pieces, 64)
        assert full == want_full and sorted(left) == sorted(want_left)
        assert all(sum(p[2] for p in s) == 64 for s in full)
        ends = packing.tail(left)
        assert all((n := sum(p[2] for p in s)) & (n - 1) == 0 for s in ends)
        ids = sorted((d, i) for s in full + ends for d, a, n in s for i in range(a, a + n))
        assert ids == [(d, i) for d, _, n in pieces for i in range(n)]


def test_packing_keeps_null_repeated_and_equal_rows(spark):
    rows = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None), (3, ""), (3, "x")], "doc_id long, text string")
    found = packing.pack(rows, WORD).collect()
    starts = [(r.doc_id, r.doc_tokens) for r in found if r.start == 0]
    assert len(starts) == 5 and sum(i is None for i, _ in starts) == 2 and sum(r.length for r in found) == sum(n for _, n in starts)
    assert packing.pack(rows.where("doc_id = 9"), WORD).count() == 0
