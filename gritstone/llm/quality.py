"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed terms (byte-class trigrams, letter bigrams,
and how words repeat), weighted by log frequency and inverse document
frequency.  A truncated singular value decomposition of a bounded labelled
sample gives the latent space.  The sample's vectors are broadcast, with their
labels; every document takes exact cosines with all of them in blocks, and the
nearest ones vote with weights that grow with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.kernels import SLICE, WORDS, chunks, text_slices, word_hashes
from gritstone.llm.sampling import smallest_hashes
from gritstone.session import spread

#: Labelled documents that are fitted and broadcast, dimensions kept, neighbours that vote: all bounded.
SAMPLE = 6_000
DIMENSIONS = 32
NEIGHBOURS = 25
SHARPNESS = 8.0
_CLASSES, _BIGRAMS, _SHAPES = 1_024, 1_024, 64
TERMS = _CLASSES + _BIGRAMS + _SHAPES


def _byte_classes() -> np.ndarray:
    """Lower letters, capitals, digits, blanks, line ends and other controls share a class each; every ASCII mark has its own."""
    out = np.arange(256, dtype=np.uint64)
    out[ord("a") : ord("z") + 1] = 1
    out[128:] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[32, 9, 0xA0]] = 4
    out[[10, 13]] = 5
    return out


_CLASS = _byte_classes()


def terms(texts: list[bytes]) -> np.ndarray:
    """Counts of the TERMS terms of each text, as float32; a text above SLICE bytes is counted slice by slice."""
    if len(texts) == 1 and len(texts[0]) > SLICE and len(parts := list(text_slices(texts[0], SLICE))) > 1:
        return np.sum([terms([x]) for x in parts], axis=0, dtype=np.float64).astype(np.float32)
    n = len(texts)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    raw = np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    total = len(owner)
    with np.errstate(over="ignore"):
        c = _CLASS[raw]
        tri = (c[:total] * np.uint64(65_599) + c[1 : total + 1]) * np.uint64(65_599) + c[2 : total + 2]
        tri = ((tri * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
        low = np.where((raw >= 65) & (raw < 91), raw + 32, raw).astype(np.uint32)
        bi = (low[:total] << np.uint32(8)) | low[1 : total + 1]
        bi = ((bi * np.uint32(2_654_435_761)) >> np.uint32(22)).astype(np.int64)
    out = np.zeros((n, TERMS), np.float32)
    out[:, :_CLASSES] = np.bincount(owner * _CLASSES + tri, minlength=n * _CLASSES).reshape(n, -1)
    out[:, _CLASSES : _CLASSES + _BIGRAMS] = np.bincount(owner * _BIGRAMS + bi, minlength=n * _BIGRAMS).reshape(n, -1)
    words, bounds = word_hashes(texts, WORDS)
    shapes = out[:, _CLASSES + _BIGRAMS :]
    for i in range(n):
        own = words[bounds[i] : bounds[i + 1]]
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            same = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
            # Ratios fall into overlapping steps, each a term of the weight of all words.
            for base, ratio in ((0, len(counts) / len(own)), (16, counts.max() / len(own)), (32, same)):
                at = min(14, int(ratio * 15))
                shapes[i, base + at] = shapes[i, base + at + 1] = len(own)
            shapes[i, 48 + min(15, int(np.log2(len(own))))] = len(own)
    return out


def _squash(counts: np.ndarray) -> np.ndarray:
    """Log of each term's rate in a thousand: a long text and a short one of a kind are alike."""
    whole = np.maximum(counts[:, : _CLASSES].sum(axis=1, keepdims=True), 1.0)
    return np.log1p(counts * (1000.0 / whole))


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, counts: np.ndarray) -> np.ndarray:
        x = (_squash(counts) * self.idf) @ self.space
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def vote(self, places: np.ndarray, block: int = 256) -> np.ndarray:
        """Each place's vote: the mean label of its nearest sample vectors, weighted by exp(SHARPNESS * cosine)."""
        out = np.full(len(places), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for a in range(0, len(places), block):
            cosine = places[a : a + block] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near_cos = np.take_along_axis(cosine, near, axis=1).astype(float)
            weight = np.exp(SHARPNESS * (near_cos - near_cos.max(axis=1, keepdims=True)))
            out[a : a + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        out[~places.any(axis=1)] = self.prior
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The latent space and its labelled vectors, from at most ``sample`` labelled documents (half of each label if
    there are enough), those with the smallest hashes of the id; of a repeated id's texts one.  Null labels, ids and texts
    teach nothing; without labels every score is 0.5.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    single = rows.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    shares = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    total = sum(shares.values())
    most = F.when(F.col("label") == 1, max(sample // 2, sample - shares.get(0, 0))).otherwise(max(sample // 2, sample - shares.get(1, 0)))
    limits = single.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("grp"), "n", most.alias("most"))
    chosen = smallest_hashes(single.select("id", F.col("label").alias("grp")), limits).withColumnRenamed("grp", "label")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            body = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for a, b in chunks(body):
                counts = _squash(terms(body[a:b])).astype(np.float16)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[a:b], "label": pdf["label"].to_numpy()[a:b], "terms": [x.tobytes() for x in counts]})

    kind = dict(texts.dtypes)["id"]
    rows = texts.select("id", "label", "text").mapInPandas(run, f"id {kind}, label int, terms binary")
    got = rows.groupBy("id").agg(F.max("label").alias("label"), F.min("terms").alias("terms")).toPandas()
    prior = shares.get(1, 0) / total if total else 0.5
    if not len(got):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    got = got.sort_values("id", kind="stable")
    x = np.frombuffer(b"".join(got["terms"]), np.float16).reshape(len(got), TERMS).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1.0
    x = x * idf
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    space = vectors[:, ::-1][:, : min(DIMENSIONS + 1, len(x))][:, 1:] if len(x) > 2 else vectors[:, ::-1][:, :1]
    model = Model(idf, np.ascontiguousarray(space, np.float32), np.zeros((0, 1), np.float32), got["label"].to_numpy(float), prior)
    place = x @ model.space
    norm = np.linalg.norm(place, axis=1, keepdims=True)
    model.vectors = np.divide(place, norm, out=np.zeros_like(place), where=norm > 0).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """keep columns with score and predicted, one row per row of docs.

    Whole texts count, long ones slice by slice.  Null and empty texts get the
    share of label 1 among the labels.  Repeated and null ids, and equal rows,
    keep their rows: ids are not looked at.  Neighbours that are equally near are
    taken in the order of the sample.  An empty table gives an empty result.
    Only keep and the text are read, so other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("body"))
    kinds = ", ".join(f"{n} {dict(given.dtypes)[n]}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            body = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in pdf["body"]]
            for a, b in chunks(body):
                got = model.vote(model.place(terms(body[a:b])))
                empty = np.fromiter((not t.strip() for t in body[a:b]), bool, b - a)
                yield pdf.iloc[a:b][names].assign(score=np.where(empty, model.prior, got))

    out = spread(given).mapInPandas(run, f"{kinds}, score double" if kinds else "score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
