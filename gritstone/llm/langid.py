"""Language identification by bit-sliced Bloom filters over character n-grams.

One slot array serves all languages: bit l of a slot belongs to language l, so
the AND of the k slots of an n-gram is the mask of every language whose filter
holds it.  Over a text the bits are counted per language, the hits that a
filter gives by chance are taken off, and the largest rest decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.kernels import chunks, mix64, splitmix
from gritstone.llm.sampling import smallest_hashes
from gritstone.session import spread

ORDERS = (2, 3, 4)
HASHES = 3
#: Training documents and kept n-grams of each language, at most.
SAMPLE_DOCS = 4_000
GRAMS = 20_000
#: A filter holds an n-gram if its language uses it at least this often compared with the language that uses it most.
SHARE = 0.4
UNKNOWN = "und"
#: Characters whose n-grams are in memory at once, but for a longer text.
CHUNK = 1 << 18
#: A text above this many characters is read in parts.
LONG = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for start, stop in ((0, 0x32000), (0xE0000, 0xE0100)):
        for c in range(start, stop):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
    return out


def text_parts(text: str, size: int = LONG) -> Iterator[str]:
    """text in parts of about size characters, cut behind a blank or line end, where no n-gram is; a longer run without one stays whole."""
    at = 0
    while len(text) - at > size:
        stop = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
        if stop <= at:
            ends = [x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0]
            stop = min(ends) + 1 if ends else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all n-grams, their text's index, whether each text has a letter).

    Words are runs of letters, with one boundary mark at either side; an n-gram lies within one word and its marks.
    """
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    # A mark goes before each text, so the n-gram that opens a text is its own.
    low = _letters()[np.frombuffer(b"".join(b"\0\0\0\0" + r for r in raw) + b"\0\0\0\0" * 5, np.uint32)]
    owner = np.repeat(np.arange(len(raw)), sizes + 1)
    n = len(owner)
    letter = low != 0
    has = np.zeros(len(raw), bool)
    has[owner[letter[:n]]] = True
    keys = splitmix(811, max(ORDERS) + 1)
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        wide = low.astype(np.uint64)
        for order in ORDERS:
            h = np.full(n, np.uint64(order))
            inner = np.ones(n, bool)
            for k in range(order):
                h = h * (keys[k] | np.uint64(1)) + wide[k : k + n]
                if 0 < k < order - 1:
                    inner &= letter[k : k + n]
            if order == 2:
                inner &= letter[:n] | letter[1 : n + 1]
            at = np.flatnonzero(inner)
            hashes.append(mix64(h[at]))
            owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners), has


@dataclass
class Model:
    """names[l] is the language of bit l % 64 of plane l // 64; chance[l] is its filter's false-positive rate."""

    names: list[str]
    slots: np.ndarray
    chance: np.ndarray

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hits of each text in each language's filter, n-grams of each text, whether it has a letter)."""
        n, total = len(texts), len(self.names)
        if n == 1 and len(texts[0]) > LONG and len(parts := list(text_parts(texts[0], LONG))) > 1:
            found = [self.count([x]) for x in parts]
            return sum(c for c, _, _ in found), sum(s for _, s, _ in found), np.any([h for _, _, h in found], axis=0)
        hashes, owner, has = gram_hashes(texts)
        seen = np.bincount(owner, minlength=n).astype(float)
        counts = np.empty((n, total))
        planes = self.slots.shape[0]
        size = np.uint64(self.slots.shape[1] - 1)
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for p in range(planes):
            mask = self.slots[p][hashes & size]
            with np.errstate(over="ignore"):
                for k in range(1, HASHES):
                    mask = mask & self.slots[p][(hashes + np.uint64(k) * step) & size]
            for bit in range(min(64, total - 64 * p)):
                hit = owner[(mask >> mask.dtype.type(bit)) & mask.dtype.type(1) == 1]
                counts[:, 64 * p + bit] = np.bincount(hit, minlength=n)
        return counts, seen, has

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.names:
            return [UNKNOWN] * n, np.zeros(n)
        counts, seen, has = self.count(texts)
        true = np.maximum(0.0, (counts - seen[:, None] * self.chance) / (1 - self.chance))
        best = true.argmax(axis=1)
        whole = true.sum(axis=1)
        share = np.divide(true[np.arange(n), best], whole, out=np.zeros(n), where=whole > 0)
        return [self.names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, share, 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Filters from the documents with a language, at most SAMPLE_DOCS of each (smallest hashes of the id).

    Null texts and ids teach nothing; each text of a repeated id does.
    """
    given = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = given.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("grp"))
    limits = rows.groupBy("grp").agg(F.count("*").alias("n")).withColumn("most", F.lit(SAMPLE_DOCS))
    chosen = smallest_hashes(rows, limits).withColumnRenamed("grp", "lang")
    given = given.where(F.col(text_col).isNotNull())
    sample = given.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), ["id", "lang"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang", sort=False):
                texts = [x for t in part["text"] for x in text_parts(t)]
                for a, b in chunks([t.encode("utf-8", "surrogatepass") for t in texts], CHUNK):
                    values, n = np.unique(gram_hashes(texts[a:b])[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": values.view(np.int64), "n": n})

    grams = sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= GRAMS)
    rows = top.select("lang", "gram", "n").toPandas()
    names = sorted(rows["lang"].unique().tolist())
    planes = max(1, -(-len(names) // 64))
    dtype = np.uint8 if len(names) <= 8 else np.uint64
    size = 1 << int(np.ceil(np.log2(16 * GRAMS)))
    slots = np.zeros((planes, size), dtype)
    if not names:
        return Model([], slots, np.zeros(0))
    rows["rate"] = rows["n"] / rows.groupby("lang")["n"].transform("sum")
    rows = rows[rows["rate"] >= SHARE * rows.groupby("gram")["rate"].transform("max")]
    chance = np.zeros(len(names))
    for i, name in enumerate(names):
        h = rows.loc[rows["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                at = (h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1)
                np.bitwise_or.at(slots[i // 64], at, dtype(1 << (i % 64)))
        full = (slots[i // 64] >> dtype(i % 64) & dtype(1)).mean()
        chance[i] = full**HASHES
    return Model(names, slots, chance)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns of docs with lang_pred and score, one row per row of docs.

    A null text, or one without a letter, is `und` with score 0; so is every
    text if no language was learned.  score is the decided language's part of
    all corrected hits, 0 where nothing was hit; ties go to the smaller name.
    Whole texts count, however long.  Repeated and null ids, and equal rows, keep
    their rows: ids are not looked at.  An empty table gives an empty result.
    Only keep and the text are read, so other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("body"))

    # Only the text goes to Python; kept columns wait on the JVM's side.
    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for column in batches:
            texts = [x if isinstance(x, str) else "" for x in column]
            langs, scores = [], [np.empty(0)]
            for a, b in chunks(texts, CHUNK):
                found, score = model.score(texts[a:b])
                langs += found
                scores.append(score)
            yield pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores)})

    out = spread(given).select(*names, run.asNondeterministic()("body").alias("r"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "r.lang_pred", "r.score")
