"""Document fingerprints by SpotSigs.

A spot is an anchor (a very common word) with the chain of the content words
that follow it.  A text's fingerprint is the set of its spots' hashes.
Fingerprints of very different sizes can't be alike, so sets are partitioned
by length on a scale where only the same and the next partition can hold a
partner, and Jaccard comparisons stop as soon as the bound can't be reached.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.kernels import LETTERS, chunks, mix64, splitmix, word_hashes
from gritstone.llm.sampling import local_rows
from gritstone.operators.graph import connected_components
from gritstone.session import cut

# Anchors are the commonest function words of English, German, French and Spanish.
ANCHORS = "the a an of is was are be to and in der die das ein eine ist und von zu le la les un une est et de du des en el los las una es y que".split()
# Further words that are no content.
FUNCTION_WORDS = "that this it he she they with for as at by from or on have has had not but his her their its i you we were been will would can which den dem mit auf für sich nicht auch im am es er sie wie als bei aus wird sind war ce cette il elle ils nous vous pour par sur dans avec qui ne pas plus au aux se lo su al con por para como más pero del".split()
CHAIN = 2
DENSE = 6
PARTITION_ROWS = 4_096
#: Ranges of ids at most, and sampled keys that cut them.
MOST_PARTS = 16_384
CUT_ROWS = 262_144


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes([" ".join(words).encode()], LETTERS)[0])


_ANCHOR = _hashes(ANCHORS)
_COMMON = _hashes(ANCHORS + FUNCTION_WORDS)
_K1, _K2 = (int(x) | 1 for x in splitmix(3_311, 2))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _bare_pairs(words: np.ndarray, bounds: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spots of words without an anchor among the DENSE words before them and of the word that follows, bounds of each text's)."""
    place = np.arange(len(words))
    last = np.full(len(words), -DENSE - 1)
    last[anchors] = anchors
    last = np.maximum.accumulate(last) if len(words) else last
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    stop = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(((place - last > DENSE) | (last < begin)) & (place + 1 < stop))
    with np.errstate(over="ignore"):
        spots_ = (mix64(words[at] * np.uint64(_K1) ^ words[at + 1]) >> np.uint64(32)).astype(np.uint32) if len(at) else np.empty(0, np.uint32)
    return spots_, np.searchsorted(at, bounds)


def spots(texts: list[bytes], chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct 32-bit spots of each text.

    A word with no anchor among the DENSE words before it (tables, capitals, the
    start of a text) is an anchor of the word that follows: a rule of the place,
    so an edit changes spots around it only.  A text without any spot is one spot
    of all its bytes, as the empty text is.
    """
    words, bounds = word_hashes(texts, LETTERS)
    content = np.flatnonzero(~_member(words, _COMMON)) if len(words) else np.empty(0, np.int64)
    anchors = np.flatnonzero(_member(words, _ANCHOR)) if len(words) else np.empty(0, np.int64)
    pairs, pair_edges = _bare_pairs(words, bounds, anchors)
    owner = np.searchsorted(bounds, anchors, side="right") - 1
    first = np.searchsorted(content, anchors)
    last = first + chain - 1
    whole = last < len(content)
    whole[whole] &= content[last[whole]] < bounds[owner[whole] + 1]
    anchors, first, owner = anchors[whole], first[whole], owner[whole]
    with np.errstate(over="ignore"):
        value = words[anchors] * np.uint64(_K1)
        for k in range(chain):
            value = (value ^ words[content[first + k]]) * np.uint64(_K2) + np.uint64(k + 1)
        value = (mix64(value) >> np.uint64(32)).astype(np.uint32)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        found = np.concatenate([value[edges[i] : edges[i + 1]], pairs[pair_edges[i] : pair_edges[i + 1]]])
        if not len(found):
            found = np.frombuffer(hashlib.blake2b(texts[i], digest_size=4).digest(), np.uint32)
        out.append(np.unique(found))
    return out


def _each(texts: list[bytes]) -> list[np.ndarray]:
    """spots of many texts, some at a time; a long one comes alone, so it is read in slices."""
    return [found for a, b in chunks(texts) for found in spots(texts[a:b])]


def write(spots_: np.ndarray) -> str:
    """A fingerprint as text: base64 of the sorted spots, little-endian."""
    return base64.b64encode(spots_.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two spot sets; 0 where the sizes alone, or the parts still to come, rule out at_least."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < at_least * large:
        return 0.0
    if at_least and large > 256:
        # Halves by value: what is left can add at most the smaller of the two rests.
        middle = np.uint32(1 << 31)
        i, j = np.searchsorted(a, middle), np.searchsorted(b, middle)
        low = np.intersect1d(a[:i], b[:j], assume_unique=True).size
        if low + min(len(a) - i, len(b) - j) < at_least / (1 + at_least) * (len(a) + len(b)):
            return 0.0
        both = low + np.intersect1d(a[i:], b[j:], assume_unique=True).size
    else:
        both = np.intersect1d(a, b, assume_unique=True).size
    return both / (len(a) + len(b) - both)


def length_partition(size, threshold: float = 0.8):
    """Sets in partitions further apart than one differ too much in size to reach threshold."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(threshold) + 1e-9).cast("int")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the first code points of following."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _cuts(keyed: DataFrame, parts: int) -> np.ndarray:
    """Keys (k, h) that cut the rows into about as many equal parts, from a sample of at most about CUT_ROWS different keys."""
    rows = keyed.count()
    share = min(1.0, CUT_ROWS / max(1, rows))
    at = F.xxhash64(F.lit(41), "k", "h") / math.ldexp(1.0, 64) + 0.5
    got = keyed.where(at <= share).distinct().orderBy("k", "h").toPandas()
    places = (np.arange(1, parts) * len(got)) // parts
    return np.unique(got[["k", "h"]].to_numpy(np.int64).reshape(-1, 2)[places], axis=0) if len(got) else np.empty((0, 2), np.int64)


def in_sequence(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, role, id, text), dealt by ranges of id and text hash and sorted: within a part ids descend, and the
    document after its last one follows with role 1.  Null texts are empty.

    Ranges hold about PARTITION_ROWS rows each; they are cut at sampled keys, so
    neither outlying nor repeated ids fill one.
    """
    spark = docs.sparkSession
    body = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # ~id descends as id ascends, without overflow.
    body = body.withColumn("k", F.bitwise_not("id")).withColumn("h", F.xxhash64("text"))
    keyed = cut(body.select("k", "h"))
    cuts = _cuts(keyed, max(1, min(MOST_PARTS, keyed.count() // PARTITION_ROWS)))

    @F.pandas_udf("int")
    def part_of(k: pd.Series, h: pd.Series) -> pd.Series:
        keys, hashes = k.to_numpy(np.int64), h.to_numpy(np.int64)
        low, high = np.searchsorted(cuts[:, 0], keys, "left"), np.searchsorted(cuts[:, 0], keys, "right")
        out = low.copy()
        for i in np.flatnonzero(low < high):
            out[i] = low[i] + np.searchsorted(cuts[low[i] : high[i], 1], hashes[i], "right")
        return pd.Series(out.astype(np.int32))

    tops = keyed.select("k", "h", part_of("k", "h").alias("part")).groupBy("part").agg(F.min(F.struct("k", "h")).alias("top")).select("part", "top.k", "top.h").orderBy("part").collect()
    if not tops:
        return body.select(F.lit(0).alias("part"), F.lit(0).alias("role"), "id", "text")
    # A part's first document follows the last one of the part before; the first of all follows the last of all.
    before = local_rows(spark, [(r["k"], r["h"], tops[i - 1]["part"]) for i, r in enumerate(tops)], "tk long, th long, before int")
    placed = body.withColumn("part", part_of("k", "h")).join(F.broadcast(before), (F.col("k") == F.col("tk")) & (F.col("h") == F.col("th")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("role"))
    other = F.struct(F.col("before").alias("part"), F.lit(1).alias("role"))
    dealt = placed.withColumn("to", F.explode(F.when(F.col("before").isNotNull(), F.array(own, other)).otherwise(F.array(own)))).select("to.part", "to.role", "k", "h", "id", "text")
    return dealt.repartitionByRange(len(tops), "part").sortWithinPartitions("part", "role", "k", "h").select("part", "role", "id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_spots, partition, spots) for every row; a null text is empty.  partition is the length partition."""
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for a, b in chunks(texts):
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[a:b], "spots": [x.astype(np.int64) for x in spots(texts[a:b])]})

    out = given.mapInPandas(run, f"id {dict(given.dtypes)['id']}, spots array<long>")
    return out.select(F.col("id").alias(id_col), F.size("spots").alias("n_spots"), length_partition(F.size("spots")).alias("partition"), "spots")


def links(prints: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(src, dst, likeness) of all different fingerprints that reach threshold, src < dst being the smallest ids of theirs.

    prints is what fingerprints() gives.  Two such sets lie in one length
    partition or in neighbouring ones, and share one of the first
    size - ceil(threshold * size) + 1 spots of either in the order of frequency:
    an equi-join on partition and spot finds every pair, and likeness(), pruned
    at threshold, confirms it.  Equal sets collapse first (see families); null
    ids are left out.
    """
    reps = prints.where(F.col(id_col).isNotNull()).groupBy("spots").agg(F.min(id_col).alias("id"))
    flat = reps.select("id", F.size("spots").alias("n"), F.explode("spots").alias("spot")).withColumn("part", length_partition(F.col("n"), threshold))
    frequency = flat.groupBy("spot").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "spot"))
    rare = flat.join(frequency, "spot").withColumn("r", place).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    one = rare.select(F.col("id").alias("x"), "spot", F.col("part").alias("own"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    two = rare.select(F.col("id").alias("y"), "spot", "part")
    met = one.join(two, ["spot", "part"]).where((F.col("own") < F.col("part")) | (F.col("x") < F.col("y")))
    pairs = met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()
    with_sets = pairs.join(reps.select(F.col("id").alias("src"), F.col("spots").alias("a")), "src").join(reps.select(F.col("id").alias("dst"), F.col("spots").alias("b")), "dst")
    least = threshold - 1e-9

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = [likeness(a.astype(np.uint32), b.astype(np.uint32), least) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            out = pdf[["src", "dst"]].assign(likeness=np.array(near, float))
            yield out[out["likeness"] >= least]

    kind = dict(reps.dtypes)["id"]
    return with_sets.select("src", "dst", "a", "b").mapInPandas(confirm, f"src {kind}, dst {kind}, likeness double")


def families(prints: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(id_col, family): documents of equal fingerprints share their smallest id, linked ones the smallest of their component."""
    rows = prints.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), "spots")
    first = rows.groupBy("spots").agg(F.min(id_col).alias("node"))
    named = rows.join(first, "spots").select(id_col, "node")
    linked = connected_components(links(rows, threshold, id_col))
    return named.join(linked, "node", "left").select(id_col, F.coalesce("component", "node").alias("family"))


def edit_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots, partition), one row per row of docs.

    partition is the fingerprint's length partition, in which links() meets it.

    The next document is the one with the next smaller id (of equal ids: the
    next by the text's hash); the largest follows the smallest, so a document
    alone is its own next.  Null texts are empty; rows with a null id are left
    out, rows that share id and text keep their place beside one another.  Whole
    texts are read, very long ones in slices.  An empty table gives an empty result.  Other
    columns are not read, whatever their names.
    """

    def flush(pairs: list[tuple[int, str, str]]) -> Iterator[pd.DataFrame]:
        texts = [t.encode("utf-8", "surrogatepass") for _, t, _ in pairs]
        changed = [edited(t, n).encode("utf-8", "surrogatepass") for _, t, n in pairs]
        following = [n.encode("utf-8", "surrogatepass") for _, _, n in pairs]
        # A run's documents are one another's next ones: only the last one's is new.
        own, after = _each([*texts, following[-1]]), _each(changed)
        rows = []
        for i, (key, text, _) in enumerate(pairs):
            rows.append((key, len(text), hashlib.sha256(changed[i]).hexdigest(), write(own[i]), write(after[i]), likeness(own[i], after[i]), likeness(own[i], own[i + 1])))
        yield pd.DataFrame(rows, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        pairs: list[tuple[int, str, str]] = []
        size = 0
        for pdf in batches:
            for part, role, key, text in zip(pdf["part"], pdf["role"], pdf["id"], pdf["text"], strict=True):
                if waiting is not None and waiting[0] == part:
                    pairs.append((waiting[1], waiting[2], text))
                    size += len(text)
                    if role or size > 1 << 19:
                        yield from flush(pairs)
                        pairs, size = [], 0
                waiting = None if role else (part, key, text)
        if pairs:
            yield from flush(pairs)

    kinds = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = in_sequence(docs, id_col, text_col).mapInPandas(run, kinds).withColumnRenamed("id", id_col)
    size = F.floor(F.octet_length(F.unbase64("fingerprint")) / 4).cast("int")
    return out.withColumn("n_spots", size).withColumn("partition", length_partition(F.col("n_spots")))
