"""Near-duplicate components by b-bit MinHash.

1. Every text gives a digest of its word sequence, the size of its shingle set
   and 160 minima of that set.  Bands of minima become 64-bit bucket keys; of
   each minimum only the low b bits are kept, packed into a signature of 80
   bytes that is stored with the document.
2. Equal word sequences collapse to their smallest id.
3. A bucket's members hang on its smallest member, one row each.  Signatures
   are compared by bit counts, corrected for chance agreement of b-bit values;
   what can reach the threshold is confirmed on the full shingle sets.  The
   components of these links are classes.
4. Buckets that hold several classes are weighed pair by pair, by signatures
   alone; only documents with a partner in another class that can reach the
   threshold go on, and are confirmed on full sets.  A bucket above
   ``block_rows`` is dealt into blocks, each pair of blocks a task of its own, so
   no task holds more than two blocks.  Links that join what is joined already
   don't leave a task.
5. Components of all confirmed links, plus the copies of step 2.

Every pair that shares a bucket is weighed or joined already, whatever the size
of its bucket or of the family around it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.kernels import WORDS, chunks, distinct_runs, mix64, shingle_hashes, splitmix, word_hashes
from gritstone.operators.graph import connected_components
from gritstone.session import cut, spread

ROWS_PER_BAND = 5
#: A power of two.
BANDS = 32
HASHES = ROWS_PER_BAND * BANDS
BITS = 4
_EVEN = np.uint64(0x1111111111111111)


def _minima(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per run the minimum of each permutation, 32 bits; empty runs get all ones."""
    runs = len(bounds) - 1
    out = np.full((HASHES, runs), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        seeds = splitmix(4_021, 2 * HASHES)
        starts = bounds[:-1][full]
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                factor = np.uint32(int(seeds[2 * k]) & 0xFFFFFFFF | 1)
                shift = np.uint32(int(seeds[2 * k + 1]) >> 32)
                out[k, full] = np.minimum.reduceat((low ^ shift) * factor, starts)
    return out.T.copy()


def signatures(minima: np.ndarray) -> np.ndarray:
    """Low BITS bits of each (mixed) minimum, 16 to a 64-bit word."""
    low = mix64(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    low = low.reshape(len(minima), HASHES // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of whole minima; its low bits are the band's number."""
    parts = minima.reshape(len(minima), BANDS, ROWS_PER_BAND).astype(np.uint64)
    key = np.broadcast_to(splitmix(515, BANDS), (len(minima), BANDS)).copy()
    for k in range(ROWS_PER_BAND):
        key = mix64(key ^ parts[:, :, k])
    return (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard estimates from packed signatures: agreeing b-bit values counted by bits, less the chance agreement."""
    x = one ^ many
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differing = np.bitwise_count(x & _EVEN).sum(axis=-1, dtype=np.int64)
    chance = 1.0 / (1 << BITS)
    return ((HASHES - differing) / HASHES - chance) / (1 - chance)


def _margin(threshold: float) -> float:
    """Estimates below this can't come from a pair at the threshold, but for five standard deviations."""
    chance = 1.0 / (1 << BITS)
    agree = threshold * (1 - chance) + chance
    return threshold - 5 * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


def _texts(column: pd.Series) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in column]


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, h1, h2, n_shingles, bands, sig): one row per document; bands is empty for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = _texts(pdf["text"])
            for a, b in chunks(texts):
                words, wb = word_hashes(texts[a:b], WORDS)
                shingles, sb = shingle_hashes(words, wb, width)
                sizes = [len(x) for x in distinct_runs(shingles, sb)]
                minima = _minima(shingles, sb)
                keys = band_keys(minima).view(np.int64)
                raw = words.tobytes()
                digest = [hashlib.blake2b(raw[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(wb[:-1], wb[1:], strict=True)]
                halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pd.DataFrame(
                    {
                        "id": pdf["id"].to_numpy()[a:b],
                        "h1": halves[:, 0],
                        "h2": halves[:, 1],
                        "n_shingles": np.array(sizes, np.int64),
                        "bands": [k if n else k[:0] for k, n in zip(keys, sizes, strict=True)],
                        "sig": list(signatures(minima).view(np.int64)),
                    }
                )

    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(given).mapInPandas(run, "id long, h1 long, h2 long, n_shingles long, bands array<long>, sig array<long>")


def _most_differing(percent: int) -> int:
    """b-bit values in which the signatures of a pair at the threshold may differ."""
    chance = 1.0 / (1 << BITS)
    return math.floor(HASHES * (1 - (_margin(percent / 100) * (1 - chance) + chance)))


def can_reach(one: Column, other: Column, sizes: tuple[Column, Column], percent: int) -> Column:
    """Whether two signatures and set sizes leave it open that a pair reaches percent."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(int(_EVEN))))

    total = F.aggregate(F.zip_with(one, other, differing), F.lit(0), lambda a, b: a + b)
    return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & (total <= _most_differing(percent))


class _Weigher:
    """Documents of one task: which pairs can reach the threshold; side 0 x side 1 pairs only where both occur.

    A pair that shares several buckets is weighed in that of its first shared band.
    """

    def __init__(self, task: pd.DataFrame, percent: int):
        self.sig = np.stack(task["sig"].to_numpy()).view(np.uint64)
        self.bands = np.stack(task["bands"].to_numpy())
        self.size, self.known, self.node = (task[c].to_numpy() for c in ("size", "known", "node"))
        self.unit = task["unit"].iloc[0]
        self.star = int(task["high"].iloc[0]) < 0
        self.side = task["side"].to_numpy()
        self.cross = int(task["low"].iloc[0]) != int(task["high"].iloc[0]) and self.side.min() != self.side.max()
        self.percent, self.floor = percent, _margin(percent / 100)

    def partners(self, i: int) -> np.ndarray:
        """Earlier documents of another class than i that can be its partners."""
        open_ = self.known[:i] != self.known[i]
        if self.cross:
            open_ &= self.side[:i] != self.side[i]
        open_ &= 100 * np.minimum(self.size[:i], self.size[i]) >= self.percent * np.maximum(self.size[:i], self.size[i])
        pool = np.flatnonzero(open_)
        if len(pool):
            pool = pool[similarity(self.sig[i], self.sig[pool]) >= self.floor]
        if len(pool) and not self.star:
            first = (self.bands[pool] == self.bands[i]).argmax(axis=1)
            pool = pool[self.bands[i, first] == self.unit]
        return pool


def _links(task: pd.DataFrame, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the given documents, confirmed on full sets. Documents of one known class count as joined already."""
    pairs = _Weigher(task, percent)
    _, first, inverse = np.unique(pairs.known, return_index=True, return_inverse=True)
    root = first[inverse]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    links = []
    for i in range(1, len(sets)):
        pool = pairs.partners(i)
        while len(pool):
            mine = find(i)
            pool = pool[[find(int(j)) != mine for j in pool]]
            if not len(pool):
                break
            j = int(pool[0])
            pool = pool[1:]
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(mine, find(j))] = min(mine, find(j))
                links.append((int(pairs.node[i]), int(pairs.node[j])))
    return links


TASK = ["unit", "low", "high"]


def _whole_tasks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows of whole tasks, bounds of each task's) from rows that come task by task."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf[TASK].to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if len(change):
            yield pdf.iloc[: change[-1]], np.concatenate([[0], change])
        rest = pdf.iloc[change[-1] :] if len(change) else pdf
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def _block_pairs(rows: DataFrame, meets: Column) -> DataFrame:
    """(unit, low, high, side, node, known): rows(unit, node, known, part) once for each of the blocks 0 to meets - 1 that its own one meets."""

    def pair(k: Column) -> Column:
        return F.struct(F.least(k, F.col("part")).alias("low"), F.greatest(k, F.col("part")).alias("high"), F.when(k < F.col("part"), 1).otherwise(0).alias("side"))

    pairs = rows.select("unit", "node", "known", F.explode(F.transform(F.sequence(F.lit(0), meets.cast("int") - 1), pair)).alias("t"))
    return pairs.select("unit", "t.low", "t.high", "t.side", "node", "known")


def _blocks(rows: Column, block_rows: int) -> Column:
    return F.ceil(rows / block_rows).cast("int")


def _star_tasks(hung: DataFrame, block_rows: int) -> DataFrame:
    """Tasks that weigh each node only against those it hangs on: as many pairs as rows."""
    sizes = hung.groupBy("dst").agg(_blocks(F.count("*"), block_rows).alias("parts"))
    below = hung.join(sizes, "dst").select(F.col("dst").alias("unit"), F.pmod(F.xxhash64("src"), "parts").cast("int").alias("low"), F.lit(-1).alias("high"), F.lit(1).alias("side"), F.col("src").alias("node"))
    hubs = sizes.select(F.col("dst").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("low"), F.lit(-1).alias("high"), F.lit(0).alias("side"), F.col("dst").alias("node"))
    return below.unionByName(hubs).withColumn("known", F.col("node"))


def _bucket_tasks(held: DataFrame, block_rows: int) -> DataFrame:
    """Tasks that weigh what held(key, node, known) leaves open within each bucket.

    A bucket whose members are all in one class is done, and so is one with the
    same members as another of an earlier band.  In the rest the pairs inside the
    class of the smallest member are left out.
    """
    band = F.col("key").bitwiseAND(F.lit(BANDS - 1))
    marks = [F.sum(F.xxhash64(F.lit(seed), "node").bitwiseAND(F.lit((1 << 31) - 1))).alias(f"m{seed}") for seed in (1, 2, 3)]
    states = held.groupBy("key").agg(F.count("*").alias("n"), *marks, F.min("known").alias("low"), F.max("known").alias("high"), F.min_by("known", "node").alias("lead"), F.min(band).alias("band"))
    open_ = states.where("low < high").groupBy("n", "m1", "m2", "m3", "lead").agg(F.min_by("key", "band").alias("key")).select("key", "lead")
    rows = held.join(open_, "key").withColumn("inside", F.col("known") == F.col("lead"))
    sizes = rows.groupBy("key").agg(_blocks(F.sum(F.col("inside").cast("long")), block_rows).alias("ins"), _blocks(F.sum((~F.col("inside")).cast("long")), block_rows).alias("outs"))
    place = F.xxhash64("node")
    part = F.when(F.col("inside"), F.col("outs") + F.pmod(place, "ins")).otherwise(F.pmod(place, "outs")).cast("int")
    placed = rows.join(sizes, "key").select(F.col("key").alias("unit"), "node", "known", part.alias("part"), "inside", "ins", "outs")
    return _block_pairs(placed, F.when(F.col("inside"), F.col("outs")).otherwise(F.col("outs") + F.col("ins")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    block_rows: int = 512,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per row of docs.

    Words are runs of bytes other than space and tab to carriage return, A-Z
    lowered; a set holds the distinct runs of ``shingle_words`` words, or the
    whole sequence of a shorter text.  Documents link where 100 times the
    intersection is at least ``percent`` times the union; component_id is the
    smallest id reachable.  Whole texts count, however long.  Null and empty
    texts have an empty set and stand alone.  All rows of a repeated id are in
    one component; rows with a null id are left out; an empty table gives an
    empty result.  Other columns of docs are not looked at, whatever their
    names.  Were the permutations independent, the bands would miss a pair at
    0.8 with probability 3e-6, closer pairs less often.
    """
    seen = cut(sketches(docs, id_col, text_col, shingle_words))
    alone = seen.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("rep"))
    filled = seen.where("n_shingles > 0")
    reps = filled.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    member = filled.select("id", "h1", "h2", "n_shingles").join(reps, ["h1", "h2"]).select("id", "n_shingles", "rep").unionByName(alone)
    # The texts of a repeated id are one document: their representatives are linked.
    lows = member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("id", "low")
    bound = member.join(lows, "id").where("rep > low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct()

    heads = filled.join(reps.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    heads = cut(heads.select("id", "n_shingles", "sig", "bands"))
    signed = heads.select(F.col("id").alias("node"), F.col("n_shingles").alias("size"), "sig", "bands")
    keyed = heads.select("id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    shared = cut(keyed.join(buckets, "key").select("key", "id", "first"))
    source = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        # A task's cost is not its bytes, so small partitions must not be merged by size: their number is given.
        return rows.repartition(width, *TASK).sortWithinPartitions(*TASK, "node")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in _whole_tasks(batches):
            texts = _texts(rows["text"])
            rows = rows.drop(columns="text")
            found: list[tuple[int, int]] = []
            # The sets of a few small tasks, or of one large one, are in memory at once.
            for first, last in chunks([texts[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], size=lambda t: sum(map(len, t))):
                low, high = bounds[first], bounds[last]
                sets: list[np.ndarray] = []
                for a, b in chunks(texts[low:high]):
                    sets += distinct_runs(*shingle_hashes(*word_hashes(texts[low + a : low + b], WORDS), shingle_words))
                for a, b in zip(bounds[first:last], bounds[first + 1 : last + 1], strict=True):
                    found += _links(rows.iloc[a:b], sets[a - low : b - low], percent)
            yield pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    def open_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in _whole_tasks(batches):
            wanted = np.zeros(len(rows), bool)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                pairs = _Weigher(rows.iloc[a:b], percent)
                for i in range(1, b - a):
                    near = pairs.partners(i)
                    wanted[a + near] = True
                    wanted[a + i] |= len(near) > 0
            yield rows[wanted]

    def confirmed(tasks: DataFrame) -> DataFrame:
        # A repeated id may stand for several texts; each comes along, and links reach the id whichever matched.
        return dealt(tasks.join(source, "node")).mapInPandas(confirm, "src long, dst long")

    hung = shared.where("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst")).distinct()
    one, two = (signed.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("sig").alias(f"{n}_sig")) for n in ("src", "dst"))
    near = can_reach(F.col("src_sig"), F.col("dst_sig"), (F.col("src_size"), F.col("dst_size")), percent)
    hung = cut(hung.join(one, "src").join(two, "dst").where(near).select("src", "dst").distinct())
    stars = cut(confirmed(_star_tasks(hung, block_rows).join(signed, "node")).unionByName(bound))
    classes = cut(connected_components(stars))
    known = F.coalesce("component", "id").alias("known")
    held = shared.join(classes.withColumnRenamed("node", "id"), "id", "left").select("key", F.col("id").alias("node"), known)
    columns = {"unit": "long", "low": "int", "high": "int", "side": "int", "node": "long", "known": "long", "size": "long", "sig": "array<long>", "bands": "array<long>"}
    tasks = _bucket_tasks(held, block_rows).join(signed, "node").select(*columns)
    ends = dealt(tasks).mapInPandas(open_ends, ", ".join(f"{c} {k}" for c, k in columns.items()))
    rest = confirmed(cut(ends))
    # What the buckets add joins classes, not documents.
    named = classes.select(F.col("node").alias("id"), "component")
    joins = rest.join(named.select(F.col("id").alias("src"), F.col("component").alias("a")), "src", "left").join(named.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst", "left")
    merged = connected_components(joins.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")))
    first = member.join(named.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("node"))
    out = first.join(merged, "node", "left").select("id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
