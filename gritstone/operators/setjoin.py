"""All pairs of sets whose Jaccard reaches a threshold, exactly, where such pairs may be as many as the square of the sets.

Sets are coded once: a bit for each common element, the numbers of the rest,
and a sketch, the parity of the elements that fall on each of its bits.  They
are dealt by size into blocks of bounded bytes, and each pair of blocks whose
sizes allow a link is one task.  There sketches are compared by whole tiles
(they differ in no more bits than the sets in elements, so no link is lost),
and what is left is counted on the bits.  Tasks give pairs as they find them,
or sums and a spanning forest, which are no more than their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.session import cut, scratch_path

#: Sets and bytes of a block at most, bits for common elements, words of a sketch.
BLOCK_ROWS, BLOCK_BYTES, COMMON, WORDS = 32_768, 24 << 20, 2_048, 64
#: Rows and columns of a tile of sketches, pairs counted at a time.
TILE, PAIRS = (64, 4_096), 16_384
#: Results are rounded to nine digits, so a set may fall short of the threshold by so much.
SLACK = 2e-9


def links(sets: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, sim) with src < dst of sets(id, g), all different ones of numbers, alike from ``threshold`` on."""
    kind = sets.schema["id"].dataType.simpleString()
    return _met(sets.select("id", "g", F.lit(1).cast("long").alias("size")), threshold, False, f"src {kind}, dst {kind}, sim double")


def sums(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, beyond, root) of sets(id, g, size) with links: beyond adds up to the sizes of all linked sets, and (id, root) hang together as the links do.

    A set has a row for each task where it has links, so links themselves are never rows.
    """
    kind = sets.schema["id"].dataType.simpleString()
    return _met(sets, threshold, True, f"id {kind}, beyond long, root {kind}")


def _met(sets: DataFrame, threshold: float, summed: bool, schema: str) -> DataFrame:
    ratio = _ratio(threshold)
    coded = _coded(sets, ratio)
    held = coded.groupBy("n").agg(F.count("*").alias("c"), F.sum(F.octet_length("sketch") + F.octet_length("bits") + F.octet_length("rest") + 32).alias("b")).collect()
    if not held:
        return sets.sparkSession.createDataFrame([], schema)
    own, others = F.col("block.own"), F.explode("block.others").alias("k")
    dealt = coded.withColumn("block", _dealt(np.array(sorted(held), np.int64), ratio, threshold)("n", F.xxhash64("id"))).select("*", own.alias("own"), others)
    dealt = dealt.select(F.least("own", "k").alias("a"), F.greatest("own", "k").alias("b"), "own", "id", "n", "size", "sketch", "bits", "rest")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        rank = pc.rank(table["id"].combine_chunks(), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        one = _Side(table, a, rank)
        two = one if a == b else _Side(table, b, rank)
        if len(one.n) and len(two.n):
            yield from (_summed if summed else _pairs)(one, two, threshold, ratio)

    return dealt.groupBy("a", "b").applyInArrow(meet, schema)


def _ratio(threshold: float) -> float:
    """Elements that two linked sets differ in, for each element of both."""
    return (1 - threshold + SLACK) / (1 + threshold - SLACK)


def numbered(sets: DataFrame) -> DataFrame:
    """sets(id, g, size) with elements as numbers: their own, or else one that each is given."""
    if isinstance(sets.schema["g"].dataType.elementType, T.IntegralType) and sets.where(F.exists("g", lambda x: x.isNull())).isEmpty():
        return sets.withColumn("g", F.col("g").cast("array<long>"))
    each = sets.select("id", "size", F.explode("g").alias("e"))
    numbers = cut(each.select(F.col("e").alias("f")).distinct().withColumn("x", F.monotonically_increasing_id()))
    return each.join(numbers.hint("merge"), F.col("e").eqNullSafe(F.col("f"))).groupBy("id", "size").agg(F.collect_set("x").alias("g"))


def _words(n: np.ndarray, ratio: float) -> np.ndarray:
    """Words of a sketch for sets of n elements, a power of two: different sets turn about half of the bits, linked ones an eighth to a quarter at most."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(2 * n * ratio / 16, 1))), 0, math.log2(WORDS)).astype(np.int64)


def _coded(sets: DataFrame, ratio: float) -> DataFrame:
    """(id, n, size, sketch, bits, rest) of sets(id, g, size), kept as Parquet in the shared folder."""
    spark = sets.sparkSession
    path = scratch_path(spark, "numbered")
    sets.write.parquet(path)
    sets = spark.read.parquet(path)
    # A bit is a 64th of a number, but what has one is also counted much faster.
    counts = sets.select(F.explode("g").alias("e")).groupBy("e").agg(F.count("*").alias("c"))
    top = counts.where(F.col("c") >= sets.count() / 1_000).orderBy(F.desc("c"), "e").limit(COMMON).select("e").collect()
    known = np.sort(np.array([r[0] for r in top] or [0], np.int64))
    width = -(-len(known) // 64) * 64

    def code(batches):
        for batch in batches:
            g = batch.column("g").cast(pa.list_(pa.int64()))
            n, flat = np.diff(g.offsets.to_numpy()).astype(np.int64), g.flatten().to_numpy()
            place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[place] == flat
            of = np.repeat(np.arange(len(n)), n)
            fall = _mixed(flat)
            words = _words(n, ratio)
            ends = np.cumsum(n)
            bits, sketch = np.empty((len(n), width // 8), np.uint8), [b""] * len(n)
            for rows in _slices(np.maximum(words * 64, width), 1 << 22):
                part = slice(ends[rows.start] - n[rows.start], ends[rows.stop - 1])
                at, own = of[part] - rows.start, hit[part]
                grid = np.zeros((rows.stop - rows.start, width), bool)
                grid[at[own], place[part][own]] = True
                bits[rows] = np.packbits(grid, axis=1, bitorder="little")
                for w in np.unique(words[rows]):
                    of_w = words[rows][at] == w
                    cells = at[of_w] * (64 * w) + (fall[part][of_w] % np.uint64(64 * w)).astype(np.int64)
                    parity = np.bincount(cells, minlength=(rows.stop - rows.start) * 64 * w).reshape(-1, 64 * w) & 1
                    packed = np.packbits(parity.astype(bool), axis=1, bitorder="little")
                    for i in np.flatnonzero(words[rows] == w):
                        sketch[rows.start + i] = packed[i].tobytes()
            left = np.bincount(of[~hit], minlength=len(n))
            offsets = np.concatenate([[0], np.cumsum(left * 8)]).astype(np.int32)
            rest = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat[~hit].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), batch.column("size"), pa.array(sketch, pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), rest], ["id", "n", "size", "sketch", "bits", "rest"]
            )

    kind = sets.schema["id"].dataType.simpleString()
    out = scratch_path(spark, "coded")
    sets.select("id", "g", "size").mapInArrow(code, f"id {kind}, n long, size long, sketch binary, bits binary, rest binary").write.parquet(out)
    return spark.read.parquet(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    h = (x.view(np.uint64) ^ (x.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slices(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that weigh ``most`` together, or of one row."""
    ends, at = np.cumsum(weights), 0
    while at < len(weights):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, upto)
        at = upto


def _dealt(held: np.ndarray, ratio: float, threshold: float):
    """The block of a set and the blocks that it meets, from (n, sets, bytes) for each size n in ascending order."""
    n, count, size = held.T
    rows = min(BLOCK_ROWS, max(4_096, int(count.sum()) // 64))
    share = np.maximum(count / rows, size / BLOCK_BYTES)
    words = _words(n, ratio)
    start = np.zeros(len(n))
    for i in range(1, len(n)):
        start[i] = start[i - 1] + share[i - 1]
        # Sketches of a block are of one length.
        if words[i] != words[i - 1]:
            start[i] = math.floor(start[i]) + 1
    first, last = np.floor(start).astype(np.int64), np.floor(start + share).astype(np.int64)
    last[:-1] = np.where(words[1:] != words[:-1], np.minimum(last[:-1], first[1:] - 1), last[:-1])
    blocks = np.arange(last.max() + 1)
    low, high = n[np.searchsorted(last, blocks)], n[np.searchsorted(first, blocks, side="right") - 1]
    upto = np.searchsorted(low, high / (threshold - SLACK) + 1e-6, side="right") - 1
    since = np.searchsorted(upto, blocks)

    @F.pandas_udf("own int, others array<int>")
    def block(sizes: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(n, sizes.to_numpy())
        within = (hashes.to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        own = np.minimum(np.floor(start[at] + within * share[at]).astype(np.int64), last[at])
        meets = {b: np.arange(since[b], upto[b] + 1, dtype=np.int32) for b in np.unique(own)}
        return pd.DataFrame({"own": own.astype(np.int32), "others": [meets[b] for b in own]})

    return block


class _Side:
    """The sets of one block in the order of their sizes, an id that repeats once."""

    def __init__(self, table: pa.Table, block: int, rank: np.ndarray):
        rows = np.flatnonzero(table["own"].to_numpy() == block)
        rows = rows[np.unique(rank[rows], return_index=True)[1]]
        rows = rows[np.argsort(table["n"].to_numpy()[rows], kind="stable")]
        table = table.take(pa.array(rows)).combine_chunks()
        self.ids, self.rank = table["id"].combine_chunks(), rank[rows]
        self.n, self.size = table["n"].to_numpy(), table["size"].to_numpy()
        if len(rows):
            self.sketch = _bytes(table["sketch"])[1].view(np.uint64).reshape(len(rows), -1)
            self.bits = _bytes(table["bits"])[1].view(np.uint64).reshape(len(rows), -1)
            ends, data = _bytes(table["rest"])
            self.starts, self.left, self.rest = ends[:-1] // 8, np.diff(ends) // 8, data.view(np.int64)


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the values of a binary column, from 0 on, and all bytes."""
    values = pa.concat_arrays([c.cast(pa.binary()) for c in column.chunks])
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], np.ascontiguousarray(data)


def _spread(one: _Side, two: _Side) -> list[np.ndarray]:
    """For each set of both sides a number that differs by no more than the sets do: what it holds of some elements less what it holds of the others.

    Elements are parted along the main axis of some rows, which tells languages
    from each other; it decides only how much is looked at.
    """
    some = np.concatenate([s.bits[:: len(s.n) // 1_000 + 1] for s in (one, two)])
    grid = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    grid -= grid.mean(axis=0)
    axis = np.random.default_rng(0).standard_normal(grid.shape[1]).astype(np.float32)
    for _ in range(8):
        axis = grid.T @ (grid @ axis)
        axis /= max(float(np.abs(axis).max()), 1e-9)
    mask, ones = np.packbits(axis > 0, bitorder="little").view(np.uint64), np.ones(some.shape[1], np.float32)
    return [((2 * np.bitwise_count(s.bits & mask) - np.bitwise_count(s.bits).astype(np.int16)) @ ones).astype(np.int64) for s in (one, two)]


def _windows(one: _Side, two: _Side, threshold: float, ratio: float):
    """The orders in which both sides are gone through, and for some rows at a time in that order the first and last place of the other side where partners can be: by sizes, or by _spread where that leaves less."""
    least, most = lambda n: n * (threshold - SLACK) - 1e-6, lambda n: n / (threshold - SLACK) + 1e-6
    k1, k2 = _spread(one, two)
    o1, o2 = np.argsort(k1, kind="stable"), np.argsort(k2, kind="stable")
    reach, k1, k2 = (one.n + two.n[-1]) * ratio + 1e-6, k1[o1], k2[o2]
    reach = reach[o1]
    wide = (np.searchsorted(two.n, most(one.n), side="right") - np.searchsorted(two.n, least(one.n))).sum()
    if (np.searchsorted(k2, k1 + reach, side="right") - np.searchsorted(k2, k1 - reach)).sum() >= wide:
        return np.arange(len(one.n)), np.arange(len(two.n)), lambda a, b: (np.searchsorted(two.n, least(one.n[a])), np.searchsorted(two.n, most(one.n[b - 1]), side="right"))
    return o1, o2, lambda a, b: (np.searchsorted(k2, k1[a] - reach[a:b].max()), np.searchsorted(k2, k1[b - 1] + reach[a:b].max(), side="right"))


def _candidates(one: _Side, two: _Side, threshold: float, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs, each pair once, whose sizes and sketches allow a link, some thousands at a time."""
    words = min(one.sketch.shape[1], two.sketch.shape[1])
    o1, o2, window = _windows(one, two, threshold, ratio)
    n1, n2 = one.n[o1], two.n[o2]
    # Twice as many words fold into one half: a bit falls on the same place in it.
    s1, s2 = (np.ascontiguousarray(np.bitwise_xor.reduce(s.sketch[o].reshape(len(o), -1, words), axis=1).T) for s, o in ((one, o1), (two, o2)))
    cells = TILE[0] * TILE[1]
    word, near, far, ok = np.empty(cells, np.uint64), np.empty(cells, np.uint8), np.empty(cells, np.uint16), np.zeros(cells + 8, bool)
    found, count = [], 0
    for at in range(0, len(n1), TILE[0]):
        upto = min(at + TILE[0], len(n1))
        first, last = window(at, upto)
        largest = n1[at:upto].max()
        for left in range(max(first, at) if one is two else first, last, TILE[1]):
            right = min(left + TILE[1], last)
            shape, size = (upto - at, right - left), (upto - at) * (right - left)
            x, bits = word[:size].reshape(shape), near[:size].reshape(shape)
            np.bitwise_xor(s1[0, at:upto, None], s2[0, None, left:right], out=x)
            apart = np.bitwise_count(x, out=bits)
            if words > 1:
                apart = far[:size].reshape(shape)
                apart[:] = bits
                for w in range(1, words):
                    np.bitwise_xor(s1[w, at:upto, None], s2[w, None, left:right], out=x)
                    apart += np.bitwise_count(x, out=bits)
            bound = min(int((largest + n2[left:right].max()) * ratio + 1e-6), 64 * words)
            np.less_equal(apart, bound, out=ok[:size].reshape(shape))
            # Eight at a time are looked through for any.
            whole = -(-size // 8) * 8
            ok[size:whole] = False
            eights = np.flatnonzero(ok[:whole].view(np.uint64))
            if not len(eights):
                continue
            hits = (eights[:, None] * 8 + np.arange(8))[ok[:whole].reshape(-1, 8)[eights]]
            i, j = at + hits // shape[1], left + hits % shape[1]
            if one is two:
                i, j = i[i < j], j[i < j]
            found.append((o1[i], o2[j]))
            count += len(i)
            if count >= PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
                found, count = [], 0
    if count:
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _linked(one: _Side, two: _Side, threshold: float, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of linked pairs and their similarity, counted on all elements."""
    ones = np.ones(one.bits.shape[1], np.float32)
    # Bits laid upon each other are one more sketch.
    f1, f2 = (np.bitwise_xor.reduce(s.bits, axis=1) for s in (one, two))
    m1, m2 = one.n * ratio, two.n * ratio + 1e-6
    if len(one.rest) and len(two.rest):
        values, codes = np.unique(np.concatenate([one.rest, two.rest]), return_inverse=True)
        c1, c2 = codes[: len(one.rest)], codes[len(one.rest) :]
    for all_i, all_j in _candidates(one, two, threshold, ratio):
        kept = []
        for k in range(0, len(all_i), PAIRS):
            i, j = all_i[k : k + PAIRS], all_j[k : k + PAIRS]
            x = f1.take(i)
            x ^= f2.take(j)
            most = m1.take(i)
            most += m2.take(j)
            close = np.flatnonzero(np.bitwise_count(x) <= most)
            i, j, most = i.take(close), j.take(close), most.take(close)
            x = one.bits.take(i, axis=0)
            x ^= two.bits.take(j, axis=0)
            apart = np.bitwise_count(x) @ ones
            close = np.flatnonzero(apart <= most)
            i, j = i.take(close), j.take(close)
            total, r1, r2 = one.n.take(i) + two.n.take(j), one.left.take(i), two.left.take(j)
            apart = apart.take(close).astype(np.int64) + r1 + r2
            both = np.flatnonzero((r1 > 0) & (r2 > 0))
            for part in _slices(r1[both] + r2[both], 1 << 20):
                p = both[part]
                apart[p] -= 2 * _shared((one.starts[i[p]], r1[p], c1), (two.starts[j[p]], r2[p], c2), len(values))
            shared = (total - apart) // 2
            union = total - shared
            # Rounded half up to nine digits, in whole numbers.
            sim = ((2 * shared * 1_000_000_000 + union) // (2 * union)) / 1e9
            linked = sim >= threshold - 1e-9
            kept.append((i[linked], j[linked], sim[linked]))
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _shared(one, two, codes: int) -> np.ndarray:
    """How many codes both sides of each pair have, a side being (starts, lengths, all codes)."""
    keys = []
    for starts, lengths, values in (one, two):
        of = np.repeat(np.arange(len(lengths)), lengths)
        keys.append(of * codes + values[np.arange(len(of)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)])
    keys = np.sort(np.concatenate(keys))
    return np.bincount(keys[1:][keys[1:] == keys[:-1]] // codes, minlength=len(one[1]))


def _pairs(one: _Side, two: _Side, threshold: float, ratio: float) -> Iterator[pa.RecordBatch]:
    ids, after = (one.ids, 0) if one is two else (pa.concat_arrays([one.ids, two.ids]), len(one.n))
    for i, j, sim in _linked(one, two, threshold, ratio):
        forth = one.rank[i] < two.rank[j]
        src, dst = np.where(forth, i, j + after), np.where(forth, j + after, i)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(src)), ids.take(pa.array(dst)), pa.array(sim)], ["src", "dst", "sim"])


def _summed(one: _Side, two: _Side, threshold: float, ratio: float) -> Iterator[pa.RecordBatch]:
    ids, size, after = (one.ids, one.size, 0) if one is two else (pa.concat_arrays([one.ids, two.ids]), np.concatenate([one.size, two.size]), len(one.n))
    beyond, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j, _ in _linked(one, two, threshold, ratio):
        j = j + after
        for x, y in ((i, j), (j, i)):
            order = np.argsort(x, kind="stable")
            places, starts = np.unique(x[order], return_index=True)
            if len(places):
                beyond[places] += np.add.reduceat(size[y[order]], starts)
        _hang(root, i, j)
    some = np.flatnonzero(beyond)
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(beyond[some]), ids.take(pa.array(root[some]))], ["id", "beyond", "root"])


def _hang(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; root keeps for each place the smallest one of its tree."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]
