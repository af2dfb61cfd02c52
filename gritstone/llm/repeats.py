"""Suffix-array dedup: bytes that repeat an earlier 100-byte string of the corpus, through merged Burrows-Wheeler transforms.

1. Every 100-byte window has a key, the smallest hash of the 32-byte strings in
   it.  A run of windows with one key is a segment; equal windows always meet
   under their key, wherever they stand.
2. Segments are sorted by (key, content, place).  Later copies of a segment are
   covered; the first of each content goes on if its key has other contents too.
3. Those first segments, dealt out by key, are the shards: each gets its
   transform, and the transforms of the keys in a task are merged.  Intervals with
   a common prefix of 100 bytes name the windows that stand there already.
4. What is covered comes back to the documents.

Windows under a key with a great share of all segments, or with more different
segments than a task can hold, are keyed by their own 100 bytes instead, and the
first of each is found by sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.bwt import merge, transform
from gritstone.llm.kernels import mix64, splitmix
from gritstone.session import scratch_path, spread

#: Bytes of a repeated string, of the strings that give a window its key, and windows of a segment at most.
WIDTH, GRAM, LONGEST = 100, 32, 128
#: Bytes worked on at once, and bytes of the strings of one shard and of those merged at once.
PIECE, SHARD, MERGED = 1 << 20, 1 << 16, 1 << 19
#: A key with this part of the sampled segments (one document in SAMPLE) is hot; one with more than WIDE different segments is wide.
HOT_PART, SAMPLE, WIDE = 4096, 64, 8192
_LAST = (1 << 63) - 1
_BYTES = splitmix(41_113, 256)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 1), _powers(_BACK, 1)


def _sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any part of text follows, and the powers that bring it to one scale."""
    global _UP, _DOWN
    if len(_UP) <= len(text):
        _UP, _DOWN = _powers(_BASE, 2 * len(text) + 1), _powers(_BACK, 2 * len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTES[text] * _UP[: len(text)], out=sums[1:])
    return sums, _DOWN


def _part_hash(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def _slide(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        values, n = pick(values[:-n], values[n:]), n * 2
    return pick(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def segments(text: np.ndarray, starts: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, content, place, windows, repeats itself) of the segments of joined strings text[starts[i]:starts[i + 1]].

    A segment repeats itself if the string that gives its key stands twice in it;
    only then can one window stand twice in it.  Windows under a hot key are
    segments of their own, keyed by all of their bytes.
    """
    span = WIDTH - GRAM + 1
    if len(text) < WIDTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    sums, down = _sums(text)
    at = np.arange(len(text) - GRAM + 1)
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(at)])
    least = _slide(grams, span)
    whole = np.zeros(len(least) + 1, np.int8)
    sizes = np.diff(starts)
    fits = sizes >= WIDTH
    np.add.at(whole, starts[:-1][fits], 1)
    np.add.at(whole, starts[1:][fits] - WIDTH + 1, -1)
    valid = np.cumsum(whole[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    new[starts[:-1][fits]] = True
    first = np.flatnonzero(new)
    length = np.diff(first, append=len(least))
    pieces = -(-length // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = np.repeat(first, pieces) + nth * LONGEST
    n = np.minimum(np.repeat(first + length, pieces) - place, LONGEST)
    place, n = place[valid[place]], n[valid[place]]
    key = least[place]
    # Strings that are the least of some window, and where the same one stands next.
    least_of = np.flatnonzero(grams == np.concatenate([_slide(np.pad(least, span - 1), span, np.maximum)]))
    values, rank = np.unique(grams[least_of], return_inverse=True)
    ordered = np.append(np.sort(rank.astype(np.int64) << 32 | least_of), np.int64(_LAST))
    own = np.searchsorted(values, key).astype(np.int64) << 32
    seen = np.searchsorted(ordered, own | place)
    twice = ordered[np.minimum(seen + 1, len(ordered) - 1)] < (own | (place + n + span - 1))
    if len(hot) and (is_hot := np.isin(key, hot)).any():
        windows = np.repeat(place[is_hot], n[is_hot]) + (np.arange(n[is_hot].sum()) - np.repeat(np.cumsum(n[is_hot]) - n[is_hot], n[is_hot]))
        content = _part_hash(sums, down, windows, windows + WIDTH)
        place, n, twice = (np.concatenate([x[~is_hot], y]) for x, y in ((place, windows), (n, np.ones(len(windows), np.int64)), (twice, np.zeros(len(windows), bool))))
        key = np.concatenate([key[~is_hot], mix64(content ^ np.uint64(0x5851F42D4C957F2D))])
    return key, _part_hash(sums, down, place, place + n + WIDTH - 1), place, n, twice


def joined(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, starts, number of the text, its byte at which each part starts) of about PIECE bytes; longer texts come in parts that share WIDTH - 1 bytes."""
    held, who, where, size = [], [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(len(text) - WIDTH + 1, 1), PIECE):
            part = text[a : a + PIECE + WIDTH - 1]
            held.append(part)
            who.append(i)
            where.append(a)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), np.array(who), np.array(where)
                held, who, where, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), np.array(who), np.array(where)


def united(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjacent ranges of a group as one; group in whole numbers from 0, starts and stops below 2**40."""
    order = np.lexsort((start, group))
    group, start, stop = group[order], start[order], stop[order]
    far = np.maximum.accumulate(stop + (group << 40)) if len(group) else stop
    new = np.ones(len(group), bool)
    new[1:] = start[1:] + (group[1:] << 40) > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(group))[: len(first)] - 1
    return group[first], start[first], far[last] - (group[first] << 40)


_SEGMENTS = "kind int, key long, content long, id long, h long, start long, n int"
_NAMES = ["kind", "key", "content", "id", "h", "start", "n"]


def _rows(kind: int, key, content, ids, h, start, n) -> pa.RecordBatch:
    columns = [np.full(len(start), kind, np.int32), key, content, ids, h, start, np.asarray(n, np.int32)]
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=_NAMES)


def _covered(ids, h, start, stop) -> pa.RecordBatch:
    """Ranges [start, start + n) of documents, as kind 1."""
    none = np.zeros(len(start), np.int64)
    return _rows(1, none, none, ids, h, start, stop - start)


def find_segments(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Kind 0: segments of docs(id, h, body), n negative where a segment repeats itself; kind 1: ranges that repeat a segment of the same Arrow batch, of which only the first goes on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = np.asarray(batch["id"]), np.asarray(batch["h"])
            found = []
            for text, starts, who, where in joined(batch["body"].to_pylist()):
                key, content, place, n, twice = segments(text, starts, hot)
                part = np.searchsorted(starts, place, side="right") - 1
                found.append((key, content, who[part], place - starts[part] + where[part], np.where(twice, -n, n)))
            if not found:
                continue
            key, content, who, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(key):
                continue
            order = np.lexsort((start, h[who], ids[who], content, key))
            key, content, who, start, n = (x[order] for x in (key, content, who, start, n))
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            origin = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
            itself = (ids[who] == ids[who[origin]]) & (h[who] == h[who[origin]]) & (start == start[origin])
            yield _rows(0, key[~again], content[~again], ids[who[~again]], h[who[~again]], start[~again], n[~again])
            later = again & ~itself
            group, a, b = united(who[later], start[later], start[later] + np.abs(n[later]) + WIDTH - 1)
            yield _covered(ids[group], h[group], a, b)

    return docs.mapInArrow(scan, _SEGMENTS)


def firsts(segs: DataFrame) -> DataFrame:
    """Kind 0: the first segment of each content whose key has other contents too, or that repeats itself; kind 1: ranges of all later segments of a content.

    A task sorts its keys on the JVM's side, reads them once and holds one row
    between batches.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, fresh = None, True
        for batch in batches:
            cols = [np.asarray(batch[c]) for c in _NAMES[1:]]
            if not len(cols[0]):
                continue
            if head is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(head, cols, strict=True)]
            key, content, ids, h, start, n = cols
            same_key = np.zeros(len(key), bool)
            same_key[1:] = key[1:] == key[:-1]
            again = same_key.copy()
            again[1:] &= content[1:] == content[:-1]
            origin = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
            later = again & ~((ids == ids[origin]) & (h == h[origin]) & (start == start[origin]))
            yield _covered(ids[later], h[later], start[later], start[later] + np.abs(n[later]) + WIDTH - 1)
            at = np.flatnonzero(~again)
            shared = np.zeros(len(at), bool)
            shared[1:] = key[at[1:]] == key[at[:-1]]
            joined_before = not fresh  # the held row's key had another content in an earlier batch
            shared[:-1] |= shared[1:].copy() if len(at) > 1 else False
            shared[0] |= joined_before
            wanted = shared | (n[at] < 0)
            # The last content stays open: what comes next tells whether its key has others.
            out = at[:-1][wanted[:-1]]
            yield _rows(0, key[out], content[out], ids[out], h[out], start[out], n[out])
            head, fresh = [c[at[-1]] for c in cols], not (len(at) > 1 and key[at[-1]] == key[at[-2]] or (len(at) == 1 and joined_before))
        if head is not None and (not fresh or head[-1] < 0):
            yield _rows(0, *(np.array([x]) for x in head))

    order = ("key", "content", "id", "h", "start")
    return segs.select(*_NAMES[1:]).repartition("key").sortWithinPartitions(*order).mapInArrow(walk, _SEGMENTS)


def cut_out(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The strings of asked(key, id, h, start, n, wide) from docs; of a wide key each window by itself, with its hash as key and an empty string."""
    wanted = asked.groupBy("id", "h").agg(*[F.collect_list(c).alias(c) for c in ("key", "start", "n", "wide")])
    rows = docs.join(wanted, ["id", "h"])
    schema = "key long, content long, id long, h long, start long, n int, part binary"

    def cut_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, doc, h = batch["body"][i].as_buffer(), batch["id"][i].as_py(), batch["h"][i].as_py()
                key, start, n, wide = (np.asarray(batch[c][i].values) for c in ("key", "start", "n", "wide"))
                wide = wide.astype(bool)
                parts = [bytes(body[a : a + m + WIDTH - 1]) for a, m in zip(start.tolist(), np.abs(n).tolist(), strict=True)]
                out = [(k, 0, a, m, p) for k, a, m, p, w in zip(key.tolist(), start.tolist(), np.abs(n).tolist(), parts, wide.tolist(), strict=True) if not w]
                for a, p in ((a, p) for a, p, w in zip(start.tolist(), parts, wide.tolist(), strict=True) if w):
                    sums, down = _sums(np.frombuffer(p, np.uint8))
                    at = np.arange(len(p) - WIDTH + 1)
                    content = _part_hash(sums, down, at, at + WIDTH)
                    own = mix64(content ^ np.uint64(0x5851F42D4C957F2D))
                    out += [(k, c, a + j, 1, b"") for k, c, j in zip(own.view(np.int64).tolist(), content.view(np.int64).tolist(), at.tolist(), strict=True)]
                k, c, a, m, p = zip(*out, strict=True)
                yield pa.record_batch([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array([doc] * len(k), pa.int64()), pa.array([h] * len(k), pa.int64()), pa.array(a, pa.int64()), pa.array(m, pa.int32()), pa.array(p, pa.binary())], names=[*_NAMES[1:], "part"])

    return rows.mapInArrow(cut_parts, schema)


def repeated_windows(ids: np.ndarray, h: np.ndarray, start: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to): ranges of windows that stand earlier in one of the parts; parts of one text don't share windows' places."""
    order = np.lexsort((start, h, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(h[order]) != 0) | (np.diff(start[order]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    sizes = np.array([len(p) for p in parts])
    cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(SHARD, sizes.sum() + SHARD, SHARD), side="left").clip(max=len(parts) - 1) + 1)
    bounds = np.concatenate([[0], cuts])
    shards, owners = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        text, starts = np.frombuffer(b"".join(parts[a:b]), np.uint8), np.concatenate([[0], np.cumsum(sizes[a:b])])
        shards.append(transform(text, starts, WIDTH))
        owners.append(a + np.searchsorted(starts, shards[-1].at, side="right") - 1)
    shard, row, interval = merge(shards, WIDTH)
    base = np.cumsum([0, *(len(s.at) for s in shards)])[shard] + row
    owner, offset = np.concatenate(owners)[base], np.concatenate([s.offset for s in shards])[base]
    place = rank[owner] << 12 | offset
    if not len(place):
        return owner, offset, offset
    first = np.minimum.reduceat(place, np.flatnonzero(np.diff(interval, prepend=-1)))
    later = place > first[interval]
    return united(owner[later], offset[later], offset[later] + WIDTH)


def merged(strings: DataFrame) -> DataFrame:
    """Ranges that repeat earlier strings of their key: whole keys are gathered to about MERGED bytes, cut into shards, and the shards' transforms merged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(rows: pa.Table) -> pa.RecordBatch:
            ids, h, start = (rows[c].to_numpy() for c in ("id", "h", "start"))
            who, a, b = repeated_windows(ids, h, start, rows["part"].to_pylist())
            return _covered(ids[who], h[who], start[who] + a, start[who] + b)

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                size += part["part"].nbytes
                if size < MERGED:
                    continue
                rows = pa.Table.from_batches(held)
                keys = rows["key"].to_numpy()
                stop = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
                if stop:
                    yield ranges(rows.slice(0, stop))
                    rows = rows.slice(stop).combine_chunks()
                    held, size = rows.to_batches(), rows["part"].nbytes
        if held:
            yield ranges(pa.Table.from_batches(held))

    return strings.select("key", "id", "h", "start", "part").repartition("key").sortWithinPartitions("key").mapInArrow(work, _SEGMENTS)


def hot_keys(docs: DataFrame) -> np.ndarray:
    """Keys with 1 / HOT_PART or more of the segments of one document in SAMPLE, at most HOT_PART; they change how windows are dealt out, never what is found."""
    some = find_segments(docs.where(F.pmod(F.xxhash64("id", "h"), F.lit(SAMPLE)) == 0), np.zeros(0, np.uint64))
    counts = some.groupBy("kind", "key").count().where("kind = 0 and count >= 8")
    total = some.where("kind = 0").count()
    found = counts.where(F.col("count") >= total / HOT_PART).orderBy(F.desc("count"), "key").limit(HOT_PART).collect()
    return np.array([r.key for r in found], np.int64).view(np.uint64)


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(id, h, start, n): ranges of docs(id, h, body) that repeat an earlier string of WIDTH bytes; they overlap."""
    spark = docs.sparkSession
    put = lambda df, what: (df.write.partitionBy("kind").parquet(path := scratch_path(spark, what)), spark.read.schema(_SEGMENTS).parquet(path))[1]
    segs = put(find_segments(docs, hot_keys(docs)), "segments")
    known = put(firsts(segs.where("kind = 0")), "firsts")
    asked = known.where("kind = 0")
    counts = asked.groupBy("key").count().where(F.col("count") > WIDE).select("key", F.lit(True).alias("is_wide"))
    asked = asked.join(counts, "key", "left").withColumn("wide", F.coalesce("is_wide", F.lit(False)))
    path = scratch_path(spark, "strings")
    cut_out(docs, asked).write.parquet(path)
    strings = spark.read.parquet(path)
    ranges = [segs.where("kind = 1"), known.where("kind = 1"), merged(strings.where("length(part) > 0"))]
    ranges.append(firsts(strings.where("length(part) = 0")).where("kind = 1"))
    out = ranges[0]
    for r in ranges[1:]:
        out = out.unionByName(r)
    return out.select("id", "h", "start", "n")


def spans(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs of one document."""
    _, a, b = united(np.zeros(len(starts), np.int64), starts, starts + sizes)
    return list(zip(a.tolist(), b.tolist(), strict=True))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with_text adds kept, the bytes that stay.

    A null text is empty; one below WIDTH bytes loses nothing.  Very long texts are
    read in parts that overlap, whole.  Documents are ordered by id, null last, then
    by a hash of the text; rows equal in id and text are one document and lose the
    same.  No documents give none.  Other columns, whatever their names, take no part.
    """
    body = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    plain = docs.select(F.col(id_column).cast("long").alias("given"), body.alias("body"))
    plain = plain.select("given", F.coalesce("given", F.lit(_LAST)).alias("id"), F.xxhash64("body").alias("h"), "body")
    gone = removed_ranges(spread(plain.select("id", "h", "body"))).groupBy("id", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    rows = plain.join(gone, ["id", "h"], "left").select("given", "body", "starts", "sizes")
    names = f"`{id_column}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text, at, kept, digest, removed = memoryview(batch["body"][i].as_buffer()), 0, [], hashlib.sha256(), 0
                cuts = spans(batch["starts"][i].values.to_numpy(), batch["sizes"][i].values.to_numpy().astype(np.int64)) if batch["starts"][i].is_valid else []
                for a, b in [*cuts, (len(text), len(text))]:
                    digest.update(text[at:a])
                    if with_text:
                        kept.append(bytes(text[at:a]))
                    removed, at = removed + b - a, b
                out.append((len(text), removed, len(cuts), digest.hexdigest(), *([b"".join(kept)] * with_text)))
            columns = list(zip(*out, strict=True)) or [()] * (4 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch([batch["given"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return rows.mapInArrow(strip, names)
