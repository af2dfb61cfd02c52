"""Approximate nearest neighbours by adaptive dimension scanning of inverted lists.

Vectors are scaled to unit length and turned by one random rotation, after
which any leading block of components estimates the whole distance.  Lists
come from k-means over a bounded sample; every row is put into the list of its
nearest centroid.  A query probes its nearest lists: in each, distances grow
block by block of columns, and a candidate is abandoned as soon as a
hypothesis test on its partial distance says that it can't enter the best
found so far.  What survives is scored exactly, in double precision, on the
original vectors.

How many lists to probe is measured in fitting: the fewest that give
``recall`` on the sample against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.sampling import local_rows, smallest_hashes
from gritstone.session import cut

SAMPLE = 16_384
SAMPLE_QUERIES = 256
MAX_LISTS = 4_096
RECALL = 0.985
#: Column blocks of the scan and the test's strictness (epsilon of the published method).
BLOCK = 16
EPSILON = 2.1
#: Vectors and queries that meet in one task, about.
TASK_VECTORS = 8_192
TASK_QUERIES = 4_096


@dataclass
class Index:
    """rotation (D x D), centroids (rotated), probes (lists of a query), groups (task group of each list), chunks of each group."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    groups: np.ndarray
    chunks: np.ndarray

    def turn(self, raw: np.ndarray) -> np.ndarray:
        near = scaled(raw)
        unit = near / np.linalg.norm(near, axis=1, keepdims=True)
        return (unit @ self.rotation).astype(np.float32)

    def nearest(self, turned: np.ndarray) -> np.ndarray:
        """List of each vector."""
        return np.concatenate([(turned[a : a + 1024] @ self.centroids.T).argmax(axis=1) for a in range(0, len(turned), 1024)]) if len(turned) else np.empty(0, np.int64)

    def probed(self, turned: np.ndarray) -> np.ndarray:
        """Whether each query probes each list."""
        out = np.zeros((len(turned), len(self.centroids)), bool)
        for a in range(0, len(turned), 1024):
            near = np.argpartition(-(turned[a : a + 1024] @ self.centroids.T), self.probes - 1, axis=1)[:, : self.probes]
            np.put_along_axis(out[a : a + 1024], near, True, axis=1)
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec double[]) of the rows that take part: no null, zero, NaN or infinite vectors."""
    vec = F.col(vec_col).cast("array<double>")
    sound = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))


def _kmeans(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 1024] @ centroids.T).argmax(axis=1) for a in range(0, len(x), 1024)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids).astype(np.float32)
    return centroids


def fit(rows: DataFrame, k: int, seed: int = 11) -> Index | None:
    """The index over usable rows of one length: at most SAMPLE of them, those with the smallest hashes of the id, are
    read on the driver; None without rows."""
    count = rows.count()
    limits = local_rows(rows.sparkSession, [(0, count, SAMPLE)], "grp int, n long, most int")
    chosen = smallest_hashes(rows.select(F.col("vec_id").alias("id"), F.lit(0).alias("grp")), limits).select(F.col("id").alias("vec_id"))
    got = rows.join(F.broadcast(chosen), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id").toPandas()
    if not len(got):
        return None
    raw = np.stack(got["vec"].to_numpy()).astype(np.float64)
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((raw.shape[1], raw.shape[1])))
    lists = int(min(MAX_LISTS, len(raw), max(1, round(count**0.5))))
    index = Index(rotation, np.empty((0, 0), np.float32), 1, np.empty(0), np.empty(0))
    x = index.turn(raw)
    index.centroids = _kmeans(x, lists, rng)
    own = index.nearest(x)
    asked = x[:SAMPLE_QUERIES]
    cosine = asked @ x.T
    cosine[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-cosine, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-(asked @ index.centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
    needed = np.sort(place[np.arange(len(asked))[:, None], own[near]].ravel()) if near.size else np.zeros(1, int)
    index.probes = int(min(lists, needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)] + 1))
    # Lists share a task group until it holds about TASK_VECTORS rows; a larger list is dealt into chunks.
    size = np.bincount(own, minlength=lists) * (count / len(x))
    groups, chunks, held = np.zeros(lists, np.int32), [], 0.0
    for i in np.argsort(index.centroids[:, 0], kind="stable"):
        if not chunks or held + size[i] > TASK_VECTORS:
            chunks.append(1)
            held = 0.0
        held += size[i]
        chunks[-1] = max(1, int(np.ceil(held / TASK_VECTORS)))
        groups[i] = len(chunks) - 1
    index.groups, index.chunks = groups, np.array(chunks, np.int32)
    return index


class Columns:
    """Rotated vectors in blocks of BLOCK columns, each block contiguous, with the block's squared length of each vector."""

    def __init__(self, turned: np.ndarray):
        self.size = turned.shape[1]
        self.ends = [*range(BLOCK, self.size, BLOCK), self.size]
        self.blocks = [np.ascontiguousarray(turned[:, a:d]) for a, d in zip([0, *self.ends[:-1]], self.ends, strict=True)]
        self.squares = [np.einsum("ij,ij->i", b, b) for b in self.blocks]


def scan(query: np.ndarray, held: Columns, lists: list[tuple[int, int]], k: int) -> np.ndarray:
    """Positions of the candidates that survive, of lists (begin, end) from the nearest on.

    Distances grow block by block; once k distances are known whole, a
    candidate is dropped when its partial distance fails the test against the
    k-th of them, which is renewed after every list.
    """
    parts = [query[d - b.shape[1] : d] for d, b in zip(held.ends, held.blocks, strict=True)]
    lengths = [float(q @ q) for q in parts]
    places: list[np.ndarray] = []
    distances: list[np.ndarray] = []
    best, bound = np.empty(0, np.float32), np.inf
    for begin, stop in lists:
        kept = np.arange(begin, stop)
        partial = np.zeros(stop - begin, np.float32)
        for d, block, square, part, length in zip(held.ends, held.blocks, held.squares, parts, lengths, strict=True):
            whole = len(kept) == stop - begin
            rows, norm = (block[begin:stop], square[begin:stop]) if whole else (block[kept], square[kept])
            partial = partial + (norm + length - 2 * (rows @ part))
            if np.isfinite(bound):
                limit = bound if d == held.size else bound * (d / held.size) * (1 + EPSILON / np.sqrt(d)) ** 2
                alive = partial <= limit + 1e-5
                if not alive.all():
                    kept, partial = kept[alive], partial[alive]
            if not len(kept):
                break
        if len(kept):
            places.append(kept)
            distances.append(partial)
            best = np.concatenate([best, partial])
            if len(best) > k:
                best = np.partition(best, k - 1)[:k]
            if len(best) >= k:
                bound = float(best.max())
    if not places:
        return np.empty(0, np.int64)
    at = np.concatenate(places)
    return at[np.concatenate(distances) <= bound + 1e-5]


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: no product over- or underflows, nothing is rounded."""
    _, exponent = np.frexp(np.abs(raw).max(axis=-1, keepdims=True))
    return np.ldexp(raw, -exponent)


def cosine(query: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Double precision, each row by itself, so that equal vectors score equally."""
    query, many = scaled(query), scaled(many)
    dots = (many * query).sum(axis=1)
    return dots / (np.sqrt((many * many).sum(axis=1)) * np.sqrt((query * query).sum()))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of vectors found, other than the row with its own id.

    Fewer come where there are fewer candidates.  Ties go to the smaller
    vec_id.  Null and zero vectors, and those that hold a null or a component
    that is not finite, take no part on either side, nor do rows with a null id.
    Vectors are searched among those of their own length, each length with an
    index of its own.  An empty table gives an empty result.  Equal vectors are
    searched once: of a vector's rows only the k + 1 smallest ids can be among
    anyone's k nearest.  Equal rows are one.  Of a repeated id each different
    vector is a candidate; as a query the id is answered once, by all its vectors
    together, which take one of its places each but for the first.  Other columns
    are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    lengths = sorted(r["d"] for r in rows.select(F.size("vec").alias("d")).distinct().collect())
    found = [_search(rows.where(F.size("vec") == d), asked.where(F.size("vec") == d), k, seed) for d in lengths]
    if not found:
        return local_rows(spark, [], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: DataFrame, k: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest found, and some more, of usable vectors of one length."""
    spark = rows.sparkSession
    index = fit(rows, k, seed)
    shared = spark.sparkContext.broadcast(index)
    most = k + 1

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                raw = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                own = shared.value.nearest(shared.value.turn(raw))
                group = shared.value.groups[own]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "list": own.astype(np.int32), "grp": group, "parts": shared.value.chunks[group], "raw": [r.tobytes() for r in raw]})

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                raw = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                turned = shared.value.turn(raw)
                probed = shared.value.probed(turned)
                into = np.zeros((len(raw), len(shared.value.chunks)), bool)
                for g in range(into.shape[1]):
                    into[:, g] = probed[:, shared.value.groups == g].any(axis=1)
                home = shared.value.groups[shared.value.nearest(turned)]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "home": home, "groups": [np.flatnonzero(x).astype(np.int32) for x in into], "raw": [r.tobytes() for r in raw]})

    stored = rows.mapInPandas(placed, "vec_id long, list int, grp int, parts int, raw binary")
    same = Window.partitionBy(F.md5("raw"), "raw").orderBy("vec_id")
    again = F.lag("vec_id").over(same).eqNullSafe(F.col("vec_id"))
    stored = stored.withColumn("copy", F.dense_rank().over(same)).withColumn("again", again).where((F.col("copy") <= most) & ~F.col("again"))
    turned = cut(asked.mapInPandas(routed, "vec_id long, home int, groups array<int>, raw binary").withColumn("qkey", F.md5("raw")))
    members = turned.select("qkey", F.col("vec_id").alias("query_id")).distinct()
    single = turned.groupBy("qkey").agg(F.min("home").alias("home"), F.min("groups").alias("groups"), F.min("raw").alias("raw"))
    # Queries that are near one another share a block, so a block probes few groups and candidates go to few blocks.
    blocks, held = [], TASK_QUERIES
    for r in sorted(single.groupBy("home").count().collect()):
        parts = -(-r["count"] // TASK_QUERIES)
        if parts > 1 or held + r["count"] > TASK_QUERIES:
            first = blocks[-1][1] + blocks[-1][2] if blocks else 0
            held = TASK_QUERIES if parts > 1 else 0
        held += r["count"] if parts == 1 else 0
        blocks.append((r["home"], first, parts))
    homes = local_rows(spark, blocks, "home int, first int, split int")
    chunk_table = F.array(*[F.lit(int(c)) for c in index.chunks])
    right = single.join(F.broadcast(homes), "home").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("qkey"), "split")).cast("int")).withColumn("grp", F.explode("groups"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.element_at(chunk_table, F.col("grp") + 1) - 1))).select("grp", "chunk", "block", "qkey", "raw")
    meetings = right.select(F.col("grp").alias("g"), F.col("block").alias("b")).distinct()
    left = stored.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).join(meetings, F.col("grp") == F.col("g"))
    left = left.select(F.col("g").alias("grp"), "chunk", F.col("b").alias("block"), "list", "vec_id", "raw")

    def meet(candidates: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(questions):
            index = shared.value
            candidates = candidates.sort_values(["list", "vec_id"], kind="stable")
            ids, lists = candidates["vec_id"].to_numpy(), candidates["list"].to_numpy()
            raw = np.frombuffer(b"".join(candidates["raw"]), np.float64).reshape(len(candidates), -1)
            asked = np.frombuffer(b"".join(questions["raw"]), np.float64).reshape(len(questions), -1)
            turned, wanted = index.turn(raw), index.turn(asked)
            present = np.unique(lists)
            begin, stop = np.searchsorted(lists, present), np.searchsorted(lists, present, side="right")
            probed = index.probed(wanted)[:, present]
            closeness = wanted @ index.centroids[present].T
            columns = Columns(turned)
            for i, key in enumerate(questions["qkey"]):
                here = np.flatnonzero(probed[i])
                here = here[np.argsort(-closeness[i, here], kind="stable")]
                at = scan(wanted[i], columns, [(begin[j], stop[j]) for j in here], most)
                exact = cosine(asked[i], raw[at])
                for j in np.lexsort((ids[at], -exact))[:most]:
                    found.append((key, int(ids[at[j]]), float(exact[j])))
        return pd.DataFrame(found, columns=["qkey", "vec_id", "score"])

    keys = ["grp", "chunk", "block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "qkey string, vec_id long, score double")
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
    return members.join(top, "qkey").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
