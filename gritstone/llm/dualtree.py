"""Centroid clustering: Lloyd's rounds over a cover tree of the vectors and one of the centroids.

Each task keeps its vectors in blocks, every block with its own cover tree, built
once.  A round walks both trees together: a pair of nodes is dropped when no
vector of the one can be nearest to a centroid of the other; a node that is left
with one centroid goes to it whole, and only leaves that are left with several
are compared vector by vector, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.sampling import local_rows
from gritstone.session import cut, scratch_path

#: Vectors of a block, and of a leaf at most (but for equal vectors).
BLOCK, LEAF = 2048, 16
#: Components are held within this, so that a squared distance of 64 components is a long.
LARGEST = 1 << 27
#: Below this, sums of squares are whole in double precision.
EXACT = 1 << 20


@dataclass(frozen=True)
class Tree:
    """Nodes breadth first.  span: the node's places in order; kids: its children (empty for a leaf); centre: a row; radius: no member is farther from it."""

    order: np.ndarray
    span: np.ndarray
    kids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def _distance(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree of points (double): the children of a node of scale s cover its members within s / 2 and lie more than s / 2 apart."""
    order = np.arange(len(points))
    away = _distance(points, points[0])
    nodes = [[0, len(points), 0, 0, 0, float(away.max())]]
    todo = [(0, away)]
    for at, away in todo:
        start, stop, _, _, centre, radius = nodes[at]
        if stop - start <= leaf or radius == 0:
            continue
        half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
        half = half if half < radius else half / 2
        rest, seen, first = order[start:stop].copy(), start, len(nodes)
        near = away <= half
        while len(rest):
            mine, gaps = rest[near], away[near]
            order[seen : seen + len(mine)] = mine
            nodes.append([seen, seen + len(mine), 0, 0, centre, float(gaps.max())])
            todo.append((len(nodes) - 1, gaps))
            seen, rest = seen + len(mine), rest[~near]
            if len(rest):
                centre = rest[0]
                away = _distance(points[rest], points[centre])
                near = away <= half
        nodes[at][2:4] = first, len(nodes)
    flat = np.array([n[:5] for n in nodes], np.int32)
    return Tree(order, flat[:, :2], flat[:, 2:4], flat[:, 4], np.array([n[5] for n in nodes]) * (1 + 1e-12))


def levels(tree: Tree) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The tree from its root to its single points, as (rows, radii, place of the parent in the level above); nodes without children stay to the end."""
    front, out = np.array([0]), [(tree.centre[:1], tree.radius[:1], np.array([0]))]
    while (tree.kids[front, 1] > 0).any():
        sizes = np.maximum(tree.kids[front, 1] - tree.kids[front, 0], 1)
        parent = np.repeat(np.arange(len(front)), sizes)
        nth = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        front = np.where(tree.kids[front[parent], 1] > 0, tree.kids[front[parent], 0] + nth, front[parent])
        out.append((tree.centre[front], tree.radius[front], parent))
    sizes = tree.span[front, 1] - tree.span[front, 0]
    rows = np.concatenate([tree.order[a:b] for a, b in tree.span[front]])
    back = np.argsort(rows)
    out.append((rows[back], np.zeros(len(rows)), np.repeat(np.arange(len(front)), sizes)[back]))
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows, a by b."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1)


def assign(vectors: np.ndarray, tree: Tree, centroids: np.ndarray, steps: list) -> tuple[np.ndarray, int]:
    """(nearest centroid of each vector, number of vector-centroid pairs compared one by one).

    vectors lie in the tree's order.  Bounds give way by more than rounding can
    shift them, so equally near centroids are both kept; of those the smaller
    number wins, as leaves are compared in whole numbers.
    """
    found, points, means = np.empty(len(vectors), np.int32), vectors.astype(np.float64), centroids.astype(np.float64)
    place = np.empty(len(vectors), np.int64)
    place[tree.order] = np.arange(len(vectors))
    centre, leaf = place[tree.centre], tree.kids[:, 1] == 0
    own, other = (points**2).sum(1), (means**2).sum(1)
    front, depth, open_leaves, compared = np.array([0]), 0, {}, 0
    mask = np.ones((1, 1), bool)
    while len(front):
        rows, radii, _ = steps[depth]
        size = own[centre[front]][:, None] + other[rows][None]
        gap = np.sqrt(np.maximum(size - 2 * points[centre[front]] @ means[rows].T, 0))
        reach = tree.radius[front][:, None] + radii[None]
        give = 1e-6 * np.sqrt(size) + 1e-6
        nearest = np.where(mask, gap + reach + give, np.inf).min(1)
        mask = mask & (gap - reach - give <= nearest[:, None])
        if depth < len(steps) - 1:
            depth += 1
            mask = mask[:, steps[depth][2]]
            stay = leaf[front]
        else:
            single = mask.sum(1) == 1
            for (a, b), c in zip(tree.span[front[single]], mask[single].argmax(1), strict=True):
                found[a:b] = c
            for node, row in zip(front[leaf[front] & ~single], mask[leaf[front] & ~single], strict=True):
                open_leaves.setdefault(row.tobytes(), (np.flatnonzero(row), []))[1].append(node)
            keep = ~single & ~leaf[front]
            front, mask = front[keep], mask[keep]
            stay = np.zeros(len(front), bool)
        sizes = np.where(stay, 1, tree.kids[front, 1] - tree.kids[front, 0])
        parent = np.repeat(np.arange(len(front)), sizes)
        nth = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        front, mask = np.where(stay[parent], front[parent], tree.kids[front[parent], 0] + nth), mask[parent]
    for among, nodes in open_leaves.values():
        # Equal vectors are compared once.
        spans = [(a, a + 1 if tree.radius[n] == 0 else b) for n, (a, b) in zip(nodes, tree.span[nodes], strict=True)]
        rows = np.concatenate([np.arange(a, b) for a, b in spans])
        best = among[squared(vectors[rows], centroids[among]).argmin(1)]
        compared += len(rows) * len(among)
        at = 0
        for node, (a, b) in zip(nodes, spans, strict=True):
            found[slice(*tree.span[node])] = best[at : at + b - a]
            at += b - a
    return found, compared


def kept(vectors: DataFrame, dims: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector has exactly dims components, none null, NaN or infinite."""
    v = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.where((F.size(v) == dims) & F.forall(v, fine)).select(F.col(id_column).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


_BLOCKS = "ids array<long>, vectors binary, tree binary, radius binary"


def blocks(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """Blocks of up to BLOCK whole-number vectors in the order of their cover tree, kept in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
            tree = cover_tree(v.astype(np.float64))
            nodes = np.column_stack([tree.span, tree.kids, np.argsort(tree.order)[tree.centre]]).astype(np.int32)
            columns = [pa.array([ids.take(pa.array(tree.order)).to_pylist()], pa.list_(pa.int64())), pa.array([v[tree.order].tobytes()]), pa.array([nodes.tobytes()]), pa.array([tree.radius.tobytes()])]
            return pa.record_batch(columns, names=["ids", "vectors", "tree", "radius"])

        ids, held, n = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                v = np.asarray(part["v"].flatten()).reshape(-1, dims)
                ids.append(part["vec_id"])
                held.append(np.clip(np.floor(v * scale), -LARGEST, LARGEST).astype(np.int32))
                n += part.num_rows
                if n >= BLOCK:
                    all_ids, all_v = pa.concat_arrays(ids), np.concatenate(held)
                    yield packed(all_ids[:BLOCK], all_v[:BLOCK])
                    ids, held, n = [all_ids[BLOCK:]], [all_v[BLOCK:]], n - BLOCK
        if n:
            yield packed(pa.concat_arrays(ids), np.concatenate(held))

    return cut(rows.mapInArrow(build, _BLOCKS))


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for i in range(batch.num_rows):
        vectors = np.frombuffer(batch["vectors"][i].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
        nodes = np.frombuffer(batch["tree"][i].as_buffer(), np.int32).reshape(-1, 5)
        tree = Tree(np.arange(len(vectors)), nodes[:, :2], nodes[:, 2:4], nodes[:, 4], np.frombuffer(batch["radius"][i].as_buffer(), np.float64))
        yield batch["ids"][i].values, vectors, tree


def _steps(centroids: np.ndarray) -> list:
    return levels(cover_tree(centroids.astype(np.float64), leaf=1))


_SUMS = "cluster int, n long, sums array<long>, compared long, pairs long"


def round_sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, s0, s1, ..., compared, pairs): what one round's assignment sums up to; a row for each cluster of each task is shuffled."""
    k, dims = centroids.shape
    steps = _steps(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, compared, pairs = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0, 0
        for batch in batches:
            for _, vectors, tree in _opened(batch, dims):
                found, n = assign(vectors, tree, centroids, steps)
                compared, pairs = compared + n, pairs + len(vectors) * k
                order = np.argsort(found, kind="stable")
                first = np.flatnonzero(np.diff(found[order], prepend=-1))
                sums[found[order][first]] += np.add.reduceat(vectors[order], first, axis=0)
                counts += np.bincount(found, minlength=k)
        some = np.flatnonzero(counts)
        once = np.arange(len(some)) == 0
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array(once * compared), pa.array(once * pairs)], names=["cluster", "n", "sums", "compared", "pairs"])

    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return trees.mapInArrow(partial, _SUMS).groupBy("cluster").agg(F.sum("n").alias("n"), *total, F.sum("compared").alias("compared"), F.sum("pairs").alias("pairs"))


def start(rows: DataFrame, k: int, salt: str, scale: int) -> np.ndarray:
    """The k rows with the smallest sha256 of salt:id, in that order (ties by their components); rows without an id are none of them."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(hashed.alias("at"), "v").orderBy("at", "v").limit(k).collect()
    return np.clip(np.floor(np.array([r.v for r in first]) * scale), -LARGEST, LARGEST).astype(np.int64)


def _label(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2", report: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector after the rounds.

    Vectors that are null, of another length, or hold null or non-finite
    components are left out.  Null and repeated ids stay, row by row; only rows
    with an id are starts, as many as there are if fewer than k.  Equally near
    centroids: the smaller number.  An empty cluster keeps its centroid.  Components
    beyond LARGEST in whole numbers count as LARGEST.  No vectors, or none with an
    id, give none.  Other columns, whatever their names, take no part.  report gets
    (pairs compared, pairs in all) of each round.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, dims)
    centroids = start(rows, k, salt, scale)
    names = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], names + ", cluster_inertia long, inertia long, centroid_sha256 string")
    trees = blocks(rows, dims, scale)
    for _ in range(rounds):
        sums = round_sums(trees, centroids).collect()
        for r in sums:
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
        if report is not None:
            report.append((sum(r.compared for r in sums), sum(r.pairs for r in sums)))
    steps = _steps(centroids)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, tree in _opened(batch, dims):
                found, _ = assign(v, tree, centroids, steps)
                yield pa.record_batch([ids, pa.array(found), pa.array(((v - centroids[found]) ** 2).sum(1))], names=["vec_id", "cluster", "distance"])

    path = scratch_path(spark, "clusters")
    trees.mapInArrow(final, names).write.parquet(path)
    placed = spark.read.parquet(path)
    inertia = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole, labels = sum(inertia.values()), _label(centroids)
    clusters = local_rows(spark, [(c, d, whole, labels[c]) for c, d in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
