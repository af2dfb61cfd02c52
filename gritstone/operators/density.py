"""Exact density clustering by pivots: cells that can't be near never meet, vectors whose answer is known go nowhere, and no list of pairs is kept.

Vectors are dealt to the nearest of some pivots, a cell each.  In the angle
between vectors the triangle inequality holds, so two cells meet only if their
pivots are no further apart than both radii and the angle of eps.  Cells with the
same near cells are one zone, which is dealt into blocks.  Within its block every
vector is counted against all others; only one with too few neighbours there
visits near blocks, first a few, then the rest, until it has enough.  Core points
of a block that hang together are a part.  A sample of the core points visits all
near blocks and links most parts; then whoever is outside the largest group of
parts visits them, since a link that is still unknown has an end there.  So a
vector travels once or twice where most of them have neighbours in their block
and hang together; vectors that are all sparse or in many groups, with a radius
as wide as the data, still visit all blocks, which is quadratic.  What leaves a
task is a count for each vector, a name for each core point, and one row for each
linked pair of groups; edges don't grow with the square of a cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.operators.graph import connected_components
from gritstone.session import cut

#: Vectors of a cell that the number of pivots aims at, of a block at most about, and pivots at most (so 8 MB of them for 1,024 components).
CELL_ROWS, BLOCK_ROWS, PIVOTS = 1_024, 8_192, 1_024
#: Components of a block's vectors at most about, near blocks up to which a vector goes at first (its own is one), and core points of the sample about.
BLOCK_VALUES, FIRST_BLOCKS, SAMPLE_ROWS = 1 << 22, 8, 4_096


def _unit(v) -> np.ndarray:
    return _scaled(np.stack(v.to_numpy()).astype(float) if len(v) else np.empty((0, 1)))


def _scaled(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _rows(t: pa.Table) -> np.ndarray:
    """The vectors of a table as rows of unit length."""
    flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _scaled(flat.astype(float).reshape(len(t), -1))


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    return 1.0 - x @ y.T <= eps + 1e-12


def parts_of(x: np.ndarray, eps: float) -> np.ndarray:
    """For each vector the first one of its part: vectors within eps hang together.  Matrices of 512 rows are held at once."""
    name = np.arange(len(x))
    while True:
        before = name.copy()
        for at in range(0, len(x), 512):
            least = np.where(near(x[at : at + 512], x, eps), name[None], len(x)).min(1)
            np.minimum.at(name, name[at : at + 512], least)
            name[at : at + 512] = np.minimum(name[at : at + 512], least)
        while (name[name] != name).any():
            name = name[name]
        if (name == before).all():
            return name


def weighed(x: np.ndarray, y: np.ndarray, w: np.ndarray, eps: float) -> np.ndarray:
    """For each of x the weights w of those of y within eps."""
    heavy = np.flatnonzero(w > 1)
    found = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 512):
        close = near(x[at : at + 512], y, eps)
        found[at : at + 512] = np.count_nonzero(close, axis=1) + close[:, heavy] @ (w[heavy] - 1)
    return found


@dataclass
class Cells:
    """points (id, v, w, zone, block), and which blocks a zone's rows may visit: (zone, others) with others all its near blocks, at most ``most``."""

    points: DataFrame
    partners: DataFrame
    block_rows: int
    most: int
    report: list | None
    met: int = 0

    def visit(self, rows: DataFrame, residents: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, first: int = 0, last: int | None = None) -> DataFrame | None:
        """work(visitors, residents) of each block that rows (id, zone, block and more) visit, or None if none is visited.

        A row visits its near blocks number first to last - 1, counted on from its own
        one, which is number 0.  Visitors of a block are dealt into groups of about a
        block's rows, and residents are sent once for each group.
        """
        at = F.array_position("others", F.col("block"))
        turned = F.concat(F.slice("others", at, F.size("others")), F.slice("others", F.lit(1), at - 1))
        sent = rows.join(F.broadcast(self.partners), "zone").withColumn("to", F.explode(F.slice(turned, first + 1, (last or self.most) - first))).drop("others")
        load = cut(sent.groupBy("to").agg(F.count("*").alias("visitors")))
        if load.isEmpty():
            return None
        if self.report is not None:
            here = residents.groupBy(F.col("block").alias("to")).agg(F.count("*").alias("n"))
            self.met += load.join(here, "to").agg(F.sum(F.col("visitors") * F.col("n"))).first()[0] or 0
        groups = F.broadcast(load.select("to", F.ceil(F.col("visitors") / self.block_rows).cast("int").alias("groups")))
        one = sent.join(groups, "to").withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), "groups").cast("int")).drop("groups")
        # Columns under new ids: both sides may come from one table.
        two = residents.select(*[F.col(c).alias("to" if c == "block" else c) for c in residents.columns])
        two = two.join(groups, "to").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        return one.groupBy("to", "group").cogroup(two.groupBy("to", "group")).applyInArrow(work, schema)

    def tell(self) -> None:
        """report gets the pairs that met so far, within blocks once, and all pairs."""
        if self.report is not None:
            sizes = self.points.groupBy("block").agg(F.count("*").alias("n"))
            home, n = sizes.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
            self.report.append((self.met + home, n * n))


def cells(points: DataFrame, eps: float, report: list | None = None) -> Cells:
    """points(id, v, w) dealt to pivots: the rows with the smallest hashes of their id."""
    spark = points.sparkSession
    n = points.count()
    first = points.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, -(-n // CELL_ROWS)))).select("v").collect()
    pivots = _unit(pd.Series([np.array(r.v) for r in first]))

    @F.pandas_udf("cell int, angle double")
    def place(v: pd.Series) -> pd.DataFrame:
        angle = _angle(_unit(v), pivots)
        cell = angle.argmin(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle[np.arange(len(cell)), cell]})

    placed = cut(points.withColumn("p", place("v")).select("id", "v", "w", "p.cell", "p.angle"))
    stats = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    known = sorted(stats)
    sizes, radius = np.array([stats[c][0] for c in known]), np.array([stats[c][1] for c in known])
    reach = radius[:, None] + radius[None] + np.arccos(1 - eps) + 1e-6
    close = _angle(pivots[known], pivots[known]) <= reach
    sides, zone = np.unique(close | close.T, axis=0, return_inverse=True)
    zone = zone.reshape(-1)
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // pivots.shape[1]))
    blocks = -(-np.bincount(zone, weights=sizes).astype(int) // block_rows)
    base = np.cumsum(blocks) - blocks
    others = [[int(x) for z in np.unique(zone[side]) for x in range(base[z], base[z] + blocks[z])] for side in sides]
    partners = spark.createDataFrame(pd.DataFrame({"zone": np.arange(len(sides), dtype=np.int32), "others": others}), "zone int, others array<int>")
    zones = spark.createDataFrame(pd.DataFrame({"cell": np.array(known, np.int32), "zone": zone.astype(np.int32), "base": base[zone].astype(np.int32), "blocks": blocks[zone].astype(np.int32)}), "cell int, zone int, base int, blocks int")
    placed = placed.join(F.broadcast(zones), "cell")
    placed = placed.select("id", "v", "w", "zone", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("block"))
    return Cells(placed, partners, block_rows, max(map(len, others)), report)


def clusters(rows: DataFrame, eps: float, min_samples: int, key: str = "id", column: str = "embedding", report: list | None = None) -> DataFrame:
    """match.dbscan for eps below 1.  report gets (pairs of vectors that met to be counted or linked, all pairs)."""
    from gritstone.operators.match import small

    # Single precision travels as such; all is worked out in double.
    kind = "array<float>" if dict(rows.dtypes)[column] == "array<float>" else "array<double>"
    given = rows.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).cast(kind).alias("v"))
    length = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    given = cut(given.withColumn("digest", F.xxhash64("v")).withColumn("length", length))
    # A vector without direction is a neighbour of itself alone.
    bare = given.where("not (length > 0)").select("id", F.col("id").alias("cluster"))
    if min_samples > 1:
        bare = bare.limit(0)
    points = given.where("length > 0").groupBy("digest", "v").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    points = cut(points)
    if points.isEmpty():
        return bare
    made = cells(points.select("id", "v", "w"), eps, report)

    def home(t: pa.Table) -> pa.Table:
        x = _rows(t)
        return t.append_column("n", pa.array(weighed(x, x, t["w"].to_numpy(), eps)))

    counted = cut(made.points.groupBy("block").applyInArrow(home, f"id long, v {kind}, w long, zone int, block int, n long"))

    def count(one: pa.Table, two: pa.Table) -> pa.Table:
        if not len(one) or not len(two):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return pa.table({"id": one["id"], "n": pa.array(weighed(_rows(one), _rows(two), two["w"].to_numpy(), eps))})

    few = counted.where(F.col("n") < min_samples)
    for first, last in ((1, FIRST_BLOCKS), (FIRST_BLOCKS, made.most)):
        more = made.visit(few.select("id", "v", "zone", "block"), counted.select("block", "v", "w"), count, "id long, n long", first, last) if first < made.most else None
        if more is None:
            break
        more = small(cut(more.groupBy("id").agg(F.sum("n").alias("more"))))
        few = few.join(more, "id", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).drop("more")
        few = cut(few.where(F.col("n") < min_samples))
    # Who is no core point is known by now, and whether it has any neighbours.
    few = small(cut(few.select("id", (F.col("n") > F.col("w")).alias("beside"))))
    counted = counted.drop("n", "w").join(few, "id", "left")

    def name(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        core = np.flatnonzero(t["beside"].is_null().to_numpy())
        ids, part = t["id"].to_numpy(), np.zeros(len(t), np.int64)
        part[core] = ids[core][parts_of(_rows(t.take(core)), eps)] if len(core) else 0
        return t.append_column("part", pa.array(part, mask=~t["beside"].is_null().to_numpy()))

    marked = cut(counted.groupBy("block").applyInArrow(name, f"id long, v {kind}, zone int, block int, beside boolean, part long"))

    def link(one: pa.Table, two: pa.Table) -> pa.Table:
        """(src, dst, border): linked groups, and for a point that is no core (border) the groups beside it."""
        out = [pd.DataFrame({"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64), "border": np.empty(0, bool)})]
        if len(one) and len(two):
            x, y, group = _rows(one), _rows(two), two["label"].to_numpy()
            order = np.argsort(group, kind="stable")
            y, group = y[order], group[order]
            starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            border = one["label"].is_null().to_numpy()
            own = np.where(border, one["id"].to_numpy(), one["label"].fill_null(0).to_numpy())
            for at in range(0, len(x), 512):
                i, j = np.nonzero(np.maximum.reduceat(near(x[at : at + 512], y, eps), starts, axis=1))
                found = pd.DataFrame({"src": own[at + i], "dst": group[starts][j], "border": border[at + i]})
                out.append(found[(found["src"] != found["dst"]) | found["border"]].drop_duplicates())
        return pa.Table.from_pandas(pd.concat(out).drop_duplicates(), preserve_index=False)

    linked = "src long, dst long, border boolean"
    groups = cut(marked.where("part is not null").groupBy("part").agg(F.count("*").alias("n")).withColumn("label", F.col("part")))
    core = marked.where("part is not null").select("id", "v", "zone", "block", F.col("part").alias("label"))
    if made.most > 1:
        every = max(1, -(-points.count() // SAMPLE_ROWS))
        links = made.visit(core.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(every)) == 0), core.select("block", "v", "label"), link, linked, 1)
        if links is not None:
            named = connected_components(links.select("src", "dst"))
            groups = cut(groups.drop("label").join(named.select(F.col("node").alias("part"), "component"), "part", "left").select("part", "n", F.coalesce("component", "part").alias("label")))
    largest = groups.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").first()
    if largest is None:
        made.tell()
        return bare
    labelled = marked.join(small(groups.select("part", "label")), "part", "left").select("id", "v", "zone", "block", "beside", "label")
    outside = labelled.where((F.col("label") != largest["label"]) | F.col("beside")).drop("beside")
    links = made.visit(outside, labelled.where("label is not null").select("block", "v", "label"), link, linked)
    links = cut(links.distinct() if links is not None else rows.sparkSession.createDataFrame([], linked))
    made.tell()
    named = connected_components(links.where("not border").select("src", "dst")).select(F.col("node").alias("label"), "component")
    cluster = F.coalesce("component", "label").alias("cluster")
    whole = marked.join(small(cut(groups.join(named, "label", "left").select("part", cluster))), "part").select("id", "cluster")
    beside = links.where("border").select(F.col("src").alias("id"), F.col("dst").alias("label"))
    border = beside.join(named, "label", "left").select("id", cluster).groupBy("id").agg(F.min("cluster").alias("cluster"))
    of_point = whole.unionByName(border)
    copies = given.where("length > 0").select(F.col("id").alias("given"), "digest", "v").join(small(points.where("w > 1").select("id", "digest", "v")), ["digest", "v"]).select("id", "given")
    return of_point.join(copies, "id", "left").select(F.coalesce("given", "id").alias("id"), "cluster").unionByName(bare)
