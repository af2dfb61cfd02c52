"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts are a group and stay together.  Every group enters the packing by
its own size: groups of equal size are a class, and classes from the largest
size down enter the bin with the tightest remaining capacity that holds them,
found in a balanced search tree (a treap keyed by remaining capacity).  Best fit
puts one group after another of a class into the same bin until it has no room
for a further one, so a class is placed by a few steps however many groups it
has, and the driver holds two numbers a class.  The different sizes of groups of
b bytes in all are at most the square root of 2 b: 15 million for 100 TB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.kernels import splitmix
from gritstone.llm.sampling import local_rows
from gritstone.session import cut

#: Groups from this part of all rows or bytes on are broadcast with their shard, at most 2 / PART of them.
PART = 1 / 4_096
#: Placed runs of classes that are broadcast; more are joined by shuffle.
BROADCAST_RUNS = 1 << 18
#: Rows that share a bucket when slots are numbered, about.
BUCKET_ROWS = 8_192


@dataclass
class _Node:
    key: tuple[int, int]
    priority: int
    left: _Node | None = None
    right: _Node | None = None


class Bins:
    """Bins by remaining capacity in a treap: insert, remove and successor in logarithmic time."""

    def __init__(self) -> None:
        self.top: _Node | None = None
        self.drawn = 0

    def add(self, room: int, bin_: int) -> None:
        self.drawn += 1
        low, high = self._split(self.top, (room, bin_))
        self.top = self._merge(self._merge(low, _Node((room, bin_), int(splitmix(self.drawn, 1)[0]))), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the tightest bin with room for size."""
        at, best = self.top, None
        while at:
            if at.key[0] >= size:
                best, at = at.key, at.left
            else:
                at = at.right
        if best:
            self._drop(best)
        return best

    def take_roomiest(self) -> tuple[int, int] | None:
        at = self.top
        while at and at.right:
            at = at.right
        if at:
            self._drop(at.key)
            return at.key
        return None

    def _drop(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.top, key)
        _, high = self._split(high, (key[0], key[1] + 1))
        self.top = self._merge(low, high)

    def _split(self, t: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        """(keys below key, the others)."""
        if t is None:
            return None, None
        if t.key < key:
            t.right, rest = self._split(t.right, key)
            return t, rest
        rest, t.left = self._split(t.left, key)
        return rest, t

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, shards: int | None = None) -> list[tuple[int, int, int]]:
    """(size, groups, bin) of each run of a class, from classes (size, groups).

    With shards, no more bins than that are opened: what fits none enters the
    roomiest, group by group.
    """
    bins, runs, opened = Bins(), [], 0
    for size, left in sorted(classes, reverse=True):
        while left:
            found = bins.take(size)
            if found is None and (shards is None or opened < shards):
                found, opened = (capacity, opened), opened + 1
            elif found is None:
                found = bins.take_roomiest()
            # The bin stays the tightest one while it holds another group of this size.
            count = max(1, min(left, found[0] // size)) if size else left
            runs.append((size, count, found[1]))
            bins.add(found[0] - count * size, found[1])
            left -= count
    return runs


def balanced(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best fit at the smallest fixed capacity found for which shards bins hold everything: the least possible one is
    tried first, then wider steps above it, then the last step is halved."""
    total, largest = sum(s * n for s, n in classes), max((s for s, _ in classes), default=0)
    least = max(-(-total // shards), largest, 1)
    fits = lambda c: max((b for _, _, b in best_fit_decreasing(classes, c)), default=0) < shards
    low, high, step = least, least, 1
    while not fits(high):
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return best_fit_decreasing(classes, high, shards)


def _numbered(rows: DataFrame, key: str, order: list[str], count: int, name: str) -> DataFrame:
    """rows with a gapless number from 0 within each key: within buckets of a hash of order, after all of the key's earlier buckets."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(max(1, count // BUCKET_ROWS))))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(key, "bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(key, "bucket").orderBy(*order)
    out = placed.withColumn("at", F.row_number().over(within) - 1).join(starts, [key, "bucket"])
    return out.withColumn(name, (F.col("start") + F.col("at")).cast("long")).drop("bucket", "at", "start")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs.

    size is the text's UTF-8 bytes plus 1 (null: 1); nulls are one group, as
    empty texts are.  The law is `bytes`: shards are of near equal size, as far as
    groups that must stay together allow.  Groups of equal size are told apart by
    their digests.  slot counts a shard's rows from 0 without gaps.  grown_shard
    is null under this law.  Texts of any length are read by Spark alone.
    Repeated and null ids, and equal rows, keep their rows; an empty table gives
    an empty result.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    body = F.coalesce(text, F.lit(""))
    group = F.when(text.isNull(), F.lit(b"-")).otherwise(F.unhex(F.md5(body)))
    sized = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), group.alias("grp")))
    rows, total = sized.agg(F.count("*"), F.sum("size")).first()
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    if not rows:
        return sized.select(F.col("id").alias(id_col), "size", "text_crc32", law, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), grown)
    groups = cut(sized.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    classes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toPandas()
    ends: dict[int, int] = {}
    runs = []
    for size, count, bin_ in balanced(list(zip(classes["bytes"].tolist(), classes["n"].tolist(), strict=True)), shards):
        low = ends.get(size, 0)
        ends[size] = low + count
        runs.append((size, low, low + count, bin_))
    bounds = local_rows(spark, runs, "bytes long, low long, high long, shard int")
    bounds = F.broadcast(bounds) if len(runs) <= BROADCAST_RUNS else bounds
    numbered = _numbered(groups, "bytes", ["grp"], int(classes["n"].sum()), "place")
    placed = cut(numbered.join(bounds, "bytes").where("place >= low and place < high").select("grp", "bytes", "rows", "shard"))
    # A group with many of the rows or bytes would make one task of the join.
    hot = (F.col("rows") >= rows * PART) | (F.col("bytes") >= total * PART)
    few, many = placed.where(hot).select("grp", F.col("shard").alias("own")), placed.where(~hot).select("grp", "shard")
    marked = sized.join(F.broadcast(few), "grp", "left")
    cold = marked.where("own is null").drop("own").join(many, "grp")
    out = cold.unionByName(marked.where("own is not null").withColumnRenamed("own", "shard").select(*cold.columns))
    out = _numbered(out, "shard", ["id", "grp"], rows, "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", law, "shard", "slot", grown)
