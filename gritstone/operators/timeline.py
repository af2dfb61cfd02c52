"""Sequences in time: bursts, events, numbering, chains, gaps, nearest partners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.session import cut

#: Rows of one key that a window's task may hold; beyond, ranges of a key are scanned side by side.
HOT_ROWS = 1_000_000


def _hot(rows: DataFrame, by: list[str]) -> bool:
    """Whether some key has more than HOT_ROWS rows: a combined count."""
    return not rows.groupBy(*by).count().where(F.col("count") > HOT_ROWS).isEmpty()


def ranges(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """rows with _part, kept in the shared folder: ranges of (by, order), so a key with most rows is many of them, in order."""
    return cut(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))


def _carried(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of totals (_part, by, ...), of which there is one row for each key in each range."""
    same = F.col("r._part") == F.col("t._part")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    extra = [F.col(f"t.{c}") for c in totals.columns if c not in ("_part", *by)]
    return rows.alias("r").join(totals.alias("t"), same).select("r.*", *extra)


def running(rows: DataFrame, by: list[str], order: list, name: str, value: Column) -> DataFrame:
    """rows with ``name``, the sum of value up to and with each row of its key: within ranges, and over the ranges' sums before."""
    own = rows.withColumn("_v", value)
    if not _hot(own, by):
        return own.withColumn(name, F.sum("_v").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_v")
    seg = ranges(own, by, order)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = seg.groupBy("_part", *by).agg(F.sum("_v").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    local = seg.withColumn("_own", F.sum("_v").over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return _carried(local, totals, by).withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_v", "_own", "_before")


def islands(rows: DataFrame, by: list[str], at: str, gap: int, key: str) -> DataFrame:
    """rows with island: a new one begins where the step from the previous row is more than ``gap``.

    A key with more than HOT_ROWS rows is scanned in ranges of time; each range is
    carried the last time, and the number of islands, of those before.
    """
    step = lambda w: F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    order = [F.col(at), F.col(key)]
    if not _hot(rows, by):
        whole = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn("_b", step(whole)).withColumn("island", F.sum("_b").over(whole.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")
    seg = ranges(rows, by, order)
    within = Window.partitionBy("_part", *by).orderBy(*order)
    seg = seg.withColumn("_b", step(within))
    inner = seg.groupBy("_part", *by).agg(F.sum("_b").alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    along = Window.partitionBy(*by).orderBy("_part")
    opens = F.coalesce((F.col("_first") - F.max("_last").over(along.rowsBetween(Window.unboundedPreceding, -1)) > gap).cast("int"), F.lit(0))
    inner = inner.withColumn("_open", opens)
    upto = F.coalesce(F.sum(F.col("_n") + F.col("_open")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = inner.withColumn("_base", upto + F.col("_open")).select("_part", *by, "_base")
    local = seg.withColumn("_c", F.sum("_b").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return _carried(local, totals, by).withColumn("island", F.col("_c") + F.col("_base")).drop("_part", "_b", "_c", "_base")


def sessions(rows: DataFrame, by: list[str], at: str, gap: int, key: str, least: int = 1) -> DataFrame:
    """(by, island, first, last, n) of the islands with at least ``least`` rows."""
    found = islands(rows.where(F.col(at).isNotNull()), by, at, gap, key)
    return found.groupBy(*by, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)


def numbered(rows: DataFrame, folder: Column, at: str, key: str) -> DataFrame:
    """rows with folder and sequence, counted within the folder in time order (no time: last); a folder with most rows is counted in ranges."""
    return running(rows.withColumn("folder", folder), ["folder"], [F.asc_nulls_last(at), F.col(key)], "sequence", F.lit(1)).withColumn("sequence", F.col("sequence").cast("int"))


def best_of_burst(rows: DataFrame, by: list[str], score: str, size: str, key: str) -> DataFrame:
    """The row of each group with the best score, else the largest."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), F.desc(size), key)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def gap_threshold(days: Column) -> Column:
    """Similarity that two faces must reach, by the days between them."""
    return F.when(days <= 1, 0.5).when(days <= 30, 0.6).when(days <= 365, 0.7).otherwise(0.8)


def chain(rows: DataFrame, similarity: Column, days: Column, weak: float = 0.7) -> DataFrame:
    """rows (pairs of neighbours in time) with similarity, days, threshold and link: auto, weak or break."""
    scored = rows.withColumn("similarity", similarity).withColumn("days", days).withColumn("threshold", gap_threshold(F.col("days")))
    link = F.when(F.col("similarity") >= F.col("threshold"), "auto").when(F.col("similarity") >= weak * F.col("threshold"), "weak").otherwise("break")
    return scored.withColumn("link", link)


def year_gaps(rows: DataFrame, by: str, year: str = "year") -> DataFrame:
    """(by, gap_start, gap_end, years) between consecutive distinct years more than one apart."""
    seen = rows.where(F.col(by).isNotNull() & F.col(year).isNotNull()).select(by, year).distinct()
    following = F.lead(year).over(Window.partitionBy(by).orderBy(year))
    return seen.withColumn("_next", following).where(F.col("_next") - F.col(year) > 1).select(by, (F.col(year) + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"), (F.col("_next") - F.col(year) - 1).alias("years"))


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """For each left row the right row of the same key nearest in time, at most ``limit`` away (ties: earlier, then smaller id).

    Time is cut into slots of ``limit``; a left row probes its own and both
    neighbouring slots, so the join is an equi-join however long a key's history.
    """
    slot = F.floor(F.col(at) / limit)
    probes = left.select(F.col("id").alias("left_id"), key, F.col(at).alias("_l"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("_s"))
    store = right.select(F.col("id").alias("right_id"), key, F.col(at).alias("_r"), slot.alias("_s"))
    pairs = probes.join(store, [key, "_s"]).where(F.abs(F.col("_l") - F.col("_r")) <= limit)
    best = F.min(F.struct(F.abs(F.col("_l") - F.col("_r")).alias("distance"), F.col("_r").alias("_r"), F.col("right_id").alias("right_id")))
    return pairs.groupBy("left_id").agg(best.alias("b")).select("left_id", F.col("b.right_id").alias("right_id"), F.col("b.distance").alias("distance"))


def live_pairs(images: DataFrame, videos: DataFrame) -> DataFrame:
    """(image_id, video_id, how): first by content id (the smallest video id wins), then by folder and stem among the rest.

    Rows are (id, content_id, folder, stem).
    """
    by_id = videos.where("content_id is not null").groupBy("content_id").agg(F.min("id").alias("video_id"))
    first = images.join(by_id, "content_id").select(F.col("id").alias("image_id"), "video_id", F.lit("content_id").alias("how"))
    rest_i = images.join(first.select(F.col("image_id").alias("id")), "id", "left_anti")
    rest_v = videos.join(first.select(F.col("video_id").alias("id")), "id", "left_anti")
    by_stem = rest_v.groupBy("folder", "stem").agg(F.min("id").alias("video_id"))
    return first.unionByName(rest_i.join(by_stem, ["folder", "stem"]).select(F.col("id").alias("image_id"), "video_id", F.lit("stem").alias("how")))


def birth_year(faces: DataFrame) -> DataFrame:
    """(person_id, birth_year): the floor of the median of photo year less estimated age."""
    known = faces.where("person_id is not null and age is not null and year is not null")
    return known.groupBy("person_id").agg(F.floor(F.median(F.col("year") - F.col("age"))).cast("int").alias("birth_year"))


def plausible(age: Column, birth: Column, year: Column) -> Column:
    """An age estimate that fits a photo's year: none before birth, within 10 years below 12, else within 8; unknown fits."""
    expected = year - birth
    return F.coalesce(F.when(expected < 0, False).when(F.abs(age - expected) <= F.when(expected < 12, 10).otherwise(8), True).when(age.isNull() | birth.isNull() | year.isNull(), True).otherwise(False), F.lit(True))


def one_per_photo(candidates: DataFrame) -> DataFrame:
    """candidates (face_id, file_id, person_id, similarity, plausible) with accepted.

    In a photo a person is given once, to the plausible face of highest similarity; implausible ones are never given.
    """
    order = Window.partitionBy("file_id", "person_id").orderBy(F.desc("plausible"), F.desc("similarity"), "face_id")
    return candidates.withColumn("accepted", F.col("plausible") & (F.row_number().over(order) == 1))
