"""Choosing a keeper in each duplicate group, and what resolving the groups would do.

Rows are (group_id, id, size, modified_s, path, drive_id, file_type, locked) with
quality columns where a strategy needs them.  Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Preference of formats within each kind, higher is better.
IMAGE_RANKS = {".bmp": 1, ".gif": 2, ".webp": 3, ".jpg": 4, ".jpeg": 4, ".heic": 5, ".heif": 5, ".png": 6, ".tiff": 7, ".tif": 7, ".dng": 8, ".cr2": 8, ".nef": 8, ".arw": 8, ".raw": 8}
VIDEO_RANKS = {".3gp": 1, ".flv": 2, ".wmv": 3, ".avi": 4, ".webm": 5, ".m4v": 6, ".mpg": 6, ".mpeg": 6, ".mp4": 7, ".mov": 8, ".mkv": 9}
DOCUMENT_RANKS = {".txt": 1, ".rtf": 2, ".odt": 3, ".doc": 4, ".docx": 5, ".pdf": 6}
AUDIO_RANKS = {".wma": 1, ".aac": 2, ".ogg": 3, ".mp3": 4, ".m4a": 5, ".wav": 6, ".flac": 7, ".alac": 8}
# Labels of the ranks from a number on, by kind; documents have none.
IMAGE_LABELS = ((8, "RAW"), (6, "Lossless"), (4, "Lossy"), (0, "Low"))
VIDEO_LABELS = ((7, "High"), (4, "Medium"), (0, "Low"))
AUDIO_LABELS = ((6, "Lossless"), (4, "High"), (0, "Lossy"))
FORMAT_RANKS = IMAGE_RANKS | VIDEO_RANKS | DOCUMENT_RANKS | AUDIO_RANKS
STRATEGIES = ("keep_first", "keep_newest", "keep_oldest", "keep_largest", "keep_smallest", "keep_shortest_path", "keep_on_drive", "keep_best_quality", "keep_best_format", "manual")


def format_rank(file_type: Column) -> Column:
    ranks = F.create_map(*[x for k, v in FORMAT_RANKS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(ranks[F.lower(file_type)], F.lit(0))


def format_label(file_type: Column) -> Column:
    """The class of a format within its kind; empty for documents and unknown types."""
    known = {}
    for ranks, labels in ((IMAGE_RANKS, IMAGE_LABELS), (VIDEO_RANKS, VIDEO_LABELS), (AUDIO_RANKS, AUDIO_LABELS)):
        known |= {ext: next(name for least, name in labels if rank >= least) for ext, rank in ranks.items()}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.lower(file_type)], F.lit(""))


def _order(strategy: str, drive: str | None, columns: list[str]) -> list[Column]:
    first, largest = [F.col("id")], [F.desc("size"), F.col("id")]
    if strategy == "keep_newest":
        return [F.desc_nulls_last("modified_s"), F.col("id")]
    if strategy == "keep_oldest":
        return [F.asc_nulls_last("modified_s"), F.col("id")]
    if strategy == "keep_largest":
        return largest
    if strategy == "keep_smallest":
        return [F.asc("size"), F.col("id")]
    if strategy == "keep_shortest_path":
        return [F.length("path"), F.col("id")]
    if strategy == "keep_on_drive":
        # Without a drive the first is kept; in a group without a copy there, the largest.
        here = (F.col("drive_id") == drive).cast("int") if drive else None
        return first if here is None else [F.desc("_on"), F.when(F.col("_on") == 1, F.col("id")), *largest]
    if strategy == "keep_best_quality":
        return [F.desc_nulls_last("quality_score"), *largest] if "quality_score" in columns else largest
    if strategy == "keep_best_format":
        area = F.coalesce(F.col("width") * F.col("height"), F.lit(0)) if {"width", "height"} <= set(columns) else F.lit(0)
        return [F.desc(format_rank(F.col("file_type"))), F.desc(area), *largest]
    return first


def keepers(rows: DataFrame, strategy: str, drive: str | None = None) -> DataFrame:
    """rows with is_keeper; manual chooses none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    if strategy == "manual":
        return rows.withColumn("is_keeper", F.lit(False))
    if strategy == "keep_on_drive" and drive:
        rows = rows.withColumn("_on", F.coalesce((F.col("drive_id") == drive).cast("int"), F.lit(0)))
    window = Window.partitionBy("group_id").orderBy(*_order(strategy, drive, rows.columns))
    return rows.withColumn("is_keeper", F.row_number().over(window) == 1).drop("_on")


def resolutions(rows: DataFrame, strategy: str, drive: str | None = None) -> DataFrame:
    """(group_id, keeper_id, remove_ids, space_saved) of groups with something to remove.

    Locked rows may be kept but are never removed; groups of one row, or where
    nothing could go, are left out.
    """
    chosen = keepers(rows, strategy, drive).withColumn("goes", ~F.col("is_keeper") & ~F.coalesce(F.col("locked"), F.lit(False)))
    found = chosen.groupBy("group_id").agg(
        F.max(F.when(F.col("is_keeper"), F.col("id"))).alias("keeper_id"),
        F.count_if("goes").alias("removed"),
        F.sum(F.when(F.col("goes"), F.col("size"))).alias("space_saved"),
        F.count("*").alias("n"),
    )
    return found.where("n > 1 and removed > 0 and keeper_id is not null").drop("n")


def preview(rows: DataFrame, strategy: str, drive: str | None = None) -> DataFrame:
    """(file_type, files, bytes) of what resolving would remove, by lower-case type."""
    chosen = keepers(rows, strategy, drive)
    sizes = chosen.withColumn("n", F.count("*").over(Window.partitionBy("group_id")))
    gone = sizes.where(~F.col("is_keeper") & ~F.coalesce(F.col("locked"), F.lit(False)) & (F.col("n") > 1))
    return gone.groupBy(F.lower(F.coalesce("file_type", F.lit(""))).alias("file_type")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def recommend(rows: DataFrame) -> DataFrame:
    """(group_id, id, points) of the best row of each group by added points.

    Largest 2, oldest 1, shortest path 0.5, EXIF 0.5, GPS 0.3, camera 0.2 (if the
    column is there), a tenth of the quality score (zero counts as none), best
    format 1.5.  Ties to the smaller id.
    """
    group = Window.partitionBy("group_id")
    have = set(rows.columns)
    flag = lambda c, p: F.when(F.coalesce(F.col(c), F.lit(False)), p).otherwise(0.0) if c in have else F.lit(0.0)
    rank = format_rank(F.col("file_type"))
    points = (
        F.when(F.col("size") == F.max("size").over(group), 2.0).otherwise(0.0)
        + F.when(F.col("modified_s") == F.min("modified_s").over(group), 1.0).otherwise(0.0)
        + F.when(F.length("path") == F.min(F.length("path")).over(group), 0.5).otherwise(0.0)
        + flag("has_exif", 0.5)
        + flag("has_gps", 0.3)
        + flag("has_camera", 0.2)
        + (F.coalesce(F.col("quality_score") / 10.0, F.lit(0.0)) if "quality_score" in have else F.lit(0.0))
        + F.when((rank > 0) & (rank == F.max(rank).over(group)), 1.5).otherwise(0.0)
    )
    scored = rows.withColumn("points", F.round(points, 6))
    best = F.row_number().over(group.orderBy(F.desc("points"), "id"))
    return scored.withColumn("_n", best).where("_n = 1").select("group_id", "id", "points")


def best_by(rows: DataFrame, score: str, group: str = "group_id", key: str = "id") -> DataFrame:
    """(group, key, score) of the row with the highest score in each group, ties to the smaller key; rows without a score
    don't count.  An aggregate, so a group of any size is reduced where its rows are."""
    best = rows.where(F.col(score).isNotNull()).groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(key))).alias("b"))
    return best.select(group, F.col(f"b.{key}").alias(key), (-F.col("b.s")).alias(score))


def removals(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Non-keepers of pending groups that have a keeper: what a clean-up would take."""
    has = members.groupBy("group_id").agg(F.bool_or("is_keeper").alias("has_keeper"))
    open_ = groups.where("status = 'pending'").select("group_id").join(has.where("has_keeper"), "group_id")
    return members.where("not is_keeper").join(open_.select("group_id"), "group_id", "left_semi")


def set_status(groups: DataFrame, ids: list[int], status: str) -> DataFrame:
    """groups with the given ones set to a status."""
    return groups.withColumn("status", F.when(F.col("group_id").isin(ids), status).otherwise(F.col("status")))


def clear_selections(groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved groups are pending again and no row is a keeper."""
    return groups.withColumn("status", F.when(F.col("status") == "resolved", "pending").otherwise(F.col("status"))), members.withColumn("is_keeper", F.lit(False))
