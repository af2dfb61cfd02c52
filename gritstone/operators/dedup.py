"""Exact duplicates: hash groups, two-phase candidate elimination, existing groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def exact_groups(files: DataFrame, key: str = "content_hash", size: str = "size", scope: str | None = None) -> DataFrame:
    """(key, file_count, total_size, wasted_size, file_ids) of values that more than one row has; null keys form no group.

    With ``scope`` (a drive column) rows group within each scope only.
    """
    by = [key] + ([scope] if scope else [])
    groups = files.where(F.col(key).isNotNull()).groupBy(*by)
    found = groups.agg(F.count("*").alias("file_count"), F.sum(size).alias("total_size"), (F.sum(size) - F.min(size)).alias("wasted_size"))
    return found.where("file_count > 1")


def hash_candidates(files: DataFrame, only_unhashed: bool = False, drive: str | None = None) -> DataFrame:
    """Live rows without a hash whose size another live row has.

    The count runs over all live rows, so that a new file is compared with
    hashed ones as well; only_unhashed=True counts unhashed rows alone.  A drive
    restricts the rows returned, never the count.
    """
    rows = live(files)
    counted = rows.where("content_hash is null") if only_unhashed else rows
    sizes = counted.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    wanted = rows.where("content_hash is null").join(sizes, "size", "left_semi")
    return wanted.where(F.col("drive_id") == drive) if drive else wanted


def quick_hash(text, edge: int = 64):
    """md5 of the first and last ``edge`` characters and the length: cheap, and equal for equal texts."""
    return F.md5(F.concat(F.substring(text, 1, edge), F.when(F.char_length(text) > edge, F.expr(f"right({text}, {edge})")).otherwise(F.lit("")), F.char_length(text).cast("string")))


def two_phase_hash(files: DataFrame, text: str = "text") -> DataFrame:
    """(id, content_hash) of rows that collide in size, then in the quick hash; only those are hashed whole."""
    sizes = files.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    quick = files.join(sizes, "size", "left_semi").withColumn("quick_hash", quick_hash(text))
    same = quick.groupBy("size", "quick_hash").agg(F.count("*").alias("n")).where("n > 1").select("size", "quick_hash")
    return quick.join(same, ["size", "quick_hash"], "left_semi").select("id", "quick_hash", F.sha2(text, 256).alias("content_hash"))


def uncovered_groups(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidate groups that no existing group contains whole (a superset counts): relational division.

    Both sides are (group_id, id) rows; the result is candidates' group ids.
    """
    pairs = candidates.alias("c").join(existing.alias("e"), F.col("c.id") == F.col("e.id"))
    shared = pairs.groupBy(F.col("c.group_id").alias("group_id"), F.col("e.group_id").alias("other")).agg(F.countDistinct("c.id").alias("both"))
    sizes = candidates.groupBy("group_id").agg(F.countDistinct("id").alias("n"))
    covered = shared.join(sizes, "group_id").where("both = n").select("group_id").distinct()
    return candidates.select("group_id").distinct().join(covered, "group_id", "left_anti")


def group_rows(members: DataFrame, files: DataFrame, match_type: str = "exact") -> DataFrame:
    """A row for each group: file_count, total_size, wasted_size = total less the smallest, status pending."""
    sized = members.join(files.select("id", "size"), "id")
    found = sized.groupBy("group_id").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"), (F.sum("size") - F.min("size")).alias("wasted_size"))
    return found.withColumn("match_type", F.lit(match_type)).withColumn("status", F.lit("pending"))


def group_similarity(components: DataFrame, pairs: DataFrame, default: float = 0.9) -> DataFrame:
    """(component, similarity): the mean over pairs inside each component, ``default`` without any."""
    inside = pairs.join(components.select(F.col("node").alias("src"), "component"), "src")
    means = inside.groupBy("component").agg(F.avg("sim").alias("mean"))
    return components.select("component").distinct().join(means, "component", "left").select("component", F.coalesce("mean", F.lit(default)).alias("similarity"))
