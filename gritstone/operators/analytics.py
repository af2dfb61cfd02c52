"""Storage reports, catalogue statistics, work-lists and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.operators.dedup import live


def by_type(files: DataFrame) -> DataFrame:
    return live(files).groupBy(F.coalesce("file_type", F.lit("(none)")).alias("file_type")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def by_year(files: DataFrame, after: int = 1980) -> DataFrame:
    rows = live(files).where("modified_s is not null").withColumn("year", F.year(F.timestamp_seconds("modified_s")))
    return rows.where(F.col("year") > after).groupBy("year").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def statistics(files: DataFrame, large: int = 1 << 30) -> DataFrame:
    """One row of counts over live files, in one pass."""
    return live(files).agg(
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        F.count("content_hash").alias("hashed"),
        F.countDistinct("drive_id").alias("drives"),
        F.count_if(F.col("size") > large).alias("large_files"),
        F.count_if(F.col("file_type").isNull()).alias("untyped"),
    )


STATUSES = ("pending", "resolved", "ignored")


def status_counts(groups: DataFrame, status: str = "status") -> DataFrame:
    """(status, groups), with a zero for a status that no group has."""
    one = groups.agg(*[F.count_if(F.col(status) == s).alias(s) for s in STATUSES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("groups")) for s in STATUSES])).alias("x")).select("x.*")


def missing(rows: DataFrame, satellite: DataFrame, key: str = "id") -> DataFrame:
    """Rows without a satellite row: the work-list of an extractor."""
    return rows.join(satellite.select(key), key, "left_anti")


def preflight(files: DataFrame, satellite: DataFrame, types: list[str]) -> DataFrame:
    """One row: files an extractor may take, those without a row and those without a score."""
    rows = live(files).where(F.col("file_type").isin(types))
    joined = rows.select("id").join(satellite.select("id", "quality_score", F.lit(1).alias("known")), "id", "left")
    return joined.agg(F.count("*").alias("eligible"), F.count_if(F.col("known").isNull()).alias("missing_row"), F.count_if(F.col("quality_score").isNull()).alias("missing_score"))


def co_occurrence(faces: DataFrame, min_count: int = 5) -> DataFrame:
    """(person_id, other, files): persons seen in the same files, in at least min_count of them.

    Pairs are formed of distinct (file, person) rows, so a file's repeated faces don't multiply.
    """
    seen = faces.where("person_id is not null").select("file_id", "person_id").distinct()
    pairs = seen.join(seen.withColumnRenamed("person_id", "other"), "file_id").where("person_id <> other")
    return pairs.groupBy("person_id", "other").agg(F.count("*").alias("files")).where(F.col("files") >= min_count)


def photo_counts(faces: DataFrame) -> DataFrame:
    return faces.where("person_id is not null").groupBy("person_id").agg(F.countDistinct("file_id").alias("photo_count"), F.count("*").alias("face_count"))


def top_values(rows: DataFrame, column: str, limit: int, count: str = "uses") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias(count)).orderBy(F.desc(count), column).limit(limit)


# What a quick win is by extension and by name.
TEMPORARY = (".tmp", ".temp", ".bak", ".cache", ".log")
TEMPORARY_NAMES = ("Thumbs.db", "desktop.ini", ".DS_Store")


def quick_wins(files: DataFrame, huge: int = 1 << 30) -> DataFrame:
    """(kind, files, bytes): temporary files (types and names as they are written there), and files above ``huge``."""
    temp = F.coalesce("file_type", F.lit("")).isin(*TEMPORARY) | F.coalesce("filename", F.lit("")).isin(*TEMPORARY_NAMES)
    one = live(files).agg(F.count_if(temp).alias("tn"), F.sum(F.when(temp, F.col("size"))).alias("tb"), F.count_if(F.col("size") > huge).alias("hn"), F.sum(F.when(F.col("size") > huge, F.col("size"))).alias("hb"))
    kinds = F.array(F.struct(F.lit("temporary").alias("kind"), F.col("tn").alias("files"), F.coalesce("tb", F.lit(0)).alias("bytes")), F.struct(F.lit("huge").alias("kind"), F.col("hn").alias("files"), F.coalesce("hb", F.lit(0)).alias("bytes")))
    return one.select(F.explode(kinds).alias("x")).select("x.*")
