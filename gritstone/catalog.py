"""Readers of the Parquet tables, and the file catalogue seen through them.

The catalogue's relations are views over the synthetic tables: documents stand
for files (a source is a drive), labels for quality scores, embeddings for
detections and their persons, events for photo times and the action log.  The
SQL in VIEWS defines the same relations for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that files take in turn, by id.
EXTENSIONS = (".jpg", ".png", ".mp4", ".txt", ".pdf", ".cr2", ".docx", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, drive_id, path, filename, file_type (null for none), size, modified_s (null for some), content_hash, is_deleted, text, lang."""
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return (
        table(spark, sf_dir, "documents")
        .withColumn("ext", ext)
        .select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("drive_id"),
            F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/d"), (F.col("doc_id") % 7).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), "ext").alias("path"),
            F.concat(F.lit("f"), F.col("doc_id").cast("string"), "ext").alias("filename"),
            F.when(F.col("ext") != "", F.col("ext")).alias("file_type"),
            F.col("n_chars").alias("size"),
            F.when(F.col("doc_id") % 13 != 5, F.lit(1388534400) + (F.col("doc_id") * 104729) % 315360000).cast("long").alias("modified_s"),
            F.when(F.col("doc_id") % 19 != 3, F.sha2("text", 256)).alias("content_hash"),
            (F.col("doc_id") % 17 == 0).alias("is_deleted"),
            "text",
            "lang",
        )
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, quality_score (0 to 100, null for some), width, height, has_gps, has_exif for the labelled files."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 11 != 4, (F.col("quality") * 60 + F.col("doc_id") % 40).cast("double")).alias("quality_score"),
        (F.lit(640) + F.col("doc_id") % 5 * 320).cast("int").alias("width"),
        (F.lit(480) + F.col("doc_id") % 3 * 240).cast("int").alias("height"),
        (F.col("toxic") == 1).alias("has_gps"),
        (F.col("doc_id") % 2 == 0).alias("has_exif"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id (smallest id), id of live files that share a content hash with another live file."""
    live = files(spark, sf_dir).where("not is_deleted and content_hash is not null")
    groups = live.groupBy("content_hash").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return live.join(groups, "content_hash").select("group_id", "id")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face_id, file_id, person_id (null for every third), confidence, age, birth_year, year, embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("face_id"),
        F.floor(F.col("vec_id") / 3).cast("long").alias("file_id"),
        F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("person_id"),
        ((F.col("vec_id") * 37 % 100) / F.lit(100.0)).alias("confidence"),
        F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") * 13 % 60).cast("int")).alias("age"),
        (F.lit(1970) + F.col("label") * 3).cast("int").alias("birth_year"),
        (F.lit(1990) + F.col("vec_id") * 31 % 30).cast("int").alias("year"),
        (F.col("vec_id") * 7_919 % 900_000).alias("taken_h"),
        "embedding",
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, owner, t (seconds), size: photo times from the event stream."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("photo_id"), F.col("user_id").alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("kind"), "value"
    )


_EXT = ", ".join(f"'{x}'" for x in EXTENSIONS)
VIEWS = {
    "files": f"""SELECT doc_id AS id, source AS drive_id, '/'||source||'/'||lang||'/d'||(doc_id % 7)||'/f'||doc_id||ext AS path,
        'f'||doc_id||ext AS filename, nullif(ext, '') AS file_type, n_chars AS size,
        CASE WHEN doc_id % 13 <> 5 THEN 1388534400 + (doc_id * 104729) % 315360000 END AS modified_s,
        CASE WHEN doc_id % 19 <> 3 THEN sha256(text) END AS content_hash, doc_id % 17 = 0 AS is_deleted, text, lang
        FROM (SELECT *, ([{_EXT}])[doc_id % 8 + 1] AS ext FROM documents)""",
    "quality": """SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 4 THEN (quality * 60 + doc_id % 40)::DOUBLE END AS quality_score,
        (640 + doc_id % 5 * 320)::INT AS width, (480 + doc_id % 3 * 240)::INT AS height, toxic = 1 AS has_gps, doc_id % 2 = 0 AS has_exif FROM labels""",
    "members": """SELECT min(id) OVER (PARTITION BY content_hash) AS group_id, id FROM files WHERE NOT is_deleted AND content_hash IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY content_hash) > 1""",
    "faces": """SELECT vec_id AS face_id, vec_id // 3 AS file_id, CASE WHEN vec_id % 3 <> 0 THEN label END AS person_id,
        (vec_id * 37 % 100) / 100.0::DOUBLE AS confidence, CASE WHEN vec_id % 7 <> 0 THEN (vec_id * 13 % 60)::INT END AS age,
        (1970 + label * 3)::INT AS birth_year, (1990 + vec_id * 31 % 30)::INT AS year, vec_id * 7919 % 900000 AS taken_h, embedding FROM embeddings""",
    "photos": "SELECT event_id AS photo_id, user_id AS owner, epoch_us(ts) AS us, event_type AS kind, value FROM events",
}


def with_views(sql: str, *names: str) -> str:
    """sql after the named views' definitions, in the order in which they build on one another."""
    wanted = {n for n in names} | ({"files"} if "members" in names else set())
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted) + " " + sql
