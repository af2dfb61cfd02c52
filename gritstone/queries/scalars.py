"""Scalar expressions over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.catalog import files, quality
from gritstone.functions import paths, scalars
from gritstone.queries.book import Book

Q = Book()


@Q.query(r"""SELECT id, regexp_extract(path, '[^/]*$', 0) AS base, regexp_replace(path, '/[^/]*$', '') AS folder, nullif(lower(regexp_extract(filename, '^.+(\.[^.]+)$', 1)), '') AS ext FROM files""", "files")
def path_parts(spark, sf_dir):
    return files(spark, sf_dir).select("id", paths.basename("path").alias("base"), paths.dirname("path").alias("folder"), paths.extension("filename").alias("ext"))


@Q.query("""SELECT id, CASE WHEN size < 1024 THEN size||' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) ELSE printf('%.1f MB', size / 1048576.0::DOUBLE) END AS shown FROM files""", "files")
def formatted_sizes(spark, sf_dir):
    return files(spark, sf_dir).select("id", scalars.format_size(F.col("size")).alias("shown"))


@Q.query("""SELECT id, CASE WHEN lower(file_type) IN ('.txt', '.cr2') THEN 'TEXT' WHEN file_type IN ('.jpg', '.png') THEN 'IMAGE' WHEN file_type IN ('.pdf', '.docx') THEN 'VISUAL_DOC' WHEN file_type = '.mp4' THEN 'VIDEO' WHEN file_type IS NULL THEN 'SKIP' ELSE 'TEXT' END AS kind FROM files""", "files")
def summary_kinds(spark, sf_dir):
    return files(spark, sf_dir).select("id", scalars.summary_kind(F.col("file_type")).alias("kind"))


@Q.query("""SELECT id, width * height / 1e6 AS megapixels, (640, 480) = (width, height) AS vga FROM quality""", "quality")
def megapixels(spark, sf_dir):
    return quality(spark, sf_dir).select("id", scalars.megapixels(F.col("width"), F.col("height")).alias("megapixels"), ((F.col("width") == 640) & (F.col("height") == 480)).alias("vga"))


@Q.query("""SELECT id, 'drive_'||substr(sha256(lower(path)), 1, 8) AS drive FROM files""", "files")
def drive_ids(spark, sf_dir):
    return files(spark, sf_dir).select("id", scalars.drive_id(F.col("path")).alias("drive"))


@Q.query("""SELECT id, 'vault/2024-01-31/'||trim(regexp_replace(regexp_replace(path, '/[^/]*$', ''), '[^A-Za-z0-9]+', '_', 'g'), '_')||'/'||filename AS target FROM files""", "files")
def quarantine_paths(spark, sf_dir):
    from gritstone.operators.actions import quarantine_path

    return files(spark, sf_dir).select("id", quarantine_path("vault", "2024-01-31").alias("target"))
