"""Catalogue changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.catalog import faces, files, quality
from gritstone.operators import mutation
from gritstone.queries.book import Book
from gritstone.session import scratch_path
from gritstone.sources.versioned import VersionedTable

Q = Book()
_BATCH = ", b AS (SELECT drive_id, path, CASE WHEN id % 5 = 0 THEN size + 1 ELSE size END AS size, modified_s FROM files WHERE id % 3 <> 0 UNION ALL SELECT drive_id, path||'.new', size, modified_s FROM files WHERE id % 50 = 0)"


def batch(spark, sf_dir):
    rows = files(spark, sf_dir)
    old = rows.where("id % 3 <> 0").select("drive_id", "path", F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified_s")
    return old.unionByName(rows.where("id % 50 = 0").select("drive_id", F.concat("path", F.lit(".new")).alias("path"), "size", "modified_s"))


@Q.query(_BATCH + """ SELECT coalesce(b.path, f.path) AS path, CASE WHEN b.path IS NULL THEN f.size ELSE b.size END AS size,
    CASE WHEN b.path IS NULL OR (f.size IS NOT DISTINCT FROM b.size AND f.modified_s IS NOT DISTINCT FROM b.modified_s) THEN f.content_hash END AS content_hash, CASE WHEN b.path IS NULL THEN f.is_deleted ELSE false END AS is_deleted,
    CASE WHEN b.path IS NULL THEN 'unseen' WHEN f.path IS NULL THEN 'new' WHEN f.size = b.size THEN 'unchanged' ELSE 'modified' END AS change FROM files f FULL JOIN b ON f.drive_id = b.drive_id AND f.path = b.path""", "files")
def merge_scan(spark, sf_dir):
    old = files(spark, sf_dir).select("drive_id", "path", "size", "modified_s", "content_hash", "is_deleted")
    return mutation.merge_scan(old, batch(spark, sf_dir)).select("path", "size", "content_hash", "is_deleted", "change")


_MERGED = """SELECT coalesce(b.drive_id, f.drive_id) AS drive_id, coalesce(b.path, f.path) AS path, CASE WHEN b.path IS NULL THEN f.size ELSE b.size END AS size,
    CASE WHEN b.path IS NULL OR (f.size IS NOT DISTINCT FROM b.size AND f.modified_s IS NOT DISTINCT FROM b.modified_s) THEN f.content_hash END AS content_hash, CASE WHEN b.path IS NULL THEN f.is_deleted ELSE false END AS is_deleted FROM files f FULL JOIN b ON f.drive_id = b.drive_id AND f.path = b.path"""


@Q.query(_BATCH + f""" SELECT 2 AS version, * FROM ({_MERGED}) WHERE NOT (drive_id = 'src1' AND size < 500) UNION ALL SELECT 1, * FROM ({_MERGED}) UNION ALL SELECT 0, drive_id, path, size, content_hash, is_deleted FROM files""", "files")
def versioned_catalogue(spark, sf_dir):
    """The catalogue as a versioned table: made, merged with a scan's batch, rows deleted; all three versions read back."""
    columns = ["drive_id", "path", "size", "modified_s", "content_hash", "is_deleted"]
    stored = VersionedTable.create(spark, scratch_path(spark, "catalogue"), files(spark, sf_dir).select(*columns), ["drive_id", "path"], buckets=32)
    stored.merge(batch(spark, sf_dir), lambda rows, new: mutation.merge_scan(rows, new).select(*columns))
    stored.delete("drive_id = 'src1' and size < 500")
    out = [stored.read(v).select(F.lit(v).alias("version"), "drive_id", "path", "size", "content_hash", "is_deleted") for v in (2, 1, 0)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@Q.query("SELECT id, is_deleted OR (drive_id = 'src1' AND id % 3 = 0) AS is_deleted FROM files", "files")
def reconcile_deleted(spark, sf_dir):
    rows = files(spark, sf_dir)
    return mutation.mark_unseen(rows, rows.where("id % 3 <> 0"), "src1").select("id", "is_deleted")


@Q.query(_BATCH + """ SELECT coalesce(f.path, b.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM files f FULL JOIN b ON f.path = b.path WHERE f.path IS NULL OR b.path IS NULL OR f.size <> b.size""", "files")
def snapshot_diff(spark, sf_dir):
    return mutation.snapshot_diff(files(spark, sf_dir), batch(spark, sf_dir))


@Q.query("SELECT id, CASE WHEN starts_with(path, '/src2/') THEN '/vault/two'||substr(path, 6) ELSE path END AS path FROM files", "files")
def remap_prefix(spark, sf_dir):
    return mutation.remap_prefix(files(spark, sf_dir), "/src2", "/vault/two").select("id", "path")


@Q.query("SELECT file_id, count(*) AS faces_found FROM faces WHERE file_id NOT IN (SELECT id FROM quality WHERE id % 2 = 0) GROUP BY 1", ("faces", "quality"))
def backfill_face_status(spark, sf_dir):
    known = quality(spark, sf_dir).where("id % 2 = 0").select(F.col("id").alias("file_id"))
    return mutation.backfill(faces(spark, sf_dir), known).select("file_id", "faces_found")


@Q.query("SELECT face_id FROM faces WHERE NOT (person_id IS NULL AND confidence < 0.5)", "faces")
def drop_weak_faces(spark, sf_dir):
    return mutation.delete_where(faces(spark, sf_dir), F.col("person_id").isNull() & (F.col("confidence") < 0.5)).select("face_id")


@Q.query("SELECT id, CASE WHEN id % 4 = 0 THEN 99.0::DOUBLE ELSE quality_score END AS quality_score, width FROM quality", "quality")
def upsert_quality(spark, sf_dir):
    rows = quality(spark, sf_dir).select("id", "quality_score", "width")
    new = rows.where("id % 4 = 0").select("id", F.lit(99.0).alias("quality_score"), F.lit(1).alias("width"))
    return mutation.upsert(rows, new, ["id"], only=["quality_score"])
