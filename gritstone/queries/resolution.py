"""Keepers, recommendations and previews over the duplicate groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.catalog import files, members, quality
from gritstone.operators import resolve
from gritstone.queries.book import Book

Q = Book()
VIEWS = ("files", "quality", "members")
ROWS = """, g AS (SELECT m.group_id, f.*, q.quality_score, q.width, q.height, q.has_gps, q.has_exif, f.id % 5 = 1 AS locked
    FROM members m JOIN files f USING (id) LEFT JOIN quality q USING (id)) """
#: Written out for the types that the files have.
RANK = "(CASE lower(file_type) WHEN '.jpg' THEN 4 WHEN '.png' THEN 6 WHEN '.cr2' THEN 8 WHEN '.mp4' THEN 7 WHEN '.txt' THEN 1 WHEN '.docx' THEN 5 WHEN '.pdf' THEN 6 ELSE 0 END)"


def rows(spark, sf_dir):
    joined = members(spark, sf_dir).join(files(spark, sf_dir).drop("text"), "id").join(quality(spark, sf_dir), "id", "left")
    return joined.withColumn("locked", F.col("id") % 5 == 1)


def _keeper(name: str, order: str, strategy: str, drive: str | None = None) -> None:
    def run(spark, sf_dir):
        return resolve.keepers(rows(spark, sf_dir), strategy, drive).where("is_keeper").select("group_id", "id")

    run.__name__ = name
    Q.query(f"{ROWS} SELECT group_id, id FROM g QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {order}) = 1", VIEWS)(run)


_keeper("keep_first", "id", "keep_first")
_keeper("keep_newest", "modified_s DESC NULLS LAST, id", "keep_newest")
_keeper("keep_oldest", "modified_s NULLS LAST, id", "keep_oldest")
_keeper("keep_largest", "size DESC, id", "keep_largest")
_keeper("keep_smallest", "size, id", "keep_smallest")
_keeper("keep_shortest_path", "length(path), id", "keep_shortest_path")
_keeper("keep_on_drive", "(drive_id = 'src2')::INT DESC, CASE WHEN drive_id = 'src2' THEN id END, size DESC, id", "keep_on_drive", "src2")
_keeper("keep_best_quality", "quality_score DESC NULLS LAST, size DESC, id", "keep_best_quality")
_keeper("keep_best_format", f"{RANK} DESC, coalesce(width * height, 0) DESC, size DESC, id", "keep_best_format")


@Q.query(f"""{ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, id) = 1 AS keeper FROM g)
    SELECT group_id, max(CASE WHEN keeper THEN id END) AS keeper_id, sum((NOT keeper AND NOT locked)::INT)::BIGINT AS removed,
    sum(CASE WHEN NOT keeper AND NOT locked THEN size END)::BIGINT AS space_saved FROM k GROUP BY 1 HAVING count(*) > 1 AND sum((NOT keeper AND NOT locked)::INT) > 0""", VIEWS)
def resolution_plan(spark, sf_dir):
    return resolve.resolutions(rows(spark, sf_dir), "keep_largest")


@Q.query(f"""{ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY modified_s DESC NULLS LAST, id) = 1 AS keeper FROM g)
    SELECT lower(coalesce(file_type, '')) AS file_type, count(*) AS files, sum(size)::BIGINT AS bytes FROM k WHERE NOT keeper AND NOT locked GROUP BY 1""", VIEWS)
def resolution_preview(spark, sf_dir):
    return resolve.preview(rows(spark, sf_dir), "keep_newest")


@Q.query(f"""{ROWS}, p AS (SELECT group_id, id, round(CASE WHEN size = max(size) OVER w THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN modified_s = min(modified_s) OVER w THEN 1.0::DOUBLE ELSE 0 END
    + CASE WHEN length(path) = min(length(path)) OVER w THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN has_exif THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN has_gps THEN 0.3::DOUBLE ELSE 0 END
    + coalesce(quality_score / 10.0::DOUBLE, 0) + CASE WHEN {RANK} > 0 AND {RANK} = max({RANK}) OVER w THEN 1.5::DOUBLE ELSE 0 END, 6) AS points FROM g WINDOW w AS (PARTITION BY group_id))
    SELECT group_id, id, points FROM p QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY points DESC, id) = 1""", VIEWS)
def keeper_recommendation(spark, sf_dir):
    return resolve.recommend(rows(spark, sf_dir))


@Q.query(f"""SELECT id, {RANK} AS rank, CASE lower(file_type) WHEN '.cr2' THEN 'RAW' WHEN '.png' THEN 'Lossless' WHEN '.jpg' THEN 'Lossy' WHEN '.mp4' THEN 'High' ELSE '' END AS label FROM files""", "files")
def format_labels(spark, sf_dir):
    kind = F.col("file_type")
    return files(spark, sf_dir).select("id", resolve.format_rank(kind).alias("rank"), resolve.format_label(kind).alias("label"))


@Q.query("""SELECT id, group_id FROM members WHERE group_id % 3 <> 0 AND id <> group_id""", "members")
def pending_removals(spark, sf_dir):
    rows_ = members(spark, sf_dir).withColumn("is_keeper", F.col("id") == F.col("group_id"))
    groups = rows_.select("group_id").distinct().withColumn("status", F.when(F.col("group_id") % 3 == 0, "resolved").otherwise("pending"))
    return resolve.removals(groups, rows_).select("id", "group_id")


@Q.query(f"""{ROWS} SELECT group_id, id AS best, quality_score FROM g WHERE quality_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY quality_score DESC, id) = 1""", VIEWS)
def best_quality_file(spark, sf_dir):
    return resolve.best_by(rows(spark, sf_dir), "quality_score").select("group_id", F.col("id").alias("best"), "quality_score")
