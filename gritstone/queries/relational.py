"""Relational core: duplicate groups, reports, work-lists, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.catalog import faces, files, members, photos, quality, table
from gritstone.operators import analytics, dedup, redundancy
from gritstone.queries.book import Book

Q = Book()
LIVE = "NOT is_deleted"


@Q.query("""SELECT sha256(text) AS content_hash, count(*) AS file_count, sum(n_chars)::BIGINT AS total_size,
    (sum(n_chars) - min(n_chars))::BIGINT AS wasted_size FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("size"))
    return dedup.exact_groups(docs)


@Q.query(f"""SELECT drive_id, content_hash, count(*) AS file_count, sum(size)::BIGINT AS total_size, (sum(size) - min(size))::BIGINT AS wasted_size
    FROM files WHERE {LIVE} AND content_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""", "files")
def exact_groups_by_drive(spark, sf_dir):
    return dedup.exact_groups(dedup.live(files(spark, sf_dir)), scope="drive_id").select("drive_id", "content_hash", "file_count", "total_size", "wasted_size")


@Q.query(f"""SELECT content_hash, max(size) AS size, count(*) AS file_count, count(DISTINCT drive_id) AS drive_count FROM files
    WHERE {LIVE} AND content_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT drive_id) BETWEEN 1 AND 3""", "files")
def content_hash_groups(spark, sf_dir):
    return redundancy.hash_groups(files(spark, sf_dir), min_drives=1, max_drives=3)


@Q.query(f"""SELECT count(*) AS live_files, sum(size)::BIGINT AS live_bytes, (SELECT count(*) FROM files WHERE {LIVE} AND content_hash IN
      (SELECT content_hash FROM files WHERE {LIVE} AND content_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT drive_id) = 1)) AS at_risk_files,
      (SELECT sum(size) FROM files WHERE {LIVE} AND content_hash IN
      (SELECT content_hash FROM files WHERE {LIVE} AND content_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT drive_id) = 1))::BIGINT AS at_risk_bytes
    FROM files WHERE {LIVE}""", "files")
def redundancy_totals(spark, sf_dir):
    return redundancy.totals(files(spark, sf_dir))


@Q.query(f"""SELECT content_hash, CASE WHEN count(DISTINCT drive_id) <= 1 THEN 'at_risk' ELSE 'redundant' END AS state, count(*) AS file_count
    FROM files WHERE {LIVE} AND content_hash IS NOT NULL GROUP BY 1""", "files")
def redundancy_report(spark, sf_dir):
    return redundancy.report(files(spark, sf_dir)).select("content_hash", "state", "file_count")


@Q.query(f"""WITH t AS (SELECT DISTINCT drive_id AS target FROM files WHERE drive_id IN ('src1', 'src2'))
    SELECT f.id, t.target, '/'||t.target||substr(f.path, length('/src0')+1) AS dest FROM files f, t
    WHERE {LIVE} AND f.drive_id = 'src0' AND NOT EXISTS (SELECT 1 FROM files g WHERE NOT g.is_deleted AND g.drive_id = t.target AND g.content_hash = f.content_hash)
    AND NOT regexp_full_match(f.path, '.*\\.(mp4|cr2)')""".replace("WITH t AS", ", t AS"), "files")
def backup_plan(spark, sf_dir):
    return redundancy.backup_plan(files(spark, sf_dir), "src0", ["src1", "src2"], ["*.mp4", "*.cr2"]).select("id", "target", "dest")


@Q.query(f"""SELECT coalesce(file_type, '(none)') AS file_type, count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE {LIVE} GROUP BY 1""", "files")
def storage_by_type(spark, sf_dir):
    return analytics.by_type(files(spark, sf_dir))


@Q.query(f"""SELECT year(make_timestamp(modified_s * 1000000))::INT AS year, count(*) AS files, sum(size)::BIGINT AS bytes FROM files
    WHERE {LIVE} AND modified_s IS NOT NULL AND year(make_timestamp(modified_s * 1000000)) > 1980 GROUP BY 1""", "files")
def storage_by_year(spark, sf_dir):
    return analytics.by_year(files(spark, sf_dir))


@Q.query(f"""SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(content_hash) AS hashed, count(DISTINCT drive_id) AS drives,
    sum((size > 20000)::INT)::BIGINT AS large_files, sum((file_type IS NULL)::INT)::BIGINT AS untyped FROM files WHERE {LIVE}""", "files")
def catalogue_statistics(spark, sf_dir):
    return analytics.statistics(files(spark, sf_dir), large=20_000)


@Q.query(f"""SELECT status, coalesce(n, 0)::BIGINT AS groups FROM (VALUES ('pending'), ('resolved'), ('ignored')) v(status) LEFT JOIN
    (SELECT CASE WHEN group_id % 3 = 0 THEN 'resolved' ELSE 'pending' END AS status, count(DISTINCT group_id) AS n FROM members GROUP BY 1) USING (status)""", "members")
def group_status_counts(spark, sf_dir):
    groups = members(spark, sf_dir).select("group_id").distinct().withColumn("status", F.when(F.col("group_id") % 3 == 0, "resolved").otherwise("pending"))
    return analytics.status_counts(groups)


@Q.query(f"""SELECT f.id, f.size FROM files f WHERE {LIVE} AND content_hash IS NULL AND size IN
    (SELECT size FROM files WHERE {LIVE} GROUP BY size HAVING count(*) > 1)""", "files")
def files_needing_hash(spark, sf_dir):
    return dedup.hash_candidates(files(spark, sf_dir)).select("id", "size")


@Q.query("""WITH s AS (SELECT id, text, size, md5(substr(text, 1, 64)||CASE WHEN length(text) > 64 THEN right(text, 64) ELSE '' END||length(text)) AS quick_hash FROM files
      WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1))
    SELECT id, quick_hash, sha256(text) AS content_hash FROM s WHERE (size, quick_hash) IN (SELECT (size, quick_hash) FROM s GROUP BY size, quick_hash HAVING count(*) > 1)""".replace("WITH s AS", ", s AS"), "files")
def candidate_hash_phases(spark, sf_dir):
    return dedup.two_phase_hash(files(spark, sf_dir))


@Q.query(f"SELECT f.id, f.path FROM files f ANTI JOIN quality q ON f.id = q.id WHERE {LIVE}", ("files", "quality"))
def files_missing_quality(spark, sf_dir):
    return analytics.missing(dedup.live(files(spark, sf_dir)), quality(spark, sf_dir)).select("id", "path")


@Q.query(f"""SELECT count(*) AS eligible, sum((q.id IS NULL)::INT)::BIGINT AS missing_row, sum((q.quality_score IS NULL)::INT)::BIGINT AS missing_score
    FROM files f LEFT JOIN quality q ON f.id = q.id WHERE {LIVE} AND file_type IN ('.jpg', '.png', '.cr2')""", ("files", "quality"))
def backlog_preflight(spark, sf_dir):
    return analytics.preflight(files(spark, sf_dir), quality(spark, sf_dir), [".jpg", ".png", ".cr2"])


@Q.query("""SELECT a.person_id, b.person_id AS other, count(DISTINCT a.file_id) AS files FROM faces a JOIN faces b
    ON a.file_id = b.file_id AND a.person_id <> b.person_id GROUP BY 1, 2 HAVING count(DISTINCT a.file_id) >= 2""", "faces")
def co_occurrence(spark, sf_dir):
    return analytics.co_occurrence(faces(spark, sf_dir), min_count=2)


@Q.query("""SELECT person_id, count(DISTINCT file_id) AS photo_count, count(*) AS face_count FROM faces WHERE person_id IS NOT NULL GROUP BY 1""", "faces")
def person_photo_counts(spark, sf_dir):
    return analytics.photo_counts(faces(spark, sf_dir))


@Q.query("""SELECT l_partkey AS tag_id, count(*) AS uses FROM lineitem GROUP BY 1 ORDER BY uses DESC, tag_id LIMIT 50""")
def popular_tags(spark, sf_dir):
    return analytics.top_values(table(spark, sf_dir, "lineitem"), "l_partkey", 50).select(F.col("l_partkey").alias("tag_id"), "uses")


@Q.query("""SELECT photo_id, kind FROM photos WHERE kind IN ('click', 'error') AND us >= epoch_us(TIMESTAMP '2024-01-01') AND value > 10 ORDER BY us DESC, photo_id LIMIT 20 OFFSET 40""", "photos")
def action_log_page(spark, sf_dir):
    from gritstone.operators.actions import log_page

    log = photos(spark, sf_dir).where("value > 10")
    return log_page(log, kinds=["click", "error"], start_us=1704067200000000, limit=20, offset=40).select("photo_id", "kind")


@Q.query("""SELECT kind, count(*) AS actions, sum(value) AS total FROM photos GROUP BY 1""", "photos")
def action_counts(spark, sf_dir):
    return photos(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("actions"), F.sum("value").alias("total"))


@Q.query(f"""SELECT drive_id, count(*) AS files, sum(size)::BIGINT AS bytes, max(modified_s) AS newest FROM files WHERE {LIVE} GROUP BY 1""", "files")
def drive_stats(spark, sf_dir):
    return dedup.live(files(spark, sf_dir)).groupBy("drive_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("modified_s").alias("newest"))


@Q.query(f"SELECT id, path FROM files WHERE {LIVE} AND lower(path) LIKE '/src3/en/%'", "files")
def files_by_path_prefix(spark, sf_dir):
    from gritstone.functions.paths import under

    return dedup.live(files(spark, sf_dir)).where(under("path", "/SRC3/en")).select("id", "path")


@Q.query(f"SELECT id, file_type FROM files WHERE {LIVE} AND lower(file_type) IN ('.jpg', '.png')", "files")
def files_by_type(spark, sf_dir):
    return dedup.live(files(spark, sf_dir)).where(F.lower("file_type").isin(".jpg", ".png")).select("id", "file_type")


@Q.query(f"SELECT id FROM files WHERE id > 100 AND {LIVE} ORDER BY id LIMIT 200", "files")
def keyset_page(spark, sf_dir):
    return dedup.live(files(spark, sf_dir)).where("id > 100").orderBy("id").limit(200).select("id")


@Q.query(f"SELECT DISTINCT content_hash FROM files WHERE {LIVE} AND drive_id = 'src4' AND content_hash IS NOT NULL", "files")
def drive_hashes(spark, sf_dir):
    return dedup.live(files(spark, sf_dir)).where("drive_id = 'src4' and content_hash is not null").select("content_hash").distinct()


@Q.query("""SELECT DISTINCT regexp_extract(path, '^/src5/([^/]+)/', 1) AS name FROM files WHERE starts_with(path, '/src5/')""", "files")
def subdirectories(spark, sf_dir):
    from gritstone.functions.paths import child_directories

    return child_directories(files(spark, sf_dir), "/src5")


@Q.query(f"""SELECT f.id, f.filename, q.id IS NOT NULL AS has_summary FROM files f LEFT JOIN quality q ON q.id = f.id
    WHERE {LIVE} AND regexp_full_match(path, '/src5/en/d3/[^/]*')""", ("files", "quality"))
def folder_files(spark, sf_dir):
    from gritstone.functions.paths import direct_child

    rows = dedup.live(files(spark, sf_dir)).where(direct_child("path", "/src5/en/d3"))
    flag = quality(spark, sf_dir).select("id", F.lit(True).alias("known"))
    return rows.join(flag, "id", "left").select("id", "filename", F.coalesce("known", F.lit(False)).alias("has_summary"))


@Q.query("""SELECT group_id, count(DISTINCT drive_id) AS drives, CASE WHEN count(DISTINCT drive_id) > 1 THEN 'cross' ELSE 'single' END AS scope
    FROM members JOIN files USING (id) GROUP BY 1""", ("files", "members"))
def group_scope(spark, sf_dir):
    rows = members(spark, sf_dir).join(files(spark, sf_dir).select("id", "drive_id"), "id")
    n = F.countDistinct("drive_id")
    return rows.groupBy("group_id").agg(n.alias("drives"), F.when(n > 1, "cross").otherwise("single").alias("scope"))


@Q.query("""SELECT group_id, count(*) AS file_count, sum(size)::BIGINT AS total_size, (sum(size) - min(size))::BIGINT AS wasted_size FROM members JOIN files USING (id)
    GROUP BY 1 ORDER BY wasted_size DESC, group_id LIMIT 20""", ("files", "members"))
def largest_groups(spark, sf_dir):
    rows = dedup.group_rows(members(spark, sf_dir), files(spark, sf_dir))
    return rows.orderBy(F.desc("wasted_size"), "group_id").limit(20).select("group_id", "file_count", "total_size", "wasted_size")


@Q.query("""WITH e AS (SELECT group_id, id FROM members WHERE group_id % 2 = 0), c AS (SELECT group_id, count(*) AS n FROM members GROUP BY 1)
    SELECT group_id FROM c WHERE group_id NOT IN (SELECT m.group_id FROM members m JOIN e USING (id) JOIN c ON c.group_id = m.group_id GROUP BY m.group_id, e.group_id, c.n HAVING count(DISTINCT m.id) = c.n)""".replace("WITH e AS", ", e AS"), "members")
def existing_group_division(spark, sf_dir):
    rows = members(spark, sf_dir)
    return dedup.uncovered_groups(rows, rows.where("group_id % 2 = 0"))


@Q.query("""SELECT pattern, count(*) AS files, sum(size)::BIGINT AS bytes FROM files JOIN (VALUES ('*.mp4'), ('*/d3/*'), ('*.zip'), ('*.p*')) p(pattern)
    ON drive_id = 'src0' AND regexp_full_match(path, replace(replace(pattern, '.', '\\.'), '*', '.*')) GROUP BY 1""", "files")
def exclusion_candidates(spark, sf_dir):
    return redundancy.exclusion_candidates(files(spark, sf_dir).where("drive_id = 'src0'"), ["*.mp4", "*/d3/*", "*.zip", "*.p*"])


@Q.query("""WITH d AS (SELECT '/'||s||x AS root, s AS drive FROM (SELECT DISTINCT source AS s FROM documents), (VALUES (''), ('/en'), ('/en/d1')) v(x))
    SELECT id, max_by(root, length(root)) AS root FROM files JOIN d ON path = root OR starts_with(path, root||'/') GROUP BY id""".replace("WITH d AS", ", d AS"), "files")
def longest_prefix_drive(spark, sf_dir):
    roots = table(spark, sf_dir, "documents").select("source").distinct().withColumn("x", F.explode(F.array(F.lit(""), F.lit("/en"), F.lit("/en/d1"))))
    return redundancy.longest_prefix(files(spark, sf_dir), roots.select(F.concat(F.lit("/"), "source", "x").alias("root"))).select("id", "root")


@Q.query("""SELECT n_name AS name, r_name AS region, count(c_custkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def family_group_members(spark, sf_dir):
    nation, region, customer = (table(spark, sf_dir, n) for n in ("nation", "region", "customer"))
    counted = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(counted, "n_nationkey", "left").select(F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.coalesce("members", F.lit(0)).alias("members"))


@Q.query("""SELECT l_suppkey AS tag, l_orderkey AS file, min(l_discount) AS confidence FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    WHERE l_discount >= 0.05 GROUP BY 1, 2 ORDER BY confidence DESC, tag, file LIMIT 100""")
def files_by_tag(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_discount >= 0.05").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi")
    best = rows.groupBy(F.col("l_suppkey").alias("tag"), F.col("l_orderkey").alias("file")).agg(F.min("l_discount").alias("confidence"))
    return best.orderBy(F.desc("confidence"), "tag", "file").limit(100)
