"""Bursts, events, chains, gaps and numbering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gritstone.catalog import faces, files, photos, quality
from gritstone.functions.vectors import cosine
from gritstone.operators import names, timeline
from gritstone.queries.book import Book

Q = Book()
_ISLAND = """, b AS (SELECT *, coalesce((us - lag(us) OVER w > {gap})::INT, 0) AS n FROM photos WINDOW w AS (PARTITION BY owner ORDER BY us, photo_id)),
    i AS (SELECT *, sum(n) OVER (PARTITION BY owner ORDER BY us, photo_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM b)"""


@Q.query(_ISLAND.format(gap=1_800_000_000) + " SELECT owner, island, min(us) AS first, max(us) AS last, count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) >= 3", "photos")
def bursts(spark, sf_dir):
    return timeline.sessions(photos(spark, sf_dir), ["owner"], "us", 1_800_000_000, "photo_id", least=3)


@Q.query(_ISLAND.format(gap=14_400_000_000) + " SELECT owner, island, min(us) AS first, max(us) AS last, count(*) AS n FROM i GROUP BY 1, 2", "photos")
def photo_events(spark, sf_dir):
    return timeline.sessions(photos(spark, sf_dir), ["owner"], "us", 14_400_000_000, "photo_id")


@Q.query(_ISLAND.format(gap=1_800_000_000) + " SELECT owner, island, photo_id FROM i QUALIFY row_number() OVER (PARTITION BY owner, island ORDER BY value DESC NULLS LAST, photo_id) = 1", "photos")
def best_of_bursts(spark, sf_dir):
    rows = timeline.islands(photos(spark, sf_dir).where("us is not null"), ["owner"], "us", 1_800_000_000, "photo_id").withColumn("size", F.lit(0))
    return timeline.best_of_burst(rows, ["owner", "island"], "value", "size", "photo_id").select("owner", "island", "photo_id")


@Q.query("""SELECT id, CASE WHEN modified_s IS NULL THEN 'Undated' ELSE strftime(make_timestamp(modified_s * 1000000), '%Y/%m-%B') END AS folder,
    row_number() OVER (PARTITION BY CASE WHEN modified_s IS NULL THEN 'Undated' ELSE strftime(make_timestamp(modified_s * 1000000), '%Y/%m-%B') END ORDER BY modified_s NULLS LAST, id)::INT AS sequence
    FROM files WHERE NOT is_deleted""", "files")
def sequence_numbers(spark, sf_dir):
    from gritstone.functions.dates import folder

    rows = files(spark, sf_dir).where("not is_deleted")
    return timeline.numbered(rows, folder(F.timestamp_seconds("modified_s"), "year_month_name"), "modified_s", "id").select("id", "folder", "sequence")


@Q.query("""SELECT person_id, (year + 1)::INT AS gap_start, (nxt - 1)::INT AS gap_end, (nxt - year - 1)::INT AS years FROM
    (SELECT person_id, year, lead(year) OVER (PARTITION BY person_id ORDER BY year) AS nxt FROM (SELECT DISTINCT person_id, year FROM faces WHERE person_id IS NOT NULL AND true)) WHERE nxt - year > 1""", "faces")
def chain_gaps(spark, sf_dir):
    return timeline.year_gaps(faces(spark, sf_dir), "person_id")


@Q.query("""SELECT person_id, year, count(*) AS faces, min(face_id) AS first_face FROM faces WHERE person_id IS NOT NULL GROUP BY 1, 2""", "faces")
def person_timeline(spark, sf_dir):
    return faces(spark, sf_dir).where("person_id is not null").groupBy("person_id", "year").agg(F.count("*").alias("faces"), F.min("face_id").alias("first_face"))


@Q.query("SELECT person_id, floor(median(year - age))::INT AS birth_year FROM faces WHERE person_id IS NOT NULL AND age IS NOT NULL GROUP BY 1", "faces")
def birth_year_median(spark, sf_dir):
    return timeline.birth_year(faces(spark, sf_dir))


@Q.query("""SELECT face_id, age - (year - birth_year) AS error FROM faces WHERE person_id IS NOT NULL AND age IS NOT NULL""", "faces")
def age_accuracy(spark, sf_dir):
    return faces(spark, sf_dir).where("person_id is not null and age is not null").select("face_id", (F.col("age") - (F.col("year") - F.col("birth_year"))).alias("error"))


@Q.query("""SELECT face_id, CASE WHEN year - birth_year < 0 THEN false WHEN age IS NULL THEN true ELSE abs(age - (year - birth_year)) <= CASE WHEN year - birth_year < 12 THEN 10 ELSE 8 END END AS plausible FROM faces""", "faces")
def age_plausibility(spark, sf_dir):
    return faces(spark, sf_dir).select("face_id", timeline.plausible(F.col("age"), F.col("birth_year"), F.col("year")).alias("plausible"))


@Q.query("""SELECT file_id, label AS person_id, face_id FROM (SELECT faces.*, vec_id, label FROM faces JOIN embeddings ON vec_id = face_id)
    WHERE confidence >= 0.2 QUALIFY row_number() OVER (PARTITION BY file_id, label ORDER BY confidence DESC, face_id) = 1""", "faces")
def photo_conflicts(spark, sf_dir):
    from gritstone.catalog import table

    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("face_id"), "label")
    rows = faces(spark, sf_dir).drop("person_id").join(labels, "face_id").select("face_id", "file_id", F.col("label").alias("person_id"), F.col("confidence").alias("similarity"))
    checked = rows.withColumn("plausible", F.col("similarity") >= 0.2)
    return timeline.one_per_photo(checked).where("accepted").select("file_id", "person_id", "face_id")


@Q.query("""SELECT person_id, face_id, nxt AS next_id, days::BIGINT AS days, CASE WHEN sim >= t THEN 'auto' WHEN sim >= 0.7 * t THEN 'weak' ELSE 'break' END AS link FROM (SELECT *, CASE WHEN days <= 1 THEN 0.5::DOUBLE WHEN days <= 30 THEN 0.6 WHEN days <= 365 THEN 0.7 ELSE 0.8 END AS t FROM
    (SELECT person_id, face_id, lead(face_id) OVER w AS nxt, (lead(taken_h) OVER w - taken_h) // 24 AS days, list_cosine_similarity(embedding::DOUBLE[], (lead(embedding) OVER w)::DOUBLE[]) AS sim FROM faces WHERE person_id IS NOT NULL WINDOW w AS (PARTITION BY person_id ORDER BY taken_h, face_id)) WHERE nxt IS NOT NULL)""", "faces")
def temporal_chain(spark, sf_dir):
    w = Window.partitionBy("person_id").orderBy("taken_h", "face_id")
    rows = faces(spark, sf_dir).where("person_id is not null").withColumn("next_id", F.lead("face_id").over(w)).withColumn("_e", F.lead("embedding").over(w)).withColumn("_h", F.lead("taken_h").over(w))
    rows = rows.where("next_id is not null")
    return timeline.chain(rows, cosine("embedding", "_e"), F.floor((F.col("_h") - F.col("taken_h")) / 24)).select("person_id", "face_id", "next_id", "days", "link")


@Q.query("""SELECT a.id AS left_id, arg_min(b.id, (abs(a.modified_s - b.modified_s), b.modified_s, b.id)) AS right_id, min(abs(a.modified_s - b.modified_s)) AS distance FROM files a JOIN files b ON a.lang = b.lang
    AND a.file_type = '.jpg' AND b.file_type = '.mp4' AND abs(a.modified_s - b.modified_s) <= 600000 GROUP BY 1""", "files")
def nearest_live_photo(spark, sf_dir):
    rows = files(spark, sf_dir).where("modified_s is not null").select("id", "lang", "modified_s", "file_type")
    return timeline.nearest_within(rows.where("file_type = '.jpg'"), rows.where("file_type = '.mp4'"), "lang", "modified_s", 600_000)


_LIVE = """, r AS (SELECT id, CASE WHEN id % 3 = 0 THEN (id // 48)::VARCHAR END AS content_id, regexp_replace(path, '/[^/]*$', '') AS folder, ((id // 100)::VARCHAR) AS stem, file_type FROM files),
    f AS (SELECT i.id AS image_id, v.video_id, 'content_id' AS how FROM r i JOIN (SELECT content_id, min(id) AS video_id FROM r WHERE file_type = '.mp4' AND content_id IS NOT NULL GROUP BY 1) v USING (content_id) WHERE i.file_type = '.jpg')"""


@Q.query(_LIVE + """ SELECT * FROM f UNION ALL SELECT i.id, v.video_id, 'stem' FROM r i JOIN (SELECT folder, stem, min(id) AS video_id FROM r WHERE file_type = '.mp4' AND id NOT IN (SELECT video_id FROM f) GROUP BY 1, 2) v
    USING (folder, stem) WHERE i.file_type = '.jpg' AND i.id NOT IN (SELECT image_id FROM f)""", "files")
def live_photo_pairs(spark, sf_dir):
    from gritstone.functions.paths import dirname

    rows = files(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 48).cast("string")).alias("content_id"), dirname("path").alias("folder"), F.floor(F.col("id") / 100).cast("string").alias("stem"), "file_type")
    return timeline.live_pairs(rows.where("file_type = '.jpg'").drop("file_type"), rows.where("file_type = '.mp4'").drop("file_type"))


@Q.query("SELECT id, quality_score, row_number() OVER (ORDER BY quality_score DESC NULLS LAST, id)::INT AS rank FROM quality ORDER BY rank LIMIT 50", "quality")
def quality_ranking(spark, sf_dir):
    top = quality(spark, sf_dir).orderBy(F.desc_nulls_last("quality_score"), "id").limit(50)
    return top.select("id", "quality_score", F.row_number().over(Window.orderBy(F.desc_nulls_last("quality_score"), "id")).alias("rank"))


_CLAIMS = """, c AS (SELECT id, drive_id||'/'||lang AS folder, CASE WHEN id % 7 = 0 THEN 'f'||(id % 5)||'_002' ELSE 'F'||(id % 5) END||coalesce(file_type, '') AS name FROM files WHERE NOT is_deleted),
    e AS (SELECT DISTINCT drive_id||'/'||lang AS folder, lower('f'||(id % 5)||CASE WHEN id % 2 = 0 THEN '_003' ELSE '' END||coalesce(file_type, '')) AS low FROM files WHERE is_deleted),
    n AS (SELECT *, lower(name) AS low, regexp_extract(lower(name), '^.+(\\.[^.]*)$', 1) AS ext FROM c),
    b AS (SELECT folder, low, min(id) AS id FROM n WHERE (folder, low) NOT IN (SELECT (folder, low) FROM e) GROUP BY 1, 2),
    r AS (SELECT *, left(low, length(low) - length(ext)) AS stem FROM n WHERE id NOT IN (SELECT id FROM b)), k AS (SELECT *, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY id) AS rank FROM r),
    u AS (SELECT folder, low FROM e UNION SELECT folder, low FROM b), m AS (SELECT folder, stem, ext, count(*) AS most FROM k GROUP BY ALL),
    g AS (SELECT folder, stem, ext, unnest(generate_series(2, 2 + most + 1000)) AS number FROM m),
    f AS (SELECT g.*, row_number() OVER (PARTITION BY g.folder, stem, ext ORDER BY number) AS rank FROM g LEFT JOIN u ON u.folder = g.folder AND u.low = stem||'_'||lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INT, '0')||ext WHERE u.low IS NULL)"""


@Q.query(_CLAIMS + """ SELECT id, c.name AS final FROM c JOIN b USING (id) UNION ALL
    SELECT id, left(name, length(name) - length(k.ext))||'_'||lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INT, '0')||right(name, length(k.ext)) FROM k JOIN f USING (folder, stem, ext, rank)""", "files")
def free_names(spark, sf_dir):
    """Where files would go if all of a folder's were renamed to a few names, beside those that are there."""
    rows = files(spark, sf_dir).withColumn("place", F.concat("drive_id", F.lit("/"), "lang")).withColumn("ext", F.coalesce("file_type", F.lit("")))
    digit = (F.col("id") % 5).cast("string")
    wanted = F.when(F.col("id") % 7 == 0, F.concat(F.lit("f"), digit, F.lit("_002"))).otherwise(F.concat(F.lit("F"), digit))
    claims = rows.where("not is_deleted").select("id", F.col("place").alias("folder"), F.concat(wanted, "ext").alias("name"))
    there = rows.where("is_deleted").select(F.col("place").alias("folder"), F.concat(F.lit("f"), digit, F.when(F.col("id") % 2 == 0, "_003").otherwise(""), "ext").alias("name"))
    return names.allocate(claims, there).select("id", "final")
