"""Look-ups, work-lists, timelines, logs and dates over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.catalog import faces, files, photos, quality, table
from gritstone.functions import scalars
from gritstone.operators import lookups, people
from gritstone.queries.book import Book
from gritstone.queries.people import persons
from gritstone.sources import exif

Q = Book()
_P = "p AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, n_nationkey % 6 = 5 AS is_hidden FROM nation)"


@Q.query("""SELECT id, 'own' AS how FROM files WHERE drive_id = 'src3' AND path = (SELECT min(path) FROM files WHERE drive_id = 'src3') UNION ALL SELECT id, 'any' FROM files WHERE NOT is_deleted AND path = (SELECT max(path) FROM files)""", "files")
def file_lookups(spark, sf_dir):
    rows = files(spark, sf_dir)
    low, high = rows.agg(F.min(F.when(F.col("drive_id") == "src3", F.col("path"))), F.max("path")).first()
    return lookups.file_by_path(rows, low, "src3").select("id", F.lit("own").alias("how")).unionByName(lookups.file_by_path(rows, high).select("id", F.lit("any").alias("how")))


@Q.query("SELECT id FROM files WHERE NOT is_deleted AND file_type IN ('.jpg', '.png')", "files")
def image_files(spark, sf_dir):
    return lookups.image_files(files(spark, sf_dir)).select("id")


@Q.query("SELECT face_id FROM faces WHERE person_id IS NULL AND confidence >= 0.5::DOUBLE", "faces")
def unassigned_faces(spark, sf_dir):
    return lookups.unassigned(faces(spark, sf_dir), "person_id", 0.5).select("face_id")


@Q.query("SELECT face_id FROM faces JOIN files ON files.id = file_id WHERE person_id IS NULL AND confidence >= 0.2::DOUBLE AND starts_with(path, '/src1/')", ("files", "faces"))
def unassigned_in_folder(spark, sf_dir):
    return lookups.unassigned_under(faces(spark, sf_dir), files(spark, sf_dir), "/SRC1", 0.2).select("face_id")


@Q.query("SELECT face_id, file_id FROM faces WHERE face_id IN (SELECT item_id * 7 FROM benchmark)", "faces")
def faces_by_ids(spark, sf_dir):
    return lookups.by_ids(faces(spark, sf_dir), table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("face_id")), "face_id").select("face_id", "file_id")


@Q.query("SELECT id, lower(path) LIKE '/src1/%' OR lower(path) LIKE '/src2/en%' AS protected FROM files", "files")
def protected_paths(spark, sf_dir):
    return files(spark, sf_dir).select("id", lookups.protected("path", ("/SRC1/", "/src2/EN")).alias("protected"))


@Q.query(r"SELECT id FROM files WHERE size <= 5000 AND (regexp_matches(path, '\.txt$') OR regexp_matches(path, '(^|/)d3/[^/]*$')) AND NOT regexp_matches(path, '(^|/)f[^/]9\.[^/]*$')", "files")
def tracked_files(spark, sf_dir):
    return lookups.tracked(files(spark, sf_dir), 5_000, ("*.txt", "d3/*"), ("f?9.*",)).select("id")


@Q.query("SELECT face_id AS id, confidence AS similarity FROM faces WHERE face_id % 5 <> 0 AND confidence < (0.3 + face_id % 4 * 0.2)::DOUBLE * 0.7::DOUBLE", "faces")
def weak_links(spark, sf_dir):
    rows = faces(spark, sf_dir).select(F.col("face_id").alias("id"), F.col("confidence").alias("similarity"), F.when(F.col("face_id") % 5 != 0, (F.lit(3) + F.col("face_id") % 4 * 2) / F.lit(10.0)).alias("threshold_used"))
    return lookups.weak_links(rows).select("id", "similarity")


@Q.query("SELECT face_id AS id, confidence FROM faces WHERE face_id % 3 = 1 ORDER BY confidence DESC, face_id LIMIT 100", "faces")
def pending_matches(spark, sf_dir):
    rows = faces(spark, sf_dir).select(F.col("face_id").alias("id"), "confidence", F.when(F.col("face_id") % 3 == 1, "pending").otherwise("confirmed").alias("status"))
    return lookups.pending(rows, 100).select("id", "confidence")


@Q.query(f"WITH {_P} SELECT id, name FROM p WHERE NOT is_hidden AND name <> ''")
def visible_persons(spark, sf_dir):
    return people.visible(persons(spark, sf_dir), named_only=True).select("id", "name")


@Q.query("SELECT person_id AS pet_id, year, count(*) AS n, string_agg(face_id::VARCHAR, ',' ORDER BY face_id) AS ids FROM faces WHERE person_id IS NOT NULL GROUP BY 1, 2", "faces")
def pet_timeline(spark, sf_dir):
    found = lookups.timeline(faces(spark, sf_dir).withColumnRenamed("person_id", "pet_id"), "pet_id", "face_id")
    return found.select("pet_id", "year", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@Q.query("SELECT person_id AS pet_id, CASE WHEN age < 2 THEN 'young' WHEN age < 10 THEN 'adult' WHEN age IS NOT NULL THEN 'senior' ELSE 'unknown' END AS stage, count(*) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY ALL", "faces")
def life_stages(spark, sf_dir):
    stage = F.when(F.col("age") < 2, "young").when(F.col("age") < 10, "adult").when(F.col("age").isNotNull(), "senior")
    return lookups.stage_counts(faces(spark, sf_dir).withColumnRenamed("person_id", "pet_id").withColumn("stage", stage), "pet_id", "stage")


@Q.query("""SELECT id, kind, CASE kind WHEN 'TEXT' THEN 0 WHEN 'IMAGE' THEN 1 WHEN 'VISUAL_DOC' THEN 2 WHEN 'VIDEO' THEN 3 WHEN 'AUDIO' THEN 4 ELSE 5 END::INT AS stage FROM (SELECT id,
    CASE WHEN file_type IN ('.txt', '.cr2') THEN 'TEXT' WHEN file_type IN ('.jpg', '.png') THEN 'IMAGE' WHEN file_type IN ('.pdf', '.docx') THEN 'VISUAL_DOC' WHEN file_type = '.mp4' THEN 'VIDEO' ELSE 'SKIP' END AS kind
    FROM files WHERE NOT is_deleted AND starts_with(path, '/src2/') AND id NOT IN (SELECT doc_id FROM labels))""", "files")
def summary_worklist(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return lookups.summary_work(files(spark, sf_dir), done, "/src2")


@Q.query("""SELECT face_id, row_number() OVER (ORDER BY modified_s DESC NULLS LAST, face_id) AS place FROM faces JOIN files ON files.id = file_id QUALIFY place <= 60""", ("files", "faces"))
def gallery_sorted(spark, sf_dir):
    rows = faces(spark, sf_dir).join(files(spark, sf_dir).select(F.col("id").alias("file_id"), "filename", F.col("modified_s").alias("photo_date")), "file_id").withColumn("similarity", F.col("confidence"))
    top = lookups.gallery_order(rows, "date_desc").limit(60).select("face_id", "photo_date")
    from pyspark.sql import Window

    return top.select("face_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("photo_date"), "face_id")).cast("long").alias("place"))


_ORDERS = {"date_asc": "modified_s ASC NULLS FIRST", "name": "lower(coalesce(filename, ''))", "similarity_desc": "confidence DESC NULLS LAST", "similarity_asc": "confidence ASC NULLS FIRST"}


@Q.query(" UNION ALL ".join(f"SELECT '{name}' AS sorted_by, face_id, row_number() OVER (ORDER BY {order}, face_id) AS place FROM faces JOIN files ON files.id = file_id QUALIFY place <= 60" for name, order in _ORDERS.items()), ("files", "faces"))
def gallery_orders(spark, sf_dir):
    """The first screen of a gallery in each of its other four orders."""
    from pyspark.sql import Window

    rows = faces(spark, sf_dir).join(files(spark, sf_dir).select(F.col("id").alias("file_id"), "filename", F.col("modified_s").alias("photo_date")), "file_id").withColumn("similarity", F.col("confidence"))
    keys = {"date_asc": F.asc_nulls_first("photo_date"), "name": F.lower("filename"), "similarity_desc": F.desc_nulls_last("similarity"), "similarity_asc": F.asc_nulls_first("similarity")}
    out = None
    for name, key in keys.items():
        top = lookups.gallery_order(rows, name).limit(60)
        placed = top.select(F.lit(name).alias("sorted_by"), "face_id", F.row_number().over(Window.orderBy(key, "face_id")).cast("long").alias("place"))
        out = placed if out is None else out.unionByName(placed)
    return out


@Q.query(f""", {_P}, r AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 5), g AS (SELECT person_id, max(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM r))) AS score FROM faces WHERE person_id IS NOT NULL GROUP BY 1)
    SELECT id AS person_id, name || CASE WHEN score IS NULL THEN ' (n/a)' ELSE printf(' (%.2f)', score) END AS label, round(score, 9) AS score FROM p LEFT JOIN g ON person_id = id WHERE NOT is_hidden""", "faces")
def assign_map(spark, sf_dir):
    rows = faces(spark, sf_dir).where("person_id is not null")
    reference = table(spark, sf_dir, "embeddings").where("vec_id = 5").select(F.col("embedding").cast("array<double>")).first()[0]
    return lookups.assign_map(persons(spark, sf_dir), rows, list(reference)).withColumn("score", F.round("score", 9))


@Q.query("SELECT id FROM files WHERE id % 4 IN (0, 2)", "files")
def object_files(spark, sf_dir):
    lists = F.element_at(F.array(*map(F.lit, ('["Dog", "tree"]', '["hotdog"]', '["cat", "DOG"]', "dog"))), (F.col("id") % 4 + 1).cast("int"))
    return lookups.with_object(files(spark, sf_dir).select("id", lists.alias("objects")), "dog").select("id")


@Q.query("""SELECT id, trim(coalesce(CASE WHEN id % 3 = 0 THEN lang END, '') || ' ' || coalesce(CASE WHEN id % 5 = 0 THEN drive_id END, '') || ' ' || coalesce(CASE WHEN id % 7 = 0 THEN '  ' END, '')) AS text
    FROM files WHERE NOT is_deleted AND (id % 3 = 0 OR id % 5 = 0)""", "files")
def corpus_documents(spark, sf_dir):
    rows = files(spark, sf_dir)
    texts = rows.where("id % 3 = 0").select("id", F.col("lang").alias("extracted_text"))
    summaries = rows.where("id % 5 = 0 or id % 7 = 0").select("id", F.when(F.col("id") % 5 == 0, F.col("drive_id")).alias("summary"), F.when(F.col("id") % 7 == 0, "  ").alias("document_summary"))
    return lookups.corpus_documents(rows, texts, summaries)


@Q.query("SELECT DISTINCT file_id FROM faces JOIN nation ON n_nationkey = person_id JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'", "faces")
def family_files(spark, sf_dir):
    members = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").cast("int").alias("person_id"))
    groups = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return lookups.family_files(faces(spark, sf_dir), members, groups, "ASIA")


@Q.query("SELECT lang AS day, count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE drive_id = 'src1' GROUP BY ROLLUP (lang) HAVING count(*) > 0", "files")
def quarantine_stats(spark, sf_dir):
    return lookups.quarantine_stats(files(spark, sf_dir), "/src1")


@Q.query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 0 THEN 'error' WHEN n_nationkey % 5 = 0 THEN 'scanning' WHEN n_nationkey % 3 = 0 THEN 'disconnected' WHEN n_nationkey % 2 = 0 THEN 'needs_scan' ELSE 'connected' END AS status FROM nation""")
def drive_states(spark, sf_dir):
    k = F.col("n_nationkey")
    drives = table(spark, sf_dir, "nation").select(k.alias("id"), (k % 7 != 0).alias("known"), (k % 5 == 0).alias("scanning"), (k % 3 != 0).alias("present"), F.when(k % 2 != 0, F.lit(1)).alias("last_scan"))
    return lookups.drive_states(drives).select("id", "status")


def version_log(spark, sf_dir):
    """Each event is a version of its user's file."""
    return photos(spark, sf_dir).select(F.concat(F.lit("c"), F.col("photo_id").cast("string")).alias("commit_id"), F.col("us").alias("committed_at"), F.concat(F.lit("edit "), "kind").alias("message"), F.concat(F.lit("/f"), F.col("owner").cast("string")).alias("path"), F.floor(F.col("value") * 10).cast("long").alias("size"), F.md5("kind").alias("content_hash"))


_LOG = "l AS (SELECT 'c'||photo_id AS commit_id, us AS committed_at, 'edit '||kind AS message, '/f'||owner AS path, floor(value * 10)::BIGINT AS size, md5(kind) AS content_hash FROM photos)"


@Q.query(f", {_LOG} SELECT path, committed_at, message FROM l ORDER BY committed_at DESC, path LIMIT 50", "photos")
def recent_changes(spark, sf_dir):
    return lookups.recent_changes(version_log(spark, sf_dir), 50)


@Q.query(f", {_LOG} SELECT commit_id, size, size - coalesce(lag(size) OVER (ORDER BY committed_at, commit_id), 0) AS delta FROM l WHERE path = (SELECT min(path) FROM l)", "photos")
def file_history(spark, sf_dir):
    log = version_log(spark, sf_dir)
    return lookups.history(log, log.agg(F.min("path")).first()[0]).select("commit_id", "size", "delta")


@Q.query(f""", {_LOG}, b AS (SELECT path, max_by(content_hash, (committed_at, commit_id)) AS h FROM l GROUP BY 1), s AS (SELECT path, 7::BIGINT AS size, md5('view') AS content_hash FROM b UNION ALL SELECT '/new', 1, md5('x'))
    SELECT s.path, s.size, s.content_hash FROM s LEFT JOIN b USING (path) WHERE b.h IS DISTINCT FROM s.content_hash""", "photos")
def snapshot_commit(spark, sf_dir):
    log = version_log(spark, sf_dir)
    now = log.select("path").distinct().select("path", F.lit(7).cast("long").alias("size"), F.md5(F.lit("view")).alias("content_hash"))
    now = now.unionByName(spark.range(1).select(F.lit("/new").alias("path"), F.lit(1).cast("long").alias("size"), F.md5(F.lit("x")).alias("content_hash")))
    return lookups.commits(log, now, "snapshot", F.lit(9_000_000_000_000_000)).where("message = 'snapshot'").select("path", "size", "content_hash")


@Q.query("""SELECT photo_id AS id, CASE WHEN photo_id % 3 = 0 THEN 'exif' WHEN photo_id % 5 <> 0 THEN 'file' ELSE 'unknown' END AS source,
    CASE WHEN photo_id % 3 = 0 THEN us // 1000000 WHEN photo_id % 5 <> 0 THEN 1400000000 + photo_id END AS at FROM photos""", "photos")
def best_dates(spark, sf_dir):
    rows = photos(spark, sf_dir).withColumn("id", F.col("photo_id"))
    shapes = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd_HHmmss")
    shown = F.element_at(F.array(*[F.date_format(F.timestamp_micros("us"), s) for s in shapes]), (F.col("id") % 9 / 3 + 1).cast("int"))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), shown)).otherwise("no date")
    own = F.when(F.col("id") % 5 != 0, F.timestamp_seconds(F.lit(1_400_000_000) + F.col("id")))
    best = exif.best_date(exif.parse_date(text), F.lit(None).cast("timestamp"), own)
    return rows.select("id", best.alias("b")).select("id", "b.source", F.unix_seconds("b.at").alias("at"))


@Q.query("""SELECT id, gps AS has_gps, CASE WHEN w > 0 AND h > 0 THEN w || 'x' || h END AS resolution FROM (SELECT id, has_gps AND id % 2 = 0 AS gps, CASE WHEN id % 4 <> 1 THEN width ELSE 0 END AS w, height AS h FROM quality)""", "quality")
def position_and_size(spark, sf_dir):
    rows = quality(spark, sf_dir).select("id", F.when(F.col("has_gps"), 1.5).alias("lat"), F.when(F.col("id") % 2 == 0, 2.5).alias("lon"), F.when(F.col("id") % 4 != 1, F.col("width")).otherwise(0).alias("w"), F.col("height").alias("h"))
    size = scalars.resolution(F.col("w"), F.col("h"))
    return rows.select("id", scalars.has_gps(F.col("lat"), F.col("lon")).alias("has_gps"), F.when(size.isNotNull(), F.concat_ws("x", size["width"], size["height"])).alias("resolution"))


@Q.query("""SELECT id, CASE WHEN id % 3 = 0 THEN 'Ann,Bob' WHEN id % 3 = 1 THEN '' ELSE '' END AS people, CASE WHEN id % 3 = 0 THEN 'home|http://a' ELSE '' END AS url FROM files""", "files")
def stored_json(spark, sf_dir):
    entities = F.when(F.col("id") % 3 == 0, '{"people": ["Ann", "Bob"], "places": []}').when(F.col("id") % 3 == 1, "[broken")
    urls = F.when(F.col("id") % 3 == 0, '[{"label": "home", "url": "http://a"}]').when(F.col("id") % 3 == 1, "nothing")
    found = files(spark, sf_dir).select("id", scalars.entity_lists(entities).alias("e"), scalars.url_list(urls).alias("u"))
    return found.select("id", F.coalesce(F.array_join(F.col("e")["people"], ","), F.lit("")).alias("people"), F.array_join(F.transform("u", lambda x: F.concat(x["label"], F.lit("|"), x["url"])), ",").alias("url"))


@Q.query("""SELECT a.id, CASE WHEN lower(a.path) < lower(b.path) THEN -1 WHEN lower(a.path) = lower(b.path) THEN 0 ELSE 1 END::INT AS side FROM files a JOIN files b ON b.id = a.id // 2""", "files")
def path_sides(spark, sf_dir):
    rows = files(spark, sf_dir).select("id", "path")
    other = rows.select(F.col("id").alias("half"), F.upper("path").alias("q"))
    return rows.join(other, F.floor(F.col("id") / 2) == F.col("half")).select("id", scalars.compare_paths(F.col("path"), F.col("q")).alias("side"))


@Q.query("""SELECT photo_id, 'export_' || strftime(make_timestamp(us), '%Y%m%d_%H%M%S') || '.csv' AS name FROM photos""", "photos")
def export_names(spark, sf_dir):
    return photos(spark, sf_dir).select("photo_id", scalars.timestamped_name("export", "csv", F.timestamp_micros("us")).alias("name"))


@Q.query("""WITH n AS (SELECT id, size, modified_s FROM files) SELECT id, CASE WHEN id % 4 = 0 THEN 'new' WHEN id % 4 = 1 THEN 'removed' ELSE 'modified' END AS change, FALSE AS stable FROM n WHERE id % 4 < 3
    UNION ALL SELECT id, 'same', size > 0 FROM n WHERE id % 4 = 3""".replace("WITH n AS (SELECT id, size, modified_s FROM files)", ", n AS (SELECT id, size, coalesce(modified_s, 0) AS modified_s FROM files)"), "files")
def folder_looks(spark, sf_dir):
    rows = files(spark, sf_dir).select(F.col("id").cast("string").alias("path"), "size", F.coalesce("modified_s", F.lit(0)).alias("modified_s"))
    k = F.col("path").cast("long") % 4
    before, now = rows.where(k != 0), rows.where(k != 1).withColumn("size", F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")))
    changes = lookups.changed_paths(now, before)
    every = rows.select("path").join(changes, "path", "left").join(lookups.stable(now, before).select("path", F.lit(True).alias("s")), "path", "left")
    return every.select(F.col("path").cast("long").alias("id"), F.coalesce("change", F.lit("same")).alias("change"), F.coalesce("s", F.lit(False)).alias("stable"))


@Q.query("""SELECT 'hash' AS stage, count(*) FILTER (content_hash IS NULL) AS missing FROM files WHERE NOT is_deleted UNION ALL SELECT 'quality', count(*) FROM files WHERE NOT is_deleted AND id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'faces', count(*) FROM files WHERE NOT is_deleted AND id NOT IN (SELECT vec_id // 3 FROM embeddings)""", "files")
def analysis_backlog(spark, sf_dir):
    rows = files(spark, sf_dir)
    return lookups.backlog(rows, {"hash": rows.where("content_hash is not null"), "quality": quality(spark, sf_dir), "faces": faces(spark, sf_dir).select(F.col("file_id").alias("id"))})


@Q.query("SELECT owner AS folder, count(*) AS n FROM photos WHERE kind = 'click' GROUP BY 1", "photos")
def waiting_by_folder(spark, sf_dir):
    return lookups.pending_counts(photos(spark, sf_dir).where("kind = 'click'").withColumnRenamed("owner", "folder"))


@Q.query("""SELECT row_number() OVER (ORDER BY p) - 1 AS position, label FROM (SELECT n_nationkey AS p, n_name AS label FROM nation WHERE n_name NOT IN ('FRANCE', 'CHINA') UNION ALL SELECT 101, 'night' UNION ALL SELECT 102, 'snow')""")
def edited_categories(spark, sf_dir):
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("label"))
    return lookups.edited_labels(labels, ("night", "FRANCE", "snow", "night"), ("FRANCE", "CHINA")).select(F.col("position").cast("long").alias("position"), "label")
