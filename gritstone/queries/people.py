"""Persons, pets, tags and the log's undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.catalog import faces, files, photos, quality, table
from gritstone.operators import actions, analytics, match, people, redundancy, timeline
from gritstone.queries.book import Book

Q = Book()


def persons(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.lit(1950) + F.col("n_nationkey") * 7 % 60).alias("birth_year"), (F.col("n_nationkey") % 6 == 5).alias("is_hidden"))


_P = "p AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, 1950 + n_nationkey * 7 % 60 AS birth_year, n_nationkey % 6 = 5 AS is_hidden FROM nation)"
_L = "l AS (SELECT n_nationkey::BIGINT AS a, ((n_nationkey * 3 + 1) % 25)::BIGINT AS b, CASE n_nationkey % 3 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' ELSE 'sibling' END AS kind FROM nation)"


def links(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("a"), ((k * 3 + 1) % 25).cast("long").alias("b"), F.when(k % 3 == 0, "parent").when(k % 3 == 1, "child").otherwise("sibling").alias("kind"))


@Q.query(f"""WITH {_P}, {_L} SELECT a AS person_id, b AS other_id, name AS other_name, kind FROM l JOIN p ON p.id = b
    UNION ALL SELECT b, a, name, CASE kind WHEN 'parent' THEN 'child' WHEN 'child' THEN 'parent' ELSE kind END FROM l JOIN p ON p.id = a""")
def person_relationships(spark, sf_dir):
    return people.relationships(links(spark, sf_dir), persons(spark, sf_dir))


@Q.query(f""", {_P}, {_L}, c AS (SELECT a.person_id, b.person_id AS other, count(DISTINCT a.file_id) AS files FROM faces a JOIN faces b ON a.file_id = b.file_id AND a.person_id <> b.person_id GROUP BY 1, 2 HAVING count(DISTINCT a.file_id) >= 3)
    SELECT person_id, other, CASE WHEN abs(y.birth_year - x.birth_year) <= 5 THEN 'sibling' WHEN y.birth_year - x.birth_year BETWEEN 18 AND 45 THEN 'parent' WHEN y.birth_year - x.birth_year BETWEEN -45 AND -18 THEN 'child' ELSE 'other' END AS kind
    FROM c LEFT JOIN p x ON x.id = person_id LEFT JOIN p y ON y.id = other WHERE NOT EXISTS (SELECT 1 FROM l WHERE (a = person_id AND b = other) OR (b = person_id AND a = other))""", "faces")
def relationship_suggestions(spark, sf_dir):
    return people.suggest(analytics.co_occurrence(faces(spark, sf_dir), 3), persons(spark, sf_dir), links(spark, sf_dir))


_SCORE = """CASE WHEN d <= 1 THEN 1.0::DOUBLE WHEN d <= 7 THEN 1.0::DOUBLE - 0.2::DOUBLE * (d - 1) / 6 WHEN d <= 30 THEN 0.8::DOUBLE - 0.4::DOUBLE * (d - 7) / 23 WHEN d <= 365 THEN 0.4::DOUBLE - 0.3::DOUBLE * (d - 30) / 335
    ELSE greatest(0.0::DOUBLE, 0.1::DOUBLE - 0.1::DOUBLE * (d - 365) / 365) END"""


@Q.query(f""", x AS (SELECT f.face_id AS id, g.face_id AS pet_id, list_cosine_similarity(f.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS e, (f.face_id % 3 = g.face_id % 3)::INT::DOUBLE AS b,
      floor(abs(floor((f.taken_h - g.taken_h) / 24.0)))::BIGINT AS d FROM faces f JOIN faces g ON g.person_id IS NOT NULL AND f.person_id IS NULL AND f.face_id % 2 = g.face_id % 2), s AS (SELECT id, pet_id, round(0.5::DOUBLE * e + 0.3::DOUBLE * (e + 1) / 2 + 0.1::DOUBLE * b + 0.1::DOUBLE * {_SCORE}, 6) AS score FROM x)
    SELECT id, pet_id FROM s WHERE score > 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pet_id) = 1""", "faces")
def pet_candidates(spark, sf_dir):
    rows = faces(spark, sf_dir).select("face_id", "person_id", "taken_h", "embedding", (F.col("face_id") % 2).alias("species"), (F.col("face_id") % 3).alias("breed"))
    known, unassigned = rows.where("person_id is not null"), rows.where("person_id is null")
    return people.nearest_pets(unassigned.withColumnRenamed("face_id", "id"), known.withColumnRenamed("face_id", "pet_id"), 0.3)


@Q.query(f"""WITH t AS (SELECT l_orderkey % 200 AS id, 'tag'||(l_partkey % 9) AS tag FROM lineitem), k AS (SELECT id, list_sort(list_distinct(list(tag))) AS k FROM t GROUP BY 1), q AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 4 THEN quality * 60 + doc_id % 40 END AS s FROM labels)
    , n AS (SELECT doc_id AS id, string_agg('N' || k, ',' ORDER BY 'N' || k) AS names FROM documents, generate_series(0, 2) AS g(k) WHERE doc_id % 4 > k GROUP BY 1)
    SELECT doc_id AS id, concat_ws(',', nullif(array_to_string(k, ','), ''), names) AS keywords, CASE WHEN s >= 80 THEN 5 WHEN s >= 60 THEN 4 WHEN s >= 40 THEN 3 WHEN s >= 20 THEN 2 WHEN s IS NOT NULL THEN 1 END AS rating FROM documents LEFT JOIN k ON k.id = doc_id LEFT JOIN q ON q.id = doc_id LEFT JOIN n ON n.id = doc_id""")
def keyword_payload(spark, sf_dir):
    tags = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("id"), F.concat(F.lit("tag"), (F.col("l_partkey") % 9).cast("string")).alias("tag"))
    shown = files(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where("id % 4 > k").select("id", F.concat(F.lit("N"), F.col("k").cast("string")).alias("person"))
    return people.payload(files(spark, sf_dir).select("id"), tags, shown, quality(spark, sf_dir)).select("id", F.array_join("keywords", ",").alias("keywords"), "rating")


@Q.query(f""", {_P} SELECT face_id, file_id, coalesce(name, 'Unknown') AS name FROM faces LEFT JOIN p ON p.id = person_id WHERE NOT coalesce(is_hidden, false)""", "faces")
def face_annotations(spark, sf_dir):
    return people.annotations(faces(spark, sf_dir), persons(spark, sf_dir))


@Q.query("""SELECT photo_id AS undoes, 'restore' AS kind FROM photos WHERE kind IN ('click', 'view') AND photo_id % 4 <> 0""", "photos")
def undoable_actions(spark, sf_dir):
    kinds = F.when(F.col("kind") == "click", "move").when(F.col("kind") == "view", "quarantine").otherwise("delete")
    log = photos(spark, sf_dir).select(F.col("photo_id").alias("id"), kinds.alias("kind"), F.lit(True).alias("reversible"), (F.col("photo_id") % 4 == 0).alias("reversed"), F.lit("/a").alias("source_path"), F.lit("/b").alias("dest_path"))
    return actions.undo(log).select("undoes", "kind")


@Q.query("""SELECT photo_id FROM photos WHERE NOT (us < epoch_us(TIMESTAMP '2024-01-10') AND photo_id % 2 = 0)""", "photos")
def retained_log(spark, sf_dir):
    return actions.retain(photos(spark, sf_dir).withColumn("reversed", F.col("photo_id") % 2 == 0), 1704844800000000).select("photo_id")


# What odd files are called here, some of them temporary, some marks of projects.
_NAMES = ("notes.tmp", "Thumbs.db", "thumbs.db", "a.old", "b.LOG", "c.log", "package.json", "Setup.py", "game.uproject", "app.csproj", "CMakeLists.txt", "gradlew", "readme.md")


def named_files(spark, sf_dir):
    """The files, each third one under one of _NAMES."""
    odd = F.element_at(F.array(*map(F.lit, _NAMES)), (F.floor(F.col("id") / 3) % len(_NAMES) + 1).cast("int"))
    rows = files(spark, sf_dir).withColumn("filename", F.when(F.col("id") % 3 == 0, odd).otherwise(F.col("filename")))
    kind = F.when(F.col("id") % 3 == 0, F.nullif(F.regexp_extract("filename", r"(\.[^.]*)$", 1), F.lit(""))).otherwise(F.col("file_type"))
    return rows.withColumn("file_type", kind).withColumn("path", F.concat(F.lit("/"), "drive_id", F.lit("/p/"), "filename"))


_NAMED = f""", m AS (SELECT id, drive_id, size, is_deleted, CASE WHEN id % 3 = 0 THEN ([{", ".join(f"'{x}'" for x in _NAMES)}])[id // 3 % {len(_NAMES)} + 1] ELSE filename END AS filename, file_type AS t FROM files),
    n AS (SELECT *, CASE WHEN id % 3 = 0 THEN nullif(regexp_extract(filename, '(\\.[^.]*)$', 1), '') ELSE t END AS file_type FROM m)"""


@Q.query(f"""{_NAMED} SELECT 'temporary' AS kind, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM n WHERE NOT is_deleted AND (file_type IN ('.tmp', '.temp', '.bak', '.cache', '.log') OR filename IN ('Thumbs.db', 'desktop.ini', '.DS_Store'))
    UNION ALL SELECT 'huge', count(*), coalesce(sum(size), 0)::BIGINT FROM n WHERE NOT is_deleted AND size > 8000""", "files")
def quick_wins(spark, sf_dir):
    return analytics.quick_wins(named_files(spark, sf_dir), huge=8_000)


@Q.query(f"""{_NAMED}, p AS (SELECT drive_id, filename, CASE filename WHEN 'package.json' THEN 'Node.js' WHEN 'Setup.py' THEN 'Python' WHEN 'game.uproject' THEN 'Unreal Engine' WHEN 'app.csproj' THEN '.NET' WHEN 'CMakeLists.txt' THEN 'CMake/C++' WHEN 'gradlew' THEN 'Android/Gradle' END AS project FROM n)
    SELECT DISTINCT drive_id, project, CASE project WHEN 'Node.js' THEN '/package.json' WHEN 'Python' THEN '/setup.py' WHEN 'Unreal Engine' THEN '/*.uproject' WHEN '.NET' THEN '/*.csproj' WHEN 'CMake/C++' THEN '/CMakeLists.txt' ELSE '/gradlew' END AS markers,
    CASE project WHEN 'Node.js' THEN '*/node_modules/* */dist/* */build/* */.next/* */.cache/*' WHEN 'Python' THEN '*/.venv/* */venv/* */__pycache__/* */.pytest_cache/*' WHEN 'Unreal Engine' THEN '*/Binaries/* */Intermediate/* */DerivedDataCache/* */Saved/*'
    WHEN '.NET' THEN '*/bin/* */obj/* */.vs/*' WHEN 'CMake/C++' THEN '*/build/* */CMakeFiles/*' ELSE '*/.gradle/* */build/* */.idea/*' END AS suggested FROM p WHERE project IS NOT NULL""", "files")
def project_types(spark, sf_dir):
    found = redundancy.project_types(named_files(spark, sf_dir), by=("drive_id",))
    return found.select("drive_id", "project", F.array_join("markers", " ").alias("markers"), F.array_join("suggested", " ").alias("suggested"))


@Q.query(""", g AS (SELECT * FROM faces WHERE person_id IS NOT NULL), s AS (SELECT f.face_id, g.person_id, abs(floor((f.taken_h - g.taken_h) / 24.0))::BIGINT AS days, round(list_cosine_similarity(f.embedding::DOUBLE[], g.embedding::DOUBLE[]), 9) AS similarity
      FROM faces f, g WHERE f.person_id IS NULL), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY face_id, person_id ORDER BY days, similarity DESC) = 1)
    SELECT face_id, person_id, days FROM n WHERE similarity > CASE WHEN days <= 1 THEN 0.05::DOUBLE WHEN days <= 30 THEN 0.06 WHEN days <= 365 THEN 0.07 ELSE 0.08 END""", "faces")
def nearest_face_in_time(spark, sf_dir):
    rows = faces(spark, sf_dir)
    return match.nearest_in_time(rows.where("person_id is null"), rows.where("person_id is not null"), lambda d: timeline.gap_threshold(d) / 10).select("face_id", "person_id", "days")


_AGE = "CASE WHEN year - birth_year BETWEEN 0 AND 120 THEN year - birth_year WHEN age > 0 THEN age ELSE 25 END"


@Q.query(f""", c AS (SELECT face_id, face_id // 12 AS cluster, age, embedding::DOUBLE[] AS e FROM faces WHERE person_id IS NULL QUALIFY row_number() OVER (PARTITION BY face_id // 12 ORDER BY face_id) <= 10),
    g AS (SELECT CASE WHEN {_AGE} < 2 THEN 1 WHEN {_AGE} < 5 THEN 3 WHEN {_AGE} < 12 THEN 8 WHEN {_AGE} < 18 THEN 15 ELSE 25 END AS middle, embedding::DOUBLE[] AS e FROM faces WHERE person_id = 3),
    s AS (SELECT cluster, round(max(list_cosine_similarity(c.e, g.e) + CASE WHEN abs(c.age - middle) < 5 THEN 0.02::DOUBLE ELSE 0 END), 9) AS score FROM c, g GROUP BY 1)
    SELECT cluster, score, CASE WHEN score >= 0.6 THEN 'auto' ELSE 'suggest' END AS decision FROM s WHERE score >= 0.2""", "faces")
def intermediate_clusters(spark, sf_dir):
    rows = faces(spark, sf_dir)
    unknown = rows.where("person_id is null").select(F.floor(F.col("face_id") / 12).cast("long").alias("cluster"), "face_id", "age", "embedding")
    person = people.gallery(rows.where("person_id = 3")).select("stage", "embedding")
    return people.intermediate_clusters(unknown, person, auto=0.6, suggest_from=0.2)
