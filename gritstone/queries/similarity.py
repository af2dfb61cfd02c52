"""Similarity joins, components, vector search and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.catalog import faces, table
from gritstone.functions.vectors import cosine, pearson_unit, sign_bits
from gritstone.operators import match, people, similar
from gritstone.operators.increments import NearIndex
from gritstone.queries.book import Book
from gritstone.session import cut, scratch_path

Q = Book()
_HASH = "h AS (SELECT vec_id AS id, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: (x > 0)::INT::HUGEINT)), lambda a, b: a * 2 + b) AS hash FROM embeddings)"


def hashes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_bits("embedding").alias("hash"))


#: From l(x, y, v), all linked pairs of rows in both directions, and n(id), all rows: rep(id, rep) by links of value {same}; rows that share a representative are one class.
_CLASSES = "rep AS (SELECT n.id, least(n.id, coalesce(min(l.y), n.id)) AS rep FROM n LEFT JOIN l ON l.x = n.id AND {same} GROUP BY n.id)"
_PAIRS = """SELECT l.x AS src, l.y AS dst, l.v AS {value} FROM l JOIN rep a ON a.id = l.x JOIN rep b ON b.id = l.y WHERE (l.x < l.y AND a.rep = l.x AND b.rep = l.y) OR (a.id <> b.id AND b.rep = l.x AND {same})"""
_ROWS = """, c(x, y) AS (SELECT id, id FROM n UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x), m AS (SELECT x AS id, min(y) AS component FROM c GROUP BY 1), k AS (SELECT x AS id, count(*) AS n FROM l GROUP BY 1)
    SELECT id, rep AS class_id, count(*) OVER (PARTITION BY rep) AS class_size, coalesce(k.n, 0) AS n_links, component FROM rep JOIN m USING (id) LEFT JOIN k USING (id)"""
_HAMMING = f"""{_HASH}, n AS (SELECT id FROM h), l AS (SELECT a.id AS x, b.id AS y, bit_count(xor(a.hash, b.hash))::INT AS v FROM h a JOIN h b ON a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 18), {_CLASSES.format(same="v = 0")}"""


@Q.query(f"WITH {_HAMMING} " + _PAIRS.format(value="distance", same="v = 0"))
def hamming_pairs(spark, sf_dir):
    """Pairs of representatives of different hashes, and each representative with the other rows of its hash (distance 0)."""
    rows = hashes(spark, sf_dir)
    return similar.with_members(similar.hamming_links(rows, 18), similar.hash_members(rows), "distance", F.lit(0))


@Q.query(f"WITH RECURSIVE {_HAMMING}{_ROWS}")
def hamming_classes(spark, sf_dir):
    rows = hashes(spark, sf_dir)
    return similar.class_rows(similar.hash_members(rows), similar.hamming_links(rows, 18))


@Q.query(f"""WITH RECURSIVE {_HASH}, r AS (SELECT hash, min(id) AS id FROM h GROUP BY 1), e AS (SELECT a.id AS x, b.id AS y FROM r a JOIN r b ON a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 16),
    c(x, y) AS (SELECT id, id FROM r UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
    SELECT h.id, m.component FROM h JOIN r USING (hash) JOIN (SELECT x, min(y) AS component FROM c GROUP BY 1) m ON m.x = r.id""")
def near_duplicate_components(spark, sf_dir):
    rows = hashes(spark, sf_dir)
    return similar.hash_classes(rows, similar.hamming_links(rows, 16))


@Q.query(f"""WITH RECURSIVE {_HASH}, e AS (SELECT a.id AS x, b.id AS y FROM h a JOIN h b ON a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 8), c(x, y) AS (SELECT id, id FROM h UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
    g AS (SELECT x AS id, min(y) AS component FROM c GROUP BY 1) SELECT id, component FROM g""")
def grown_groups(spark, sf_dir):
    """Groups that grew over three batches of ascending ids: the same as made at once."""
    rows = hashes(spark, sf_dir)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    index = NearIndex(spark, scratch_path(spark, "near-index"), 8)
    for i in range(3):
        at = lambda k: low + (high - low + 1) * k // 3
        index.add(rows.where((F.col("id") >= at(i)) & (F.col("id") < at(i + 1))))
    return index.groups()


def image_hashes(spark, sf_dir):
    """Three hashes of each vector, of a copy of each with some components turned (ids from a million on), and of an exact copy of every third (two million on).

    Every fifth has no second hash, every seventh no third, every eleventh no first, so all sets of kinds occur.
    """
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    copy = F.transform("e", lambda x, i: F.when((F.col("id") * 7 + (i + 1) * 13) % 97 < 4, -x).otherwise(x))
    all_of = own.unionByName(own.withColumn("e", copy).withColumn("id", F.col("id") + 1_000_000)).unionByName(own.where("id % 3 = 0").withColumn("id", F.col("id") + 2_000_000))
    steps = F.zip_with("e", F.concat(F.slice("e", 2, 63), F.slice("e", 1, 1)), lambda x, y: x - y)
    p, d, a = sign_bits("e"), sign_bits(steps), sign_bits(F.transform("e", lambda x: x.cast("double") - 0.1))
    has = lambda n: F.col("id") % 1_000_000 % n != n - 1
    return all_of.select("id", F.when(has(11), p).alias("p"), F.when(has(5), d).alias("d"), F.when(has(7), a).alias("a"))


_BITS = "list_reduce(list_prepend(0::HUGEINT, list_transform({}, lambda i: ({})::INT::HUGEINT)), lambda a, b: a * 2 + b)"
_DIFFER = "coalesce(bit_count(xor(x.{0}, y.{0}))::INT, 0)"
_COMPOSITE = f"""o AS (SELECT vec_id AS id, embedding AS e FROM embeddings), b AS (SELECT * FROM o UNION ALL SELECT id + 1000000, list_transform(generate_series(1, 64), lambda i: CASE WHEN (id * 7 + i * 13) % 97 < 4 THEN -e[i] ELSE e[i] END) FROM o UNION ALL SELECT id + 2000000, e FROM o WHERE id % 3 = 0),
    h AS (SELECT id, CASE WHEN id % 1000000 % 11 <> 10 THEN {_BITS.format("generate_series(1, 64)", "e[i] > 0")} END AS p, CASE WHEN id % 1000000 % 5 <> 4 THEN {_BITS.format("generate_series(1, 64)", "e[i] - e[i % 64 + 1] > 0")} END AS d, CASE WHEN id % 1000000 % 7 <> 6 THEN {_BITS.format("generate_series(1, 64)", "e[i]::DOUBLE - 0.1::DOUBLE > 0")} END AS a FROM b),
    n AS (SELECT id FROM h WHERE coalesce(p, d, a) IS NOT NULL),
    x AS (SELECT x.id AS x, y.id AS y, {" + ".join(_DIFFER.format(k) for k in "pda")} AS bits, 64 * ((x.p IS NOT NULL AND y.p IS NOT NULL)::INT + (x.d IS NOT NULL AND y.d IS NOT NULL)::INT + (x.a IS NOT NULL AND y.a IS NOT NULL)::INT) AS width,
      x.p IS NOT DISTINCT FROM y.p AND x.d IS NOT DISTINCT FROM y.d AND x.a IS NOT DISTINCT FROM y.a AS same FROM h x JOIN h y ON x.id <> y.id),
    l AS (SELECT x, y, round(1 - bits / width::DOUBLE, 9) AS v, same FROM x WHERE width > 0 AND 10 * bits <= width), {_CLASSES.format(same="l.same")}"""


@Q.query(f"WITH {_COMPOSITE} " + _PAIRS.format(value="similarity", same="l.same"))
def composite_pairs(spark, sf_dir):
    """Pairs of representatives of different hashes on the kinds that both have, and each representative with its equals (similarity 1)."""
    rows = cut(image_hashes(spark, sf_dir))
    return similar.with_members(similar.composite_links(rows, 0.90), similar.hash_members(rows, columns=("p", "d", "a")), "similarity", F.lit(1.0))


@Q.query(f"WITH RECURSIVE {_COMPOSITE}{_ROWS}")
def composite_classes(spark, sf_dir):
    rows = cut(image_hashes(spark, sf_dir))
    return similar.class_rows(similar.hash_members(rows, columns=("p", "d", "a")), similar.composite_links(rows, 0.90))


_JACCARD = r"""s AS (SELECT doc_id AS id, list_sort(list_distinct(list_transform(generate_series(1, length(t) - 1), lambda i: t[i:i + 1]))) AS g FROM
    (SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x{A0}]+', ' ', 'g')) AS t FROM documents WHERE length(text) > 50)), n AS (SELECT id FROM s),
    p AS (SELECT a.id AS x, b.id AS y, len(list_intersect(a.g, b.g)) AS k, len(a.g) + len(b.g) AS t FROM s a JOIN s b ON a.id < b.id AND least(len(a.g), len(b.g)) >= 0.95 * greatest(len(a.g), len(b.g)) - 1),
    j AS (SELECT x, y, round(k / (t - k), 9) AS v FROM p WHERE k / (t - k) >= 0.95 - 1e-9), l AS (SELECT x, y, v FROM j UNION ALL SELECT y, x, v FROM j), """ + _CLASSES.format(same="v = 1")


@Q.query(f"WITH {_JACCARD} " + _PAIRS.format(value="sim", same="v = 1"))
def jaccard_pairs(spark, sf_dir):
    """Pairs of representatives of different sets of bigrams, and each representative with the other documents of its set (1)."""
    members, links = similar.document_links(table(spark, sf_dir, "documents"))
    return similar.with_members(links, members, "sim", F.lit(1.0))


@Q.query(f"WITH RECURSIVE {_JACCARD}{_ROWS}")
def jaccard_classes(spark, sf_dir):
    return similar.document_classes(table(spark, sf_dir, "documents"))


@Q.query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT e FROM q)), 9) AS similarity FROM embeddings
    WHERE vec_id <> 7 AND round(list_inner_product(embedding::DOUBLE[], (SELECT e FROM q)), 9) >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 20""")
def similar_images(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 7").select("embedding").first()[0]
    return match.knn(vectors, list(query), at_least=0.1, limit=20, exclude=7)


@Q.query(""", g AS (SELECT person_id, CASE WHEN year - birth_year BETWEEN 0 AND 120 THEN year - birth_year WHEN age > 0 THEN age ELSE 25 END AS age, embedding::DOUBLE[] AS e FROM faces WHERE person_id IS NOT NULL), s AS (SELECT f.face_id, g.person_id,
      round(list_cosine_similarity(f.embedding::DOUBLE[], g.e) + CASE WHEN (CASE WHEN f.age < 2 THEN 0 WHEN f.age < 5 THEN 1 WHEN f.age < 12 THEN 2 WHEN f.age < 18 THEN 3 WHEN f.age IS NOT NULL THEN 4 END)
      = (CASE WHEN g.age < 2 THEN 0 WHEN g.age < 5 THEN 1 WHEN g.age < 12 THEN 2 WHEN g.age < 18 THEN 3 WHEN g.age IS NOT NULL THEN 4 END) THEN 0.05::DOUBLE ELSE 0 END, 9) AS score FROM faces f, g WHERE f.person_id IS NULL)
    SELECT face_id, person_id, score, CASE WHEN score >= 0.45 THEN 'confirmed' ELSE 'pending' END AS status FROM s WHERE score > 0.3 QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY score DESC, person_id) = 1""", "faces")
def gallery_matches(spark, sf_dir):
    rows = faces(spark, sf_dir)
    unassigned = rows.where("person_id is null").withColumn("stage", match.age_stage(F.col("age")))
    return match.route(match.gallery_match(unassigned, people.gallery(rows), 0.3), 0.45)


_UNIT = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id <> b.id AND 1 - list_cosine_similarity(a.e, b.e) <= 0.62)"


@Q.query(f"""WITH RECURSIVE {_UNIT}, k AS (SELECT x AS id FROM n GROUP BY 1 HAVING count(*) + 1 >= 3), e AS (SELECT x, y FROM n WHERE x IN (SELECT id FROM k) AND y IN (SELECT id FROM k)),
    c(x, y) AS (SELECT id, id FROM k UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x), m AS (SELECT x AS id, min(y) AS cluster FROM c GROUP BY 1)
    SELECT id, cluster FROM m UNION ALL SELECT n.y, min(m.cluster) FROM n JOIN m ON m.id = n.x WHERE n.y NOT IN (SELECT id FROM k) GROUP BY 1""")
def density_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return match.dbscan(rows, 0.62, 3)


@Q.query("""SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, (coalesce(corr_, 0) + 1) / 2), 7) AS sim FROM (SELECT a.vec_id, b.vec_id AS vb, (SELECT corr(x, y) FROM (SELECT unnest(a.embedding::DOUBLE[]) AS x, unnest(b.embedding::DOUBLE[]) AS y)) AS corr_
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a JOIN embeddings b ON b.vec_id = vb""")
def histogram_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    left = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("embedding").alias("x"))
    return left.join(v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b").select("a", "b", F.round(pearson_unit("x", "y"), 7).alias("sim"))


_FRAMES = f"""WITH {_HASH}, f AS (SELECT id // 4 AS video, id % 4 AS frame, hash AS p, lead(hash, 1, hash) OVER (ORDER BY id) AS d FROM h),
    c AS (SELECT video, count(*) AS n FROM f GROUP BY 1), q AS (SELECT a.video AS a, b.video AS b, a.n <= b.n AS first FROM c a JOIN c b ON b.video > a.video)"""


@Q.query(_FRAMES + """, m AS (SELECT q.a, q.b, l.frame, max(((1 - bit_count(xor(l.p, r.p)) / 64.0::DOUBLE) + (1 - bit_count(xor(l.d, r.d)) / 64.0::DOUBLE)) / 2) AS best FROM q
    JOIN f l ON l.video = CASE WHEN first THEN q.a ELSE q.b END JOIN f r ON r.video = CASE WHEN first THEN q.b ELSE q.a END GROUP BY 1, 2, 3) SELECT a, b, round(avg(best), 9) AS sim FROM m GROUP BY 1, 2 HAVING round(avg(best), 9) >= 0.70""")
def video_similarity(spark, sf_dir):
    from pyspark.sql import Window

    # The next id's hash in two steps, within ranges of ids and over the ranges' first hashes, so no task orders all rows.
    rows = hashes(spark, sf_dir).withColumn("range", F.floor(F.col("id") / 4_096))
    firsts = rows.groupBy("range").agg(F.min_by("hash", "id").alias("first"))
    after = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("after"))
    following = F.lead("hash").over(Window.partitionBy("range").orderBy("id"))
    rows = rows.withColumn("next", following).join(after, "range")
    frames = rows.select(F.floor(F.col("id") / 4).alias("video"), F.col("hash").alias("p"), F.coalesce("next", "after", "hash").alias("d"))
    return similar.video_links(frames, 0.70).select(F.col("src").alias("a"), F.col("dst").alias("b"), "sim")


_COS = "round(list_cosine_similarity({}.embedding::DOUBLE[], {}.embedding::DOUBLE[]), 9)"
_HOP = """SELECT n.q, CASE WHEN l.a = n.face THEN l.b ELSE l.a END AS face, max(n.p * (l.w * {decay}::DOUBLE)) AS p FROM {last} n JOIN faces f ON f.face_id = n.face JOIN l ON l.person = f.person_id GROUP BY ALL"""


@Q.query(f""", s AS (SELECT a.face_id AS q, b.face_id AS face, {_COS.format("a", "b")} AS p FROM faces a JOIN faces b ON a.face_id <> b.face_id WHERE a.person_id IS NULL AND {_COS.format("a", "b")} >= 0.2
      QUALIFY row_number() OVER (PARTITION BY a.face_id ORDER BY {_COS.format("a", "b")} DESC, b.face_id) <= 10),
    c AS (SELECT person_id, face_id, embedding, lead(face_id) OVER w AS next FROM faces WHERE person_id IS NOT NULL WINDOW w AS (PARTITION BY person_id ORDER BY year, face_id)),
    l AS (SELECT c.person_id AS person, c.face_id AS a, n.face_id AS b, {_COS.format("c", "n")} AS w FROM c JOIN faces n ON n.face_id = c.next WHERE {_COS.format("c", "n")} > 0),
    h2 AS ({_HOP.format(decay="0.85", last="s")}), h3 AS ({_HOP.format(decay="0.70", last="h2")}),
    u AS (SELECT q, face, p, 1 AS hop FROM s UNION ALL SELECT q, face, p, 2 FROM h2 UNION ALL SELECT q, face, p, 3 FROM h3)
    SELECT q AS query_id, person_id, round(p, 9) AS confidence, hop FROM u JOIN faces f ON f.face_id = u.face WHERE person_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q, person_id ORDER BY round(p, 9) DESC, hop) = 1""", "faces")
def transitive_matches(spark, sf_dir):
    from pyspark.sql import Window

    rows = faces(spark, sf_dir)
    following = F.lead(F.struct("face_id", "embedding")).over(Window.partitionBy("person_id").orderBy("year", "face_id"))
    chain = rows.where("person_id is not null").withColumn("next", following).where("next is not null")
    links = chain.select("person_id", F.col("face_id").alias("face_a"), F.col("next.face_id").alias("face_b"), F.round(cosine("embedding", "next.embedding"), 9).alias("similarity")).where("similarity > 0")
    seeds = match.similar_faces(rows.where("person_id is null"), rows, at_least=0.2, limit=10)
    return match.transitive(seeds, links, rows.select("face_id", "person_id"))
