"""The queries of this subpackage over the synthetic tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.catalog import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _part(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; -1 for a null id, which is in no part."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(_part("doc_id", 3) != 1))
    scored = toxicity.score(docs, model, keep=("doc_id",), threshold=0.7)
    return scored.select("doc_id", (_part("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_clauses")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(_part("doc_id", 5) != 0))
    scored = quality.score(docs, model, keep=("doc_id",), threshold=0.3)
    return scored.select("doc_id", (_part("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_part("doc_id", 4) != 2))
    found = langid.identify(docs, model, keep=("doc_id",))
    return found.select("doc_id", (_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=8)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shard_words").cast("array<string>"), ",").alias("shard_words"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.spotsigs import edit_check

    return edit_check(table(spark, sf_dir, "documents"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.repeats import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.dualtree import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.llm.timestamps import normalise

    return normalise(table(spark, sf_dir, "stamps"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_nearest, op3_toxicity, op4_quality, op5_language_id, op6_minhash, op7_sharding, op8_mixing, op9_packing, op10_fingerprints, op11_repeats, op12_centroids, op13_timestamps)}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL: dict[str, str] = {
    "op6_minhash": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE coalesce(w, []) END) AS g FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
        c(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT x, min(y) AS component_id FROM c GROUP BY x) ON x = doc_id""",
    "op8_mixing": r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS ss, ([1, 2, 3])[(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
        r AS (SELECT *, ss * 3.0::DOUBLE AS most, ss * 3.0::DOUBLE / w AS ratio FROM s),
        f AS (SELECT *, row_number() OVER o AS place, coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
              coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(ss) OVER ()::DOUBLE AS total, sum(w) OVER () AS weights FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, encode(source))),
        g AS (SELECT *, (total - below) / (weights - filled) AS x FROM f),
        t AS (SELECT source, ss, total, least(most, w * coalesce((SELECT x FROM g WHERE x <= ratio ORDER BY place LIMIT 1), 'Infinity'::DOUBLE)) AS target FROM g),
        n AS (SELECT i AS s, coalesce((SELECT max(floor(total / 64 * i / 8 + 0.5)) FROM t), 0)::BIGINT AS n FROM generate_series(1, 8) AS g(i)),
        q AS (SELECT source, target, unnest(generate_series(1, (SELECT max(n) FROM n))) AS j FROM t),
        won AS (SELECT source, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, source IS NULL, encode(source)) AS r FROM q),
        u AS (SELECT t.source, t.ss, t.target, s, least(ss * 3, 64 * (SELECT count(*) FROM won WHERE r <= n.n AND won.source IS NOT DISTINCT FROM t.source)) AS high FROM t, n),
        e AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY source ORDER BY s), 0) AS low FROM u),
        k AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d),
        x AS (SELECT k.doc_id, k.size, ss, target, s, sum(CASE WHEN k.size > 0 THEN greatest(0, least(i * ss + pos + k.size, high) - greatest(i * ss + pos, low)) ELSE 0 END)::BIGINT AS words FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source, generate_series(0, 2) AS p(i) GROUP BY ALL)
        SELECT doc_id, size, ss AS source_size, target, sum(words)::BIGINT AS taken, string_agg(words::VARCHAR, ',' ORDER BY s) AS shard_words FROM x GROUP BY ALL""",
    "op11_repeats": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
        w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d)),
        f AS (SELECT m, min(struct_pack(doc_id, i)) AS first FROM w GROUP BY m HAVING count(*) > 1),
        r AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w JOIN f USING (m) WHERE (doc_id, i) <> (first.doc_id, first.i)),
        g AS (SELECT doc_id, i, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, island),
        k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM s),
        p AS (SELECT doc_id, string_agg(substr(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS kept, sum(b - a)::BIGINT AS gone, count(*) AS n_spans, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)""",
    "op13_timestamps": r"""WITH p AS (SELECT *, trim(raw, E' \t\n\x0B\x0C\r') AS s FROM stamps),
        g AS (SELECT stamp_id, source, zone, s, regexp_extract(s, '\A(?:(20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})\.([0-9]{2})\.(20[0-9]{2})|([0-9]{2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9]{2})|([0-9]{2})/([0-9]{2})/(20[0-9]{2}))(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP]M))?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z',
              ['y1', 'm1', 'd1', 'y2', 'm2', 'd2', 'd3', 'm3', 'y3', 'd4', 'b4', 'y4', 'a5', 'b5', 'y5', 'h', 'mi', 'sec', 'ap', 'off']) AS x FROM p),
        n AS (SELECT * EXCLUDE (x), x.h, try_cast(x.h AS INT) AS hh, try_cast(x.mi AS INT) AS mi, coalesce(try_cast(x.sec AS INT), 0) AS sec, x.ap, x.off,
              try_cast(x.off[2:3] AS INT) AS oh, try_cast(right(x.off, 2) AS INT) AS om,
              try_cast(CASE WHEN x.y1 <> '' THEN concat_ws('-', x.y1, x.m1, x.d1) WHEN x.y2 <> '' THEN concat_ws('-', x.y2, x.m2, x.d2) WHEN x.y3 <> '' THEN concat_ws('-', x.y3, x.m3, x.d3)
                WHEN x.y4 <> '' THEN concat_ws('-', x.y4, (list_position(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], x.b4))::VARCHAR, x.d4) END AS DATE) AS d,
              CASE WHEN x.y5 <> '' THEN try_cast(concat_ws('-', x.y5, x.b5, x.a5) AS DATE) END AS df, CASE WHEN x.y5 <> '' THEN try_cast(concat_ws('-', x.y5, x.a5, x.b5) AS DATE) END AS mf FROM g),
        c AS (SELECT *, CASE WHEN h = '' THEN 0 WHEN mi <= 59 AND sec <= 59 THEN CASE WHEN ap = '' AND hh <= 23 THEN hh WHEN ap <> '' AND hh BETWEEN 1 AND 12 THEN hh % 12 + CASE ap WHEN 'PM' THEN 12 ELSE 0 END END * 3600 + mi * 60 + sec END AS tod,
              CASE WHEN off = 'Z' THEN 0 WHEN off <> '' AND oh <= 14 AND om <= 59 THEN (oh * 3600 + om * 60) * CASE off[1] WHEN '-' THEN -1 ELSE 1 END END AS o FROM n),
        f AS (SELECT *, coalesce(tod IS NOT NULL AND coalesce(d, df, mf) IS NOT NULL AND CASE WHEN off = '' THEN zone IN (SELECT name FROM pg_timezone_names()) ELSE o IS NOT NULL END, FALSE) AS fine FROM c),
        v AS (SELECT source, count(*) FILTER (mf IS NULL) AS dv, count(*) FILTER (df IS NULL) AS mv FROM f WHERE fine AND (df IS NULL) <> (mf IS NULL) GROUP BY source),
        r AS (SELECT f.*, CASE WHEN regexp_full_match(s, '[0-9]{10}|[0-9]{13}') THEN 'epoch' WHEN NOT fine THEN 'bad' WHEN df <> mf THEN CASE WHEN coalesce(dv, 0) = coalesce(mv, 0) THEN 'default' ELSE 'votes' END ELSE 'plain' END AS rule,
              CASE WHEN df <> mf AND coalesce(mv, 0) > coalesce(dv, 0) THEN mf ELSE coalesce(d, df, mf) END AS day FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source),
        w AS (SELECT *, epoch(day::TIMESTAMP)::BIGINT + tod AS wall FROM r),
        o AS (SELECT *, epoch(timezone(zone, to_timestamp(wall - 86400)))::BIGINT - wall + 86400 AS o1, epoch(timezone(zone, to_timestamp(wall + 86400)))::BIGINT - wall - 86400 AS o2 FROM w WHERE fine AND off = '' AND rule NOT IN ('epoch', 'bad')),
        a AS (SELECT *, epoch(timezone(zone, to_timestamp(wall - least(o1, o2))))::BIGINT - wall + least(o1, o2) = o2 AS after, epoch(timezone(zone, to_timestamp(wall - greatest(o1, o2))))::BIGINT - wall + greatest(o1, o2) = o1 AS before FROM o)
        SELECT stamp_id, (wall - CASE WHEN after THEN o2 ELSE o1 END) * 1000000 AS utc_us, rule, rule <> 'plain' OR (o1 <> o2 AND after AND before) AS ambiguous FROM a
        UNION ALL SELECT stamp_id, CASE rule WHEN 'epoch' THEN s::BIGINT * CASE length(s) WHEN 10 THEN 1000000 ELSE 1000 END WHEN 'bad' THEN NULL ELSE (wall - o) * 1000000 END, rule, rule IN ('votes', 'default') FROM w WHERE NOT (fine AND off = '') OR rule IN ('epoch', 'bad')""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
