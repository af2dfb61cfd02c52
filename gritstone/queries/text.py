"""Corpus statistics and full-text lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.catalog import files, table
from gritstone.operators import corpus, search
from gritstone.operators.textindex import TextIndex
from gritstone.queries.book import Book

Q = Book()
# The stop words once more, for SQL, so that a change in the operator's list shows.
_STOP = """'a','an','the','and','or','but','in','on','at','to','for','of','with','by','from','is','was','are','were','be','been','being','have','has','had','do','does','did','will','would',
    'could','should','may','might','shall','can','must','need','this','that','these','those','it','its','he','she','they','we','you','i','me','my','our','your','his','her','their',
    'not','no','nor','so','if','then','than','too','very','just','about','above','after','again','all','also','am','any','as','because','before','between','both','each',
    'few','get','got','here','him','how','into','more','most','new','now','only','other','out','own','same','some','such','there','through','up','what','when','where','which','while',
    'who','whom','why','down','during','over','under'"""
_TOKENS = r"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))"
_CONTENT = "WITH d AS (SELECT doc_id, list_filter(" + _TOKENS.format(x="text") + f", lambda w: w NOT IN ({_STOP})) AS w FROM documents WHERE text IS NOT NULL)"
_TERMS = _CONTENT + ", t AS (SELECT doc_id, unnest(w) AS term FROM d), c AS (SELECT term, count(*) AS count, count(DISTINCT doc_id) AS doc_freq FROM t GROUP BY 1)"
_TFIDF = _TERMS + """, s AS (SELECT term, count, doc_freq, round(count / (SELECT sum(count) FROM c)::DOUBLE * ln((SELECT count(*) FROM d)::DOUBLE / doc_freq), 6) AS tf_idf
    FROM (SELECT * FROM c ORDER BY count DESC, term LIMIT THREE))"""


def _grams(n: int) -> str:
    run = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return _CONTENT + f""", t AS (SELECT doc_id, {run} AS term FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM d WHERE len(w) >= {n}))
    SELECT term, count(*) AS count, count(DISTINCT doc_id) AS doc_freq FROM t GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT doc_id) >= 2 ORDER BY count DESC, term LIMIT 100"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@Q.query(f"SELECT doc_id, len({_TOKENS.format(x='text')})::INT AS n_tokens FROM documents")
def token_totals(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(corpus.tokens("text")).alias("n_tokens"))


@Q.query(_TERMS + " SELECT * FROM c WHERE count >= 20")
def term_frequency(spark, sf_dir):
    return corpus.term_counts(docs(spark, sf_dir).where("text is not null"), corpus.content_tokens("text")).where("count >= 20")


@Q.query(_TFIDF.replace("THREE", "300") + " SELECT * FROM s ORDER BY tf_idf DESC, term LIMIT 100")
def tfidf_top(spark, sf_dir):
    return corpus.tfidf(docs(spark, sf_dir))


@Q.query(_TFIDF.replace("THREE", "600") + " SELECT * FROM (SELECT * FROM s ORDER BY tf_idf DESC, term LIMIT 200) WHERE tf_idf >= 0.001 AND doc_freq >= 2")
def term_patterns(spark, sf_dir):
    return corpus.patterns(docs(spark, sf_dir))


@Q.query(_grams(2))
def bigrams_top(spark, sf_dir):
    return corpus.top_ngrams(docs(spark, sf_dir), 2)


@Q.query(_grams(3))
def trigrams_top(spark, sf_dir):
    return corpus.top_ngrams(docs(spark, sf_dir), 3)


@Q.query(r"""WITH f AS (SELECT conv_id, list_distinct(regexp_extract_all(text, '\b([A-Z][a-z]+) ', 1)) AS s, list_distinct(regexp_extract_all(text, ' ([a-z]{4,6})\.', 1)) AS r FROM conversations),
    p AS (SELECT conv_id, unnest(s) AS sender, r FROM f), q AS (SELECT sender, unnest(r) AS recipient FROM p)
    SELECT sender, recipient, count(*) AS messages FROM q WHERE sender <> recipient GROUP BY 1, 2""".replace(r"\b", ""))
def communication_network(spark, sf_dir):
    return corpus.network(table(spark, sf_dir, "conversations"), "([A-Z][a-z]+) ", r" ([a-z]{4,6})\.", id_col="conv_id")


@Q.query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", corpus.strip_tags("html").alias("text"))


_INDEX = r"""WITH ix AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM
    (SELECT doc_id, regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL))"""


@Q.query(_INDEX + " SELECT doc_id, count(*) AS hits FROM ix WHERE token IN ('the', 'idiot') GROUP BY 1 HAVING count(DISTINCT token) = 2")
def search_and(spark, sf_dir):
    return search.match_all(search.index(docs(spark, sf_dir)), ["the", "idiot"])


@Q.query(_INDEX + " SELECT doc_id, count(*) AS hits FROM ix WHERE token IN ('clown', 'license') AND doc_id NOT IN (SELECT doc_id FROM ix WHERE token = 'les') GROUP BY 1")
def search_or_not(spark, sf_dir):
    return search.match_any(search.index(docs(spark, sf_dir)), ["clown", "license"], ["les"])


@Q.query(_INDEX + " SELECT doc_id, count(*) AS hits FROM ix WHERE starts_with(token, 'lic') GROUP BY 1")
def search_prefix(spark, sf_dir):
    return search.match_prefix(search.index(docs(spark, sf_dir)), "lic")


@Q.query(_INDEX + " SELECT a.doc_id, count(*) AS hits FROM ix a JOIN ix b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.token = 'apache' AND b.token = 'license' GROUP BY 1")
def search_phrase(spark, sf_dir):
    return search.match_phrase(search.index(docs(spark, sf_dir)), ["Apache", "License"])


@Q.query(_INDEX + """, n AS (SELECT doc_id, pos, token, lag(token) OVER w AS t, lag(pos) OVER w AS p FROM ix WHERE token IN ('licensed', 'version') WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, count(*) AS hits FROM n WHERE t <> token AND pos - p <= 6 GROUP BY 1""")
def search_near(spark, sf_dir):
    return search.match_near(search.index(docs(spark, sf_dir)), "licensed", "version", within=5)


@Q.query(_INDEX + """, u AS (SELECT doc_id, 0 AS r, 'summary' AS source FROM ix WHERE token = 'clown' UNION ALL SELECT doc_id, 1, 'ocr' FROM ix WHERE token = 'license' UNION ALL SELECT doc_id, 2, 'tag' FROM documents WHERE contains(source, '7'))
    SELECT doc_id, arg_min(source, r) AS source FROM u GROUP BY doc_id ORDER BY min(r), doc_id LIMIT 100""")
def search_priority_union(spark, sf_dir):
    d = docs(spark, sf_dir)
    ix = search.index(d)
    return search.priority_union([("summary", search.match_all(ix, ["clown"])), ("ocr", search.match_all(ix, ["license"])), ("tag", d.where(F.contains("source", F.lit("7"))))])


_BOTH = r"""WITH d AS (SELECT doc_id, 'text' AS col, text FROM documents UNION ALL SELECT doc_id, 'origin', source FROM documents), ix AS (SELECT doc_id, col, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM
    (SELECT doc_id, col, regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+') AS w FROM d WHERE text IS NOT NULL))"""
#: Searches as they are typed, each with the SQL of its documents and hits over ix(doc_id, col, token, pos).
SEARCHES = {
    "license NOT clown": "SELECT doc_id, count(*) AS hits FROM ix WHERE token = 'license' AND doc_id NOT IN (SELECT doc_id FROM ix WHERE token = 'clown') GROUP BY 1",
    '"apache license" OR (idiot AND the)': """SELECT doc_id, sum(n)::BIGINT AS hits FROM (SELECT a.doc_id, count(*) AS n, true AS o, false AS i, false AS t FROM ix a JOIN ix b ON a.doc_id = b.doc_id AND a.col = b.col AND b.pos = a.pos + 1 AND a.token = 'apache' AND b.token = 'license' GROUP BY 1
        UNION ALL SELECT doc_id, count(*), false, token = 'idiot', token = 'the' FROM ix WHERE token IN ('idiot', 'the') GROUP BY doc_id, token) GROUP BY 1 HAVING bool_or(o) OR (bool_or(i) AND bool_or(t))""",
    "licensed NEAR/5 version lic*": """SELECT doc_id, n + l AS hits FROM (SELECT b.doc_id, count(DISTINCT (b.col, b.pos)) AS n FROM ix a JOIN ix b ON a.doc_id = b.doc_id AND a.col = b.col AND abs(a.pos - b.pos) <= 6 AND a.token = 'licensed' AND b.token = 'version' GROUP BY 1)
        JOIN (SELECT doc_id, count(*) AS l FROM ix WHERE starts_with(token, 'lic') GROUP BY 1) USING (doc_id)""",
    "origin:src7 -the": "SELECT doc_id, count(*) AS hits FROM ix WHERE col = 'origin' AND token = 'src7' AND doc_id NOT IN (SELECT doc_id FROM ix WHERE token = 'the') GROUP BY 1",
}


@Q.query(_BOTH + " " + " UNION ALL ".join(f"SELECT '{q.replace(chr(39), chr(39) * 2)}' AS query, * FROM ({sql})" for q, sql in SEARCHES.items()))
def typed_searches(spark, sf_dir):
    """Texts and their sources in a stored index, asked as a user types; a posting row's places are counted as hits."""
    index = TextIndex.build(spark, None, docs(spark, sf_dir), {"text": "text", "origin": "source"})
    out = None
    for query in SEARCHES:
        found = index.search(query).select(F.lit(query).alias("query"), "doc_id", "hits")
        out = found if out is None else out.unionByName(found)
    return out


@Q.query(_INDEX + r""", w AS (SELECT doc_id, token, pos FROM ix WHERE token IN ('apache', 'license')), b AS (SELECT doc_id, count(*) AS hits, min(pos) AS first FROM w GROUP BY 1 HAVING count(DISTINCT token) = 2),
    t AS (SELECT b.*, greatest(first - 4, 0) AS a, regexp_extract_all(text, '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS x FROM b JOIN documents USING (doc_id)),
    u AS (SELECT doc_id, hits, a + i - 1 AS p, x[a + i] AS word FROM t, generate_series(1, 8) AS g(i) WHERE a + i <= len(x)),
    m AS (SELECT u.*, u.p IN (SELECT pos FROM w WHERE w.doc_id = u.doc_id) AS hit FROM u)
    SELECT doc_id, hits, rtrim(string_agg(CASE WHEN hit THEN '[' || regexp_extract(word, '[\p{L}\p{N}]+') || ']' || regexp_replace(word, '^[\p{L}\p{N}]+', '') ELSE word END, '' ORDER BY p)) AS snippet FROM m GROUP BY 1, 2""")
def search_snippets(spark, sf_dir):
    rows = docs(spark, sf_dir)
    index = TextIndex.build(spark, None, rows, {"text": "text"})
    return index.snippets(index.search("apache license"), rows, size=8).select("doc_id", "hits", "snippet")


@Q.query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id AS doc_id, round(list_inner_product(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 9) AS similarity FROM embeddings),
    h AS (SELECT doc_id, similarity, 'semantic' AS source FROM s WHERE similarity >= 0.2 UNION ALL SELECT doc_id, NULL, 'text' FROM documents WHERE contains(text, 'License'))
    SELECT doc_id, max(similarity) AS similarity, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM h GROUP BY 1""")
def hybrid_search(spark, sf_dir):
    from gritstone.operators.match import knn

    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 1").select("embedding").first()[0]
    semantic = knn(vectors, list(query), at_least=0.2).select(F.col("vec_id").alias("doc_id"), F.col("similarity"))
    return search.hybrid(semantic, [("text", docs(spark, sf_dir).where(F.contains("text", F.lit("License"))))])


@Q.query("""SELECT id, CASE WHEN lower(file_type) IN ('.jpg', '.png', '.cr2') THEN 'Images' WHEN lower(file_type) = '.mp4' THEN 'Videos' WHEN lower(file_type) IN ('.pdf', '.docx', '.txt') THEN 'Documents' ELSE 'Other' END AS class
    FROM files ORDER BY modified_s DESC NULLS LAST, id LIMIT 150""", "files")
def sorted_results(spark, sf_dir):
    return search.sort_results(files(spark, sf_dir), "date_desc", limit=150).select("id", search.type_class("file_type").alias("class"))
