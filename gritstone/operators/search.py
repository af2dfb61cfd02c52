"""Full-text lookup over a token index, and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(text: str | Column) -> Column:
    """Lower case without diacritics."""
    c = F.col(text) if isinstance(text, str) else text
    accents = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(F.lower(c), accents, plain)


def index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, token): store it partitioned or sorted by token to look words up without a scan."""
    words = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(words).alias("pos", "token"))


def match_all(ix: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, hits) of documents with every word."""
    found = ix.where(F.col("token").isin([w.lower() for w in words]))
    return found.groupBy("doc_id").agg(F.countDistinct("token").alias("_n"), F.count("*").alias("hits")).where(F.col("_n") == len({w.lower() for w in words})).drop("_n")


def match_any(ix: DataFrame, words: list[str], without: list[str] | None = None) -> DataFrame:
    """Documents with some word and none of the others."""
    found = ix.where(F.col("token").isin([w.lower() for w in words])).groupBy("doc_id").agg(F.count("*").alias("hits"))
    return found if not without else found.join(ix.where(F.col("token").isin([w.lower() for w in without])).select("doc_id").distinct(), "doc_id", "left_anti")


def match_prefix(ix: DataFrame, prefix: str) -> DataFrame:
    return ix.where(F.col("token").startswith(prefix.lower())).groupBy("doc_id").agg(F.count("*").alias("hits"))


def match_phrase(ix: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, hits): places where the words follow one another.  Each token knows where its phrase would begin, so one grouping finds them."""
    spots = F.array(*[F.struct(F.lit(w.lower()).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)])
    hits = ix.where(F.col("token").isin([w.lower() for w in words])).select("doc_id", "pos", "token", F.explode(spots).alias("x")).where("token = x.w")
    starts = hits.select("doc_id", (F.col("pos") - F.col("x.i")).alias("start"), "x.i").distinct().groupBy("doc_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(words))
    return starts.groupBy("doc_id").agg(F.count("*").alias("hits"))


def match_near(ix: DataFrame, one: str, other: str, within: int = 10) -> DataFrame:
    """Documents where the two words stand at most ``within`` words apart."""
    rows = ix.where(F.col("token").isin(one.lower(), other.lower()))
    w = Window.partitionBy("doc_id").orderBy("pos")
    close = rows.withColumn("_t", F.lag("token").over(w)).withColumn("_p", F.lag("pos").over(w)).where((F.col("_t") != F.col("token")) & (F.col("pos") - F.col("_p") <= within + 1))
    return close.groupBy("doc_id").agg(F.count("*").alias("hits"))


def snippet(text: str | Column, word: str, size: int = 32) -> Column:
    """``size`` words around the first occurrence of a word."""
    words = F.split(F.col(text) if isinstance(text, str) else text, r"\s+")
    at = F.array_position(F.transform(words, lambda x: F.regexp_replace(fold(x), r"[^\p{L}\p{N}]", "")), word.lower())
    return F.when(at > 0, F.array_join(F.slice(words, F.greatest(at.cast("int") - size // 2, F.lit(1)), F.lit(size)), " "))


def priority_union(parts: list[tuple[str, DataFrame]], key: str = "doc_id", limit: int = 100) -> DataFrame:
    """(key, source): ids of all parts, each with the first part that has it; the first by part and id."""
    rows = None
    for rank, (source, part) in enumerate(parts):
        one = part.select(key, F.lit(rank).alias("_r"), F.lit(source).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(key).agg(F.min(F.struct("_r", "source")).alias("x")).select(key, "x._r", "x.source")
    return first.orderBy("_r", key).limit(limit).select(key, "source")


def hybrid(semantic: DataFrame, text_hits: list[tuple[str, DataFrame]], key: str = "doc_id") -> DataFrame:
    """(key, similarity, sources): semantic rows (key, similarity) and text hits merged; best similarity, sources sorted and joined by +."""
    rows = semantic.select(key, F.col("similarity"), F.lit("semantic").alias("source"))
    for name, part in text_hits:
        rows = rows.unionByName(part.select(key, F.lit(None).cast("double").alias("similarity"), F.lit(name).alias("source")))
    return rows.groupBy(key).agg(F.max("similarity").alias("similarity"), F.array_join(F.sort_array(F.collect_set("source")), "+").alias("sources"))


ORDERS = {
    "relevance": lambda: [F.desc_nulls_last(F.nullif("similarity", F.lit(0.0)))],
    "date_desc": lambda: [F.desc_nulls_last("modified_s")],
    "date_asc": lambda: [F.asc_nulls_last("modified_s")],
    "size_desc": lambda: [F.desc("size")],
    "size_asc": lambda: [F.asc("size")],
    "name": lambda: [F.lower("filename")],
}


def sort_results(rows: DataFrame, by: str, key: str = "id", limit: int | None = None) -> DataFrame:
    """Results in one of six orders, ties by key."""
    out = rows.orderBy(*ORDERS[by](), key)
    return out if limit is None else out.limit(limit)


# What the type filter calls images, videos and documents.
TYPES = {"Images": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".heic", ".cr2"), "Videos": (".mp4", ".mov", ".avi", ".mkv", ".wmv"), "Documents": (".pdf", ".docx", ".txt", ".rtf", ".odt", ".xlsx", ".pptx")}


def type_class(file_type: str | Column) -> Column:
    c = F.lower(F.col(file_type) if isinstance(file_type, str) else file_type)
    out = F.lit("Other")
    for name, exts in TYPES.items():
        out = F.when(c.isin(*exts), name).otherwise(out)
    return out
