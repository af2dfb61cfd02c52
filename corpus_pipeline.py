"""The training-data pipeline: language ID, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.catalog import table
from gritstone.llm import langid, minhash, mixing, packing, toxicity
from gritstone.session import scratch_path

#: Near-duplicates: words of a shingle, and the similarity in percent.
SHINGLE_WORDS, PERCENT = 5, 80
TOXIC_FROM = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null or empty text, or one without a letter, goes.

    Very long texts are read in parts, whole.  Repeated and null ids, and equal
    rows, stay as they are; equally likely languages don't matter here.  If no
    language was learned, or there are no documents, nothing stays.
    """
    model = langid.fit(docs)
    return langid.identify(docs, model, keep=tuple(docs.columns)).where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM, with the grammar learned from the labels of those that came here.

    Null and empty texts score 0 and stay; a score of exactly TOXIC_FROM goes.
    Very long texts are read whole.  Repeated and null ids, and equal rows, stay
    as they are.  Without labels the fixed lists decide.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=tuple(docs.columns), threshold=TOXIC_FROM).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    A document is what its id names: rows that share an id are one group, and of
    them the one with the smallest hash of the text stays.  Rows with a null id
    can't be named as members of a group; of those with equal texts one stays.
    Null and empty texts are like no other and stay.  Very long texts are compared
    whole.  No documents give none.
    """
    kept = minhash.near_duplicates(docs, shingle_words=SHINGLE_WORDS, percent=PERCENT).where("kept").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes once for each whole pass, and cut where a source's last block ends.

    Null and empty texts hold no word and go; a null source is one of its own.
    Very long texts are cut like any other.  Repeated and null ids, and equal
    rows, each take their own place in the stream; equal quotients go to the
    source that comes first.  No documents give none.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "n_chars")]
    mixed = mixing.mix(docs.select("doc_id", *others), keep=tuple(others))
    taken = mixing.take(mixed, "text", ["doc_id", *others])
    return taken.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096, as pieces of documents.

    A null or empty text is its end token alone; very long texts are cut into
    several sequences.  Repeated and null ids, and equal rows, are packed row by
    row; sequences of equal cost are filled from the first on.  No documents give
    no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL can express none of the trained stages; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
