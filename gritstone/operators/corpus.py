"""Corpus statistics: tokens, terms, n-grams, patterns, communication networks, text extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.session import cut

# Words that term statistics leave out.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is was are were be been being have has had do does did will would "
    "could should may might shall can must need this that these those it its he she they we you i me my our your his her their "
    "not no nor so if then than too very just about above after again all also am any as because before between both each "
    "few get got here him how into more most new now only other out own same some such there through up what when where which while "
    "who whom why down during over under"
).split()


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: str | Column) -> Column:
    """Words of two or more ASCII letters that stand alone, lower-cased, in order."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike("^[a-z]{2,}$"))


def content_tokens(text: str | Column, extra: tuple[str, ...] = ()) -> Column:
    # A map is looked up by hash, a list would be read word by word for each token.
    stop = F.create_map(*[F.lit(x) for w in sorted({*STOP_WORDS, *(x.lower() for x in extra)}) for x in (w, True)])
    return F.filter(tokens(text), lambda w: stop[w].isNull())


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by blanks; none where there are fewer."""
    out = words
    for k in range(1, n):
        # Only elements enter the lambda: anything else in it would be worked out again for each one.
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.filter(out, lambda x: x.isNotNull())


def term_counts(docs: DataFrame, grams: Column, id_col: str = "doc_id") -> DataFrame:
    """(term, count, doc_freq): each text's terms are sorted, so the first of equal ones is marked in the text and both counts combine within each task.

    Where an id is null or repeats, terms are counted by id and term first.
    """
    each = docs.select(F.col(id_col).alias("_d"), grams.alias("_g"))
    if docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        # Exploded, so that the text is split once and not in every place that reads its terms.
        each = each.select(F.explode(F.array(F.sort_array("_g"))).alias("_g"))
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice("_g", F.lit(1), F.greatest(F.size("_g") - 1, F.lit(0))))
        marked = F.zip_with("_g", before, lambda x, y: F.struct(x.alias("term"), (~x.eqNullSafe(y)).cast("long").alias("first")))
        # Of an empty text the entry before is left over.
        flat = each.where(F.size("_g") > 0).select(F.explode(marked).alias("x")).select("x.term", "x.first")
        return flat.groupBy("term").agg(F.count("*").alias("count"), F.sum("first").alias("doc_freq"))
    each = each.select("_d", F.explode("_g").alias("term")).groupBy("_d", "term").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("count"), F.count("*").alias("doc_freq"))


def tfidf(docs: DataFrame, text: str = "text", id_col: str = "doc_id", top: int = 100) -> DataFrame:
    """(term, count, doc_freq, tf_idf) of the top terms.

    Of the 3 * top commonest terms: count over all words of the corpus, times
    ln(documents / doc_freq), rounded to 6 places.  Ties by term.
    """
    worded = docs.where(F.col(text).isNotNull())
    # Both the total and the ranking read the counts: texts are split into tokens once.
    counts = cut(term_counts(worded, content_tokens(text), id_col))
    n = worded.count()
    words = counts.agg(F.sum("count")).first()[0] or 1
    best = counts.orderBy(F.desc("count"), "term").limit(3 * top)
    return best.withColumn("tf_idf", F.round(F.col("count") / F.lit(float(words)) * F.log(F.lit(float(n)) / F.col("doc_freq")), 6)).orderBy(F.desc("tf_idf"), "term").limit(top)


def top_ngrams(docs: DataFrame, n: int, text: str = "text", id_col: str = "doc_id", top: int = 100, least: int = 2) -> DataFrame:
    """(term, count, doc_freq) of the commonest n-grams of content words, in at least ``least`` documents."""
    worded = docs.where(F.col(text).isNotNull()).select(id_col, content_tokens(text).alias("_w"))
    counts = term_counts(worded, ngrams(F.col("_w"), n), id_col)
    return counts.where((F.col("count") >= least) & (F.col("doc_freq") >= least)).orderBy(F.desc("count"), "term").limit(top)


def patterns(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.001) -> DataFrame:
    """The top 200 terms with tf_idf of at least ``least`` in two documents or more."""
    return tfidf(docs, text, id_col, 200).where((F.col("tf_idf") >= least) & (F.col("doc_freq") >= 2))


def network(docs: DataFrame, sender: str, recipients: str, id_col: str = "id", head: int | None = None, text: str = "text") -> DataFrame:
    """(sender, recipient, messages): every sender of a text with every recipient of it, other than itself; with head, of its first characters only."""
    start = F.col(text) if head is None else F.substring(text, 1, head)
    found = docs.select(
        F.col(id_col).alias("_d"),
        F.array_distinct(F.regexp_extract_all(start, F.lit(sender), F.lit(1))).alias("s"),
        F.array_distinct(F.regexp_extract_all(start, F.lit(recipients), F.lit(1))).alias("r"),
    )
    pairs = found.select("_d", F.explode("s").alias("sender"), "r").select("_d", "sender", F.explode("r").alias("recipient"))
    return pairs.where((F.col("sender") != F.col("recipient")) & (F.length("sender") <= 100) & (F.length("recipient") <= 100)).groupBy("sender", "recipient").agg(F.count("*").alias("messages"))


def strip_tags(html: str | Column) -> Column:
    """Markup replaced by blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(html), "<[^>]+>", " "), r"\s+", " "))


def readable(text: str | Column) -> Column:
    """Over 90 % printable ASCII or letters, and a mean word length between 2 and 15."""
    t = _c(text)
    n = F.greatest(F.char_length(t), F.lit(1))
    shown = F.regexp_count(t, F.lit(r"[\p{L}\p{N}\p{P}\p{S}\s]"))
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    mean = F.aggregate(words, F.lit(0), lambda s, w: s + F.char_length(w)) / F.greatest(F.size(words), F.lit(1))
    return F.coalesce((shown / n > 0.9) & (mean > 2) & (mean < 15), F.lit(False))
