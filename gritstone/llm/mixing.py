"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

Targets share out all words by weight; none exceeds ``cap`` times its source,
and what is cut off goes to the others by weight.  Equal blocks of words are
then given to sources by highest quotients target / (2j - 1), which makes
integer quotas, shard by shard.  A source's documents form a stream in seeded
order, cut into blocks; shard after shard takes its quota of blocks from where
the one before ended, again from the start after each full pass.  What the mix
takes of a document is the sum of what the shards take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 64
SHARDS = 8
CAP = 3
#: Documents of one source that share a bucket of its stream, about.
BUCKET_ROWS = 1_024


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, key, otherwise):
    """60 bits of the md5 of seed and key (of otherwise, where key is null): the order of a source's stream."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), otherwise, F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources(source, source_size) with weight and target; one row per source, null last.

    The level x with sum of min(cap * size, weight * x) = total is found from
    the sources in order of cap * size / weight, by running sums.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    at = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    place = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    up = place.rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.withColumn("place", F.row_number().over(place)).withColumn("below", F.coalesce(F.sum("most").over(up), F.lit(0.0))).withColumn("weight_below", F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    every = Window.partitionBy(F.lit(0))
    full = full.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    full = full.withColumn("x", (F.col("total") - F.col("below")) / (F.col("weights") - F.col("weight_below")))
    # The level is the x of the first source that it does not fill.
    level = F.min(F.when(F.col("x") <= F.col("ratio"), F.struct("place", "x"))).over(every)["x"]
    return full.withColumn("target", F.least(F.col("most"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "weight", "total", "target")


def quotas(wanted: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """wanted with blocks (array: quota of each shard).

    After s shards, s / shards of all blocks are given out by highest
    quotients, so a shard's quota is a difference of two apportionments.
    Quotients that surely win are counted, not listed: with d such that rounding
    target / d up to d gives no more than the blocks there are, each source holds
    round(target / d) of them; only the few after that are ranked.
    """
    every = Window.partitionBy("s")
    steps = wanted.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    seats = F.floor(F.col("total") / block_words * F.col("s") / shards + 0.5).cast("double")
    steps = steps.withColumn("seats", seats).withColumn("sum", F.sum("target").over(every)).withColumn("n", F.count("*").over(every))
    sure = F.greatest(F.lit(0.0), F.ceil(F.col("target") * F.greatest(F.lit(0.0), F.col("seats") - F.col("n") / 2) / F.col("sum") - 0.5))
    most = F.ceil(F.col("target") * (F.col("seats") + F.col("n") / 2 + 1) / F.col("sum") + 0.5)
    steps = steps.withColumn("sure", F.when(F.col("sum") > 0, sure).otherwise(0.0).cast("long")).withColumn("most", F.when(F.col("sum") > 0, most).otherwise(0.0).cast("long"))
    steps = steps.withColumn("left", F.col("seats") - F.sum("sure").over(every))
    listed = steps.withColumn("j", F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("most")))))
    rank = Window.partitionBy("s").orderBy(F.desc(F.col("target") / (2 * F.col("j") - 1)), F.col("source").isNull(), F.col("source").cast("binary"))
    won = F.col("j").isNotNull() & (F.row_number().over(rank) <= F.col("left"))
    given = listed.withColumn("won", won).groupBy("source", "source_size", "weight", "target", "s").agg((F.first("sure") + F.sum(F.col("won").cast("long"))).alias("upto"))
    kept = given.groupBy("source", "source_size", "weight", "target").agg(F.array_sort(F.collect_list(F.struct("s", "upto"))).alias("upto"))
    # An apportionment of more blocks never gives a source fewer (house monotonicity), so differences are not negative.
    blocks = F.transform("upto", lambda x, i: x["upto"] - F.when(i > 0, F.get(F.col("upto.upto"), i - 1)).otherwise(0))
    return kept.select("source", "source_size", "weight", "target", blocks.alias("blocks"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    cap: int = CAP,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id_col, size, source_size, target, taken, shard_words, first_word, *keep), one row per row of docs.

    size counts words of the text, however long (null: 0).  shard_words has what
    each shard's blocks hold of the document, and taken is their sum: whole
    passes plus, of the one document where a source's last block ends, some first
    words.  It never exceeds cap times size.  first_word is the document's place
    in its source's stream.  Equal ids are ordered by the text's hash, so are
    null ones among themselves; rows equal in both are told apart only by place.
    A null source is one of its own, the last.  A source without words takes
    nothing; an empty table gives none.  Columns other than those named are not
    read, whatever their names.
    """
    names = [f"k{i}" for i in range(len(keep))]
    given = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        seeded(seed, F.col(id_col), F.md5(F.col(text_col).cast("string"))).alias("h"),
        F.xxhash64(F.lit(seed), F.col(text_col).cast("string")).alias("t"),
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
    )
    narrow = cut(given) if not keep else given
    count = narrow.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, count // BUCKET_ROWS)
    placed = narrow.withColumn("bucket", F.expr(f"h div {(1 << 60) // buckets + 1}"))
    sums = cut(placed.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    wanted = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    plan = quotas(wanted, block_words, shards)
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda n: F.least(F.aggregate(F.slice("blocks", 1, n), F.lit(0).cast("long"), lambda a, b: a + b) * block_words, F.col("source_size") * cap))
    # The last shard ends where the source's quota does.
    plan = cut(plan.select("source", "source_size", "target", upto.alias("upto")))
    known = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"], "bucket", "start", "source_size", "target", "upto")
    known = known.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    joined = placed.join(known, placed["source"].eqNullSafe(known["s"]) & (placed["bucket"] == known["b"]))
    within = Window.partitionBy("s", "b").orderBy("h", "id", "t").rowsBetween(Window.unboundedPreceding, -1)
    stream = joined.withColumn("first_word", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    # Each pass is a run of the source's repeated stream; a shard takes what lies between the end of the one before and its own.
    quota = F.element_at("upto", -1)
    begins = F.when((F.col("size") > 0) & (quota > F.col("first_word")), F.sequence(F.col("first_word"), quota - 1, F.col("source_size"))).otherwise(F.array().cast("array<long>"))
    lows = F.concat(F.array(F.lit(0).cast("long")), F.slice("upto", 1, shards - 1))
    held = F.transform(
        F.array(F.struct(begins.alias("begins"), F.arrays_zip(lows.alias("low"), F.col("upto").alias("high")).alias("ends"))),
        lambda t: F.transform(t["ends"], lambda e: F.aggregate(t["begins"], F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(0).cast("long"), F.least(x + F.col("size"), e["high"]) - F.greatest(x, e["low"])))),
    )[0]
    stream = stream.withColumn("shard_words", held)
    taken = F.aggregate("shard_words", F.lit(0).cast("long"), lambda a, b: a + b)
    return stream.select(
        F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), "shard_words", "first_word", *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)]
    )


def shard_parts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    cap: int = CAP,
    seed: int = 7,
) -> DataFrame:
    """(id_col, pass, shard, first, words): what each shard takes of each document that mix takes from.

    A source's stream is cut at the cumulative quotas of its shards, so shard s
    (from 0) holds as many of its blocks as quotas gives it.  A part is ``words``
    words of the document from word ``first`` on, in the stream's given pass.
    """
    mixed = cut(mix(docs, id_col, text_col, source_col, weights, block_words, shards, cap, seed, keep=(source_col,)))
    mixed = mixed.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), "size", "source_size", "taken", "first_word")
    plan = quotas(targets(mixed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), block_words, shards)
    upto = F.aggregate(F.slice("blocks", 1, F.col("shard") + 1), F.lit(0).cast("long"), lambda a, b: a + b)
    ends = plan.select("source", "source_size", "blocks", F.posexplode("blocks").alias("shard", "n")).withColumn("upto", upto)
    most = F.col("source_size") * cap
    ends = ends.select(F.col("source").alias("s"), "shard", F.least((F.col("upto") - F.col("n")) * block_words, most).alias("low"), F.least(F.col("upto") * block_words, most).alias("high")).where("high > low")
    passes = mixed.where("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    begin = F.col("pass") * F.col("source_size") + F.col("first_word")
    passes = passes.withColumn("begin", begin).withColumn("end", begin + F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size")))
    met = passes.join(ends, passes["source"].eqNullSafe(ends["s"]) & (F.col("begin") < F.col("high")) & (F.col("end") > F.col("low")))
    first = F.greatest("begin", "low")
    return met.select(F.col("id").alias(id_col), "pass", "shard", (first - F.col("begin")).alias("first"), (F.least("end", "high") - first).alias("words"))


def take(mixed: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """The documents that a mix takes: a row for each whole pass, one with the first words for a part."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn("part", F.explode(parts))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), 1, F.greatest(F.col("part"), F.lit(1))), "")
    return rows.withColumn(text_col, F.when(F.col("part") > 0, head).otherwise(F.col(text_col))).select(*columns)
