"""Token counts through a digest cache.

The key of a count is the digest of the normalised content together with the
digest of the tokenizer file and of the library's version.  Contents whose key
is stored are joined, each other distinct content is encoded once, and the new
counts are appended to the cache as Parquet.  Normalising is the identity but
for null, which counts as empty: any other folding could change a count.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from importlib.metadata import version
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.session import cut, scratch_path

#: Entries of a worker's piece cache, and characters of a piece that enters it: 150 MB at most, 250 with values of ids.
PIECES = 800_000
PIECE_CHARS = 32
#: Contents of this part of all rows and more are joined by broadcast.
PART = 1 / 4_096


def tokenizer_digest(path: str) -> str:
    """Names the vocabulary file's bytes and the library that reads it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|tokenizers {version('tokenizers')}".encode()).hexdigest()


class Pieces:
    """Whole texts by a tokenizers file, working out each distinct piece of text once.

    Neither supported pre-tokenizer lets a token cross a space that follows a
    non-space, so a text falls there into pieces.  A piece of plain characters
    is split by the file's own pre-tokenizer pattern and given to its BPE
    model; any other piece, and any text with a space behind other white
    space, goes through the library's whole pipeline.  ``value`` makes what is
    kept of a list of ids, ``join`` puts the parts of a text together.
    """

    def __init__(self, path: str, value: Callable[[list[int]], Any], join: Callable[[Iterable], Any], pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.model = self.encoder.model
        self.value, self.join, self.limit = value, join, pieces
        self.known: dict[str, Any] = {}
        self.specials = [x["content"] for x in config["added_tokens"]]
        self.keeps_space = config["pre_tokenizer"]["type"] == "ByteLevel"
        if self.keeps_space:
            self.pattern, self.lower = regex.compile(BYTE_LEVEL_PATTERN), False
        else:
            self.pattern, self.lower = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), True
        self.plain = regex.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\xff]*").fullmatch
        self.tokens: dict[str, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.encoder.encode(text, add_special_tokens=False).ids

    def plain_piece(self, text: str) -> Any:
        """text holds plain characters only."""
        ids: list = []
        for word in self.pattern.findall(text.lower() if self.lower else text):
            got = self.tokens.get(word)
            if got is None:
                shown = word.replace(" ", "\u0120") if word.isascii() and word.isprintable() else "".join(map(BYTE_CHARS.__getitem__, word.encode()))
                got = self.model.tokenize(shown)
                if len(word) < 6 and len(self.tokens) < 20_000:
                    self.tokens[word] = got
            ids += got
        return self.value([t.id for t in ids])

    def __call__(self, text: str) -> Any:
        if _LOOSE.search(text) or any(x in text for x in self.specials):
            return self.value(self.whole(text))
        piece = self.plain_piece if self.plain(text) else lambda t: self.plain_piece(t) if self.plain(t) else self.value(self.whole(t))
        first, *rest = text.split(" ")
        known = self.known
        try:
            parts = [known[p] for p in rest]
        except KeyError:
            parts = []
            for p in rest:
                got = known.get(p)
                if got is None:
                    got = piece(" " + p)
                    if len(known) < self.limit and len(p) <= PIECE_CHARS:
                        known[p] = got
                parts.append(got)
        return self.join([piece(first), *parts]) if first else self.join(parts)


#: Fixed values of byte-level BPE: the pattern that cuts words, and the printable character of each byte.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


def token_counter(path: str) -> Pieces:
    return Pieces(path, len, sum)


_LOOSE = re.compile(r"\s ")


def _encoder_batches(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(path)
        last = None
        for pdf in batches:
            # The join leaves repeated rows beside one another.
            pdf = pdf.drop_duplicates("digest")
            pdf = pdf[pdf["digest"] != last] if last is not None else pdf
            last = pdf["digest"].iloc[-1] if len(pdf) else last
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": [count(x) for x in pdf["text"]]})

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit, digest), one row per row of docs.

    Null texts count as empty: 0 bytes, 0 tokens.  Whole texts count, however
    long.  Repeated texts and repeated or null ids keep their rows.  No begin, end or padding tokens, no truncation.  An
    empty table gives an empty result.  Other columns of docs are not read.
    Without ``cache_path`` the counts live in the shared checkpoint folder for
    this call only; with it they are read first and appended to.
    """
    spark = docs.sparkSession
    tag = tokenizer_digest(tokenizer_path)
    path = cache_path or scratch_path(spark, "token-counts")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), body.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.lit(tag), F.col("text")), 256))
    index = cut(given.select("id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")))
    grouped = cut(index.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    wanted = grouped.select("digest", "id")
    stored = _stored(spark, path)
    if stored is not None:
        wanted = wanted.join(stored.select("digest"), "digest", "left_anti")
    # A repeated id may carry other texts; only the row whose own content is wanted is encoded, once where rows repeat.
    mine = given.select(F.col("id").alias("own"), "text", digest.alias("key"))
    fresh = mine.join(wanted, mine["own"].eqNullSafe(wanted["id"]) & (mine["key"] == wanted["digest"])).select("digest", "text")
    counted = fresh.mapInPandas(_encoder_batches(tokenizer_path), "digest binary, n_tokens long")
    counted.write.mode("append").parquet(path)
    cache = spark.read.schema("digest binary, n_tokens long").parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # A content that many rows share would make one task of the join; of such there are at most 1 / PART.
    often = grouped.where(F.col("n") >= grouped.agg(F.sum("n")).first()[0] * PART) if not index.isEmpty() else grouped
    few = cache.join(F.broadcast(often.select("digest")), "digest", "left_semi").withColumnRenamed("n_tokens", "own")
    marked = index.join(F.broadcast(few), "digest", "left")
    rare = marked.where("own is null").drop("own").join(cache, "digest")
    out = rare.unionByName(marked.where("own is not null").withColumnRenamed("own", "n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))


def _stored(spark, path: str) -> DataFrame | None:
    """The counts at path, or None where nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema("digest binary, n_tokens long").parquet(path) if files.exists(where) else None
