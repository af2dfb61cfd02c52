"""File listings and contents as DataFrames, and the extractors that run over contents."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import paths

EDGE = 64 << 10


def listing(spark: SparkSession, root: str, drive: str, most_bytes: int = 50 << 30, hidden: bool = False) -> DataFrame:
    """(drive_id, path, filename, file_type, size, modified_s) below root, without ignored names and too large files.

    Only names and sizes are read: the content column is pruned.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_s"))
    kept = rows.where((F.col("size") <= most_bytes) & ~paths.ignored("path"))
    if not hidden:
        kept = kept.where(~paths.hidden("path"))
    return kept.select(F.lit(drive).alias("drive_id"), "path", paths.basename("path").alias("filename"), paths.extension("path").alias("file_type"), "size", "modified_s")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of the files below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), "content")


def quick_hash(content: bytes) -> str:
    """xxh64 (seed 0) of the first 64 KiB, the last 64 KiB (what is left, if that is less) and the size in digits."""
    h = xxhash.xxh64(content[:EDGE])
    if len(content) > EDGE:
        h.update(content[-min(EDGE, len(content) - EDGE) :])
    h.update(str(len(content)).encode())
    return h.hexdigest()


def hashed(files: DataFrame) -> DataFrame:
    """files (with content) with quick_hash and content_hash; the content stays behind."""

    @F.pandas_udf("string")
    def quick(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else quick_hash(x))

    return files.select(*[c for c in files.columns if c != "content"], quick("content").alias("quick_hash"), F.sha2("content", 256).alias("content_hash"))


def texts(files: DataFrame, most_chars: int | None = None) -> DataFrame:
    """(path, text): UTF-8 with errors left out, trimmed; whole texts unless most_chars limits them."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else x.decode("utf-8", "ignore").strip()[:most_chars])

    return files.select("path", decode("content").alias("text"))


def extract(rows: DataFrame, extractor: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """One output row for each input row: the extractor's fields, or null fields and the error's text.

    schema names key and fields; the extractor gets a row as a dict.  A failing
    row is recorded with its error, so that a work-list doesn't meet it forever.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    got, error = extractor(row) or {}, None
                except Exception as e:  # noqa: BLE001 - the error is the row's result
                    got, error = {}, f"{type(e).__name__}: {e}"
                out.append({n: got.get(n, row.get(n)) for n in names} | {"error": error})
            yield pd.DataFrame(out, columns=[*names, "error"])

    return rows.mapInPandas(run, f"{schema}, error string")


def embedding_bytes(values: list[float]) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


def embedding(column: str = "embedding") -> Callable:
    """Little-endian 32-bit floats as an array."""

    @F.pandas_udf("array<float>")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else list(struct.unpack(f"<{len(x) // 4}f", x)))

    return read(column)


# Classes of a decoder's complaint about an image.
CORRUPTIONS = (("truncated", "truncated"), ("extraneous", "extraneous_data"), ("marker", "invalid_markers"), ("cannot identify", "unreadable"))


def corruption(message, size):
    """Struct of class and severity (high below 10,240 bytes) of a decoder's message; null without one."""
    kind = F.lit("unknown")
    for part, name in reversed(CORRUPTIONS):
        kind = F.when(F.contains(F.lower(message), F.lit(part)), name).otherwise(kind)
    return F.when(message.isNotNull(), F.struct(kind.alias("corruption_type"), F.when(size < 10_240, "high").otherwise("medium").alias("severity")))
