"""Cost-balanced packing of documents into token sequences.

A task encodes its documents and packs them window by window: pieces of a
window (documents, or what is left of long ones after full sequences were cut
off) go in descending order to the sequence of lowest estimated attention cost
(linear plus quadratic in each piece) that has room; a piece that fits nowhere
is cut.  Sequences leave the task full.  What stays over at the end of a window
is carried into the next one; at the end of the task it is cut into sequences
of powers of two, which need no padding.  Nothing is shuffled, and a task holds
one window at a time.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.tokens import Pieces

CAPACITY = 4_096
WINDOW_TOKENS = 1 << 20
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1_024

#: (document, start, length)
Piece = tuple[int, int, int]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(pieces: list[Piece], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """(full sequences, pieces left over): every sequence has exactly capacity tokens, what is left is less than that."""
    full: list[list[Piece]] = []
    short: list[Piece] = []
    for doc, start, length in pieces:
        while length >= capacity:
            full.append([(doc, start, capacity)])
            start, length = start + capacity, length - capacity
        if length:
            short.append((doc, start, length))
    count = sum(p[2] for p in short) // capacity
    if not count:
        return full, short
    short.sort(key=lambda p: (-p[2], p[0], p[1]))
    room = np.full(count, capacity)
    load = np.zeros(count)
    bins: list[list[Piece]] = [[] for _ in range(count)]
    late: list[Piece] = []
    for piece in short:
        fits = np.where(room >= piece[2], load, np.inf)
        at = int(fits.argmin())
        if fits[at] == np.inf:
            late.append(piece)
            continue
        bins[at].append(piece)
        room[at] -= piece[2]
        load[at] += cost(piece[2])
    # What fits nowhere is cut to fill the rest, cheapest sequences first.
    over = late[::-1]
    for at in np.argsort(load, kind="stable"):
        while room[at] and over:
            doc, start, length = over.pop()
            part = min(length, int(room[at]))
            bins[at].append((doc, start, part))
            room[at] -= part
            if part < length:
                over.append((doc, start + part, length - part))
    return full + [b for b, r in zip(bins, room, strict=True) if not r], over + [p for b, r in zip(bins, room, strict=True) if r for p in b]


def tail(pieces: list[Piece]) -> list[list[Piece]]:
    """The last pieces of a task as sequences of powers of two, largest first."""
    left = sum(p[2] for p in pieces)
    todo, out = list(pieces[::-1]), []
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out.append([])
        while size:
            doc, start, length = todo.pop()
            part = min(length, size)
            out[-1].append((doc, start, part))
            size -= part
            if part < length:
                todo.append((doc, start + part, length - part))
    return out


def _emit(sequences: list[list[Piece]], base: int, ids: dict, tokens: dict) -> pd.DataFrame:
    rows = []
    for k, sequence in enumerate(sequences):
        offset = 0
        for doc, start, length in sequence:
            body = tokens[doc]
            rows.append((ids[doc], start, length, zlib.crc32(body[4 * start : 4 * (start + length)]), len(body) // 4, base + k, offset))
            offset += length
    return pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 2,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    A document is its ids without special tokens, then end_id; a null text is
    end_id alone.  Each id lies in exactly one piece and offsets are gapless.
    capacity must be a power of two.  Sequence ids are distinct, not gapless:
    the task's number times 2**32 plus a count.  Repeated and null ids are packed
    row by row, equal rows too.  A very long text is cut into full sequences as it
    is.  Documents of equal length go in their order of reading, sequences of equal
    cost are filled from the first on.  An empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Pieces(tokenizer_path, lambda ids: array("I", ids).tobytes(), b"".join)
        base = TaskContext.get().partitionId() << 32
        end = array("I", [end_id]).tobytes()
        ids: dict[int, int] = {}
        tokens: dict[int, bytes] = {}
        waiting: list[Piece] = []
        held = seen = 0
        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                body = (encode(text) if isinstance(text, str) else b"") + end
                ids[seen], tokens[seen] = key, body
                waiting.append((seen, 0, len(body) // 4))
                held += len(body) // 4
                seen += 1
                if held >= window_tokens:
                    full, waiting = assign(waiting, capacity)
                    yield _emit(full, base, ids, tokens)
                    base += len(full)
                    alive = {p[0] for p in waiting}
                    ids, tokens = {d: ids[d] for d in alive}, {d: tokens[d] for d in alive}
                    held = sum(p[2] for p in waiting)
        full, waiting = assign(waiting, capacity)
        last = full + tail(waiting)
        if last:
            yield _emit(last, base, ids, tokens)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = given.mapInPandas(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
