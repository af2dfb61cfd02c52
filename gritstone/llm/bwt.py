"""Shard Burrows-Wheeler transforms, and their merge by refining an interleave.

A shard is a set of byte strings.  Its transform lists its suffixes in order, each
with the symbols in front of it.  Several shards are merged without sorting their
suffixes again: the interleave of their rows, right for the first k symbols,
becomes right for k + 2 by going through it once and dealing each row's
predecessor to the place of the two symbols that lead to it.  Where neighbouring
rows part is known from the step before, so common prefixes come for nothing;
rows that stand alone are settled, and so is whatever precedes them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shard:
    """Rows are suffixes in order.  at: where each begins in the shard's joined strings; offset: in its own string; first, before: two symbols from there, and the two in front; back: row of the suffix two symbols longer, -1 for none; rest: symbols to the string's end."""

    at: np.ndarray
    offset: np.ndarray
    rest: np.ndarray
    first: np.ndarray
    before: np.ndarray
    back: np.ndarray


#: Symbols of a suffix that are packed into its first number.
_PACKED = 7


def _dense(values: np.ndarray) -> np.ndarray:
    """Each value's place among the different ones, from 1."""
    order = np.argsort(values)
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.diff(values[order], prepend=-1) != 0)
    return out


def transform(text: np.ndarray, starts: np.ndarray, depth: int) -> Shard:
    """The transform of the strings text[starts[i]:starts[i + 1]]: suffixes in the order of their first depth symbols, then of their place.  A suffix that ends comes before its continuations."""
    n = len(text)
    sizes = np.diff(starts)
    offset = np.arange(n) - np.repeat(starts[:-1], sizes)
    rest = np.repeat(sizes, sizes) - offset
    symbols, rank = text.astype(np.int64) + 1, np.zeros(n, np.int64)
    for j in range(_PACKED):
        ahead = np.zeros(n, np.int64)
        ahead[: n - j] = symbols[j:]
        ahead[rest <= j] = 0
        rank = rank * 257 + ahead
    rank, k = _dense(rank), _PACKED
    while k < depth and n and rank.max() < n:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:]
        after[rest <= k] = 0
        rank, k = _dense(rank * (n + 1) + after), 2 * k
    at = np.argsort(rank * (n + 1) + np.arange(n))
    row = np.empty(n, np.int32)
    row[at] = np.arange(n, dtype=np.int32)
    pair = np.zeros(n, np.uint16)
    pair[:-1] = text[:-1].astype(np.uint16) << 8 | text[1:]
    longer = offset[at] >= 2
    return Shard(at, offset[at], rest[at], pair[at], np.where(longer, pair[at - 2], 0).astype(np.uint16), np.where(longer, row[at - 2], -1).astype(np.int32))


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row, interval) of all suffixes whose first depth symbols stand at least twice in the shards, in merged order; depth is even.

    interval numbers the repeated intervals: neighbours with a common prefix of
    depth symbols or more.
    """
    bases = np.cumsum([0, *(len(s.at) for s in shards)])
    first, before = (np.concatenate([getattr(s, name) for s in shards]) for name in ("first", "before"))
    back = np.concatenate([np.where(s.back >= 0, s.back + base, -1) for s, base in zip(shards, bases, strict=False)]).astype(np.int32)
    rows = np.flatnonzero(np.concatenate([s.rest for s in shards]) >= 2).astype(np.int32)
    rows = rows[np.argsort(first[rows], kind="stable")]
    symbols = first[rows]
    new = np.ones(len(rows), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    k = 2
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        rows, block = rows[~alone], np.cumsum(new, dtype=np.int32)[~alone]
        if k >= depth or not len(rows):
            break
        longer = back[rows] >= 0
        rows, block = rows[longer], block[longer]
        symbols = before[rows]
        order = np.argsort(symbols, kind="stable")
        rows, block, symbols = back[rows[order]], block[order], symbols[order]
        new = np.ones(len(rows), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        k += 2
    interval = np.cumsum(np.diff(block, prepend=-1) != 0) - 1
    shard = np.searchsorted(bases, rows, side="right") - 1
    return shard, rows - bases[shard], interval
