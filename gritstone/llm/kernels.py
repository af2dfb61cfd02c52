"""Vectorised text kernels: words and their 64-bit hashes straight from UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np

_MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers fixed by seed."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & _MASK) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mix64(z: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_SPAN = 32
_CELLS = splitmix(20_231, _SPAN * 256).reshape(_SPAN, 256)
_FAR = splitmix(77_003, 1)[0] | np.uint64(1)


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """256 entries: 0 for a separator, otherwise the byte itself, with A-Z lowered if asked."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


#: Words as the near-duplicate and mixing contracts define them: no space, no tab to carriage return.
WORDS = byte_table(bytes([0x20, *range(9, 14)]))
#: Words of letters and digits: any ASCII punctuation or control also separates.
LETTERS = byte_table(bytes(x for x in range(128) if not chr(x).isalnum()))


#: Bytes of several texts that are worked on at once; the arrays that a slice of text needs are some fifty times as large.
CHUNK = 1 << 18


def chunks(items: Sequence, limit: int = CHUNK, size: Callable[[Any], int] = len) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items (texts) of about limit bytes; a larger one stands alone."""
    start = held = 0
    for i, item in enumerate(items):
        more = size(item)
        if held and held + more > limit:
            yield start, i
            start, held = i, 0
        held += more + 1
    if start < len(items):
        yield start, len(items)


#: Bytes of a text that are in memory as arrays at once.
SLICE = 1 << 22


def text_slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """text in parts of about size bytes, each cut behind a blank or line end; a longer run without one stays whole."""
    at = 0
    while len(text) - at > size:
        stop = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size)) + 1
        if stop <= at:
            ends = [x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0]
            stop = min(ends) + 1 if ends else len(text)
        yield text[at:stop]
        at = stop
    if at < len(text):
        yield text[at:]


def word_hashes(texts: list[bytes], table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): the words of text i are hash[bounds[i]:bounds[i + 1]].

    NUL bytes are part of a word unless the table says that they separate.  Texts
    above SLICE bytes are read slice by slice.
    """
    if len(texts) == 1 and len(texts[0]) > SLICE and len(parts := list(text_slices(texts[0], SLICE))) > 1:
        found = np.concatenate([word_hashes([x], table)[0] for x in parts])
        return found, np.array([0, len(found)], np.int64)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    mapped = table[buffer]
    inside = mapped != 0
    if table is WORDS:
        inside |= buffer == 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    sizes = np.flatnonzero(edge == -1) - starts
    ends = np.cumsum(lengths)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    at = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    offset = np.arange(len(at)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        cells = _CELLS[offset & (_SPAN - 1), mapped[at]]
        if int(sizes.max()) > _SPAN:
            far = offset >= _SPAN
            cells[far] = mix64(cells[far] * _FAR + (offset[far] // _SPAN).astype(np.uint64))
        found = mix64(np.add.reduceat(cells, first) + sizes.astype(np.uint64))
    return found, bounds


_LEFT, _RIGHT = (int(x) | 1 for x in splitmix(9_176, 2))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words (not distinct) with their bounds; a shorter text gives its whole sequence."""
    count = np.diff(bounds)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_bounds = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    owner = np.repeat(np.arange(len(count)), runs)
    at = bounds[:-1][owner] + (np.arange(out_bounds[-1]) - out_bounds[:-1][owner])
    size = np.minimum(count, width)[owner]
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for k in range(width):
            here = size > k
            step = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else total
            total = np.where(here, total * np.uint64(_LEFT) + step * np.uint64(_RIGHT), total)
        return mix64(total + size.astype(np.uint64)), out_bounds


def distinct_runs(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each run."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
