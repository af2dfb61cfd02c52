"""Pixels of PNG, BMP and PNM files without an image library, and the features that need no model.

Other formats are decoded by whatever decoder the caller gives.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gritstone.sources.extractors import image_scores, perceptual_hashes

#: Bins of hue and of saturation.
HIST_BINS = 32


def _png(content: bytes) -> np.ndarray | None:
    at, packed, head, palette = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[6]:
        return None
    width, height, _, colour, _, _, _ = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    lines = np.zeros((height + 1, (width + 1) * channels), np.int32)
    for y in range(height):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        above = lines[y, channels:]
        if rule == 0:
            lines[y + 1, channels:] = line
        elif rule == 2:
            lines[y + 1, channels:] = (line + above) & 255
        elif rule == 1:
            whole = line.reshape(width, channels)
            lines[y + 1, channels:] = (np.cumsum(whole, axis=0) & 255).ravel()
        else:
            own, left_up = lines[y + 1], lines[y]
            for x in range(width * channels):
                a, b, c = int(own[x]), int(above[x]), int(left_up[x])
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                own[x + channels] = (int(line[x]) + guess) & 255
    pixels = lines[1:, channels:].astype(np.uint8).reshape(height, width, channels)
    if colour == 3 and palette is not None:
        return palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def _bmp(content: bytes) -> np.ndarray | None:
    start, width, height, bits, packing = struct.unpack_from("<I", content, 10)[0], *struct.unpack_from("<ii", content, 18), *struct.unpack_from("<HI", content, 28)
    if bits not in (24, 32) or packing not in (0, 3):
        return None
    step = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * bits // 8]
    pixels = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


_PNM_HEAD = re.compile(rb"P[56]" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s")


def _pnm(content: bytes) -> np.ndarray | None:
    head = _PNM_HEAD.match(content)
    if not head or int(head[3]) != 255:
        return None
    width, height = int(head[1]), int(head[2])
    channels = 3 if content[:2] == b"P6" else 1
    pixels = np.frombuffer(content, np.uint8, width * height * channels, head.end()).reshape(height, width, channels)
    return pixels if channels == 3 else np.repeat(pixels, 3, axis=2)


def pixels_of(content: bytes) -> np.ndarray | None:
    """Red, green and blue of each pixel; None where this module can't tell."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(content)
        if content[:2] == b"BM":
            return _bmp(content)
        if content[:2] in (b"P5", b"P6"):
            return _pnm(content)
    except (struct.error, zlib.error, ValueError, KeyError, IndexError):
        return None
    return None


def hue_saturation(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue from 0 to 180 and saturation from 0 to 255 of red-green-blue pixels."""
    rgb = pixels.reshape(-1, 3).astype(float)
    top, low = rgb.max(axis=1), rgb.min(axis=1)
    spread = top - low
    safe = np.where(spread > 0, spread, 1.0)
    r, g, b = rgb.T
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    hue = np.where(spread > 0, hue * 60.0 % 360.0, 0.0) / 2
    return hue, np.where(top > 0, 255.0 * spread / np.where(top > 0, top, 1.0), 0.0)


def colour_histogram(pixels: np.ndarray, bins: int = HIST_BINS) -> list[float] | None:
    """Counts over hue and saturation at unit length; None for an image without pixels."""
    if not pixels.size:
        return None
    hue, saturation = (np.round(x) for x in hue_saturation(pixels))
    i = np.minimum(hue % 180 * bins // 180, bins - 1).astype(int)
    j = np.minimum(saturation * bins // 256, bins - 1).astype(int)
    counts = np.bincount(i * bins + j, minlength=bins * bins).astype(float)
    return (counts / np.linalg.norm(counts)).tolist()


def likely_colours(shares: dict[str, float], least: float = 0.10, most: int = 3) -> list[str]:
    """Labels above ``least``, in the order of the labels, the first ``most`` of them."""
    return [name for name, share in shares.items() if share > least][:most]


_KINDS = "path string, width int, height int, phash long, dhash long, ahash long, histogram array<double>, laplacian double, mean double, p5 double, p95 double, deviation double, high_pass double"
_NAMES = [x.split()[0] for x in _KINDS.split(", ")]


def image_features(files: DataFrame, decode: Callable[[bytes], np.ndarray | None] = pixels_of) -> DataFrame:
    """Size, three 64-bit hashes, colour histogram and what the quality scores take, of files(path, content).

    Files that decode can't read keep their path with nulls, so that a
    work-list doesn't meet them forever.  Images are read one at a time.
    """

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                pixels = None if content is None else decode(bytes(content))
                if pixels is None or not pixels.size:
                    rows.append({"path": path})
                    continue
                grey = pixels.astype(float) @ np.array([0.299, 0.587, 0.114])
                p, d, a = perceptual_hashes(grey)
                scores = image_scores(grey) if min(grey.shape) >= 3 else {}
                rows.append({"path": path, "width": pixels.shape[1], "height": pixels.shape[0], "phash": signed(p), "dhash": signed(d), "ahash": signed(a), "histogram": colour_histogram(pixels)} | scores)
            # Objects keep nulls as nulls, and 64-bit numbers whole beside them.
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in _NAMES})

    return files.select("path", "content").mapInPandas(read, _KINDS)
