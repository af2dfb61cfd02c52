"""Extractors that need no model: byte-level facts of images and videos, frame times, text differences."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UUID = re.compile(rb"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")


def jpeg_fault(content: bytes) -> str | None:
    """Class of a broken JPEG, None for a sound one: walks the markers up to the scan, then looks for the end."""
    if content[:2] != b"\xff\xd8":
        return "unreadable"
    at = 2
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            return "invalid_markers"
        marker = content[at + 1]
        if marker == 0xDA:
            end = content.rfind(b"\xff\xd9")
            if end < 0:
                return "truncated"
            return "extraneous_data" if len(content) - end - 2 > 0 else None
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if size < 2:
            return "invalid_markers"
        at += 2 + size
    return "truncated"


def content_identifier(content: bytes, head: int = 256 << 10, reach: int = 100) -> str | None:
    """UUID within ``reach`` bytes of a content-identifier mark in the head; None without one."""
    start = content[:head]
    for mark in (b"ContentIdentifier", b"content.identifier"):
        at = start.find(mark)
        if at >= 0 and (found := _UUID.search(start, at, at + len(mark) + reach + 36)):
            return found[0].decode().upper()
    return None


def motion_offset(content: bytes) -> int | None:
    """Where an MP4 begins inside a JPEG that embeds one; None if none does."""
    at = content.find(b"ftyp", 4)
    return at - 4 if content[:2] == b"\xff\xd8" and at > 4 else None


def perceptual_hashes(pixels: np.ndarray) -> tuple[int, int, int]:
    """64-bit DCT, difference and average hashes of a grey image."""

    def shrink(rows: int, columns: int) -> np.ndarray:
        ys = np.linspace(0, pixels.shape[0], rows + 1).astype(int)
        xs = np.linspace(0, pixels.shape[1], columns + 1).astype(int)
        return np.array([[pixels[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].mean() for j in range(columns)] for i in range(rows)])

    def pack(bits: np.ndarray) -> int:
        return int("".join("1" if b else "0" for b in bits.ravel()), 2)

    n = 32
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ shrink(n, n) @ basis.T)[:8, :8]
    nine, eight = shrink(8, 9), shrink(8, 8)
    return pack(low > np.median(low)), pack(nine[:, 1:] > nine[:, :-1]), pack(eight > eight.mean())


def image_scores(pixels: np.ndarray) -> dict[str, float]:
    """Laplacian variance, mean, 5th and 95th percentile, deviation, and deviation of the high-pass: what the quality scores take."""
    p = pixels.astype(float)
    inner = p[1:-1, 1:-1]
    laplace = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * inner
    blur = sum(p[i : p.shape[0] - 2 + i, j : p.shape[1] - 2 + j] for i in range(3) for j in range(3)) / 9
    p5, p95 = np.percentile(p, (5, 95))
    return {"laplacian": float(laplace.var()), "mean": float(p.mean()), "p5": float(p5), "p95": float(p95), "deviation": float(p.std()), "high_pass": float((inner - blur).std())}


# Brightness bins of a fragment's channels, the grey of missing data, and what each feature weighs.
FRAGMENT_BINS, MISSING_GREY = 32, 128
FRAGMENT_WEIGHTS = {"histogram": 0.4, "colour": 0.2, "brightness": 0.2, "aspect": 0.1, "grey": 0.1}


def fragment_features(pixels: np.ndarray) -> dict:
    """What tells one photo's fragments from another's, of decoded pixels (height, width[, channels]): a histogram for
    each channel, mean colour, brightness, percentage of missing-data grey, width by height (0 for no height)."""
    planes = pixels if pixels.ndim == 3 else pixels[:, :, None]
    count = max(planes.shape[0] * planes.shape[1], 1)
    channels = [planes[:, :, c] for c in range(planes.shape[2])]
    return {
        "histogram": [float(n) for c in channels[:3] for n in np.histogram(c, FRAGMENT_BINS, (0, 255))[0]],
        "colour": [float(c.mean()) if c.size else 0.0 for c in channels],
        "brightness": float(planes.mean()) if planes.size else 0.0,
        "grey": 100.0 * float((planes == MISSING_GREY).all(axis=2).sum()) / count,
        "aspect": planes.shape[1] / planes.shape[0] if planes.shape[0] else 0.0,
    }


def fragment_similarity(a: dict, b: dict) -> float:
    """Weighted likeness of two fragments' features, 0 to 1; histograms or colours of different channels say nothing, which counts as a half."""

    def near(x: float, y: float, scale: float) -> float:
        return scale / (scale + abs(x - y))

    one, other = np.asarray(a["histogram"], float), np.asarray(b["histogram"], float)
    same = len(one) == len(other)
    parts = {
        "histogram": float(one @ other / (np.linalg.norm(one) * np.linalg.norm(other) + 1e-10)) if same else 0.5,
        "colour": near(float(np.linalg.norm(np.subtract(a["colour"], b["colour"]))), 0.0, 255.0) if len(a["colour"]) == len(b["colour"]) else 0.5,
        "brightness": near(a["brightness"], b["brightness"], 255.0),
        "aspect": near(a["aspect"], b["aspect"], 1.0),
        "grey": near(a["grey"], b["grey"], 100.0),
    }
    return sum(FRAGMENT_WEIGHTS[k] * v for k, v in parts.items())


def fragment_photos(fragments: DataFrame, above: float) -> DataFrame:
    """(file_id, offset, photo): the fragments of a file dealt to photos; photo is the offset of the photo's first fragment.

    fragments has file_id, offset and the columns of fragment_features.  In
    order of offset a fragment joins the first photo whose first fragment is
    more alike than ``above``, or opens one.  A file's features, not its
    pixels, meet in one task.
    """

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        firsts: list[dict] = []
        found = []
        for row in pdf.sort_values("offset", kind="stable").to_dict("records"):
            like = next((f for f in firsts if fragment_similarity(f, row) > above), None)
            if like is None:
                firsts.append(like := row)
            found.append((row["file_id"], row["offset"], like["offset"]))
        return pd.DataFrame(found, columns=["file_id", "offset", "photo"])

    kind = dict(fragments.dtypes)["file_id"]
    return fragments.groupBy("file_id").applyInPandas(deal, f"file_id {kind}, offset long, photo long")


def bytes_column(f, kind: str):
    """A column function of binary contents from a function of bytes; nulls stay null."""

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else f(bytes(x)))

    return run


def frame_times(duration: Column, frames: int = 8) -> Column:
    """Times of evenly spaced frames, neither first nor last."""
    return F.transform(F.sequence(F.lit(1), F.lit(frames)), lambda i: duration / (frames + 1) * i)


def interval_times(duration: Column, every: int = 30, most: int = 5) -> Column:
    """A frame each ``every`` seconds from 0, at most ``most``: a feature's limit."""
    return F.slice(F.sequence(F.lit(0), F.greatest(F.ceil(duration).cast("int") - 1, F.lit(0)), F.lit(every)), 1, most)


def text_difference(old: str, new: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), "old", "new"))
