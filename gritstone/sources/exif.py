"""EXIF of JPEG and TIFF files from their bytes: dates, camera, orientation, size and position."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# EXIF tag numbers by their names, the bytes of each value type, and accepted date forms.
MAIN_TAGS = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "DateTime", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x8769: "ExifOffset", 0x8825: "GPSInfo"}
EXIF_TAGS = {0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight"}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
DATE_FORMS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd_HHmmss")


def _value(data: bytes, order: str, kind: int, count: int, at: int):
    if kind == 2:
        return data[at : at + count].split(b"\0")[0].decode("utf-8", "ignore").strip()
    if kind in (5, 10):
        pairs = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, at)
        return [(n, d) for n, d in zip(pairs[::2], pairs[1::2], strict=True)]
    if kind == 7:
        return data[at : at + count].hex()
    values = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind]}", data, at)
    return values[0] if count == 1 else list(values)


def _directory(data: bytes, order: str, at: int, names: dict[int, str]) -> dict:
    found = {}
    (entries,) = struct.unpack_from(order + "H", data, at)
    for i in range(entries):
        place = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        if tag not in names or kind not in TYPE_BYTES:
            continue
        size = TYPE_BYTES[kind] * count
        where = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if where + size <= len(data):
            found[names[tag]] = _value(data, order, kind, count, where)
    return found


def _tiff(data: bytes) -> dict:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return {}
    tags = _directory(data, order, struct.unpack_from(order + "I", data, 4)[0], MAIN_TAGS)
    if isinstance(at := tags.pop("ExifOffset", None), int):
        tags |= _directory(data, order, at, EXIF_TAGS)
    if isinstance(at := tags.pop("GPSInfo", None), int):
        tags |= _directory(data, order, at, GPS_TAGS)
    return tags


def exif_tags(content: bytes) -> dict:
    """Tags by name, with the frame's size for a JPEG; empty where nothing can be read."""
    try:
        if content[:2] != b"\xff\xd8":
            return _tiff(content)
        tags: dict = {}
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            marker = content[at + 1]
            if marker == 0xDA:
                break
            if marker == 0xFF:
                at += 1
                continue
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            body = content[at + 4 : at + 2 + size]
            if marker == 0xE1 and body[:6] == b"Exif\0\0":
                tags = _tiff(body[6:]) | tags
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
                tags["height"], tags["width"] = struct.unpack(">HH", body[1:5])
            at += 2 + size
        return tags
    except (struct.error, IndexError):
        return {}


def _degrees(values, ref: str | None) -> float | None:
    if not isinstance(values, list) or len(values) < 3 or not ref or any(not isinstance(v, tuple) or not v[1] for v in values[:3]):
        return None
    d, m, s = (n / q for n, q in values[:3])
    value = d + m / 60.0 + s / 3600.0
    return -value if ref.upper() in ("S", "W") else value


def metadata(content: bytes | None) -> dict | None:
    """exif_date (as text), camera, orientation, size, position and all tags as JSON; None where there is nothing."""
    tags = exif_tags(content) if content else {}
    if not tags:
        return None
    return {
        "exif_date": next((tags[k] for k in ("DateTimeOriginal", "DateTimeDigitized", "DateTime") if tags.get(k)), None),
        "camera_make": tags.get("Make") or None,
        "camera_model": tags.get("Model") or None,
        "orientation": tags.get("Orientation"),
        "width": tags.get("width") or tags.get("ExifImageWidth") or tags.get("ImageWidth"),
        "height": tags.get("height") or tags.get("ExifImageHeight") or tags.get("ImageLength"),
        "gps_lat": _degrees(tags.get("GPSLatitude"), tags.get("GPSLatitudeRef")),
        "gps_lon": _degrees(tags.get("GPSLongitude"), tags.get("GPSLongitudeRef")),
        "raw_exif": json.dumps(tags, sort_keys=True),
    }


_KINDS = "path string, exif_text string, camera_make string, camera_model string, orientation int, width int, height int, gps_lat double, gps_lon double, raw_exif string"
_NAMES = [x.split()[0] for x in _KINDS.split(", ")]


def parse_date(text: Column) -> Column:
    """The first accepted form that fits the trimmed text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMS])


def image_metadata(files: DataFrame) -> DataFrame:
    """(path, exif_date, camera_make, camera_model, orientation, width, height, gps_lat, gps_lon, raw_exif) of files(path, content); files without any are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if found := metadata(None if content is None else bytes(content)):
                    rows.append([path, found["exif_date"], *(found[n] for n in _NAMES[2:])])
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(_NAMES)})

    got = files.select("path", "content").mapInPandas(read, _KINDS)
    return got.select("path", parse_date(F.col("exif_text")).alias("exif_date"), *_NAMES[2:])


def best_date(exif: Column, created: Column, modified: Column) -> Column:
    """Struct of the best date and its source: EXIF, then the file's (its birth where known, else its last change), else unknown."""
    own = F.coalesce(created, modified)
    source = F.when(exif.isNotNull(), "exif").when(own.isNotNull(), "file").otherwise("unknown")
    return F.struct(F.coalesce(exif, own).alias("at"), source.alias("source"))
