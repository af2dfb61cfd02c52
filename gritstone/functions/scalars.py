"""Small expressions: sizes, boxes, types, spaces, orientation, JSON lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_size(size: Column) -> Column:
    """N/A, bytes, KB and MB with one decimal, GB with two."""
    kb = 1024.0
    return (
        F.when(size.isNull(), "N/A")
        .when(size < kb, F.concat(size.cast("long").cast("string"), F.lit(" B")))
        .when(size < kb**2, _fixed(size / kb, 1, "KB"))
        .when(size < kb**3, _fixed(size / kb**2, 1, "MB"))
        .otherwise(_fixed(size / kb**3, 2, "GB"))
    )


def _fixed(value: Column, places: int, unit: str) -> Column:
    """Fixed decimals as C's printf gives them: of the binary value itself, exact ties to even."""
    # A size over a power of 1024 is a binary fraction that decimal(38, 18) holds whole down to 2**-18; what lies below can't tip a tie it isn't.
    exact = F.bround(value.cast("decimal(38,18)"), places)
    return F.concat(exact.cast(f"decimal(38,{places})").cast("string"), F.lit(" " + unit))


def format_bytes(size: Column) -> Column:
    """One decimal and the unit from B to PB."""
    out = _fixed(size / 1024.0**5, 1, "PB")
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (power + 1), _fixed(size / 1024.0**power, 1, unit)).otherwise(out)
    return out


def used_space(total: Column, free: Column) -> Column:
    return total - free


def usage_percent(total: Column, free: Column) -> Column:
    """Null without a total."""
    return F.try_divide((total - free) * 100.0, total)


def centre_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel box as centre and size in parts of the image, 6 places, half to even."""
    r = lambda v: F.bround(v, 6)
    return F.struct(r((x + w / 2.0) / width).alias("cx"), r((y + h / 2.0) / height).alias("cy"), r(w / width.cast("double")).alias("w"), r(h / height.cast("double")).alias("h"))


def orient_point(x: Column, y: Column, orientation: Column, width: Column, height: Column) -> Column:
    """A point of the stored image where EXIF orientation shows it."""
    s = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    o = orientation
    return (
        F.when(o == 2, s(width - x, y)).when(o == 3, s(width - x, height - y)).when(o == 4, s(x, height - y)).when(o == 5, s(y, x))
        .when(o == 6, s(height - y, x)).when(o == 7, s(height - y, width - x)).when(o == 8, s(y, width - x)).otherwise(s(x, y))
    )


def orientation_code(text: Column) -> Column:
    """First token as a number, null where it is none."""
    return F.get(F.split(F.trim(text), r"\s+"), 0).try_cast("int")


def mid_age(stage: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in ("baby", 1, "toddler", 3, "child", 8, "teen", 15, "adult", 25)])[stage]


def pet_stage(species: Column, area: Column) -> Column:
    """Age stage from the box area, by species; null for others."""
    stage = lambda a, b: F.when(area < a, "young").when(area < b, "adolescent").otherwise("adult")
    return F.when(species == "dog", stage(5_000, 15_000)).when(species == "cat", stage(3_000, 10_000))


def blur_score(variance: Column) -> Column:
    return F.least(F.lit(100.0), 25.0 * F.log10(variance + 1))


def exposure_score(mean: Column, p5: Column, p95: Column) -> Column:
    base = F.greatest(F.lit(0.0), 100.0 - 0.8 * F.abs(mean - 128))
    return F.when((p5 < 10) | (p95 > 245), base * 0.8).otherwise(base)


def contrast_score(deviation: Column) -> Column:
    return F.least(F.lit(100.0), 1.5 * deviation)


def noise_score(deviation: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - 5.0 * deviation)


def overall_quality(blur: Column, exposure: Column, contrast: Column, noise: Column) -> Column:
    return 0.35 * blur + 0.30 * exposure + 0.20 * contrast + 0.15 * noise


def megapixels(width: Column, height: Column) -> Column:
    """Null where a side is missing or 0."""
    return F.when((width > 0) & (height > 0), width * height / 1e6)


def string_list(text: Column) -> Column:
    """JSON text as a list, empty on any error."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def entity_lists(text: Column) -> Column:
    """JSON object of lists as a map, empty on any error."""
    return F.coalesce(F.from_json(text, "map<string, array<string>>"), F.create_map().cast("map<string, array<string>>"))


def url_list(text: Column) -> Column:
    """JSON list of label and url, empty on any error."""
    kind = "array<struct<label: string, url: string>>"
    return F.filter(F.coalesce(F.from_json(text, kind), F.array().cast(kind)), lambda x: x["url"].isNotNull())


def has_gps(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def resolution(width: Column, height: Column) -> Column:
    """Struct of width and height, null where a side is missing or 0."""
    return F.when((width > 0) & (height > 0), F.struct(width.alias("width"), height.alias("height")))


def compare_paths(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the order of two paths, whatever their case and separators."""
    from gritstone.functions.paths import normalise

    x, y = F.lower(normalise(a)), F.lower(normalise(b))
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def timestamped_name(prefix: str, extension: str, at: Column) -> Column:
    """prefix_yyyyMMdd_HHmmss.extension"""
    return F.concat(F.lit(prefix + "_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("." + extension.lstrip(".")))


def drive_id(path: Column) -> Column:
    return F.concat(F.lit("drive_"), F.substring(F.sha2(F.lower(path), 256), 1, 8))


def drive_status(error: Column, scanning: Column, connected: Column, last_scan: Column) -> Column:
    return F.when(error, "error").when(scanning, "scanning").when(~connected, "disconnected").when(last_scan.isNull(), "needs_scan").otherwise("connected")


# Image sizes and names that are screenshots.
SCREENS = (
    (1920, 1080), (2560, 1440), (3840, 2160), (1080, 1920), (1440, 2560), (2160, 3840),
    (1170, 2532), (1284, 2778), (1242, 2688), (1080, 2340), (1080, 2400), (1440, 3200),
)
SCREEN_NAMES = ("screenshot", "screen.?shot", "screen.?capture", "snip")


def is_screenshot(filename: Column, width: Column, height: Column, score: Column) -> Column:
    """By a name before its extension, by the exact size of a screen, or by a scene score from 0.6 on."""
    sizes = F.lit(False)
    for w, h in SCREENS:
        sizes = sizes | ((width == w) & (height == h))
    named = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "").rlike("(?i)" + "|".join(SCREEN_NAMES))
    return F.coalesce(named, F.lit(False)) | F.coalesce(sizes, F.lit(False)) | F.coalesce(score >= 0.6, F.lit(False))


# How extensions are summarised.
SUMMARY_KINDS = {
    "TEXT": tuple(".txt .md .rst .log .csv .tsv .py .js .java .cpp .c .h .cs .go .rs .php .json .xml .yaml .yml .toml .ini .conf .cfg .html .css .sql .sh .bat .ps1 .eml .msg".split()),
    "IMAGE": tuple(".jpg .jpeg .png .gif .bmp .webp .tiff .tif .heic .heif .ico .svg".split()),
    "VISUAL_DOC": tuple(".pdf .docx .doc .xlsx .xls .pptx .ppt .odt .ods .odp".split()),
    "VIDEO": tuple(".mp4 .avi .mov .mkv .webm .flv .wmv .m4v .mpeg .mpg .3gp".split()),
    "AUDIO": tuple(".mp3 .wav .m4a .flac .ogg .aac .wma .opus".split()),
    "SKIP": tuple(".exe .dll .so .dylib .bin .zip .rar .7z .tar .gz .db .sqlite .mdb .iso .dmg .img .tmp .cache .lock".split()),
}


def summary_kind(file_type: Column) -> Column:
    """The extension's kind; an unknown one is TEXT, and what starts with no dot is SKIP."""
    out = F.when(F.coalesce(file_type.startswith("."), F.lit(False)), "TEXT").otherwise("SKIP")
    for kind, exts in SUMMARY_KINDS.items():
        out = F.when(F.lower(file_type).isin(*exts), kind).otherwise(out)
    return out
