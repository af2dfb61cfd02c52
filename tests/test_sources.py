"""Readers of documents, EXIF and pixels on files made here, and fixed values against literal expectations."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions import paths, scalars
from gritstone.operators import redundancy, resolve, similar
from gritstone.sources import documents, exif, images


def zipped(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return held.getvalue()


DOCX = zipped({"word/document.xml": "<w:p><w:t>Hello</w:t> <w:t>world</w:t></w:p>", "word/media/x.png": "no", "word/footer.xml": "<a>end</a>"})
XLSX = zipped(
    {
        "xl/workbook.xml": '<workbook><sheets><sheet name="A &amp; B" sheetId="1"/><sheet name="Two" sheetId="2"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>two </t></r><r><t>parts</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<sheetData><row><c t="s"><v>0</v></c><c><v>12.5</v></c></row><row><c/></row><row><c t="s"><v>1</v></c></row></sheetData>',
        "xl/worksheets/sheet2.xml": '<sheetData><row><c t="inlineStr"><is><t>in &lt;line&gt;</t></is></c></row></sheetData>',
    }
)
PDF = b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >> stream\n" + zlib.compress(b"BT /F1 12 Tf (Hello \\(world\\)) Tj 0 -14 Td [(sec) -20 (ond)] TJ <41 42> Tj ET") + b"\nendstream endobj\n2 0 obj << >> stream\nBT (\\101\\n) ' ET\nendstream"


@pytest.mark.parametrize(
    ("content", "extension", "want"),
    [
        (b" caf\xc3\xa9 \xff\n", ".TXT", "café"),
        (rb"{\rtf1\ansi Hello\'e9 \b bold\b0\par}", ".rtf", "Hello bold"),
        (rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\generator x;}\u8364 ?5\tab a\{b\}\par c\~d}", ".rtf", "\u20ac5 a{b} c d"),
        (zipped({"word/document.xml": "<d><w:p><w:r><w:t>wor</w:t></w:r><w:r><w:t>ld &amp; more</w:t></w:r></w:p><w:p><w:t>next</w:t></w:p></d>", "word/x.xml": "<a>broken</a><b>"}), ".docx", "world & more next broken"),
        (DOCX, ".docx", "Hello world end"),
        (zipped({"ppt/slides/slide1.xml": "<a:t>One</a:t>", "ppt/notes.xml": "<a:t>no</a:t>"}), ".pptx", "One"),
        (zipped({"content.xml": "<p>Odt text</p>", "meta.xml": "<p>no</p>"}), ".odt", "Odt text"),
        (zipped({"x.xml": "<p>no</p>"}), ".docx", None),
        (b"not a zip", ".xlsx", None),
        (PDF, ".pdf", "Hello (world)\nsecondAB\nA"),
        (b"%PDF-1.4", ".pdf", None),
        (b"abc", ".exe", None),
        (b"abc", None, None),
        (b"", ".txt", None),
        (None, ".txt", None),
    ],
)
def test_document_text(content, extension, want):
    assert documents.document_text(content, extension) == want


def test_sheets_and_slides_as_lines():
    assert documents.sheet_text(XLSX) == "Sheet: A & B\nname | 12.5\ntwo parts\nSheet: Two\nin <line>"
    assert documents.sheet_text(XLSX, sheets=1, rows=1) == "Sheet: A & B\nname | 12.5"
    deck = zipped({f"ppt/slides/slide{n}.xml": f"<a:p><a:r><a:t>T{n}</a:t></a:r><a:r><a:t>x</a:t></a:r></a:p>" for n in (1, 2, 10)})
    assert documents.slides_text(deck) == "Slide 1:\nT1x\nSlide 2:\nT2x\nSlide 3:\nT10x"


def test_documents_are_read_whole_from_a_folder(spark, tmp_path):
    from gritstone.sources.listing import contents

    (tmp_path / "a.txt").write_text("long " * 100_000)
    (tmp_path / "b.docx").write_bytes(DOCX)
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in documents.document_texts(contents(spark, str(tmp_path))).collect()}
    assert got["b.docx"] == "Hello world end" and got["c.bin"] is None and len(got["a.txt"]) == 499_999
    assert documents.document_text(b"x" * 900, ".txt", most_chars=10) == "x" * 10


def tiff(order, gps=True):
    """A TIFF block with a camera, dates and a position."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    extra, base = b"", 8 + 2 + 12 * 6 + 4
    entries = []

    def put(tag, kind, count, value):
        nonlocal extra
        if len(value) <= 4:
            return pack("HHI", tag, kind, count) + value.ljust(4, b"\0")
        at = base + len(extra)
        extra += value
        return pack("HHI", tag, kind, count) + pack("I", at)

    make, when = b"Maker Co\0", b"2021:07:04 12:30:00\0"
    entries.append(put(0x010F, 2, len(make), make))
    entries.append(put(0x0110, 2, 4, b"M-1\0"))
    entries.append(put(0x0112, 3, 1, pack("H", 6)))
    entries.append(put(0x0132, 2, 20, b"1999:01:01 00:00:00\0"))
    own = pack("H", 1) + pack("HHI", 0x9003, 2, 20) + pack("I", base + len(extra) + 18) + pack("I", 0) + when
    entries.append(pack("HHI", 0x8769, 4, 1) + pack("I", base + len(extra)))
    extra += own
    place = base + len(extra)
    body = pack("H", 4) + pack("HHI", 1, 2, 2) + b"S\0\0\0" + pack("HHI", 2, 5, 3) + pack("I", place + 54) + pack("HHI", 3, 2, 2) + b"E\0\0\0" + pack("HHI", 4, 5, 3) + pack("I", place + 78) + pack("I", 0)
    body += pack("IIIIII", 33, 1, 51, 1, 36, 2) + pack("IIIIII", 151, 1, 12, 1, 0, 1 if gps else 0)
    entries.append(pack("HHI", 0x8825, 4, 1) + pack("I", place))
    extra += body
    return (b"II" if order == "<" else b"MM") + pack("HI", 42, 8) + pack("H", 6) + b"".join(entries) + pack("I", 0) + extra


def jpeg(block):
    app1 = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\x01\x11\x00\x00" + b"\xff\xda\x00\x02\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    got = exif.metadata(jpeg(tiff(order)))
    assert (got["exif_date"], got["camera_make"], got["camera_model"], got["orientation"]) == ("2021:07:04 12:30:00", "Maker Co", "M-1", 6)
    assert (got["width"], got["height"]) == (640, 480) and abs(got["gps_lat"] + 33.855) < 1e-9 and abs(got["gps_lon"] - 151.2) < 1e-9
    assert json.loads(got["raw_exif"])["DateTime"] == "1999:01:01 00:00:00"
    assert exif.metadata(tiff(order))["camera_make"] == "Maker Co"
    assert exif.metadata(jpeg(tiff(order, gps=False)))["gps_lon"] is None
    for broken in (b"", b"\xff\xd8", b"II*\0", jpeg(tiff(order))[:60], b"GIF89a"):
        assert exif.metadata(broken) is None or exif.metadata(broken)["camera_make"] in (None, "Maker Co")


def test_exif_of_files_and_best_dates(spark):
    files = spark.createDataFrame([("a", jpeg(tiff("<"))), ("b", b"none"), ("c", None)], "path string, content binary")
    rows = exif.image_metadata(files).collect()
    assert [(r["path"], str(r["exif_date"]), r["orientation"]) for r in rows] == [("a", "2021-07-04 12:30:00", 6)]
    dates = spark.createDataFrame([(1, "20200102_030405", 5), (2, "x", 5), (3, None, None)], "id int, t string, m int")
    own = F.timestamp_seconds("m")
    got = dates.select("id", exif.best_date(exif.parse_date(F.col("t")), F.lit(None).cast("timestamp"), own).alias("b")).select("id", "b.source", F.unix_seconds("b.at").alias("at")).collect()
    assert [tuple(r) for r in got] == [(1, "exif", 1577934245), (2, "file", 5), (3, "unknown", None)]


def png(pixels, rules):
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    flat = pixels.reshape(height, -1).astype(int)
    lines, before = b"", np.zeros(width * channels, int)
    for y in range(height):
        left = np.concatenate([np.zeros(channels, int), flat[y][:-channels]])
        corner = np.concatenate([np.zeros(channels, int), before[:-channels]])
        p = left + before - corner
        d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, corner))
        guess = {0: 0 * left, 1: left, 2: before, 3: (left + before) // 2, 4: paeth}[rules[y % len(rules)]]
        lines += bytes([rules[y % len(rules)]]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
        before = flat[y]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pixels_round_trip(channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    want = pixels[:, :, :3] if channels > 2 else np.repeat(pixels[:, :, :1], 3, axis=2)
    assert (images.pixels_of(png(pixels, [0, 1, 2, 3, 4])) == want).all()


def test_bitmaps_and_other_files():
    pixels = np.random.default_rng(9).integers(0, 256, (5, 3, 3)).astype(np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * (-9 % 4) for r in pixels[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (images.pixels_of(bmp) == pixels).all()
    assert (images.pixels_of(b"P6\n# note\n3 5\n255\n" + pixels.tobytes()) == pixels).all()
    for broken in (b"", b"BM", bmp[:60], b"\x89PNG\r\n\x1a\n", b"GIF89a", b"P6 3"):
        assert images.pixels_of(broken) is None


def test_colour_histogram():
    import colorsys

    pixels = np.random.default_rng(2).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    hue, saturation = images.hue_saturation(pixels)
    for k in range(0, 1600, 97):
        h, s, _ = colorsys.rgb_to_hsv(*(pixels.reshape(-1, 3)[k] / 255.0))
        assert abs(hue[k] - h * 180) < 1e-6 and abs(saturation[k] - s * 255) < 1e-6
    histogram = images.colour_histogram(pixels)
    assert len(histogram) == 1024 and abs(sum(x * x for x in histogram) - 1) < 1e-9
    assert images.colour_histogram(np.zeros((0, 3, 3), np.uint8)) is None
    assert images.likely_colours({"black": 0.2, "white": 0.1, "brown": 0.3, "grey": 0.15, "red": 0.25}) == ["black", "brown", "grey"]


def test_image_features_of_files(spark):
    pixels = np.random.default_rng(5).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    files = spark.createDataFrame([("a", png(pixels, [0])), ("b", png(pixels, [4])), ("c", b"broken"), ("d", None)], "path string, content binary")
    got = {r["path"]: r for r in images.image_features(files).collect()}
    assert (got["a"]["width"], got["a"]["height"]) == (30, 20) and got["c"]["phash"] is None and got["d"]["histogram"] is None
    assert all(got["a"][k] == got["b"][k] for k in ("phash", "dhash", "ahash", "histogram", "laplacian"))


def test_format_ranks_and_labels(spark):
    want = {".bmp": (1, "Low"), ".webp": (3, "Low"), ".jpg": (4, "Lossy"), ".HEIC": (5, "Lossy"), ".png": (6, "Lossless"), ".tif": (7, "Lossless"), ".nef": (8, "RAW"), ".wmv": (3, "Low"), ".webm": (5, "Medium"), ".mov": (8, "High"), ".mkv": (9, "High"),
            ".txt": (1, ""), ".pdf": (6, ""), ".docx": (5, ""), ".ogg": (3, "Lossy"), ".mp3": (4, "High"), ".flac": (7, "Lossless"), ".alac": (8, "Lossless"), ".xyz": (0, ""), None: (0, "")}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", resolve.format_rank(F.col("t")).alias("r"), resolve.format_label(F.col("t")).alias("l"))
    assert {r["t"]: (r["r"], r["l"]) for r in rows.collect()} == want


def test_ignored_names_projects_and_kinds(spark):
    names = {"/a/node_modules/x": True, "/a/Windows/x": True, "/a/windows/x": False, "/a/~lock": True, "/a/x.egg-info/y": True, "/a/b.bak": True, "/a/b.old": False, "/a/build/z": True, "/a/builds/z": False, "/a/Program Files (x86)/q": True, "/a/plain.txt": False}
    rows = spark.createDataFrame([(k,) for k in names], "path string").select("path", paths.ignored("path").alias("i"))
    assert {r["path"]: r["i"] for r in rows.collect()} == names
    marks = spark.createDataFrame([("/p/Game.uproject",), ("/p/PACKAGE.JSON",), ("/p/x.csproj",), ("/p/Pipfile",), ("/p/gradlew",), ("/p/Cargo.toml",), ("/p/Assets/a.png",)], "path string")
    assert sorted(r["project"] for r in redundancy.project_types(marks).collect()) == [".NET", "Android/Gradle", "Node.js", "Python", "Unreal Engine"]
    assert "*/DerivedDataCache/*" in {r["pattern"] for r in redundancy.suggested_exclusions(marks).collect()}
    kinds = {".docx": "VISUAL_DOC", ".odt": "VISUAL_DOC", ".exe": "SKIP", ".zip": "SKIP", ".tmp": "SKIP", ".svg": "IMAGE", ".opus": "AUDIO", ".eml": "TEXT", ".weird": "TEXT", "": "SKIP", None: "SKIP", ".MKV": "VIDEO"}
    rows = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", scalars.summary_kind(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in rows.collect()} == kinds
    shots = {("Screen Shot 1.png", 1, 1): True, ("snipped.png", 1, 1): True, ("a.screenshot", 1, 1): False, ("x.png", 1284, 2778): True, ("x.png", 1366, 768): False, ("ScreenCapture.jpg", None, None): True}
    rows = spark.createDataFrame([(*k,) for k in shots], "n string, w int, h int").select("n", "w", "h", scalars.is_screenshot(F.col("n"), F.col("w"), F.col("h"), F.lit(None).cast("double")).alias("s"))
    assert {(r["n"], r["w"], r["h"]): r["s"] for r in rows.collect()} == shots


def test_sizes_round_ties_to_even(spark):
    sizes = [0, 1023, 1024, 1024 + 256, 1024 * 3 + 768, 1024 * 5 + 256 * 3, 1_048_575, 1_048_576 * 7 + 262_144, 3 << 30, (1 << 30) + 5_368_709, (1 << 30) + 5_368_710, 999_999_999_999]

    def shown(n):
        return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB" if n < 1 << 30 else f"{n / (1 << 30):.2f} GB"

    def unit(n):
        k = next(k for k in range(6) if n < 1024 ** (k + 1))
        return f"{n / 1024**k:.1f} {['B', 'KB', 'MB', 'GB', 'TB', 'PB'][k]}"

    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", scalars.format_size(F.col("n")).alias("s"), scalars.format_bytes(F.col("n")).alias("b"))
    assert {r["n"]: (r["s"], r["b"]) for r in rows.collect()} == {n: (shown(n), unit(n)) for n in sizes}


def test_composite_hashes_find_every_pair_and_few_candidates(spark):
    assert similar.meeting_share(3, 19) < 0.05 < similar.meeting_share(1, 18)
    rng = np.random.default_rng(12)
    words = rng.integers(0, 2**63, (300, 3)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (300, 3)).astype(np.uint64)
    near = words[:100].copy()
    for i in range(100):
        for b in rng.choice(192, 4 + i % 24, replace=False):
            near[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    every = np.concatenate([words, near, words[:5]])
    rows = spark.createDataFrame([(i, *(int(x) for x in w.view(np.int64))) for i, w in enumerate(every)], "id long, p long, d long, a long")
    reps = every[:400]
    far = np.bitwise_count(reps[:, None, :] ^ reps[None, :, :]).sum(axis=2)
    want = {(i, j): round(1 - int(far[i, j]) / 192, 9) for i in range(400) for j in range(i) if 0 < far[i, j] <= 19 for i, j in ((j, i),)}
    got = {(r["src"], r["dst"]): r["similarity"] for r in similar.composite_links(rows, 0.90).collect()}
    assert len(want) > 50 and got == want
    bands = similar.bands_of(3, 19)
    assert sum(n for _, _, n in bands) == 192
    met = 0
    for w, a, n in bands:
        value = (words[:, w] >> np.uint64(a)) & np.uint64((1 << n) - 1)
        met += (np.triu(np.bitwise_count(value[:, None] ^ value[None, :]) <= 1, 1)).sum()
    assert met / (300 * 299 / 2) < 0.05
    blocks = {(r["src"], r["dst"]) for r in similar.block_links(rows.where("id < 400").select("id", F.col("p").alias("h0"), F.col("d").alias("h1"), F.col("a").alias("h2")), ["h0", "h1", "h2"], 19, block_rows=64).collect()}
    assert blocks == set(want)


def test_transitive_matches_carry_their_decays(spark):
    from gritstone.operators import match

    seeds = spark.createDataFrame([(9, 1, 0.8), (9, 5, 0.5)], "query_id long, face_id long, similarity double")
    links = spark.createDataFrame([(100, 1, 2, 0.9), (200, 2, 3, 0.5), (100, 7, 8, 0.4)], "person_id long, face_a long, face_b long, similarity double")
    persons = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (5, None), (7, 400), (8, 500)], "face_id long, person_id long")
    got = {r["person_id"]: (r["confidence"], r["hop"]) for r in match.transitive(seeds, links, persons).collect()}
    # 100 at once; 200 over its link; 300 over a further one with both decays; 400 since a link of person 100 leads to its first face.
    want = {100: (0.8, 1), 200: (0.8 * 0.9 * 0.85, 2), 300: (0.8 * 0.9 * 0.85 * 0.5 * 0.7, 3), 400: (0.8 * 0.4 * 0.85, 2)}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-8 and got[k][1] == want[k][1] for k in want)


def test_transitive_matches_equal_all_walks_without_meeting_all_links(spark):
    import random

    from gritstone.operators import match

    rng = random.Random(4)
    faces = range(60)
    person = {f: rng.choice([None, 1, 2, 3, 4]) for f in faces}
    value = lambda: rng.choice([0.3, 0.5, 0.9, 0.9, 1.0, round(rng.random(), 9) + 1e-9])
    links = [(rng.choice([1, 2, 3, 4]), *rng.sample(faces, 2), value()) for _ in range(160)]
    seeds = [(q, f, value()) for q in range(100, 130) for f in rng.sample(faces, rng.randrange(1, 5))]
    now, best = {}, {}
    for q, f, p in seeds:
        now[q, f] = max(now.get((q, f), 0), p)
    for hop in (1, 2, 3):
        ahead = {}
        for (q, f), p in now.items():
            if person[f] is None:
                continue
            mine = best.setdefault((q, person[f]), (0, 0))
            best[q, person[f]] = max(mine, (round(p, 9), -hop))
            for owner, a, b, s in links:
                if owner == person[f]:
                    to = (q, b if a == f else a)
                    ahead[to] = max(ahead.get(to, 0), p * (s * match.DECAY.get(hop + 1, 0)))
        now = ahead
    frames = (spark.createDataFrame(seeds, "query_id long, face_id long, similarity double"), spark.createDataFrame(links, "person_id long, face_a long, face_b long, similarity double"))
    known = spark.createDataFrame(list(person.items()), "face_id long, person_id long")
    got = {(r.query_id, r.person_id): (r.confidence, -r.hop) for r in match.transitive(*frames, known).collect()}
    assert got.keys() == best.keys() and all(abs(got[k][0] - best[k][0]) < 2e-9 and got[k][1] == best[k][1] for k in best)
    # A person's links that lead back are few, however many it has.
    many = spark.range(500).selectExpr("1L as person_id", "id as face_a", "id + 1 as face_b", "(id * 37 % 499 + 1) / 500D as similarity")
    assert match._leading(many, spark.range(501).selectExpr("id as face_id", "1L as person_id")).count() <= 5
