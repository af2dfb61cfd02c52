"""Text of document files straight from their bytes: plain text, RTF, zipped XML (docx, pptx, xlsx, odt) and PDF."""

from __future__ import annotations

import contextlib
import io
import re
import zipfile
import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions import paths

# Extensions read as they are, and the XML parts that hold a zipped document's text.
PLAIN = (".txt", ".md", ".csv", ".tsv", ".json", ".xml", ".yaml", ".yml", ".ini", ".log")
PARTS = {".docx": ("word/", ".xml"), ".pptx": ("ppt/slides/", ".xml"), ".xlsx": ("xl/", ".xml"), ".odt": ("", "content.xml")}


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", "ignore").strip()


#: What an RTF text consists of: a control word with its number and blank, a character in hex, a control symbol, a brace, or text.
_RTF = re.compile(r"\\(?P<word>[a-z]+)(?P<number>-?[0-9]+)?[ ]?|\\'(?P<hex>..)|\\(?P<symbol>.)|(?P<brace>[{}])|(?P<text>[^\\{}]+)", re.I | re.S)
#: Groups that hold no text of the document.
_ASIDE = frozenset("fonttbl colortbl stylesheet info pict object themedata datastore listtable listoverridetable generator".split())
_BREAKS = frozenset("par line tab cell row sect page".split())


def rtf_text(content: bytes) -> str:
    """The text of a document's groups, but for fonts, styles, pictures and the like; breaks are blanks, \\u is its character.

    Characters in hex depend on a code page and are left out.
    """
    out: list[str] = []
    aside = [False]
    skip = 0
    for m in _RTF.finditer(content.decode("utf-8", "ignore")):
        kind = m.lastgroup if m["word"] is None else "word"
        if kind == "brace":
            if m["brace"] == "{":
                aside.append(aside[-1])
            elif len(aside) > 1:
                aside.pop()
        elif kind == "word":
            word = m["word"].lower()
            if word in _ASIDE:
                aside[-1] = True
            elif not aside[-1] and word in _BREAKS:
                out.append(" ")
            elif not aside[-1] and word == "u" and m["number"]:
                out.append(chr(int(m["number"]) % 65_536))
                skip = 1
        elif kind == "symbol":
            if m["symbol"] == "*":
                aside[-1] = True
            elif not aside[-1] and m["symbol"] in "\\{}~":
                out.append(m["symbol"].replace("~", " "))
        elif kind == "text" and not aside[-1]:
            # A character by number is followed by one for readers that don't know it.
            out.append(m["text"][skip:])
            skip = 0
        elif kind == "hex":
            skip = 0
    return " ".join("".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "ignore").split())


#: Ends of these elements (whatever their prefix) part words; runs of one paragraph don't.
_PARTS_WORDS = frozenset("p h br tab cr s row c v si tc a".split())


def _xml_text(part: io.BufferedIOBase) -> str:
    """The characters of an XML part, read as a stream; what stands before a fault counts."""
    out: list[str] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.CharacterDataHandler = out.append
    parser.EndElementHandler = lambda name: out.append(" ") if name.rpartition(":")[2] in _PARTS_WORDS else None
    with contextlib.suppress(expat.ExpatError):
        parser.ParseFile(part)
    return " ".join("".join(out).split())


def zipped_text(content: bytes, extension: str) -> str | None:
    """The text of a zipped document's parts in the order of the archive; None where there is none."""
    start, end = PARTS[extension]
    texts = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            if info.filename.startswith(start) and info.filename.endswith(end):
                with archive.open(info) as part:
                    texts.append(_xml_text(part))
    return " ".join(filter(None, texts)) or None


def sheet_text(content: bytes, sheets: int | None = None, rows: int | None = None) -> str:
    """A workbook as lines: a heading for each sheet, the cells of a row joined by bars; sheets and rows limit what is read."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in re.findall(r"<si\b.*?</si>|<si\b[^>]*/>", archive.read("xl/sharedStrings.xml").decode("utf-8", "ignore"), re.S):
                strings.append(_unescape("".join(re.findall(r"<t\b[^>]*>(.*?)</t>", item, re.S))))
        book = archive.read("xl/workbook.xml").decode("utf-8", "ignore") if "xl/workbook.xml" in names else ""
        titles = [_unescape(x) for x in re.findall(r"<sheet\b[^>]*?\bname=\"([^\"]*)\"", book)]
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for i, name in enumerate(files[:sheets]):
            out.append(f"Sheet: {titles[i] if i < len(titles) else i + 1}")
            for row in re.findall(r"<row\b.*?</row>", archive.read(name).decode("utf-8", "ignore"), re.S)[:rows]:
                cells = []
                for attributes, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S):
                    value = re.search(r"<v\b[^>]*>(.*?)</v>", body, re.S) or re.search(r"<t\b[^>]*>(.*?)</t>", body, re.S)
                    if value:
                        shared = 't="s"' in attributes and value[1].isdigit() and int(value[1]) < len(strings)
                        cells.append(strings[int(value[1])] if shared else _unescape(value[1]))
                if line := " | ".join(cells).strip():
                    out.append(line)
    return "\n".join(out)


def slides_text(content: bytes) -> str:
    """A presentation as lines: a heading for each slide, then its text runs, a paragraph a line."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for i, name in enumerate(names, 1):
            out.append(f"Slide {i}:")
            for paragraph in re.findall(r"<a:p\b.*?</a:p>", archive.read(name).decode("utf-8", "ignore"), re.S):
                out.append(_unescape("".join(re.findall(r"<a:t\b[^>]*>(.*?)</a:t>", paragraph, re.S))))
    return "\n".join(out)


def _unescape(text: str) -> str:
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(mark, char)
    return text


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[djmJ*]\b|\bTD\b|'|\"|\bET\b|\]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(content: bytes) -> str | None:
    """Strings that text operators show, in the order of the content streams; None where there are none.

    Streams are plain or deflated; strings are taken as Latin-1 or, with its
    mark, UTF-16.  Fonts with encodings of their own aren't mapped.
    """
    lines: list[str] = []
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        shown: list[str] = []
        for token in _SHOWN.findall(body):
            if token[:1] == b"(":
                raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
                shown.append(raw[2:].decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1"))
            elif token[:1] == b"<":
                digits = re.sub(rb"\s", b"", token[1:-1])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                shown.append(raw[2:].decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1"))
            elif token in (b"Td", b"TD", b"T*", b"'", b'"', b"ET") and shown:
                lines.append("".join(shown))
                shown = []
        if shown:
            lines.append("".join(shown))
    return "\n".join(lines).strip() or None


def document_text(content: bytes | None, extension: str | None, most_chars: int | None = None) -> str | None:
    """A document's text by its extension; None for other types, unreadable files and files without text."""
    if content is None or not extension:
        return None
    kind = extension.lower()
    try:
        if kind in PLAIN:
            text = plain_text(content) if content else None
        elif kind == ".rtf":
            text = rtf_text(content) if content else None
        elif kind in PARTS:
            text = zipped_text(content, kind)
        elif kind == ".pdf":
            text = pdf_text(content)
        else:
            return None
    except (zipfile.BadZipFile, KeyError, ValueError, EOFError, zlib.error):
        return None
    return text if text is None or most_chars is None else text[:most_chars]


def document_texts(files: DataFrame, most_chars: int | None = None) -> DataFrame:
    """(path, text) of files(path, content): whole texts unless most_chars limits them. Arrow batches, no rows collected."""

    @F.pandas_udf("string")
    def read(content: pd.Series, extension: pd.Series) -> pd.Series:
        return pd.Series([document_text(None if c is None else bytes(c), e, most_chars) for c, e in zip(content, extension, strict=True)], dtype=object)

    return files.select("path", read("content", paths.extension("path")).alias("text"))
