"""Workbooks, PDF text and packed datapoints, read with the standard library alone."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.sources.rows import UnreadableFile, parsed_rows, typed

#: Bytes that a compressed part may grow to, and the share of plain characters that text must have.
INFLATED_MOST, PLAIN_SHARE = 256 * 1024 * 1024, 0.85


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook(content: bytes, path: str) -> Iterator[dict]:
    """Rows of the first sheet under its header row; columns without a name and rows without a value are left out."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        names = z.namelist()
    except zipfile.BadZipFile as e:
        raise UnreadableFile(f"{path}: no workbook") from e
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2]).group()))
    if not sheets:
        raise UnreadableFile(f"{path}: no sheet")
    header: list[str | None] | None = None
    for row in (e for e in ET.fromstring(z.read(sheets[0])).iter() if _local(e.tag) == "row"):
        cells: dict[int, object] = {}
        for i, c in enumerate(x for x in row if _local(x.tag) == "c"):
            at = _column(c.attrib["r"]) if "r" in c.attrib else i
            kind = c.attrib.get("t", "n")
            v = next((x.text for x in c if _local(x.tag) == "v"), None)
            if kind == "s" and v is not None:
                cells[at] = shared[int(v)]
            elif kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
            elif kind == "b":
                cells[at] = "true" if v == "1" else "false"
            elif v is not None:
                cells[at] = v
        if header is None:
            if cells:
                header = [str(cells[i]).strip() if i in cells and str(cells[i]).strip() else None for i in range(max(cells) + 1)]
            continue
        out = {n: (cells.get(i) if cells.get(i) != "" else None) for i, n in enumerate(header) if n}
        if any(v is not None for v in out.values()):
            yield out
    if header is None:
        raise UnreadableFile(f"{path}: no rows")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    return typed(parsed_rows(spark, path, workbook))


_STREAM = re.compile(rb"obj\b(.*?)stream\r?\n(.*?)endstream", re.S)
_SHOW = re.compile(rb"\[(?:[^\]\\]|\\.)*\]\s*TJ|\((?:[^()\\]|\\.)*\)\s*(?:Tj|'|\")", re.S)
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|(-?\d+(?:\.\d+)?)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescape(s: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        g = m.group(1)
        return bytes([int(g, 8) & 255]) if g.isdigit() else _ESCAPES.get(g, g)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, s, flags=re.S)


def pdf_pages(content: bytes) -> list[str]:
    """The texts that the content streams of a PDF show, one per stream that is mostly plain characters."""
    out = []
    for m in _STREAM.finditer(content):
        body = m.group(2)
        if b"FlateDecode" in m.group(1):
            try:
                body = zlib.decompressobj().decompress(body, INFLATED_MOST)
            except zlib.error:
                continue
        parts = []
        for show in _SHOW.finditer(body):
            piece = b""
            for s in _STRING.finditer(show.group()):
                if s.group(1) is not None:
                    piece += _unescape(s.group(1))
                elif float(s.group(2)) < -120 and show.group().endswith(b"TJ"):
                    piece += b" "
            parts.append(piece.decode("latin-1"))
        text = re.sub(r"\s+", " ", " ".join(parts)).strip()
        if text and sum(32 <= ord(c) < 127 for c in text) >= PLAIN_SHARE * len(text):
            out.append(text)
    return out


def document(content: bytes, path: str) -> Iterator[dict]:
    """``page, text, via`` of a PDF with a text layer, or of a text file as one page."""
    if content[:5] == b"%PDF-" or path.lower().endswith(".pdf"):
        for n, t in enumerate(pdf_pages(content), 1):
            yield {"page": n, "text": t, "via": "text-layer"}
    else:
        yield {"page": 1, "text": content.decode("utf-8", "replace"), "via": "text"}


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """``file, page, text, via``; page numbers are integers, texts stay texts."""
    rows = parsed_rows(spark, path, document)
    m = F.from_json("row", "map<string,string>")
    return rows.select("file", m["page"].cast("int").alias("page"), m["text"].alias("text"), m["via"].alias("via"))


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if i >= len(b) or shift > 63:
            raise ValueError("a number is cut short")
        n |= (b[i] & 127) << shift
        i += 1
        if not b[i - 1] & 128:
            return n, i
        shift += 7


def _fields(b: bytes) -> list[tuple[int, int, object]]:
    """Field number, wire type and value of a packed message."""
    out, i = [], 0
    while i < len(b):
        tag, i = _varint(b, i)
        number, wire = tag >> 3, tag & 7
        if not number:
            raise ValueError("no field")
        if wire == 0:
            v, i = _varint(b, i)
        elif wire == 1:
            v, i = struct.unpack_from("<d", b, i)[0], i + 8
        elif wire == 2:
            n, i = _varint(b, i)
            if i + n > len(b):
                raise ValueError("a part is cut short")
            v, i = b[i : i + n], i + n
        elif wire == 5:
            v, i = struct.unpack_from("<f", b, i)[0], i + 4
        else:
            raise ValueError("an unknown wire type")
        out.append((number, wire, v))
    return out


def datapoints(content: bytes, path: str) -> Iterator[dict]:
    """``ts, value`` of packed datapoints: messages of a whole number and a double, at whatever depth they are nested."""

    def walk(b: bytes, depth: int) -> Iterator[tuple[int, float]]:
        fields = _fields(b)
        ts = next((v for _, w, v in fields if w == 0), None)
        value = next((v for _, w, v in fields if w == 1), None)
        if ts is not None and value is not None and not any(w == 2 for _, w, _ in fields):
            yield (ts - (1 << 64) if ts >= 1 << 63 else ts), value
            return
        for _, w, v in fields:
            if w == 2 and depth < 8:
                try:
                    yield from walk(v, depth + 1)
                except (ValueError, struct.error):
                    continue

    try:
        for ts, v in walk(content, 0):
            yield {"ts": ts, "value": repr(v)}
    except (ValueError, struct.error) as e:
        raise UnreadableFile(f"{path}: {e}") from e


def read_datapoints(spark: SparkSession, path: str) -> DataFrame:
    m = F.from_json("row", "map<string,string>")
    return parsed_rows(spark, path, datapoints).select(m["ts"].cast("bigint").alias("ts"), m["value"].cast("double").alias("value"))
