"""Documents of a folder as pages or structural units; one row a page or unit, ordered by path."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltra.operators.chunking import SUSPECT_CHARS

PAGE = "path string, source string, page int, text string, suspect_scanned boolean"
UNIT = "path string, source string, page int, unit_no int, text string, kind string"
_KNOWN = r"(?i)\.(pdf|docx|txt|md)$"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files with a known extension, in any case, in all subfolders; others are ignored."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.where(F.col("path").rlike(_KNOWN)).select("path", "content")


# ---- DOCX: a zip of XML ---------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_parts(data: bytes) -> tuple[list[tuple[str | None, str]], list[list[list[str]]]]:
    """((style name, text) of the body's paragraphs, cell texts by table and row)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                if (n := s.find(f"{_W}name")) is not None:
                    names[s.get(f"{_W}styleId")] = n.get(f"{_W}val")

    def text_of(p) -> str:
        out = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                out.append(e.text or "")
            elif e.tag == f"{_W}tab":
                out.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        return "".join(out)

    def style_of(p) -> str | None:
        s = p.find(f"{_W}pPr/{_W}pStyle")
        return None if s is None else names.get(s.get(f"{_W}val"), s.get(f"{_W}val"))

    paragraphs = [(style_of(p), text_of(p)) for p in body.findall(f"{_W}p")]
    tables = [
        [["\n".join(text_of(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")
    ]
    return paragraphs, tables


def _rows(table: list[list[str]]) -> list[str]:
    return [" | ".join(c for c in row if c) for row in table if any(row)]


def docx_pages(data: bytes) -> list[tuple[int, str]]:
    """The whole file as page 1: paragraphs that aren't blank, then all tables."""
    paragraphs, tables = docx_parts(data)
    parts = [t for _, t in paragraphs if t.strip()] + [r for t in tables for r in _rows(t)]
    return [(1, "\n".join(parts).strip())]


def docx_units(data: bytes) -> list[tuple[int, str, str]]:
    """Sections (a paragraph whose style begins with heading or title opens one), then one unit a table."""
    paragraphs, tables = docx_parts(data)
    sections: list[list[str]] = []
    for style, text in paragraphs:
        if not text.strip():
            continue
        if not sections or (style or "").lower().startswith(("heading", "title")):
            sections.append([])
        sections[-1].append(text.strip())
    units = [(1, "\n".join(s), "section") for s in sections]
    return units + [(1, "\n".join(r), "table") for t in tables if (r := _rows(t))]


# ---- PDF: the library where it's installed, else a plain reader for text streams --------------------------------------

_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s/\[\]()<>]+|[A-Za-z'\"*]+")
_ESC = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    if raw[:1] == b"<":
        h = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode()).decode("latin-1")
    def one(m: re.Match) -> bytes:
        g = m[1]
        return bytes([int(g, 8) & 255]) if g[:1].isdigit() else _ESC.get(g, g)
    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S).decode("latin-1")


def _content_blocks(stream: bytes) -> list[tuple[float, float, str]]:
    """(y from the top, x, text) of each text object, lines parted where the position moves down."""
    blocks, stack = [], []
    x = y = 0.0
    start, parts, inside, array = None, [], False, False
    for m in _TOKEN.finditer(stream):
        t = m[0]
        if t == b"BT":
            inside, parts, start, x, y = True, [], None, 0.0, 0.0
        elif t == b"ET":
            if "".join(parts).strip():
                blocks.append((-(start or (0, 0))[1], (start or (0, 0))[0], "".join(parts)))
            inside = False
        elif not inside:
            stack = stack[-5:] + [t]
        elif t in (b"Td", b"TD") and len(stack) >= 2:
            dx, dy = float(stack[-2]), float(stack[-1])
            x, y = x + dx, y + dy
            if dy and parts:
                parts.append("\n")
            stack = []
        elif t == b"Tm" and len(stack) >= 6:
            nx, ny = float(stack[-2]), float(stack[-1])
            if parts and ny != y:
                parts.append("\n")
            x, y, stack = nx, ny, []
        elif t == b"T*":
            parts.append("\n")
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"') and parts:
                parts.append("\n")
            start = start or (x, y)
            for s in stack:
                if s[:1] in (b"(", b"<"):
                    parts.append(_literal(s))
                elif t == b"TJ" and re.fullmatch(rb"-\d{3,}\.?\d*", s):
                    parts.append(" ")
            stack = []
        elif t == b"[":
            stack, array = [], True
        elif t == b"]":
            array = False
        else:
            stack.append(t)
    del array
    return blocks


def _plain_pdf(data: bytes) -> list[list[tuple[float, float, str]]]:
    """Blocks of each page of a PDF with plain or deflated content streams; fonts with their own encodings aren't read."""
    objects = {int(m[1]): m[3] for m in _OBJ.finditer(data)}

    def content(number: int) -> bytes:
        body = objects.get(number, b"")
        m = _STREAM.search(body)
        if not m:
            return b"".join(content(int(r)) for r in re.findall(rb"(\d+)\s+\d+\s+R", body))
        if b"FlateDecode" in body[:m.start()]:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error:
                return b""
        return m[1]

    pages = []
    for number in sorted(objects):
        body = objects[number]
        if re.search(rb"/Type\s*/Page\b(?!s)", body):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            stream = b"\n".join(content(int(r)) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])) if refs else b""
            pages.append(_content_blocks(stream))
    return pages


def _pdf_blocks(data: bytes) -> list[list[tuple[float, float, str]]]:
    try:
        import pymupdf
    except ImportError:
        return _plain_pdf(data)
    with pymupdf.open(stream=data, filetype="pdf") as doc:
        return [[(b[1], b[0], b[4]) for b in page.get_text("blocks")] for page in doc]


def _in_reading_order(blocks: list[tuple[float, float, str]]) -> list[str]:
    """Blank blocks dropped, the others by their place rounded to one decimal, top to bottom and left to right."""
    return [t.strip() for _, _, t in sorted(blocks, key=lambda b: (round(b[0], 1), round(b[1], 1))) if t.strip()]


def pdf_pages(data: bytes) -> list[tuple[int, str]]:
    """The plain text of each page, as the library gives it; without it, the blocks in reading order."""
    try:
        import pymupdf
    except ImportError:
        return [(i, "\n".join(_in_reading_order(b)).strip()) for i, b in enumerate(_plain_pdf(data), 1)]
    with pymupdf.open(stream=data, filetype="pdf") as doc:
        return [(i, page.get_text("text").strip()) for i, page in enumerate(doc, 1)]


def pdf_units(data: bytes) -> list[tuple[int, str, str]]:
    return [(i, t, "block") for i, b in enumerate(_pdf_blocks(data), 1) for t in _in_reading_order(b)]


# ---- readers --------------------------------------------------------------------------------------------------------

#: Readers by extension; replace an entry to read a format with another library.
PAGE_READERS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {"pdf": pdf_pages, "docx": docx_pages}
UNIT_READERS: dict[str, Callable[[bytes], list[tuple[int, str, str]]]] = {"pdf": pdf_units, "docx": docx_units}


def _decoded(data: bytes) -> str:
    """UTF-8 without the bytes that are none."""
    return data.decode("utf-8", "ignore")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, page, text, suspect_scanned) of a folder's PDF, DOCX, TXT and MD files.

    PDF pages count from 1; other files are page 1. PDF and DOCX texts are stripped and flagged under 40 characters;
    plain texts are kept as they are and never flagged. Files of one base name in two folders share their ``source``;
    ``path`` tells them apart. A file that can't be read fails the job with its path.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ext = path.rpartition(".")[2].lower()
                try:
                    pages = PAGE_READERS[ext](data) if ext in PAGE_READERS else [(1, _decoded(data))]
                except Exception as e:
                    raise ValueError(f"can't read {path}: {e}") from e
                n, name, flag = len(pages), path.rpartition("/")[2], ext in PAGE_READERS
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array([p for p, _ in pages], pa.int32()), pa.array([t for _, t in pages], pa.string()), pa.array([flag and len(t) < SUSPECT_CHARS for _, t in pages], pa.bool_())],
                    names=["path", "source", "page", "text", "suspect_scanned"],
                )

    return _files(spark, folder).mapInArrow(run, PAGE)


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, page, unit_no, text, kind): blocks of PDFs, sections and tables of DOCX files, whole plain texts.

    ``unit_no`` is the unit's place in its file. Blank plain texts have no unit.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ext = path.rpartition(".")[2].lower()
                try:
                    units = UNIT_READERS[ext](data) if ext in UNIT_READERS else [(1, t, "file")] if (t := _decoded(data)).strip() else []
                except Exception as e:
                    raise ValueError(f"can't read {path}: {e}") from e
                n, name = len(units), path.rpartition("/")[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array([p for p, _, _ in units], pa.int32()), pa.array(range(n), pa.int32()), pa.array([t for _, t, _ in units], pa.string()), pa.array([k for _, _, k in units], pa.string())],
                    names=["path", "source", "page", "unit_no", "text", "kind"],
                )

    return _files(spark, folder).mapInArrow(run, UNIT)
