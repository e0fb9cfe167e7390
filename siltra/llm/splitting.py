"""Splitting of oversized texts at natural boundaries, by ranges.

Every text and every file is cut into fixed ranges. Each range is scanned on its own, with a halo on both sides, for
*candidate* cuts; the boundary tables are stitched by a prefix sum of the ranges' word counts, the cuts are planned on
the tables alone, and pieces come out by offset. Planning works on groups of ``GROUP_WORDS`` words between anchor cuts
that both neighbours of an anchor find by themselves. A column's text lies in one row already, so its ranges are
stitched where the row lies, without a shuffle; a file's ranges are scanned, planned and emitted by any task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltra.llm.common import materialize

LIMIT, OVERLAP = 400, 80
RANGE_CHARS, HALO = 1024, 256
#: Words between anchors.
GROUP_WORDS = 40_000
#: Every so many words a position is a candidate even where no sentence ends.
GRID = 20

_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?…;。！？；][\"'”’»)\]*_]*$")
#: Shortenings whose full stop ends no sentence.
_SHORT = {"dr.", "mr.", "mrs.", "ms.", "prof.", "no.", "nr.", "e.g.", "i.e.", "ext.", "st.", "bzw.", "z.b.", "sr.", "sra.", "m.", "mme."}

#: UTF-8 bytes of white space and of sentence ends and closing marks beyond ASCII.
_BLANK_BYTES = re.compile(b"|".join(c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()))
_STOP_BYTES = re.compile(b"|".join(c.encode() for c in "…。！？；"))
_CLOSE_BYTES = re.compile(b"|".join(c.encode() for c in "”’»"))


def _one_char_a_byte(raw: bytes) -> str:
    """UTF-8 bytes as a text of as many characters, in which blanks and sentence ends are ASCII and all else is no blank."""
    for pattern, mark in ((_BLANK_BYTES, b" "), (_STOP_BYTES, b"."), (_CLOSE_BYTES, b'"')):
        raw = pattern.sub(lambda m: mark * len(m[0]), raw)  # noqa: B023
    return raw.decode("latin-1").replace("\x85", "x").replace("\xa0", "x")


def scan_range(text: str, lo: int, hi: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Words that start in ``text[lo:hi]`` and the candidate cuts before them.

    A candidate is (words of this range before it, level, start of the word after it, end of the word
    before it); offsets count from ``lo``. Levels: 3 paragraph, 2 line, 1 sentence, 0 grid.
    """
    begin = lo
    if lo and not text[lo - 1].isspace():  # the word that covers lo belongs to the range before
        while begin < len(text) and not text[begin].isspace():
            begin += 1
    prev = lo
    while prev and text[prev - 1].isspace():
        prev -= 1
    before = text[max(0, prev - 24):prev] if prev and begin == lo else text[max(0, begin - 24):begin]
    end = prev if begin == lo else begin
    n, out = 0, []
    for m in _WORD.finditer(text, begin):
        s = m.start()
        if s >= hi:
            break
        if before:
            gap = text[end:s]
            lines = gap.count("\n")
            level = 3 if lines > 1 or len(gap) >= HALO - 24 else 2 if lines else 0
            if not level and _END.search(before) and before.rpartition(" ")[2].lower() not in _SHORT:
                level = 1
            if level or n % GRID == 0:
                out.append((n, level, s - lo, end - lo))
        before, end = m[0][-24:], m.end()
        n += 1
    return n, out


def plan(cands: list[tuple[int, int, int, int]], first: int, last: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy pieces as (index of the first candidate, index of the candidate after the last word).

    ``cands`` ascend by word and hold sentinels for the ends of the text; the first piece's own words begin at
    candidate ``first``, the last piece ends at candidate ``last``.
    """
    at = [c[0] for c in cands]
    slack = overlap // 4

    def opening(cut: int) -> int:
        """Start of the piece whose new words begin at ``cut``: near ``overlap`` words before it."""
        want = at[cut] - overlap
        lo, hi = bisect_left(at, want - slack), bisect_right(at, want + slack)
        near = [i for i in range(lo, min(hi, cut))]
        if not near:
            return cut
        return min(near, key=lambda i: (cands[i][1] == 0, abs(at[i] - want), i))

    out, cut = [], first
    while cut < last:
        start = opening(cut) if overlap and at[cut] > 0 else cut
        if at[last] - at[start] <= limit:
            out.append((start, last))
            break
        lo, hi = bisect_right(at, max(at[cut], at[start] + limit // 2)), bisect_right(at, at[start] + limit)
        best = max(range(lo, hi), key=lambda i: (cands[i][1], i), default=None)
        if best is None or cands[best][1] == 0:
            early = [i for i in range(bisect_right(at, at[cut]), lo) if cands[i][1]]
            best = early[-1] if early else best
        if best is None:  # no candidate within the limit: only where the grid is wider than the limit
            raise ValueError("limit must exceed the candidate grid")
        out.append((start, best))
        cut = best
    return out


def _anchor(cands: list[tuple[int, int, int, int]], at: int, span: int) -> int:
    """Index of the cut that stands for the anchor ``at`` words: the best of the ``span`` words before it."""
    return max((i for i, c in enumerate(cands) if at - span < c[0] <= at), key=lambda i: (cands[i][1], i))


def _plan_group(cands: list[tuple[int, int, int, int]], group: int, total: int, end: int, limit: int, overlap: int, group_words: int = GROUP_WORDS) -> list[tuple[int, int, int, int]]:
    """Pieces (start offset, end offset, first word, words) of one group; ``end`` is the end of the text's last word."""
    rows = sorted(set(cands))
    if group == 0:
        rows = [c for c in rows if c[0] > 0]
        lead = min((c for c in cands if c[0] == 0), key=lambda c: c[2], default=(0, 0, 0, 0))
        rows.insert(0, (0, 3, lead[2], 0))
    if total <= (group + 1) * group_words:
        rows.append((total, 3, end, end))
        last = len(rows) - 1
    else:
        last = _anchor(rows, (group + 1) * group_words, limit // 2)
    first = 0 if group == 0 else _anchor(rows, group * group_words, limit // 2)
    return [(rows[a][2], rows[b][3], rows[a][0], rows[b][0] - rows[a][0]) for a, b in plan(rows, first, last, limit, overlap)]


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap <= limit // 4 or limit < 8 * GRID:
        raise ValueError(f"needs 0 <= overlap <= limit / 4 and limit >= {8 * GRID}")


def boundary_table(body: str, head: int, size: int, at: int, first: bool) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """(words, end of the last word or -1, candidates) of the range that begins at ``head`` in ``body``, its halos around it.

    Offsets count from the start of the text, of which the range begins at ``at``.
    """
    n, cands = scan_range(body, head, head + size)
    if first and n:
        cands = [(0, 3, len(body) - len(body.lstrip()), 0), *cands]
    tail = body[head:head + size].rstrip()
    end = len(tail)
    if end == size and (m := _WORD.match(body, head + size)):  # the last word goes on into the halo
        end = m.end() - head
    return n, end + at if tail else -1, [(w, v, s + at, e + at) for w, v, s, e in cands]


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS, group_words: int = GROUP_WORDS) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Words of ``text`` and its pieces (start, end, first word, words): ranges scanned, stitched and planned."""
    base, end, cands = 0, 0, []
    for lo in range(0, len(text), range_chars):
        left = max(0, lo - HALO)
        size = min(range_chars, len(text) - lo)
        n, last, own = boundary_table(text[left:lo + size + 2 * HALO], lo - left, size, lo, lo == 0)
        cands += [(w + base, v, s, e) for w, v, s, e in own]
        base, end = base + n, max(end, last)
    at = [c[0] for c in cands]
    out = []
    for g in range(-(-base // group_words)):
        lo, hi = bisect_left(at, g * group_words - limit // 2 - 2 * overlap), bisect_right(at, (g + 1) * group_words)
        out += _plan_group(cands[lo:hi], g, base, end, limit, overlap, group_words)
    return base, out


_KINDS = {"key": pa.int64(), "piece_no": pa.int64(), "start": pa.int64(), "end": pa.int64(), "first_word": pa.int64(), "n_words": pa.int64(), "total_words": pa.int64(), "piece": pa.string()}


def _split(df: DataFrame, key: str, text: str, with_text: bool, limit: int, overlap: int, range_chars: int, group_words: int) -> DataFrame:
    _check(limit, overlap)
    names = [k for k in _KINDS if with_text or k != "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total, pieces = pieces_of(t, limit, overlap, range_chars, group_words)
                for i, (s, e, w, n) in enumerate(pieces):
                    rows.append((k, i, s, e, w, n, total, t[s:e]) if with_text else (k, i, s, e, w, n, total))
                    held += e - s if with_text else 64
                    if held > 1 << 24:  # a long text's pieces leave in portions
                        yield batch(rows)
                        held = 0
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, names)], names=names)

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null and key is not null")
    return rows.mapInArrow(run, ", ".join(f"{k} {'string' if k == 'piece' else 'long'}" for k in names))


def piece_offsets(df: DataFrame, key: str = "chunk_no", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """Ordered pieces of every text of ``df`` as offsets, in one pass without a shuffle.

    Columns: ``key, piece_no`` (from 0), ``start, end`` (characters), ``first_word, n_words, total_words``. A text of at
    most ``limit`` words is one piece; null, empty and blank texts have none, rows without key are left out. Pieces hold
    at most ``limit`` words, end at a paragraph, line or sentence end where one lies within reach (else at a word), and
    each begins about ``overlap`` words before the end of the one before. Words are parted by any white space, no-break
    space included; the table's own token counts are never read. Rows of one key are split each on its own; other columns are
    ignored.
    """
    return _split(df, key, text, False, limit, overlap, range_chars, group_words)


def split_oversized(df: DataFrame, key: str = "chunk_no", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """:func:`piece_offsets` with each piece's text, cut out in the same pass: ``key, piece_no, first_word, n_words, total_words, piece``."""
    got = _split(df, key, text, True, limit, overlap, range_chars, group_words)
    return got.select(F.col("key").alias(key), "piece_no", "first_word", "n_words", "total_words", "piece")


def coverage(pieces: DataFrame, key: str = "chunk_no", limit: int = LIMIT) -> DataFrame:
    """(key, n_words, covered, within_limit) of each split text: words in all, words in at least one piece, no piece too long."""
    before = Window.partitionBy("key").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max(F.col("first_word") + F.col("n_words")).over(before), F.lit(0))
    new = pieces.withColumn("new", F.greatest(F.col("first_word") + F.col("n_words") - F.greatest(F.col("first_word"), upto), F.lit(0)))
    return new.groupBy(F.col("key").alias(key)).agg(
        F.max("total_words").alias("n_words"), F.sum("new").alias("covered"), (F.max("n_words") <= limit).alias("within_limit")
    ).select(key, F.expr("n_words"), "covered", "within_limit")


# ---- files ----------------------------------------------------------------------------------------------------------

_SCAN = "key long, range_no int, n_words long, last_end long, cands array<struct<w:long,level:int,s:long,e:long>>"


def _stitch(scanned: DataFrame, limit: int, overlap: int, group_words: int = GROUP_WORDS) -> DataFrame:
    """(key, piece_no, start, end, n_words, total_words) of all keys from their ranges' boundary tables."""
    slim = scanned.select("key", "range_no", "n_words", "last_end")
    upto = Window.partitionBy("key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    base = slim.select("key", "range_no", F.coalesce(F.sum("n_words").over(upto), F.lit(0)).alias("base"))
    whole = slim.groupBy("key").agg(F.sum("n_words").alias("total"), F.max("last_end").alias("text_end"))
    w = (F.col("base") + F.col("c.w")).alias("w")
    cands = scanned.join(base, ["key", "range_no"]).select("key", "base", F.explode("cands").alias("c")).select("key", w, "c.level", "c.s", "c.e")
    own = F.greatest(F.floor((F.col("w") - 1) / group_words), F.lit(0)).cast("long")
    near = F.when(F.col("w") > (own + 1) * group_words - (limit // 2 + 2 * overlap), F.array(own, own + 1)).otherwise(F.array(own))
    grouped = cands.withColumn("g", F.explode(near)).join(whole, "key").where(F.col("g") * group_words < F.col("total"))

    def plan_group(key, pdf):
        import pandas as pd

        rows = [tuple(map(int, r)) for r in zip(pdf.w, pdf.level, pdf.s, pdf.e)]
        got = _plan_group(rows, int(key[1]), int(pdf.total[0]), int(pdf.text_end[0]), limit, overlap, group_words)
        return pd.DataFrame(
            [(key[0], key[1], i, s, e, n, int(pdf.total[0])) for i, (s, e, _, n) in enumerate(got)],
            columns=["key", "g", "local_no", "start", "end", "n_words", "total_words"],
        )

    pieces = grouped.groupBy("key", "g").applyInPandas(plan_group, "key long, g long, local_no long, start long, end long, n_words long, total_words long")
    pieces = materialize(pieces, "pieces")
    earlier = Window.partitionBy("key").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offs = pieces.groupBy("key", "g").count().select("key", "g", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("off"))
    return pieces.join(offs, ["key", "g"]).select("key", (F.col("off") + F.col("local_no")).alias("piece_no"), "start", "end", "n_words", "total_words")


class _Reader:
    """Byte ranges of files on any file system pyarrow knows; a file stays open while it is asked for."""

    def __init__(self):
        self.path = self.file = None

    def at(self, path: str, start: int, size: int) -> bytes:
        if path != self.path:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
            if self.file:
                self.file.close()
            self.path, self.file = path, system.open_input_file(inner)
        return self.file.read_at(size, start)


def text_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's files, by name; only the listing is read."""
    rows = spark.read.format("binaryFile").load(folder).select("path", "length").collect()  # one row a file
    return sorted((r.path, r.length) for r in rows if r.length)


def split_files(spark: SparkSession, files: list[tuple[str, int]], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 1 << 22, group_words: int = GROUP_WORDS) -> DataFrame:
    """Pieces of giant UTF-8 files: (path, size) pairs that every executor can open, read range by range.

    Columns ``path, piece_no, start, end`` (bytes), ``n_words, piece``. Neither scanning nor emitting reads more than
    a range or a piece at a time. Bytes that are no UTF-8 separate nothing and stay in the piece, decoded leniently.
    """
    _check(limit, overlap)
    names = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(files)], "key long, path string, size long")
    ranges = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / range_bytes), F.lit(1)).cast("int") - 1)
    todo = names.select("key", "path", "size", F.explode(ranges).alias("range_no")).repartition("key", "range_no")

    def scan(batches):
        reader = _Reader()
        for b in batches:
            for r in b.to_pylist():
                lo = r["range_no"] * range_bytes
                left, size = max(0, lo - HALO), min(r["size"] - lo, range_bytes)
                body = _one_char_a_byte(reader.at(r["path"], left, lo - left + size + 4 * HALO))
                n, last, cands = boundary_table(body, lo - left, size, lo, lo == 0)
                cands = [dict(w=w, level=v, s=s, e=e) for w, v, s, e in cands]
                quad = pa.list_(pa.struct([("w", pa.int64()), ("level", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), quad)
                row = (r["key"], r["range_no"], n, last, cands)
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=["key", "range_no", "n_words", "last_end", "cands"])

    scanned = materialize(todo.mapInArrow(scan, _SCAN), "ranges")
    pieces = _stitch(scanned, limit, overlap, group_words).join(F.broadcast(names) if len(files) <= 10_000 else names, "key")

    def emit(batches):
        reader = _Reader()
        for b in batches:
            rows = b.to_pylist()
            text = [reader.at(r["path"], r["start"], r["end"] - r["start"]).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in (("path", pa.string()), ("piece_no", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()))] + [pa.array(text, pa.string())],
                names=["path", "piece_no", "start", "end", "n_words", "piece"],
            )

    return pieces.select("path", "piece_no", "start", "end", "n_words").mapInArrow(emit, "path string, piece_no long, start long, end long, n_words long, piece string")
