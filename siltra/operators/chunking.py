"""From pages and units to numbered, content-addressed chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltra.functions.shared import materialize, number_rows
from siltra.functions.text import content_id, n_words, words
from siltra.functions.tokens import Tokenizer

SUSPECT_CHARS = 40


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Token windows of an array as array<struct<window_no, start, tokens>>: none for an empty array; the last one is
    the first that reaches the end."""
    _check(size, overlap)
    stride = size - overlap
    last = F.greatest(F.ceil((F.size(tokens) - size) / F.lit(stride)), F.lit(0)).cast("int")
    cut = lambda w: F.struct(w.alias("window_no"), F.slice(tokens, w * stride + 1, F.lit(size)).alias("tokens"))
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), cut)).otherwise(F.array().cast("array<struct<window_no:int,tokens:array<string>>>"))


def sliding_chunks(pages: DataFrame, size: int = 400, overlap: int = 80, text: str = "text", make: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """All columns of ``pages`` but its text, with ``window_no, id, text, n_tokens`` a window; pages are never joined.

    Tokens are words parted by white space, or those of the tokenizer that ``make`` gives. Null, empty and (as words)
    blank pages have no chunk. No shuffle.
    """
    _check(size, overlap)
    keep = [c for c in pages.columns if c not in (text, "window_no", "id", "n_tokens")]
    if make is not None:
        kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ("," if keep else "") + "window_no int, text string, n_tokens int"
        w = pages.where(F.col(text).isNotNull()).select(*keep, text).mapInArrow(_token_windows(make, size, size - overlap), schema)
        return w.select(*keep, "window_no", content_id("text").alias("id"), "text", "n_tokens")
    # words first, as a column of their own: an expression would be evaluated again for each window
    w = pages.select(*keep, words(text).alias("_t")).select(*keep, F.explode(windows(F.col("_t"), size, overlap)).alias("_w"))
    w = w.select(*keep, F.col("_w.window_no"), F.array_join("_w.tokens", " ").alias("text"), F.size("_w.tokens").alias("n_tokens"))
    return w.select(*keep, "window_no", content_id("text").alias("id"), "text", "n_tokens")


def _token_windows(make: Callable[[], Tokenizer], size: int, stride: int):
    """Arrow function: the last column is text; the others are repeated for each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for b in batches:
            rows, number, parts, counts = [], [], [], []
            for row, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                ids = own.encode(t)
                last = max(0, -(-(len(ids) - size) // stride))
                for w in range(last + 1 if ids else 0):
                    cut = ids[w * stride:w * stride + size]
                    rows.append(row)
                    number.append(w)
                    parts.append(own.decode(cut))
                    counts.append(len(cut))
            at = pa.array(rows, pa.int64())
            cols = [c.take(at) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(number, pa.int32()), pa.array(parts, pa.string()), pa.array(counts, pa.int32())], names=[*b.schema.names[:-1], "window_no", "text", "n_tokens"]
            )

    return run


def _with_counts(units: DataFrame, text: str, make: Callable[[], Tokenizer]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for b in batches:
            n = [len(own.encode(t)) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], names=[*b.schema.names, "_n"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInArrow(run, f"{kinds}, _n int")


class _Open:
    """What a greedy pack does next, for every state it may be in at the start of a range: row 0 is no open pack, row
    h + 1 an open pack of h tokens. ``packs`` counts the packs closed since."""

    def __init__(self, size: int):
        self.size = size
        self.open = np.arange(size + 2) > 0
        self.held = np.maximum(np.arange(size + 2) - 1, 0)
        self.packs = np.zeros(size + 2, dtype=np.int64)

    def take(self, n: int) -> None:
        if n > self.size:  # stands alone
            self.packs += 1 + self.open
            self.open[:] = False
            self.held[:] = 0
            return
        full = self.open & (self.held + n > self.size)
        self.packs += full
        self.held = np.where(full, n, self.held + n)
        self.open[:] = True


def pack_units(units: DataFrame, keys: list[str], order: list[str], size: int = 400, overlap: int = 80, text: str = "text", make: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """Greedy packs of whole units: ``keys, pack_no, window_no, id, text, n_tokens``.

    Units of one key in the order ``order`` are packed while their tokens fit ``size``; a longer unit stands alone
    and is cut into windows. Packs are joined by a blank line, tokens of the separators aren't counted. Null text is an
    empty unit and is left out.

    Packing is sequential within a key, yet no task has to take a whole hot key: units are sorted into ranges, each range
    works out what it does for every state the pack may be in when it begins (at most size + 2), the driver links the
    ranges (one small table a range), and then each numbers its packs.
    """
    _check(size, overlap)
    rows = units.where(F.col(text).isNotNull()).select(*keys, *[c for c in order if c not in keys], F.col(text).alias("_text"))
    rows = rows.withColumn("_n", n_words("_text").cast("int")) if make is None else _with_counts(rows, "_text", make)
    spread = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    laid = materialize(spread.select(*keys, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"), "_n", "_text"), "units")
    packs = _number_packs(laid, keys, size)
    joined = packs.groupBy(*keys, "pack_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]), "\n\n").alias("_text"), F.sum("_n").cast("int").alias("_n"))
    whole = joined.where(F.col("_n") <= size).select(*keys, "pack_no", F.lit(0).alias("window_no"), content_id("_text").alias("id"), F.col("_text").alias("text"), F.col("_n").alias("n_tokens"))
    long = sliding_chunks(joined.where(F.col("_n") > size).withColumnRenamed("_text", "text").drop("_n"), size, overlap, make=make)
    return whole.unionByName(long.select(whole.columns))


def _number_packs(laid: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``laid`` (keys, _part, _at, _n, _text) with ``pack_no``; rows of a _part are in one file, in order."""
    from pickle import dumps, loads

    slim = laid.select(*keys, "_part", "_at", "_n").repartition("_part").sortWithinPartitions("_part", "_at")

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = now = lead = None

        def row() -> tuple:
            # the first key's table (open, held, packs); the last key's state, unless it is the first one's
            rest = None if last is first else (bool(now.open[0]), int(now.held[0]), int(now.packs[0]))
            return part, dumps((first, last, (lead.open, lead.held, lead.packs), rest))

        out = []
        for b in batches:
            for *key, p, _, n in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if part is not None:
                        out.append(row())
                    part, first = p, key
                    last, lead = first, _Open(size)
                    now = lead
                elif key != last:
                    last, now = key, _Open(0)  # a key that begins here: only the state of no open pack counts
                    now.size = size
                now.take(n)
        if part is not None:
            out.append(row())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([t for _, t in out], pa.binary())], names=["part", "state"])

    carry: dict[int, tuple[bool, int, int]] = {}
    key, state = object(), (False, 0, 0)
    tables = {r.part: bytes(r.state) for r in slim.mapInArrow(survey, "part int, state binary").collect()}  # one row a range
    for part in sorted(tables):
        first, last, (is_open, held, packs), rest = loads(tables[part])
        state = state if first == key else (False, 0, 0)
        carry[part] = state
        at = state[1] + 1 if state[0] else 0
        state = (bool(is_open[at]), int(held[at]), state[2] + int(packs[at])) if rest is None else rest
        key = last
    sent = laid.sparkSession.sparkContext.broadcast(carry)
    names, kinds = [*keys, "pack_no", "_at", "_n", "_text"], {f.name: f.dataType.simpleString() for f in laid.schema.fields}
    rows = laid.select(*keys, "_part", "_at", "_n", "_text").repartition("_part").sortWithinPartitions("_part", "_at")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, is_open, held, no = None, None, False, 0, 0
        for b in batches:
            packs = []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns - 1)]
            for *now, p, _, n in zip(*cols):
                if p != part:
                    part, key, (is_open, held, no) = p, now, sent.value[p]
                elif now != key:
                    key, is_open, held, no = now, False, 0, 0
                if n > size:
                    no += is_open
                    packs.append(no)
                    is_open, held, no = False, 0, no + 1
                    continue
                if is_open and held + n > size:
                    no, held = no + 1, 0
                packs.append(no)
                is_open, held = True, held + n
            at, n, texts = b.columns[-3:]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array(packs, pa.int32()), at, n, texts], names=names)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pack_no int, _at long, _n int, _text string"
    return rows.mapInArrow(number, schema)


def fold_sections(paragraphs: DataFrame, keys: list[str], order: str = "para_no", style: str = "style", text: str = "text") -> DataFrame:
    """Paragraphs under their headings: ``keys, section_no, text``; section 0 is what stands before the first heading.

    A style that begins with ``heading`` or ``title`` in any case opens a section; a null style opens none; blank
    paragraphs are left out. Lines are joined by line ends in order.
    """
    rows = paragraphs.where(n_words(text) > 0)
    heading = F.coalesce(F.lower(F.col(style)).rlike("^(heading|title)"), F.lit(False))
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("section_no", F.sum(heading.cast("int")).over(upto).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return marked.groupBy(*keys, "section_no").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))


def dedup_first(chunks: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """The first chunk of each id in the order of ``order``, across all sources; chunks without id all stay.

    Equal chunks are combined before the shuffle, so a text that makes up a third of the corpus is no hot key. Rows
    that tie in ``order`` keep one of them.
    """
    rest = [c for c in chunks.columns if c != key]
    first = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
    return first.select(chunks.columns).unionByName(chunks.where(F.col(key).isNull()))


def numbered_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunks with ``chunk_no`` from 1, the identity of a row in every later operator and the last word on ties."""
    return number_rows(chunks, order, "chunk_no")


def flag_scanned(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with ``suspect_scanned``: fewer than 40 characters of text; a null text counts as none."""
    return pages.withColumn("suspect_scanned", F.coalesce(F.length(text), F.lit(0)) < SUSPECT_CHARS)


def ingest_counters(pages: DataFrame, chunks: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: n_pages, n_suspect_scanned, n_chunks, n_dropped, n_tokens and n_vectors (of the unique chunks)."""
    p = flag_scanned(pages).agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.col("suspect_scanned").cast("long")), F.lit(0)).alias("n_suspect_scanned"))
    c = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    u = unique.agg(F.count(F.lit(1)).alias("_u"), F.coalesce(F.sum(F.col("n_tokens").cast("long")), F.lit(0)).alias("n_tokens"))
    one = p.withColumn("_k", F.lit(1)).join(c.withColumn("_k", F.lit(1)), "_k").join(u.withColumn("_k", F.lit(1)), "_k")
    return one.select("n_pages", "n_suspect_scanned", "n_chunks", (F.col("n_chunks") - F.col("_u")).alias("n_dropped"), "n_tokens", F.col("_u").alias("n_vectors"))
