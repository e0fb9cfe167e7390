"""Evaluation passages inside a corpus, by the q-gram lemma in diagonal bands.

A window of an item (``words`` consecutive words with the blanks around them, L characters) that stands in a document
with at most e edits shares at least L - q + 1 - q e character q-grams with it, all on e + 1 neighbouring diagonals
(document place less item place). Every document goes through the same four steps, all windows alike:

1. *anchors*: every ``step``-th q-gram of the document is looked up among the items' q-grams. Bands hold 2 (e + 1)
   diagonals and overlap by half, so that any e + 1 neighbours lie in one. Each edit spoils at most ceil(q / step)
   anchors, so a near copy of a window keeps ``need`` of them in one band; windows with as many go on.
2. *count*: all q-grams that such a window shares in its band are counted and held to its bound.
3. *alignment*: windows that reach it are aligned with the document, never leaving the band; the distance is exact.
4. a document holds an item if the least distance of its windows is within the budget.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltra.llm.common import materialize, words_of

#: Consecutive words that make a leak; characters of a q-gram; edits allowed within a run.
WORDS, Q, EDITS = 12, 8, 2
#: Characters of item text up to which the index is sent to every task; beyond it q-grams meet by a shuffle.
INDEX_CHARS = 8 << 20
#: Characters of documents worked on at once.
PORTION = 1 << 18
#: Bits of the filter that thins the corpus's q-grams before they are shuffled (8 MB), and rows it travels in.
FILTER_BITS, FILTER_ROWS = 26, 256
#: Parts of a q-gram or item that more than 1 / HOT_PARTS of the rows have.
SALT, HOT_PARTS = 64, 1000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def normalised(text: str | None) -> bytes:
    """Words in lower case, a blank around each; ``b" "`` where there is none."""
    return (" " + " ".join(words_of(text)) + " ").encode()


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of each q-gram of a byte array, built from those of half its length."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    size, have = 1, data.astype(np.uint64) + np.uint64(1)
    out, at = None, 0
    left = q
    while left:
        if left & 1:
            part = have[at:at + n]
            out = part.copy() if out is None else out * _MUL + part
            out ^= out >> np.uint64(29)
            at += size
        left >>= 1
        if left:
            have = have[:-size] * _MUL + have[size:] * np.uint64(0xC2B2AE3D27D4EB4F)
            have ^= have >> np.uint64(31)
            size *= 2
    return out


def _windows(text: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of ``words`` words in a normalised text, with the blanks around it."""
    blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    return blanks[:-words], blanks[words:] + 1


def _expand(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, lo + count): the number of the range, and each of its members."""
    of = np.repeat(np.arange(len(lo)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + lo[of]


class QGramIndex:
    """Windows and q-grams of a set of items; finds those that stand in documents within the edit budget."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, q: int = Q, edits: int = EDITS):
        self.q, self.edits, self.width = q, edits, 2 * (edits + 1)
        texts = [(i, normalised(t)) for i, t in items]
        texts = [(i, t) for i, t in texts if t.count(b" ") > words]  # a shorter item has no run
        self.ids = [i for i, _ in texts]
        joined = b"\1".join(t for _, t in texts)
        self.joined = np.frombuffer(joined, dtype=np.uint8)
        if not texts:
            return
        sizes = np.fromiter((len(t) for _, t in texts), dtype=np.int64, count=len(texts)) + 1
        self.begins = np.cumsum(sizes) - sizes
        parts = [_windows(t, words) for _, t in texts]
        self.start = np.concatenate([s + b for (s, _), b in zip(parts, self.begins)])
        self.end = np.concatenate([e + b for (_, e), b in zip(parts, self.begins)])
        long = self.end - self.start
        # the budget of a window that is too short for the lemma is what the lemma still can serve
        self.budget = np.minimum(edits, (long - q) // q).clip(0)
        self.bound = long - q + 1 - q * self.budget
        self.longest, least = int(long.max()), int(long.min())
        stretch = int((-(-(long - self.budget) // (self.budget + 1))).min())  # without edits, in the worst window
        self.step = max(1, min((stretch - q + 1) // 2, q // 2))
        self.need = np.maximum(1, (long - self.budget - q + 1) // self.step - self.budget * -(-q // self.step))
        # at each place: the least need and the greatest length of the windows that cover it
        self.need_at, self.wide_at = np.full(len(joined) + 1, 1 << 40), np.zeros(len(joined) + 1, dtype=np.int64)
        for s, e, n in zip(self.start.tolist(), self.end.tolist(), self.need.tolist()):
            np.minimum(self.need_at[s:e], n, out=self.need_at[s:e])
            np.maximum(self.wide_at[s:e], e - s, out=self.wide_at[s:e])
        # of the q-grams of a near copy at most e (q + 1) aren't among the items': elsewhere nothing has to be looked up
        self.reach = least + edits - q + 1
        self.crowd = max(1, self.reach - edits * (q + 1))
        self.grams = _grams(self.joined, q)
        self.order = np.argsort(self.grams, kind="stable")
        self.hash = self.grams[self.order]
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the documents, place in the items) of the sampled q-grams that both have, where they crowd."""
        some = self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        n = len(h)
        upto = np.concatenate([[0], np.cumsum(some)])
        full = upto[np.minimum(np.arange(n) + self.reach, n)] - upto[:n] >= self.crowd
        near = np.concatenate([[0], np.cumsum(full)])
        at = np.arange(0, n, self.step)
        at = at[some[at]]
        at = at[near[at + 1] - near[np.maximum(at + 1 - self.reach, 0)] > 0]
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        of, rows = _expand(lo, hi - lo)
        return at[of], self.order[rows]

    def _bands(self, place: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest diagonal, window) of the windows that keep their need of anchors in one band."""
        half, size = self.edits + 1, len(self.joined)
        band = (place - there + size) // half
        key = np.concatenate([(band + 1) * size + there, band * size + there])  # each anchor lies in two bands
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        there = key % size
        n = len(key)
        need = self.need_at[there]
        last = np.arange(n) + need - 1
        first = np.flatnonzero((last < n) & (key[np.minimum(last, n - 1)] <= key + self.wide_at[there] - self.q))
        # the windows whose first anchor in the band this is
        base, at = key[first] - there[first], there[first]
        before = np.where(first > 0, key[np.maximum(first - 1, 0)] - base, -1)
        lo = np.searchsorted(self.start, np.maximum(before + 1, at - self.wide_at[at] + 1), "left")
        of, win = _expand(lo, np.maximum(np.searchsorted(self.start, at, "right") - lo, 0))
        count = np.searchsorted(key, base[of] + self.end[win] - self.q + 1, "left") - first[of]
        good = count >= self.need[win]
        return (base[of[good]] // size - 1) * half - size, win[good]

    def _counted(self, h: np.ndarray, base: np.ndarray, win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the windows whose shared q-grams in the band reach their bound."""
        good = np.zeros(len(win), dtype=bool)
        span = np.arange(self.longest - self.q + 1)
        step = max(1, (1 << 21) // len(span))
        for i in range(0, len(win), step):
            start, end, low = self.start[win[i:i + step]], self.end[win[i:i + step]], base[i:i + step]
            there = start[:, None] + span
            here = there + low[:, None]
            np.minimum(there, len(self.grams) - 1, out=there)
            mine = self.grams[there]
            shared = np.zeros(mine.shape, dtype=bool)
            for d in range(self.width):
                shared |= h.take(here, mode="clip") == mine
                here += 1
            shared &= span < (end - start - self.q + 1)[:, None]
            good[i:i + step] = shared.sum(axis=1) >= self.bound[win[i:i + step]]
        return base[good], win[good]

    def distances(self, data: np.ndarray, base: np.ndarray, win: np.ndarray) -> np.ndarray:
        """Edit distance of each window from the nearest stretch of ``data``, within its band of diagonals from ``base``."""
        start, long = self.start[win], self.end[win] - self.start[win]
        out = np.full(len(win), self.width, dtype=np.int16)
        if not len(win):
            return out
        row = np.zeros((len(win), self.width), dtype=np.int16)
        step = np.arange(self.width)
        for i in range(int(long.max())):
            at = start + i
            here = data.take((at + base)[:, None] + step, mode="clip")
            new = row + (here != self.joined[np.minimum(at, len(self.joined) - 1)][:, None])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            for k in range(1, self.width):
                np.minimum(new[:, k], new[:, k - 1] + 1, out=new[:, k])
            row = new
            if (ended := long == i + 1).any():
                out[ended] = row[ended].min(axis=1)
        return out

    def leaks(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text the items of which it holds a run, with the least edits of any run."""
        found: list[dict[int, int]] = [{} for _ in texts]
        if not self.ids:
            return found
        held: list[tuple[int, bytes]] = []
        size = 0
        lap = self.longest + self.width
        for n, t in enumerate(texts):
            doc = normalised(t)
            for at in range(0, max(len(doc) - lap, 1), PORTION):  # pieces of a long text overlap by more than a run
                piece = doc[at:at + PORTION + lap]
                held.append((n, piece))
                size += len(piece)
                if size >= PORTION:
                    self._search(held, found)
                    held, size = [], 0
        self._search(held, found)
        return found

    def _search(self, held: list[tuple[int, bytes]], found: list[dict[int, int]]) -> None:
        if not held:
            return
        data = np.frombuffer(b"\0".join(p for _, p in held), dtype=np.uint8)
        h = _grams(data, self.q)
        if not len(h):
            return
        base, win = self._counted(h, *self._bands(*self._anchors(h)))
        if not len(win):
            return
        sizes = np.fromiter((len(p) for _, p in held), dtype=np.int64, count=len(held)) + 1
        starts = np.cumsum(sizes) - sizes
        owner = np.fromiter((n for n, _ in held), dtype=np.int64, count=len(held))
        # the middle of a near copy lies in its document whatever its diagonal is
        doc = owner[np.clip(np.searchsorted(starts, (self.start[win] + self.end[win]) // 2 + base + self.edits + 1, "right") - 1, 0, len(held) - 1)]
        item = np.searchsorted(self.begins, self.start[win], "right") - 1
        pair = doc * len(self.ids) + item
        # one window of each pair first; the others only where that one isn't free of edits already
        _, one = np.unique(pair, return_index=True)
        cost = np.full(len(win), self.width, dtype=np.int16)
        cost[one] = self.distances(data, base[one], win[one])
        rest = np.ones(len(win), dtype=bool)
        rest[one] = False
        rest &= ~np.isin(pair, pair[one[cost[one] == 0]])
        rest = np.flatnonzero(rest)
        for i in range(0, len(rest), 50_000):
            cost[rest[i:i + 50_000]] = self.distances(data, base[rest[i:i + 50_000]], win[rest[i:i + 50_000]])
        for d, i, c in zip(doc[(good := cost <= self.budget[win])].tolist(), item[good].tolist(), cost[good].tolist()):
            known = found[d]
            known[self.ids[i]] = min(c, known.get(self.ids[i], c))


_indexes: dict[tuple, QGramIndex] = {}


def _index_of(name: str, items: list[tuple[int, str]], *options: int) -> QGramIndex:
    """The index of a broadcast, made once in each Python worker; a worker keeps one."""
    if (name, *options) not in _indexes:
        _indexes.clear()
        _indexes[name, *options] = QGramIndex(items, *options)
    return _indexes[name, *options]


def _rows(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "i", "edits"])


_FOUND = "d long, i long, edits long"


def leaked_items(
    corpus: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
    words: int = WORDS, q: int = Q, edits: int = EDITS, index_chars: int = INDEX_CHARS,
) -> DataFrame:
    """(doc_key, item_key, edits): each document with each item of which a run of ``words`` words stands in it with at
    most ``edits`` edited characters, and the least edits of any such run (0: word for word).

    Words are runs of letters and digits without regard to case; edits count in the run with single blanks between and
    around its words. A run shorter than q (edits + 1) characters may have as many edits as the lemma still serves. Null and
    short texts hold nothing; repeated rows of a document or item give one row; an empty table gives none.

    Items of up to ``index_chars`` characters in all go to the tasks as one broadcast and the corpus is searched where
    it lies. More items meet the corpus by a shuffle of q-grams (:func:`_shuffled`); the rows are the same.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.col(doc_key).cast("long").alias("d"), F.col(text).alias("t")).where("t is not null and d is not null")
    held = items.select(F.col(item_key).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null").distinct()
    total = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    if total > index_chars:
        found = _shuffled(docs, held, words, q, edits, -(-total // index_chars))
    else:
        sent = spark.sparkContext.broadcast([tuple(r) for r in held.collect()])  # at most index_chars characters

        name = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index_of(name, sent.value, words, q, edits)
            for b in batches:
                yield _rows([(d, i, c) for d, own in zip(b.column(0).to_pylist(), index.leaks(b.column(1).to_pylist())) for i, c in own.items()])

        found = docs.mapInArrow(scan, _FOUND)
    return found.groupBy(F.col("d").alias(doc_key), F.col("i").alias(item_key)).agg(F.min("edits").alias("edits"))


def _filter(grams: DataFrame) -> np.ndarray:
    """Bit table of the items' q-grams: 2 ** FILTER_BITS bits whatever their number, put together from the tasks' tables."""
    wide = (1 << FILTER_BITS) // FILTER_ROWS // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for b in batches:
            bits[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        rows = np.packbits(bits).reshape(FILTER_ROWS, wide)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["row", "bits"])

    def merge(key, pdf):
        import pandas as pd

        return pd.DataFrame({"row": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in pdf.bits]).tobytes()]})

    out = np.zeros((FILTER_ROWS, wide), dtype=np.uint8)
    for r in grams.mapInArrow(mark, "row long, bits binary").groupBy("row").applyInPandas(merge, "row long, bits binary").toLocalIterator():
        out[r.row] = np.frombuffer(r.bits, dtype=np.uint8)
    return np.unpackbits(out.reshape(-1)).view(bool)


def _shuffled(docs: DataFrame, items: DataFrame, words: int, q: int, edits: int, slices: int) -> DataFrame:
    """The same rows for items of any size: sampled q-grams of the corpus that pass a filter of fixed size meet those of
    the items by a join on the q-gram; each document then meets its candidate items in groups of about ``index_chars``
    characters, where the bands are counted and aligned as ever. Hot q-grams and hot items are salted."""
    spark = docs.sparkSession

    def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = QGramIndex([(i, t)], words, q, edits)
                if one.ids:
                    h = np.unique(one.grams).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), i)), pa.array(np.full(len(h), one.step))], names=["h", "i", "step"])

    own = materialize(items.mapInArrow(item_grams, "h long, i long, step long"), "item-grams")
    step = own.agg(F.coalesce(F.min("step"), F.lit(1))).first()[0]
    bits = spark.sparkContext.broadcast(np.packbits(_filter(own.select("h"))))

    def doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits.value).view(bool)
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = _grams(np.frombuffer(normalised(t), dtype=np.uint8), q)[::step]
                h = np.unique(h[known[h >> np.uint64(64 - FILTER_BITS)]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), d, dtype=np.int64))], names=["h", "d"])

    there = materialize(docs.mapInArrow(doc_grams, "h long, d long"), "doc-grams")
    often = max(there.count() // HOT_PARTS, 1000)
    hot = F.broadcast(there.groupBy("h").count().where(F.col("count") > often).select("h", F.lit(True).alias("hot")))  # at most HOT_PARTS rows
    left = there.join(hot, "h", "left").select("h", "d", F.when(F.col("hot"), F.pmod(F.xxhash64("d"), F.lit(SALT))).otherwise(0).cast("int").alias("salt"))
    every = F.sequence(F.lit(0), F.lit(SALT - 1))
    right = own.join(hot, "h", "left").select("h", "i", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0)))).alias("salt"))
    pairs = materialize(left.join(right, ["h", "salt"]).select("d", "i").distinct(), "pairs").withColumn("slice", F.pmod(F.xxhash64("i"), F.lit(slices)).cast("int"))
    asked = pairs.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALT)).cast("int"))
    told = asked.join(items.withColumn("salt", F.explode(every)), ["i", "salt"]).select("d", "slice", "i", F.col("t").alias("item"))
    texts = docs.join(pairs.select("d", "slice").distinct(), "d").select(F.col("d").alias("own"), F.col("slice").alias("part"), "t")

    def verify(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            index = QGramIndex(list(zip(right["i"].to_pylist(), right["item"].to_pylist())), words, q, edits)
            out = [(key[0].as_py(), i, c) for found in index.leaks(left["t"].to_pylist()) for i, c in found.items()]
        return pa.Table.from_batches([_rows(out)])

    return texts.groupBy("own", "part").cogroup(told.groupBy("d", "slice")).applyInArrow(verify, _FOUND)
