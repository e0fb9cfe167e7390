"""Packing of records into containers along a space-filling curve.

Records of one source and page are ordered by the Hilbert key of their projected word vector, so that neighbours on
the curve are alike; a range sort lays the curve over the tasks and each task packs its stretch in bounded windows of
neighbours (best fit, longest first). A hot source is spread over as many tasks as its rows need; each border between
two tasks costs at most one container that is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltra.llm.common import materialize

CAPACITY = 400
DIMS, BITS, HASHED = 3, 10, 1 << 14
#: Containers' worth of words, neighbours on the curve, that are taken in before packing (more if over four times as
#: much is left over), and records held at most; a container that is filled less than GOOD waits for the next window.
STRETCH, WINDOW, GOOD = 8, 8192, 0.985


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of integer points (n, d) with ``bits`` bits a dimension (transposed form, Gray code undone)."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and Hilbert key of each text: word counts hashed to HASHED places, a fixed random projection to DIMS, quantised."""
    base = np.random.Generator(np.random.PCG64(20)).standard_normal((HASHED, DIMS))
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        words = [t.lower().split() if t else [] for t in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.array([w for ws in words for w in ws], dtype=object)
        points = np.zeros((len(words), DIMS))
        if len(flat):
            codes, unique = pd.factorize(flat)
            places = (pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False) % np.uint64(HASHED)).astype(np.int64)
            vectors = base[places[codes]]
            some = np.flatnonzero(sizes)
            starts = np.cumsum(sizes) - sizes
            points[some] = np.add.reduceat(vectors, starts[some], axis=0)
            points[some] /= np.sqrt(sizes[some])[:, None]
        grid = np.clip(((0.5 + np.arctan(points) / np.pi) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes), pa.array(hilbert(grid), pa.int64())], names=["key", "source", "page", "n", "curve"])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` in bins of ``capacity``: longest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            bins[at].append(i)
        else:
            r, at = capacity, len(bins)
            bins.append([i])
        room[r - n].append(at)
        mask |= 1 << (r - n)
    return bins


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: tuple | None = None
        held: list[tuple[int, int, int]] = []  # (key, piece_no, words)
        fresh = left = 0  # words taken in since the last packing, and words left over by it

        def close(final: bool) -> None:
            nonlocal held, fresh, left
            kept: list[tuple[int, int, int]] = []
            fresh = left = 0
            for b in best_fit([h[2] for h in held], capacity):
                rows = [held[i] for i in b]
                words = sum(r[2] for r in rows)
                if not final and words < GOOD * capacity and len(kept) + len(rows) <= WINDOW // 2:
                    kept.extend(rows)
                    left += words
                    continue
                name = "%d-%d" % min(r[:2] for r in rows)
                out.extend((*group, name, *r) for r in rows)
            held = kept

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 6
            out.clear()
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["source", "page", "container_id", "key", "piece_no", "n_words"])

        for b in batches:
            for key, source, page, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                if group != (source, page):
                    if group is not None:
                        close(True)
                    group, held, fresh, left = (source, page), [], 0, 0
                piece = 0
                while n > capacity:
                    out.append((source, page, f"{key}-{piece}", key, piece, capacity))
                    n -= capacity
                    piece += 1
                held.append((key, piece, n))
                fresh += n
                if fresh >= max(STRETCH * capacity, left // 4) or len(held) >= WINDOW:
                    close(False)
            if len(out) > 10_000:
                yield batch()
        if group is not None:
            close(True)
        yield batch()

    return run


def pack_containers(df: DataFrame, key: str = "chunk_no", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(source, page, container_id, key, piece_no, n_words): every record in containers of its source and page.

    No container holds more than ``capacity`` words. Only a record longer than that is split: into pieces that fill a
    container each, and the rest as piece ``piece_no``. Null and empty texts have 0 words and take no room; null
    sources and pages form groups of their own. ``container_id`` names the first record and piece inside.
    """
    rows = df.select(
        F.col(key).cast("long").alias("key"), F.col("source").cast("string").alias("source"), F.col("page").cast("int").alias("page"), F.col(text).alias("t")
    ).mapInArrow(_project, "key long, source string, page int, n long, curve long")
    rows = materialize(rows, "curve")
    order = ["source", "page", "curve", "key"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "source", "page", "n")
    return laid.mapInArrow(_pack(capacity), "source string, page int, container_id string, key long, piece_no long, n_words long").withColumnRenamed("key", key)


def membership(packed: DataFrame, key: str = "chunk_no", capacity: int = CAPACITY) -> DataFrame:
    """(key, n_words, n_pieces, fits) of each record: its words over all its pieces, and whether all its containers keep to the capacity."""
    box = ["source", "page", "container_id"]
    full = packed.groupBy(*box).agg(F.sum("n_words").alias("_f")).select(*[F.col(c).alias(f"_{c}") for c in box], "_f")
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("page").eqNullSafe(F.col("_page")) & (F.col("container_id") == F.col("_container_id"))
    return packed.join(full, same).groupBy(key).agg(F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_pieces"), (F.max("_f") <= capacity).alias("fits"))
