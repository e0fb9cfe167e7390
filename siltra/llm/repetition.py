"""Repetition inside a text: the share of its words that lie in a run which also starts earlier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltra.llm.common import materialize, words_of
from siltra.llm.quantiles import merge_sketches, partial_sketches, read_quantiles

RUN = 8
#: Share of repeated words from which TESTDATA's ``p9_found`` counts a text, whatever its group.
SHARE = 0.3
#: A text stands out of its language and source beyond the upper quartile by so many interquartile ranges, and from FLOOR on.
FENCE, FLOOR = 3.0, 0.1
#: A group of fewer texts has no distribution of its own and takes its language's.
LEAST = 20
#: Parts of a hot group in the join with its threshold.
SALT = 16


def repeated_words(words: list[str], run: int = RUN) -> int:
    """Words in a run of ``run`` words that also starts at an earlier place."""
    n = len(words)
    if n <= run:
        return 0
    seen: set[tuple[str, ...]] = set()
    upto = total = 0  # words before upto are counted already
    for i, window in enumerate(zip(*(words[j:] for j in range(run)))):
        if window in seen:
            total += i + run - max(upto, i)
            upto = i + run
        else:
            seen.add(window)
    return total


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, rep = [], []
        for t in b.column(3).to_pylist():
            words = words_of(t)
            n.append(len(words))
            rep.append(repeated_words(words))
        total = np.array(n, dtype=np.int64)
        share = np.array(rep, dtype=float) / np.maximum(total, 1)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array(total), pa.array(rep, pa.int64()), pa.array(share)], names=["key", "lang", "source", "n_words", "n_repeated", "share"]
        )


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, source, n_words, n_repeated, share) of every row; share is 0 where there are no words.

    ``lang`` is in lower case and without outer blanks. One pass over the texts, no shuffle.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.lower(F.trim("lang")).alias("lang"), F.col("source").alias("source"), F.col(text).alias("t"))
    return rows.mapInArrow(_measure, "key long, lang string, source string, n_words long, n_repeated long, share double").withColumnRenamed("key", key)


def adaptive_thresholds(measured: DataFrame, fence: float = FENCE, least: int = LEAST) -> DataFrame:
    """(lang, source, n, threshold): the upper fence of the shares of each language and source, from mergeable sketches.

    The fence is the third quartile and ``fence`` interquartile ranges. Groups of fewer than ``least`` texts take the fence of
    their language, read off the same sketches merged by language. Null languages and sources are groups of their own.
    """
    groups, quartiles = ["lang", "source"], {"q1": 0.25, "q3": 0.75}
    sketches = materialize(merge_sketches(partial_sketches(measured, groups, "share"), groups), "sketches")
    cut = F.col("q3") + fence * (F.col("q3") - F.col("q1"))
    own = read_quantiles(sketches, groups, quartiles).select(*groups, "n", cut.alias("own"))
    wide = read_quantiles(merge_sketches(sketches.drop("source"), ["lang"]), ["lang"], quartiles).select(F.col("lang").alias("_l"), cut.alias("wide"))
    return own.join(wide, F.col("lang").eqNullSafe(F.col("_l"))).select(*groups, "n", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("wide")).alias("threshold"))


def flag_repetitive(measured: DataFrame, thresholds: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Rows whose share reaches their group's threshold, or ``floor`` where that is higher, with it as ``cutoff``.

    Each threshold is joined in SALT copies, so that a hot language and source is spread over as many tasks.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_p")
    t = thresholds.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.greatest(F.lit(floor), "threshold").alias("cutoff"), parts)
    hit = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_q") == F.col("_p"))
    salted = measured.withColumn("_q", F.pmod(F.xxhash64(*[c for c in measured.columns if c not in ("lang", "source")]), F.lit(SALT)).cast("int"))
    return salted.join(t, hit).where(F.col("share") >= F.col("cutoff")).drop("_l", "_s", "_p", "_q")


def repetitive_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts whose share of repeated words stands out of their language and source. Texts without words are never flagged."""
    measured = materialize(repetition(df, key, text).where("n_words > 0"), "repetition")
    return flag_repetitive(measured, adaptive_thresholds(measured))


def share_at_least(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """Texts of which a fixed share of the words is repeated, counted in integers; texts without words are none of them."""
    return repetition(df, key, text).where((F.col("n_words") > 0) & (F.col("n_repeated") >= F.lit(share) * F.col("n_words")))
