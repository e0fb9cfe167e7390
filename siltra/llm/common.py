"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltra.functions.shared import materialize, shared_dir

__all__ = ["WORD", "WS_JAVA", "materialize", "n_words", "shared_dir", "table", "words_of"]

#: White space as ``str.split()`` sees it, written as the body of a Java character class.
WS_JAVA = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A word of p8 and p9: an unbroken run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of ``text`` in lower case; ``[]`` for null."""
    return WORD.findall(text.lower()) if text else []


def n_words(col: Column | str) -> Column:
    """Number of words parted by white space; 0 for null."""
    col = F.col(col) if isinstance(col, str) else col
    parts = F.regexp_count(F.coalesce(col, F.lit("")), F.lit(rf"[^{WS_JAVA}]+"))
    return parts.cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
