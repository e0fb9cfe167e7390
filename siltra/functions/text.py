"""Text expressions with Python's reading of white space and letters, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``str.split()`` parts words at, as the body of a Java character class.
WS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters themselves.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(_col(c), rf"^[{WS}]+|[{WS}]+$", "")


def words(c: Column | str) -> Column:
    """Words parted by white space; an empty array for null and blank text. Blanks of any kind are made plain ones first:
    a cut at one character is several times faster than a pattern that collects words."""
    plain = F.translate(F.coalesce(_col(c), F.lit("")), _BLANKS, " " * len(_BLANKS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def n_words(c: Column | str) -> Column:
    return F.size(words(c))


def content_id(c: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the text; null for null."""
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def quoted(c: Column | str) -> Column:
    """A literal pattern for ``rlike`` (``\\Q..\\E``, with an inner ``\\E`` kept literal)."""
    return F.concat(F.lit(r"\Q"), F.replace(_col(c), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
