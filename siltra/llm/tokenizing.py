"""Encoding with a public byte-level BPE, by forced-boundary splitting.

A pair of bytes that stands side by side in no vocabulary token can never be covered by one token, so a cut between
the two is certain. From the pair table two kinds of cut are kept that also leave the pre-tokenizer's choices as they
are: before ASCII white space that follows other than white space, and between two letters of one script-free class
(letters only) inside a word. Fragments between cuts are encoded on their own and their ids are concatenated.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltra.functions.tokens import FOLDER as TOKENIZERS
from siltra.functions.tokens import PATTERN

VOCABULARY = "byte_bpe_50k"
#: Characters a fragment holds at least.
FRAGMENT = 256


@lru_cache(maxsize=4)
def _load(folder: str, vocabulary: str):
    import tiktoken

    ranks = {}
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ~inside


@lru_cache(maxsize=2)
def common_words(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> frozenset[str]:
    """Plain words: those that a public vocabulary writes as one token. A missing file, a broken line and a
    file without plain words are errors: without the words names would be missed, or words be taken for names."""
    out = set()
    with open(path := os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        for line in f:
            token, _ = line.split()
            token = base64.b64decode(token, validate=True)
            if token[:1] == b" " and token[1:].isalpha() and token[1:].islower():
                out.add(token[1:].decode())
    if not out:
        raise ValueError(f"no plain words in {path}")
    return frozenset(out)


class ForcedEncoder:
    """Encoder of one vocabulary; made once in each Python worker."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, size: int = FRAGMENT):
        self.encoding, self.never = _load(folder, vocabulary)
        self.size = size

    def certain(self, a: str, b: str) -> bool:
        """Whether a cut between the neighbouring characters a and b is certain."""
        if not self.never[a.encode("utf-8", "replace")[-1], b.encode("utf-8", "replace")[0]]:
            return False
        if b in " \t\n\r\x0b\x0c":
            return not a.isspace()
        return a.isalpha() and b.isalpha()

    def fragments(self, text: str, size: int = FRAGMENT) -> list[str]:
        """``text`` in fragments of ``size`` characters or more, cut at certain places only."""
        out, start, i = [], 0, size
        while i < len(text):
            if self.certain(text[i - 1], text[i]):
                out.append(text[start:i])
                start, i = i, i + size
            else:
                i += 1
        out.append(text[start:])
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; ``[]`` for null and empty. Strings of special tokens are ordinary text."""
        return list(chain.from_iterable(map(self.encoding.encode_ordinary, self.fragments(text, self.size)))) if text else []


def _pieces(keys: list, texts: list, chars: int = 1 << 22) -> Iterator[tuple[list, list]]:
    """Rows of a batch in runs of about so many characters, so that a batch of long texts isn't held as ids at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield keys[start:i + 1], texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield keys[start:], texts[start:]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, fragment: int = FRAGMENT) -> DataFrame:
    """(key, ids array<int>) of every row; an empty list where the text is null or empty.

    One pass, no shuffle: every text, long or short, is cut at certain places and its fragments are encoded where it
    lies, so rows stay rows whatever their length and however often their key (null too) occurs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ForcedEncoder(folder, vocabulary, fragment)
        for b in batches:
            for keys, texts in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lists = [enc.encode(t) for t in texts]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids], names=["key", "ids"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "key long, ids array<int>").select(F.col("key").alias(key), "ids")


def decoded_digests(coded: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_ids, digest) of each row of (key, ids): the MD5 of the bytes its tokens stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _load(folder, vocabulary)
        for b in batches:
            lists = b.column(1).to_pylist()
            digests = [hashlib.md5(own.decode_bytes(x)).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, lists)), pa.int64()), pa.array(digests, pa.string())], names=["key", "n_ids", "digest"])

    return coded.select(F.col(key).alias("key"), "ids").mapInArrow(run, "key long, n_ids long, digest string").withColumnRenamed("key", key)
