"""Tokenizers behind a protocol: words parted by white space, or a byte-level BPE vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

#: Folder of vocabulary files in tiktoken's rank format.
FOLDER = os.environ.get("SILTRA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pre-tokenizer pattern of the 50k byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str = PATTERN) -> Tokenizer:
    """The vocabulary in ``path``, loaded once a worker; strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    class Own:
        encode = staticmethod(encoding.encode_ordinary)
        decode = staticmethod(encoding.decode)

    return Own()


def tokenizer(name: str, folder: str = FOLDER) -> Callable[[], Tokenizer] | None:
    """What makes the tokenizer of ``name`` in a worker: None for ``words``, which need no Python, else that of a file."""
    if name == "words":
        return None
    path = name if os.path.isabs(name) else os.path.join(folder, f"{name}.tiktoken")
    if not os.path.exists(path):
        raise ValueError(f"no vocabulary file {path}")
    return lambda: byte_bpe(path)
