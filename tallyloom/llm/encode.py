"""Encoding of texts with a public byte-level tokenizer, and decoding back.

The ranks come from a local file whose path is a parameter.  Long texts are cut
at positions that no match of the tokenizer's splitting pattern can span: behind
a run of letters, and before white space that follows other characters.  The
pieces are encoded in turn, so the ids are those of the whole text while memory
and the quadratic part of the merging stay bounded by the longest run of letters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published splitting pattern of the byte-level 50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\S)(?=\s)")
#: Characters of a piece, at least, before it may end.
PIECE = 20_000


def rank_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public tokenizers keep the rank file ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def load_encoding(path: str):
    """The encoding of a rank file, loaded once in a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at safe positions only."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(text: str | None, path: str) -> list[int]:
    """Ids of one text without special tokens; null and the empty text both give the empty list."""
    if not text:
        return []
    encoding = load_encoding(path)
    if len(text) <= PIECE:
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text) for i in encoding.encode_ordinary(piece)]


def decode_ids(ids: list[int] | None, path: str) -> str:
    """The text of ids by their raw bytes; bytes that are no UTF-8 (a cut list) become U+FFFD."""
    if ids is None or len(ids) == 0:
        return ""
    return load_encoding(path).decode_bytes([int(i) for i in ids]).decode("utf-8", errors="replace")


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, ids ARRAY<INT>``: one row for each row of ``df``, no shuffle.

    Null, empty: the empty list.  Blank texts have the ids of their blanks.  Strings of special
    tokens in a text are ordinary text.  Repeated rows and null keys are kept; extra columns are ignored.
    """
    path = path or rank_path()

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encode_text(t, path) for t in batch], dtype=object)

    return df.select(F.col(key), encoded(F.col(text)).alias("ids"))


def decode_all(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """``key, text``: the inverse of :func:`encode_texts`; null and empty lists give the empty text."""
    path = path or rank_path()

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([decode_ids(x, path) for x in batch], dtype=object)

    return df.select(F.col(key), decoded(F.col(ids)).alias("text"))
