"""Byte-level BPE as a monoid: encode halves, join neighbours, decode by concatenation.

A segment is a text with its token ids. Segments of at most ``LEAF`` characters are encoded by
tiktoken; two neighbours are joined by encoding anew a window around their border, which grows until
both of its ends are places where the split pattern always cuts: a character that is not white space
before a blank or line break. No alternative of the pattern spans such a place or looks across it, so
whatever lies outside the window is final, and the join equals the encoding of the joined text. A text
without such places is encoded anew as a whole, which is the definition.

Edge cases: null counts as empty and has no ids. A text of any length is split into leaves; memory is
a small multiple of the longest text of an Arrow batch. Repeated rows are encoded each on its own.
Rows keep their other columns; a column with the output's name is replaced. An empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF, WINDOW = 4096, 32
RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(2)
def encoding(ranks_path: str):
    """The tiktoken encoding and the byte length of each id, once per Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("warraq", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths.tolist()


def _cuts(text: str, k: int) -> bool:
    """Whether every scan of the split pattern cuts before position k."""
    return text[k] in " \n\r\t" and not text[k - 1].isspace()


def _left_cut(text: str) -> tuple[int, int]:
    """The last certain cut in the smallest window at the end, as a position and a length in bytes."""
    w = WINDOW
    while w < len(text):
        for k in range(len(text) - 1, len(text) - w, -1):
            if _cuts(text, k):
                return k, len(text[k:].encode())
        w *= 2
    return 0, len(text.encode())


def _right_cut(text: str) -> tuple[int, int]:
    w = WINDOW
    while w < len(text):
        for k in range(1, w):
            if _cuts(text, k):
                return k, len(text[:k].encode())
        w *= 2
    return len(text), len(text.encode())


def join(left: str, left_ids: list[int], right: str, right_ids: list[int], enc, lengths: list[int]) -> list[int]:
    """Ids of ``left + right`` from the ids of both."""
    if not left or not right:
        return left_ids or right_ids
    a, n = _left_cut(left)
    b, m = _right_cut(right)
    i, j = len(left_ids), 0
    while n > 0:
        i -= 1
        n -= lengths[left_ids[i]]
    while m > 0:
        m -= lengths[right_ids[j]]
        j += 1
    return left_ids[:i] + enc.encode_ordinary(left[a:] + right[:b]) + right_ids[j:]


def encode_text(text: str, enc, lengths: list[int], leaf: int = LEAF) -> list[int]:
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return join(left, encode_text(left, enc, lengths, leaf), right, encode_text(right, enc, lengths, leaf), enc, lengths)


def decode_ids(ids, enc, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    half = len(ids) // 2
    return decode_ids(ids[:half], enc, leaf) + decode_ids(ids[half:], enc, leaf)


def _texts(column: pd.Series) -> Iterator[str]:
    return (x if isinstance(x, str) else "" for x in column)


def encode(df: DataFrame, text: str = "text", to: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """Adds ``to``: the ids as little-endian unsigned 32-bit integers, in binary."""
    path = ranks_path or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def ids(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc, lengths = encoding(path)
        for column in columns:
            yield pd.Series([np.array(encode_text(x, enc, lengths), "<u4").tobytes() for x in _texts(column)], dtype=object)

    return df.withColumn(to, ids(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """Adds ``to``: the bytes that ``ids`` stand for."""
    path = ranks_path or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def decoded(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc, _ = encoding(path)
        for column in columns:
            yield pd.Series([decode_ids(np.frombuffer(x or b"", "<u4").tolist(), enc) for x in column], dtype=object)

    return df.withColumn(to, decoded(F.col(ids)))


def round_trip(df: DataFrame, text: str = "text", ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: ``encode`` and ``decode`` in one
    pass, so that decoded bytes do not travel between Python and the JVM."""
    path = ranks_path or public_tokenizers.path(RANKS)
    out = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
    def digests(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc, lengths = encoding(path)
        for column in columns:
            rows = []
            for x in _texts(column):
                ids = encode_text(x, enc, lengths)
                packed = np.array(ids, "<u4").tobytes()
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decode_ids(ids, enc)).hexdigest(), packed)[: len(out)])
            yield pd.DataFrame(rows, columns=out)

    others = [F.col(c) for c in df.columns if c not in out]
    return df.withColumn("__digests", digests(F.col(text))).select(*others, *[F.col(f"__digests.{c}").alias(c) for c in out])


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
