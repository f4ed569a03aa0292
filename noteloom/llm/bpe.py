"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut where no match of the pattern can cross: before white space
that follows something else. Between pieces nothing is merged or lost, so the
ids are those of the whole text. Decoding joins the raw bytes of the ids.

Null and empty texts give no ids. Repeated rows are encoded each on its own. Texts of any length are
encoded whole, in time about proportional. An empty table gives no rows. ``bpe_encode`` passes id, language and source on, where
there are such columns; others are not read, whatever their names.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import pieces, strings, worker_cache

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Code points of a piece of a long text, about.
LONG = 200_000
PIECE_BYTES = 4 << 20
#: White space as Unicode has it; Python's own class holds four more characters.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


class Codec:
    """An encoding, with its ids also as decimal strings."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(k) for k in range(self.size)]

    def encode(self, text: str, long: int = LONG) -> list[int]:
        ids: list[int] = []
        for part in cut_safely(text, long):
            ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def cut_safely(text: str, long: int) -> list[str]:
    """Parts of ``text`` that concatenate to it, cut at safe boundaries only; a stretch without any stays whole."""
    parts, at = [], 0
    while len(text) - at > long:
        found = _SAFE.search(text, at + long)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def codec(ranks_path: str, pattern: str) -> Codec:
    cache = worker_cache()
    key = ("bpe", ranks_path, pattern)
    if key not in cache:
        cache[key] = Codec(ranks_path, pattern)
    return cache[key]


def bpe_digests(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """One row per document: number of ids, digests of the ids and of the decoded bytes."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_BYTES):
                n, ids_hash, back_hash = [], [], []
                for text in strings(batch.column(1)):
                    ids = c.encode(text)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(" ".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest())
                    back_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Documents with their ids in place of their text: doc_id, lang, source, n_tokens and ids. Language and source are null where there is no such column."""
    own = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for whole in batches:
            for batch in pieces(whole, 3, PIECE_BYTES):
                ids = [c.encode(t) for t in strings(batch.column(3))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "lang", "source", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), *own, F.col("text").cast("string")).mapInArrow(encode, "doc_id long, lang string, source string, n_tokens long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id and the raw bytes that its ids stand for; null ids give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, bytes binary")
