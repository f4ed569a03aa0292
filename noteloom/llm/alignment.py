"""Which tokens of two tokenizers stand for the same bytes, and how often each pair of ids does, over the whole corpus.

Both tokenizers cut a text's bytes. A link is a pair of token occurrences whose byte ranges overlap; it is
one stretch between neighbouring ends of either side. A group ends where tokens of both sides end.

Pairs of ids are packed into one int64 (B's id above A's). Each partition counts its own by ``np.unique``;
these partial counts are sorted by range over all partitions, and runs of equal keys are summed as they go by. Every
range becomes one sorted shard of keys and counts in the shared folder, which tasks map into memory and search by
``np.searchsorted``. The driver sees a line for each shard and the highest count of each id of B: as much as the vocabulary, whatever the corpus.

Null and empty texts, and texts that either tokenizer doesn't give back byte for byte (such as those that hold U+2581), have
no tokens: zeros and an empty string. Repeated rows count once each. Very long texts are encoded in parts, cut before a space after something else, where neither
side has tokens across. An empty table gives no rows. Columns other than id and text are not read, whatever their names.
"""
from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut, ensure_checkpoint_dir, pieces, strings, worker_cache
from noteloom.sources.hadoop import Files

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Code points of a part of a long text, about; bytes of text encoded at a time; bytes of ids aligned at a time.
LONG, TEXT_BYTES, ID_BYTES = 100_000, 1 << 20, 1 << 20
#: Distinct pairs that a task holds before it passes their counts on.
HELD = 1 << 21
_CUT = re.compile(r"(?s)(?<=\S) (?=.)")


def _printable() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 for itself, other bytes from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def _in_rank_order(spec: dict) -> bool:
    """Whether a vocabulary file is byte-level BPE without additions, whose merges give ids in their order: then ranks say all."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not model["dropout"] and not model["ignore_merges"]
    halves = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return bool(plain) and all(model["vocab"]["".join(m)] == 256 + k for k, m in enumerate(halves))


_IDS = np.dtype("<u4")


class Pair:
    """Both tokenizers, with the bytes, lengths and decimal forms of their ids."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.encode_a = lambda text: self.a.encode(text, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        vocab, byte_of = self.a.get_vocab(), _printable()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        if _in_rank_order(spec):
            # The same vocabulary as ranks gives the same ids for every text, in a fifth of the time.
            special = {t["content"] for t in spec["added_tokens"]}
            ranks = {self.a_bytes[k]: k for token, k in vocab.items() if token not in special}
            self.encode_a = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in range(n)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = [f"{k}{end}" for size, ends in ((len(self.a_bytes), ",|"), (n, ",;")) for end in ends for k in range(size)]

    def encode(self, texts: list[str], long: int = LONG) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where a side's bytes are not those of a space and the text."""
        for text in texts:
            a, b, parts = [], [], _parts(text, long) if text else []
            for part in parts:
                a += self.encode_a(f" {part}")
                b += self.b.encode(part)
            whole = b"".join(b" " + part.encode() for part in parts)
            same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            yield tuple(np.array(side if same else [], _IDS) for side in (a, b))


def _parts(text: str, long: int) -> list[str]:
    """Parts of a text, which joined by single spaces are the text. No token holds a space behind another character, so none is lost at the seams."""
    parts, at = [], 0
    while len(text) - at > long:
        found = _CUT.search(text, at + long)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    return [*parts, text[at:]]


def pair(a_file: str, b_file: str) -> Pair:
    cache = worker_cache()
    if ("align", a_file, b_file) not in cache:
        cache["align", a_file, b_file] = Pair(a_file, b_file)
    return cache["align", a_file, b_file]


def encode(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, long: int = LONG) -> DataFrame:
    """doc_id and the ids of both tokenizers, four little-endian bytes each (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_file, b_file)
        for whole in batches:
            for batch in pieces(whole, 1, TEXT_BYTES):
                ids = [(a.tobytes(), b.tobytes()) for a, b in both.encode(strings(batch.column(1)), long)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in ids], pa.binary()) for k in (0, 1))], names=["doc_id", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, a binary, b binary")


class Aligned:
    """The links of a run of documents. Both sides cover the same bytes, so offsets over all documents in a row keep them apart."""

    def __init__(self, both: Pair, a_column: pa.Array, b_column: pa.Array):
        self.both = both
        (self.a, self.n_a), (self.b, self.n_b) = _ids(a_column), _ids(b_column)
        self.a_end, self.b_end = np.cumsum(both.a_len[self.a]), np.cumsum(both.b_len[self.b])
        # Ends are distinct within a side, so those that occur twice are common.
        ends = np.sort(np.concatenate([self.a_end, self.b_end]), kind="stable")
        twice = np.flatnonzero(ends[1:] == ends[:-1])
        self.common, self.ends = ends[twice], np.delete(ends, twice)
        self.keys = self.b[np.searchsorted(self.b_end, self.ends)] << 32 | self.a[np.searchsorted(self.a_end, self.ends)]
        at = np.concatenate([[0], self.a_end])[np.cumsum(self.n_a)]
        self.links_to, self.groups_to = np.searchsorted(self.ends, at, "right"), np.searchsorted(self.common, at, "right")

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document."""
        a_to, b_to = np.searchsorted(self.a_end, self.common, "right"), np.searchsorted(self.b_end, self.common, "right")
        order = np.zeros(len(self.a) + len(self.b), np.int64)
        ga, gb = np.searchsorted(self.common, self.a_end), np.searchsorted(self.common, self.b_end)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[a_to - 1] = last_b[b_to - 1] = True
        size_a, size_b = len(self.both.a_bytes), len(self.both.b_bytes)
        order[np.arange(len(self.a)) + np.concatenate([[0], b_to])[ga]] = self.a + size_a * last_a
        order[np.arange(len(self.b)) + a_to[gb]] = 2 * size_a + self.b + size_b * last_b
        words, at, out = order.tolist(), 0, []
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(map(self.both.names.__getitem__, words[at : at + n]))[:-1])
            at += n
        return out


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(values), _IDS).astype(np.int64), np.array([len(x) // _IDS.itemsize for x in values], np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal keys as one each, with the sums of their counts."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def partial_counts(encoded: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, held: int = HELD) -> DataFrame:
    """(key, n): counts of packed pairs, each key once or a few times for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, none = pair(a_file, b_file), np.zeros(0, np.int64)
        keys, counts, waiting, n = none, none, [], 0

        def merged():
            new = np.unique(np.concatenate([none, *waiting]), return_counts=True)
            k, c = np.concatenate([keys, new[0]]), np.concatenate([counts, new[1]])
            order = np.argsort(k, kind="stable")
            return summed(k[order], c[order])

        def out(keys, counts):
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], names=["key", "n"])

        for whole in batches:
            for batch in pieces(whole, 0, ID_BYTES):
                waiting.append(Aligned(both, batch.column(0), batch.column(1)).keys)
                n += len(waiting[-1])
                if n > held:
                    keys, counts = merged()
                    waiting, n = [], 0
                    if len(keys) > held:
                        yield from out(keys, counts)
                        keys, counts = none, none
        yield from out(*merged())

    return encoded.select("a", "b").mapInArrow(run, "key long, n long")


@dataclass
class Counts:
    """Sorted count shards: their folder, names, first keys and lengths, and for each id of B its highest count."""

    folder: str
    names: list[str]
    first: np.ndarray
    sizes: list[int]
    best: np.ndarray

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of a shard, mapped into memory once for each worker."""
        cache = worker_cache()
        if cache.get("align-folder") != self.folder:
            cache["align-folder"], cache["align-shards"] = self.folder, {}
        opened = cache["align-shards"]
        if k not in opened:
            opened[k] = tuple(_mapped(f"{self.folder}/{self.names[k]}.{what}", self.sizes[k]) for what in ("keys", "counts"))
        return opened[k]

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys; zero for those that are in no shard."""
        out = np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.first, keys, "right") - 1
        for k in np.unique(at[at >= 0]).tolist():
            low, high = np.searchsorted(at, [k, k + 1])
            have, counts = self.shard(k)
            place = np.minimum(np.searchsorted(have, keys[low:high]), len(have) - 1)
            out[low:high] = np.where(have[place] == keys[low:high], counts[place], 0)
        return out


def _mapped(uri: str, n: int) -> np.ndarray:
    """A file of int64 mapped into memory: in place where its folder is mounted, else a nameless copy on the worker's disk."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, np.int64, "r", shape=(n,))
    with tempfile.TemporaryFile() as copy:
        with fs.open_input_stream(path) as stream:
            shutil.copyfileobj(stream, copy, 1 << 22)
        copy.flush()
        return np.memmap(copy, np.int64, "r", shape=(n,))


def count_shards(partial: DataFrame, folder: str, size_b: int) -> Counts:
    """Partial counts as sorted shards in ``folder``. A shard has the name of the attempt that wrote it, so a task that runs again never meets its other files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best, n, first = uuid.uuid4().hex, np.zeros(size_b, np.int64), 0, 0
        last = (np.zeros(0, np.int64),) * 2
        fs, path = pa.fs.FileSystem.from_uri(f"{folder}/{name}")
        with fs.open_output_stream(f"{path}.keys") as keys_file, fs.open_output_stream(f"{path}.counts") as counts_file:

            def put(keys, counts):
                nonlocal n, first
                if len(keys):
                    first = first if n else int(keys[0])
                    n += len(keys)
                    np.maximum.at(best, keys >> 32, counts)
                    keys_file.write(keys.tobytes())
                    counts_file.write(counts.tobytes())

            for batch in batches:
                keys, counts = summed(*(np.concatenate([old, new.to_numpy(zero_copy_only=False)]) for old, new in zip(last, batch.columns)))
                put(keys[:-1], counts[:-1])
                last = keys[-1:], counts[-1:]  # its run may go on in the next batch
            put(*last)
        if n:
            have = np.flatnonzero(best)
            yield pa.RecordBatch.from_pydict({"name": [name], "first": [first], "n": [n], "b": [have.tolist()], "most": [best[have].tolist()]})

    schema = "name string, first long, n long, b array<long>, most array<long>"
    rows = partial.select("key", "n").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: r.first)
    best = np.zeros(size_b, np.int64)
    for r in rows:
        np.maximum.at(best, np.array(r.b, np.int64), np.array(r.most, np.int64))
    return Counts(folder, [r.name for r in rows], np.array([r.first for r in rows], np.int64), [r.n for r in rows], best)


def alignments(encoded: DataFrame, counts: Counts, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups themselves."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_file, b_file)
        for whole in batches:
            for batch in pieces(whole, 1, ID_BYTES):
                x = Aligned(both, batch.column(1), batch.column(2))
                keys, back = np.unique(x.keys, return_inverse=True)
                n = counts.lookup(keys)
                best = n == counts.best[keys >> 32]
                sums = [np.diff(np.concatenate([[0], np.cumsum(v[back], dtype=np.int64)])[x.links_to], prepend=0) for v in (best, n)]
                columns = [x.n_a, x.n_b, np.diff(x.groups_to, prepend=0), np.diff(x.links_to, prepend=0), *sums]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(x.groups(), pa.string())], names=names)

    return encoded.select("doc_id", "a", "b").mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", groups string")


def align_digests(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, long: int = LONG) -> DataFrame:
    """The alignment of every document with the corpus-wide counts of its links, the groups as a digest.

    Ids are written once in the shared folder and read twice; they and the shards go when the rows are there.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/align-{uuid.uuid4().hex}"
    try:
        encode(docs, a_file, b_file, long).write.parquet(f"{folder}/ids")
        ids = spark.read.parquet(f"{folder}/ids")
        partial_counts(ids, a_file, b_file).write.parquet(f"{folder}/partial")
        files = Files(spark, f"{folder}/shards")
        files.fs.mkdirs(files.path(files.root))
        counts = count_shards(spark.read.parquet(f"{folder}/partial"), f"{folder}/shards", len(pair(a_file, b_file).b_bytes))
        found = alignments(ids, counts, a_file, b_file)
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
        return cut(found.select(*(c for c in found.columns if c != "groups"), digest))
    finally:
        Files(spark, folder).delete("")
