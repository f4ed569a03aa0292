"""PPM scores against a plain, byte by byte model."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from noteloom.llm import ppm

TEXTS = ["the cat sat on the mat", "The CAT sat", "", None, "zzz qqq été the", "a", "the the the the", "cat\tmat\nsat   on"] * 4


class Plain:
    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            data = self.data(t)
            for i, b in enumerate(data):
                for k in range(min(i, ppm.ORDER) + 1):
                    self.seen[data[i - k : i]][b] += 1

    @staticmethod
    def data(t):
        return b" ".join((t or "").encode().lower().split()) + b"\xff"

    def score(self, t):
        data, total = self.data(t), 0.0
        for i, b in enumerate(data):
            out = set()
            for k in range(min(i, ppm.ORDER), -1, -1):
                seen = {s: c for s, c in self.seen[data[i - k : i]].items() if s not in out}
                n, d = sum(seen.values()), len(seen)
                if b in seen:
                    total += math.log10(seen[b] / (n + d))
                    break
                if d:
                    total += math.log10(d / (n + d))
                    out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 5


def expected(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, by definition."""
    train = [t for i, t, *_ in rows if fold(i) != 1]
    model, counts = Plain(train), Counter()
    for t in train:
        counts.update((t or "").encode().lower().split())
        counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        yield (i, fold(i) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 7), round(model.score(t), 7))


def check(got, rows):
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in got), key=key) == sorted(expected(rows), key=key)


@pytest.mark.parametrize(("common", "capacity"), [(1 << 20, 1 << 21), (2, 1 << 21), (1 << 20, 600), (3, 60), (0, 0)])
def test_scores(spark, common, capacity):
    """Whatever part of words and contexts the executors hold, the scores are those of the plain model."""
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "the cat", "x"), (3, "the cat", "x"), (None, "mat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    check(ppm.score_documents(docs, common=common, capacity=capacity).collect(), rows)


def test_across_stretches_pieces_and_flushes(spark, monkeypatch):
    """Long words and texts, in stretches of a few bytes, with tasks that pass on what they count all the time."""
    monkeypatch.setattr(ppm, "STEP", 37)
    monkeypatch.setattr(ppm, "PIECE_BYTES", 200)
    monkeypatch.setattr(ppm, "HELD", 50)
    r = random.Random(3)
    words = ["".join(r.choices("abcé", k=r.choice([1, 2, 5, 70, 150]))) for _ in range(12)]
    rows = [(i, r.choice(["", " ", "\n\t"]) + r.choice([" ", "  ", "\r\n"]).join(r.choices(words, k=r.randint(0, 40))) + r.choice(["", " "])) for i in range(40)] + [(40, "x" * 3000), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    check(ppm.score_documents(docs, capacity=300).collect(), rows)


def test_word_keys():
    words = [b"a", b"b", b"ab", b"ba", b"aa", b"a" * 63, b"a" * 64, b"a" * 65, b"a" * 200, b"a" * 199 + b"b", "\u00e9".encode(), b"A"]
    data, starts = ppm.sequence(pa.array([b" ".join(words), b"", None, b" b  a "], pa.binary()))
    assert data.tobytes() == b" ".join(words).lower() + b"\xff\xff\xffb a\xff"
    assert starts.tolist() == [0, len(data) - 6, len(data) - 5, len(data) - 4]
    keys, begin = ppm.word_keys(data)
    assert (keys < 0).all()
    assert keys[-4:].tolist() == [keys[-1]] * 4
    assert begin[-4:].tolist() == [len(data) - 7, len(data) - 6, len(data) - 5, len(data) - 1]
    n = len(words)
    assert len(set(keys[: n - 1].tolist())) == n - 1
    assert keys[n - 1] == keys[0] == keys[n + 1]
    assert keys[n] == keys[1]


def test_shared_arrays(spark, monkeypatch):
    """Workers see the same arrays from a mounted folder and from the driver's file server."""
    ppm.ensure_checkpoint_dir(spark)
    arrays = {"a": np.arange(1000), "b": np.array([1.5, 2.5], np.float32), "c": np.zeros(0, np.uint8)}
    for folder in (spark.sparkContext.getCheckpointDir(), "hdfs://nowhere/folder"):
        monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self, folder=folder: folder)
        shared = ppm.Shared(spark.sparkContext, arrays)
        assert bool(shared.mounted) == folder.startswith("file:")
        got = spark.sparkContext.parallelize(range(4), 4).map(lambda _: {k: v.tolist() for k, v in shared.open().items()}).collect()  # noqa: B023
        assert got == [{k: v.tolist() for k, v in arrays.items()}] * 4


def test_hash_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 50, 5000, np.int64)).view(np.uint64)
    held = ppm.table(keys, rng.integers(1, 9, len(keys)), {"v": np.arange(len(keys))})
    at = ppm.find(held["keys"], keys)
    assert held["v"][at].tolist() == list(range(len(keys)))
    assert (ppm.find(held["keys"], keys + np.uint64(1 << 51)) == -1).all()
    assert ppm.find(ppm.table(keys[:0], np.zeros(0), {})["keys"], keys[:3]).tolist() == [-1] * 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score_documents(docs).collect() == []
