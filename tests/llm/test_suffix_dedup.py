"""Suffix-array dedup against a dictionary of all windows."""
import hashlib
import random

import numpy as np
import pytest
from noteloom.llm import suffix_dedup as sd


def brute(rows):
    seen, out = set(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - sd.LENGTH + 1):
            w = t[p : p + sd.LENGTH]
            if w in seen:
                gone[p : p + sd.LENGTH] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.setdefault(rows[i][0], []).append((len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passages = [text(k) for k in (18, 22, 25, 40, 120)] + ["x" * 99, "y" * 100, "z" * 260, "ab" * 90]
    line = "a common line that everybody repeats " * 2
    rows = []
    for i in range(n):
        t = text(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            p = r.choice([*passages, line])
            if r.random() < 0.3:
                p = p[r.randint(0, 20) : len(p) - r.randint(0, 20)]
            at = r.randint(0, len(t))
            t = t[:at] + p + t[at:]
        rows.append((i * 3 % n, t))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "short"), (n + 4, rows[5][1]), (n + 5, rows[5][1]), (None, rows[6][1]), (None, text(50))]
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_repeats_within_one_text(seed):
    r = np.random.default_rng(seed)
    data = r.integers(97, 99 + seed % 3, 3000).astype(np.uint8)
    for _ in range(6):
        a, b, n = r.integers(0, 2500, 2).tolist() + [int(r.integers(80, 400))]
        data[a : a + n] = data[b : b + n][: len(data[a : a + n])]
    if seed == 5:
        data[500:1500] = 97
    valid = np.zeros(len(data), bool)
    valid[: len(data) - 99] = True
    valid[1000:1100] = False
    got = sd.repeats_within(data, valid)
    seen = set()
    for p in np.flatnonzero(valid).tolist():
        w = data[p : p + 100].tobytes()
        assert got[p] == (w in seen), p
        seen.add(w)


@pytest.mark.parametrize(("seed", "shard_bytes", "hot", "premerged", "cells"), [(0, 4 << 20, 1000, 1 << 20, 24), (1, 4000, 1000, 1 << 20, 24), (2, 4000, 3, 300, 24), (3, 1500, 1, 1 << 20, 3), (4, 20000, 5, 0, 24)])
def test_whole_operator(spark, monkeypatch, seed, shard_bytes, hot, premerged, cells):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SALT_ROWS", 4)
    monkeypatch.setattr(sd, "PREMERGED", premerged)
    monkeypatch.setattr(sd, "CELL_BITS", cells)
    monkeypatch.setattr(sd, "PIECE_BYTES", 3000)
    monkeypatch.setattr(sd, "MERGED", 2000)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, uid string").repartition(3, "doc_id")
    got = {}
    for r in sd.remove_repeats(docs, shard_bytes).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    got = {k: sorted(v) for k, v in got.items()}
    # Of rows without an id either may count as the earlier one; they differ here.
    want = brute(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}


def test_shards_of_any_size(monkeypatch):
    """Shards too large for ranks and positions in one number are sorted alike."""
    data = np.random.default_rng(3).integers(97, 99, 3000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    w = sd.words(data)
    sa, new = sd.suffix_order(w)
    monkeypatch.setattr(sd, "PACK", 4)
    other, other_new = sd.suffix_order(w)
    # Within a group of equal ones the order is free.
    group = np.cumsum(new)
    assert np.array_equal(new, other_new)
    assert np.array_equal(sa[np.lexsort((sa, group))], other[np.lexsort((other, group))])


def test_a_passage_of_many_shards_leaves_a_task_once():
    """Equal runs of hot anchors, of many documents with one passage: the first one is left, and the others are repeats."""
    passage = bytes(np.random.default_rng(0).integers(97, 123, 107).astype(np.uint8))
    n = 500
    rows = sd.pa.table({"key": [1] * n, "hot": [True] * n, "home": range(n), "uid": range(n), "doc_id": range(n, 0, -1), "start": [10] * n, "text": sd.pa.array([passage] * (n - 1) + [passage[:-1] + b"!"], sd.pa.binary())})
    out = sd.premerged(rows.combine_chunks()).to_pylist()
    left = [r for r in out if r["text"] is not None]
    assert sorted((r["doc_id"], r["start"], r["text"]) for r in left) == [(1, 10, passage[:-1] + b"!"), (2, 10, passage)]
    gone = [r for r in out if r["text"] is None]
    assert sorted(r["doc_id"] for r in gone) == list(range(3, n + 1))
    assert {(r["start"], r["key"], r["hot"]) for r in gone} == {(10, 117, False)}
    alone = rows.slice(n - 2).combine_chunks()
    assert sd.premerged(alone).equals(alone)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
