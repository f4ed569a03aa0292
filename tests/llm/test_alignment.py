"""Cross-tokenizer alignment against a version without arrays."""
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from noteloom.llm import alignment

ROWS = [
    (1, "The quick brown fox isn't here."), (2, ""), (3, None), (4, "  two  spaces\n\nand lines \t tab "), (5, "naïve café, 東京タワー 🙂 ½"), (6, "holds ▁ the mark"), (7, "<|endoftext|> and <s> </s> <0x41>"),
    (8, "The quick brown fox isn't here."), (8, "same id again"), (None, "no id"), (9, "x"), (10, " "), (11, "a\x00b\x7f"), (12, "\n"), (13, "aaaaaaaaaa " * 60 + "end"), (14, "ﬁ ligature é combining"), (15, "words after a space ́mark"),
]


def plain(rows):
    """The contract word by word: byte ranges, all pairs that overlap, counts over the corpus."""
    both = alignment.Pair(alignment.A_FILE, alignment.B_FILE)
    parsed = []
    for doc_id, text in rows:
        a = b = []
        if text:
            a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
            whole = (" " + text).encode()
            if b"".join(both.a_bytes[k] for k in a) != whole or b"".join(both.b_bytes[k] for k in b) != whole:
                a = b = []
        spans = []
        for ids, table in ((a, both.a_bytes), (b, both.b_bytes)):
            at, out = 0, []
            for k in ids:
                out.append((k, at, at + len(table[k])))
                at += len(table[k])
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = [(low, high) for low, high in zip([0, *ends], ends)]
        text_of = ";".join("|".join(",".join(str(x[0]) for x in side if low < x[2] <= high) for side in spans) for low, high in groups)
        parsed.append((doc_id, len(a), len(b), len(groups), links, text_of))
    counts = Counter(link for row in parsed for link in row[4])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        ((doc_id if doc_id is not None else -1, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(t.encode()).hexdigest() if t else "") for doc_id, na, nb, ng, links, t in parsed)
    )


def got(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert frame.columns == names
    return sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in frame.collect())


def test_equals_plain_version(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' AS a", "1 AS key", "2 AS n").repartition(3)
    assert got(alignment.align_digests(docs)) == plain(ROWS)
    dropped = [r for r in plain(ROWS) if r[0] in (2, 3, 6)]
    assert [r[1:] for r in dropped] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_parts_of_long_texts_change_nothing(spark):
    text = "Some wörds, a  double space\nand a line.  Then 東京 (東) more " * 40
    rows = [(1, text), (2, text.replace(" ", "")), (3, "ends in a space after this " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(alignment.align_digests(docs, long=50)) == plain(rows)


def test_empty_table(spark):
    assert alignment.align_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents_of_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    assert got(alignment.align_digests(docs)) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_counts_flushed_early_and_sharded(spark, tmp_path):
    """Partial counts that leave a task several times, and keys whose runs cross batches and shards, give the same sums."""
    docs = spark.createDataFrame([(k, r[1]) for k, r in enumerate(ROWS * 3)], "doc_id long, text string").repartition(4)
    ids = alignment.encode(docs).cache()
    partial = alignment.partial_counts(ids, held=5).cache()
    assert partial.count() > partial.select("key").distinct().count()
    (tmp_path / "s").mkdir()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        counts = alignment.count_shards(partial, f"file:{tmp_path}/s", 32000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums = {r.key: r.s for r in partial.groupBy("key").sum("n").withColumnRenamed("sum(n)", "s").collect()}
    keys = np.array(sorted([*sums, 5, 1 << 60]), np.int64)
    assert counts.lookup(keys).tolist() == [sums.get(k, 0) for k in keys.tolist()]
    assert sum(counts.sizes) == len(sums) and counts.lookup(np.zeros(0, np.int64)).tolist() == []
    assert counts.best.tolist() == [max((n for k, n in sums.items() if k >> 32 == b), default=0) for b in range(32000)]


def test_shards_from_a_store_that_is_not_mounted(monkeypatch, tmp_path):
    """Where the shared folder is no local one, a worker maps a copy of the shard."""
    np.arange(5, dtype=np.int64).tofile(tmp_path / "x")
    fs = pa.fs.SubTreeFileSystem(str(tmp_path), pa.fs.LocalFileSystem())
    monkeypatch.setattr(alignment.pa.fs, "FileSystem", type("Stub", (), {"from_uri": staticmethod(lambda uri: (fs, "x"))}))
    assert alignment._mapped("store://x", 5).tolist() == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "é", "東", "1", "99", ",", "'s", "🙂", "▁", " ", "\t", "<s>"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(alignment.align_digests(docs, long=8)) == plain(rows)


def test_ranks_give_the_ids_of_the_vocabulary_file():
    """One in eleven of all characters, in words, among digits, alone and doubled; special tokens are plain text."""
    both = alignment.Pair(alignment.A_FILE, alignment.B_FILE)
    marks = [chr(c) for c in range(0, 0x110000, 11) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a 1{c}1 {c}.  {c} x {c}{c}!" for c in marks] + ["<|endoftext|> it's  x\n\n y\t"]
    assert all(both.encode_a(t) == e.ids for t, e in zip(texts, both.a.encode_batch_fast(texts, add_special_tokens=False)))
    assert both.encode_a != both.a.encode
