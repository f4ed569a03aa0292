"""Language identification against a plain parse, and its accuracy on languages it was not taught the documents of."""
import random
import zlib

import numpy as np
import pytest

from noteloom.llm import crossparse
from pyspark.sql import functions as F


def plain(known: bytes, text: bytes, stretch: int = crossparse.STRETCH) -> int:
    """Phrases by search in the labelled text itself."""
    n = 0
    for low in range(0, len(text), stretch):
        part, at = text[low : low + stretch], 0
        while at < len(part):
            to = at + 1
            while to < len(part) and part[at : to + 1] in known:
                to += 1
            n, at = n + 1, to
    return n


@pytest.mark.parametrize("seed", range(6))
def test_phrases_are_those_of_a_plain_search(seed):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcé d"[: 2 + seed]) for _ in range(n)).encode() for n in (300, 7, 0)]
    texts = ["".join(rng.choice("abcé dx") for _ in range(rng.choice((0, 1, 5, 400, 1500)))) for _ in range(30)] + [known[0].decode(errors="ignore")]
    learned = [crossparse.automaton(k) for k in known]
    found = crossparse.costs(learned, texts)
    want = np.array([[plain(k, t.encode()) * np.log2(len(k) + 256) for k in known] for t in texts])
    assert np.allclose(found, want)


def test_all_substrings_and_no_others():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abc") for _ in range(60))
    made = crossparse.automaton(text)

    def has(part):
        state = 1
        for b in part:
            c = made.classes[b]
            state = (made.to[state] if made.only[state] == c else 0) if made.only[state] >= 0 else made.table[made.to[state] + c]
            if not state:
                return False
        return True

    for n in range(1, 8):
        for _ in range(40):
            part = bytes(rng.choice(b"abcd") for _ in range(n))
            assert has(part) == (part in text)
    assert has(text) and not has(text + b"a")


def test_edges(spark):
    rows = [(k, t, l) for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("the house of the man", "en"), ("das Haus und der Mann", "de")] * 6)]
    rows += [(100, None, "en"), (101, "", "de"), (102, " 12 ½ _ !", "en"), (103, "the man", None), (104, "東京", None), (None, "der Mann", None), (105, "und der " * 30_000, None), (103, "the man", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1.0 AS score", "'x' AS lang_pred", "2 AS cost")
    out = crossparse.identify(docs, docs)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    found = {}
    for r in out.collect():
        found.setdefault(r.doc_id, []).append(r)
    assert all(r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, rs in found.items() for r in rs)
    assert [(found[k][0].lang_pred, found[k][0].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in found[103]] == ["en", "en"] and found[None][0].lang_pred == "de" and found[105][0].lang_pred == "de"
    assert found[104][0].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for rs in found.values() for r in rs)
    assert sum(len(rs) for rs in found.values()) == len(rows)


def test_nothing_learned_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a text", None), (6, "another", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in crossparse.identify(docs, docs).collect()] == [("und", 0.0)] * 2
    assert crossparse.identify(docs.limit(0), docs.limit(0)).collect() == []


def test_held_out_labels_teach_nothing(spark):
    """A language that only held-out rows have is never predicted."""
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    docs = spark.createDataFrame([(k, "zzz yyy xxx" if k in held else "the cat sat", "zz" if k in held else "en") for k in range(200)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in crossparse.identify(docs, docs).collect()} == {"en"}


def test_a_small_language_does_not_win_by_being_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    tiny = spark.createDataFrame([(9_000_000 + k, "qu", "xx") for k in range(5)], docs.schema)
    found = crossparse.identify(docs, docs.unionByName(tiny)).where("lang_pred = 'xx'")
    assert found.count() == 0


def test_sample_is_bounded_and_without_copies(spark):
    rows = [(k, "one text copied often", "en") for k in range(3000)] + [(5000 + k, f"text number {'abcdefghij'[k % 10] * (k % 40 + 1)} {k}", "en") for k in range(3000)]
    known = crossparse.labelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    drawn = crossparse.sample(known, crossparse.sizes_of(known), rows=50)
    assert drawn.count() == 50 == drawn.select("text").distinct().count()


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = crossparse.identify(docs, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97, (right, n)
