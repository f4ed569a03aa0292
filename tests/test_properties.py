"""Properties over many generated inputs, each set in one Spark job."""
import datetime as dt
import random

import pytest
from noteloom.functions import extract as X
from noteloom.functions import text as D
from noteloom.functions import tokens as T
from noteloom.operators import incremental, lexical
from noteloom.sources import changelog
from pyspark.sql import functions as F

ALPHABET = ["a", "b", "Z", "M", "9", "1", "０", "é", "ß", "ı", "日", "本", "語", "カ", "ー", "ひ", " ", "  ", "\n", "\t", "　", "-", ".", "* ", "[x]:", "2025-01-02", "10:11:12", "🎉"]


def texts(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_driver_and_executor_tokens_agree(spark, seed):
    rows = spark.createDataFrame([(t,) for t in texts(seed)], "t string").select("t", T.tokens("t").alias("x"))
    for r in rows.collect():
        assert r.x == T.query_tokens(r.t), r.t
        assert len(set(r.x)) == len(r.x)


def test_two_texts_are_one_with_a_space(spark):
    pairs = list(zip(texts(5), texts(6)))
    rows = spark.createDataFrame(pairs, "a string, b string").select(T.tokens("a", "b").alias("x"), T.tokens(F.concat_ws(" ", "a", "b")).alias("y"))
    assert all(set(r.x) == set(r.y) for r in rows.collect())


def test_lines_trims_and_heads(spark):
    sample = texts(7)
    rows = spark.createDataFrame([(t,) for t in sample], "t string").select("t", D.line_count("t").alias("lines"), D.trim_unicode("t").alias("trimmed"), X.head("t", 7).alias("head"), X.full("t", 5).alias("full"))
    for r in rows.collect():
        assert r.lines == len(r.t.split("\n")) - (r.t.endswith("\n") or r.t == "")
        assert r.trimmed == r.t.strip()
        assert r.head.text == r.t[:7] and r.head.truncated == (len(r.t) > 7) and r.head.total_chars == len(r.t)
        assert r.full.text == r.t[:5] and r.full.extracted_chars == min(5, len(r.t))


def test_rendered_documents_parse_back(spark):
    r = random.Random(1)
    clean = lambda t: " ".join(t.replace("*", "").split()).replace("2025-01-02", "").strip() or "x"
    rows = []
    for k, t in enumerate(texts(9, 200)):
        body = "\n".join(clean(x) for x in (t, t[::-1], "tail"))
        rows.append((clean(t).replace("\n", " ").replace("[x]:", "").replace("10:11:12", "").strip() or "T", dt.datetime(2025, 1, 1) + dt.timedelta(minutes=k), r.choice([[], ["a"], ["a", "日本", "a"]]), body.strip(), k))
    docs = spark.createDataFrame(rows, "title string, date timestamp, tags array<string>, text string, doc_ord long").withColumn("id", D.content_hash("title", F.col("text")))
    lines = changelog.render(docs).select(F.col("doc_ord").cast("string").alias("file"), "value")
    back = changelog.parse(lines)
    columns = ["id", "title", "date", "tags", "text"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, docs.select(columns).collect()))


def test_results_do_not_depend_on_partitions(spark):
    rows = [(str(i), t[:5], dt.datetime(2025, 1, 1), [], t, i) for i, t in enumerate(texts(11))]
    docs = spark.createDataFrame(rows, "id string, title string, date timestamp, tags array<string>, text string, doc_ord long")
    found = []
    for frame in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_ord"))):
        index = lexical.build(frame)
        found.append([tuple(r) for r in lexical.search(index, "日本 a Z 9", 15).orderBy("rank").collect()])
        stored = lexical.LexicalIndex(index.postings, index.term_stats, index.corpus_stats)
        found.append([tuple(r) for r in lexical.search(stored, "日本 a Z 9", 15).orderBy("rank").collect()])
    assert all(f == found[0] for f in found) and len(found[0]) == 15
    assert not incremental.counts(incremental.diff(docs.repartition(3), incremental.hashes(docs))).first().has_changes


def test_analysers_and_chats_get_texts_in_slices(spark):
    """However long the batches, a task gives out what it has after a slice of texts."""
    from noteloom.functions import tokens as T
    from noteloom.operators import remote

    texts = spark.range(700).coalesce(1).select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    found = texts.select("id", T.morphological(lambda t: [(t, [T.KEPT_POS[0]])])("text").alias("t")).collect()
    assert sorted((r.id, r.t) for r in found) == [(k, [f"w{k}"]) for k in range(700)]
    content = F.struct("text", F.lit(1).cast("long").alias("total_chars"), F.lit(1).cast("long").alias("total_lines"))
    rows = remote.summarise(texts.select("id", content.alias("content")), lambda t: t + "!").collect()
    assert sorted((r.id, r.summary, r.summary_method) for r in rows) == [(k, f"w{k}!", "llm") for k in range(700)]
    assert T.SLICE < 700 and remote.SLICE < 700
