"""The corpus pipeline against its stages' plain versions."""
import corpus_pipeline
from noteloom.llm import bpe, decontaminate, pii, quality_rules

from .test_simhash import jaccard

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "the benchmark holds exactly these words and no others for a test of leaks"


def clean(seed, n=70):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 1009}" for i in range(n))


def test_run(spark, tmp_path):
    rows = [(i, clean(i)) for i in range(12)]
    rows += [(20, clean(3)), (21, clean(4) + " tail"), (22, "short"), (23, None), (24, "a b c " * 60), (25, clean(50) + " " + PASSAGE.upper() + " " + clean(51)), (26, clean(60) + " mail me@x.example now"), (27, "### " * 80), (5, clean(5))]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in rows if quality_rules.passes(quality_rules.Facts(r[1] or ""), quality_rules.RULES)]
    kept = [r for r in kept if not any(o[0] < r[0] and jaccard(o[1], r[1]) >= 0.8 for o in kept)]
    index = decontaminate.Index([(1, PASSAGE)])
    kept = [r for r in kept if not index.search([r[1]])]
    codec = bpe.Codec(bpe.RANKS, bpe.PATTERN)
    model = pii.Field.fit()
    want = []
    for r in kept:
        ids = codec.encode(pii.mask(r[1], *pii.find([r[1]], model)[0]))
        want.append((r[0], r[2], r[3], len(ids), ids))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == sorted(want)
    assert {r[0] for r in got} == {*range(12), 26} 
    assert "[EMAIL]" in codec.decode(next(r[4] for r in got if r[0] == 26)).decode()


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect() == []
