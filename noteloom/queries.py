"""Every operator as a query over the driver's tables, with SQL that gives the same rows."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom import api, corpus
from noteloom.functions import extract as X
from noteloom.functions import text as D
from noteloom.functions import tokens as T
from noteloom.operators import cache, docstore, fusion, incremental, lexical, remote, telemetry, vector
from noteloom.plans import build, vector_lists
from noteloom.plans import searcher as S
from noteloom.plans.store import Stored
from noteloom.sources import changelog, files, index_files, jsonl, lines
from noteloom.sources.hadoop import shared_folder

QUERY, SECOND, TAG = "the thion src3", "erth ANDOF src11", "en"
K = 10
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# ---- SQL that several queries share -------------------------------------------------
_DOCS = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang || ' / ' || source AS title, [lang, source] AS tags,
  TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS date, text, doc_id AS doc_ord FROM documents)"""
_CAMEL = r"string_split(regexp_replace(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), ' ')"


def _tokens(text: str) -> str:
    return rf"""list_distinct(list_concat(flatten(list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9]*'),
      lambda w: list_concat([upper(w)], list_transform({_CAMEL}, lambda p: upper(p))))), regexp_extract_all({text}, '\p{{Nd}}+')))"""


_TOKENS = f"{_DOCS}, toks AS (SELECT id, doc_ord, {_tokens("title || ' ' || text")} AS toks FROM docs)"
_POSTINGS = f"""{_TOKENS}, postings AS (SELECT unnest(toks) AS term, doc_ord, id AS doc_id, 1 AS tf, len(toks) AS dl FROM toks),
  term_stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  corpus AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM toks)"""
_TERM = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _terms(query: str) -> str:
    return ", ".join(f"'{t}'" for t in T.query_tokens(query))


def _bm25(query: str, k: int, name: str = "bm25") -> str:
    return f"""{name} AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_ord) AS INTEGER) AS rank, doc_ord, doc_id, score FROM (
    SELECT doc_ord, doc_id, round(sum({_TERM}), 6) AS score FROM postings JOIN term_stats USING (term), corpus WHERE term IN ({_terms(query)}) GROUP BY doc_ord, doc_id)
    WHERE score > 0 ORDER BY score DESC, doc_ord LIMIT {k})"""


def _cosine(k: int, name: str = "vec", source: str = "embeddings") -> str:
    return f"""{name} AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_ord) AS INTEGER) AS rank, doc_ord, doc_id, score FROM (
    SELECT vec_id AS doc_ord, CAST(vec_id AS VARCHAR) AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM {source})
    WHERE score > 0 ORDER BY score DESC, doc_ord LIMIT {k})"""


def _fused(k: int, top: int | None = None) -> str:
    limit = "" if top is None else f" ORDER BY score DESC, doc_id LIMIT {top}"
    return f"""fused AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM (
    SELECT doc_id, round(sum(1.0::DOUBLE / ({k} + rank)), 6) AS score FROM (SELECT rank, doc_id FROM bm25 UNION ALL SELECT rank, doc_id FROM vec) GROUP BY doc_id{limit}))"""


_OLD = f"""{_DOCS}, new AS (SELECT id, doc_ord, left(sha256(title || chr(0) || text), 16) AS h FROM docs),
  old AS (SELECT id, left(sha256(title || chr(0) || CASE WHEN doc_ord % 7 = 0 THEN text || ' (old)' ELSE text END), 16) AS h FROM docs WHERE doc_ord % 10 <> 0
    UNION ALL SELECT 'gone-' || id, left(sha256(title || chr(0) || text), 16) FROM docs WHERE doc_ord % 20 = 1),
  diff AS (SELECT coalesce(new.id, old.id) AS id, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' WHEN new.h = old.h THEN 'unchanged' ELSE 'modified' END AS status
    FROM new FULL OUTER JOIN old ON new.id = old.id)"""
_LINES = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, chr(10))) - CASE WHEN ends_with({0}, chr(10)) THEN 1 ELSE 0 END END"
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


_CALLS = """calls AS (SELECT event_id, ts, event_type <> 'error' AS ok, user_id % 500 AS prompt, user_id % 90 AS completion, value AS latency,
  CASE WHEN event_type = 'error' THEN ['Network', 'Authentication', 'RateLimit', 'ParseError', 'Timeout'][CAST(event_id % 5 AS INTEGER) + 1] END AS category FROM events)"""
_CACHE = """log AS (SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS key, event_type AS cache, ts FROM events),
  now AS (SELECT max(ts) AS t FROM events),
  latest AS (SELECT key, cache, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM log GROUP BY key, cache)"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _index(spark, d) -> lexical.LexicalIndex:
    return lexical.build(corpus.documents(spark, d))


def _searcher(spark, d) -> S.Searcher:
    return S.Searcher(corpus.documents(spark, d), _index(spark, d), corpus.vectors(spark, d))


# ---- lexical ------------------------------------------------------------------------
@query(f"WITH {_POSTINGS}, {_bm25(QUERY, K)} SELECT * FROM bm25")
def bm25_topk(spark, d):
    return lexical.search(_index(spark, d), QUERY, K)


def _multi_sql() -> str:
    queries = [(0, QUERY), (1, SECOND), (2, "99 AT"), (3, "")]
    terms = ", ".join(f"({i}, '{t}')" for i, q in queries for t in T.query_tokens(q))
    return f"""WITH {_POSTINGS}, q AS (SELECT * FROM (VALUES {terms}) v(query_id, term)),
      s AS (SELECT query_id, doc_ord, doc_id, round(sum({_TERM}), 6) AS score FROM q JOIN postings USING (term) JOIN term_stats USING (term), corpus GROUP BY ALL)
      SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord) AS INTEGER) AS rank, doc_ord, doc_id, score FROM s) WHERE rank <= {K}"""


@query(_multi_sql())
def bm25_topk_multi(spark, d):
    queries = spark.createDataFrame([(0, QUERY), (1, SECOND), (2, "99 AT"), (3, "")], "query_id int, query string")
    return lexical.search_many(_index(spark, d), queries, K)


@query(f"WITH {_POSTINGS}, {_bm25(QUERY, K)} SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, doc_id, score FROM bm25 JOIN docs ON docs.id = doc_id WHERE list_contains(docs.tags, '{TAG}')")
def bm25_tag_postfilter(spark, d):
    s = _searcher(spark, d)
    return S.tag_filter(s.bm25(QUERY, K).select("rank", "doc_id", "score"), s.docs, TAG)


@query(f"WITH {_POSTINGS} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM term_stats, corpus")
def term_stats(spark, d):
    index = _index(spark, d)
    return index.term_stats.crossJoin(F.broadcast(index.corpus_stats)).select("term", "df", F.round(lexical.idf("n_docs", "df"), 6).alias("idf"))


@query(f"WITH {_POSTINGS} SELECT id AS doc_id, CAST(len(toks) AS BIGINT) AS dl FROM toks")
def doc_lengths(spark, d):
    return lexical.tokenised(corpus.documents(spark, d)).select("doc_id", F.size("tokens").cast("long").alias("dl"))


@query(f"WITH {_POSTINGS} SELECT n AS n_docs, round(avgdl, 6) AS avg_dl, (SELECT count(*) FROM term_stats) AS n_terms, n = 0 AS is_empty FROM corpus")
def corpus_stats(spark, d):
    return lexical.statistics(_index(spark, d))


@query(f"WITH {_TOKENS} SELECT id, array_to_string(list_sort(toks), ' ') AS tokens FROM toks")
def tokens_latin(spark, d):
    return lexical.tokenised(corpus.documents(spark, d)).select(F.col("doc_id").alias("id"), F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


@query(f"SELECT w AS word, array_to_string({_CAMEL}, '+') AS parts FROM (SELECT 'McpServer' || p_brand || 'x' || CAST(p_size AS VARCHAR) || replace(p_name, ' ', '') AS w FROM part)")
def camel_split(spark, d):
    w = corpus.table(spark, d, "part").select(F.concat(F.lit("McpServer"), "p_brand", F.lit("x"), F.col("p_size").cast("string"), F.replace("p_name", F.lit(" "), F.lit(""))).alias("word"))
    return w.select("word", F.array_join(T.split_camel("word"), "+").alias("parts"))


def _stub_morphemes(text: str) -> list[tuple[str, list[str]]]:
    """Words as morphemes, their details by their lengths."""
    pos = (*T.KEPT_POS, "other")
    return [(w, [pos[len(w) % 5], T.DROPPED_DETAILS[0] if len(w) % 7 == 0 else "plain", "*", "*", "*", "*", w + "_" if len(w) % 3 == 0 else "*"]) for w in text.split(" ") if w]


@query(f"""WITH {_DOCS}, w AS (SELECT id, list_filter(string_split(text, ' '), lambda w: w <> '' AND len(w) % 5 <> 4 AND len(w) % 7 <> 0) AS w FROM docs)
  SELECT id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(list_transform(w, lambda w: CASE WHEN len(w) % 3 = 0 THEN w || '_' ELSE w END), ' ') AS tokens FROM w""")
def morphological_tokens(spark, d):
    """Tokens by an analyser that is passed in: which morphemes count, in which form, repeats kept."""
    found = T.morphological(_stub_morphemes)("text")
    return corpus.documents(spark, d).select("id", found.alias("t")).select("id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"WITH {_POSTINGS} SELECT term, doc_ord, doc_id, CAST(tf AS BIGINT) AS tf, CAST(dl AS BIGINT) AS dl FROM postings")
def postings(spark, d):
    return _index(spark, d).postings


@query(f"WITH {_POSTINGS}, s AS (SELECT doc_ord, doc_id, sum({_TERM}) AS score FROM postings JOIN term_stats USING (term), corpus WHERE term IN ({_terms(SECOND)}) GROUP BY doc_ord, doc_id) SELECT doc_id, round(score, 6) AS score FROM s")
def bm25_scores(spark, d):
    return lexical.scores(_index(spark, d), T.query_tokens(SECOND)).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_POSTINGS} SELECT doc_id, term, round({_TERM}, 6) AS term_score FROM postings JOIN term_stats USING (term), corpus WHERE term IN ({_terms(QUERY)})")
def bm25_term_scores(spark, d):
    index = _index(spark, d)
    wanted = F.col("term").isin(T.query_tokens(QUERY))
    return index.postings.where(wanted).join(index.term_stats.where(wanted).crossJoin(index.corpus_stats), "term").select("doc_id", "term", F.round(lexical.term_score(), 6).alias("term_score"))


@query(f"WITH {_POSTINGS}, {_bm25(QUERY, K)} SELECT 0 AS n_empty, count(*) AS n_found FROM bm25")
def bm25_empty_query(spark, d):
    """A query without tokens finds nothing, where another one does."""
    n = lambda q, c: lexical.search(_index(spark, d), q, K).agg(F.count(F.lit(1)).alias(c))
    return n(" . ", "n_empty").select(F.col("n_empty").cast("int")).crossJoin(n(QUERY, "n_found"))


_LEGACY = """toks AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS toks FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM toks) GROUP BY ALL)"""


def _legacy(spark, d) -> lexical.LexicalIndex:
    docs = corpus.table(spark, d, "documents")
    return lexical.from_tokens(docs.select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_id"), F.filter(F.split(F.lower("text"), " "), lambda w: w != "").alias("tokens")))


@query(f"WITH {_LEGACY} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(max(tf) AS BIGINT) AS max_tf, CAST(sum(tf) AS BIGINT) AS dl, count(*) AS n_terms FROM tf GROUP BY doc_id")
def legacy_corpus_stats(spark, d):
    return _legacy(spark, d).postings.groupBy("doc_id").agg(F.max("tf").alias("max_tf"), F.max("dl").alias("dl"), F.count(F.lit(1)).alias("n_terms"))


@query("""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, conv_id, string_split(string_agg(role, ' ' ORDER BY turn), ' ') AS toks FROM conversations GROUP BY conv_id)
  SELECT doc_id, term, count(*) AS tf, CAST(any_value(n) AS BIGINT) AS dl FROM (SELECT doc_id, len(toks) AS n, unnest(toks) AS term FROM c) GROUP BY doc_id, term""")
def legacy_reader(spark, d):
    c = corpus.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    rows = c.select(F.array(F.col("conv_id").cast("string")).alias("doc_ids"), F.array(F.transform("r", lambda x: x["role"])).alias("corpus"))
    return index_files.legacy_bm25(rows).postings.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))


# ---- vectors and fusion -------------------------------------------------------------
@query(f"WITH {_cosine(K)} SELECT * FROM vec")
def cosine_topk(spark, d):
    return vector.search(corpus.vectors(spark, d), corpus.query_vector(spark, d), K)


_MANY = f"""q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
  many AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, CAST(vec_id AS VARCHAR) AS doc_id, score
    FROM (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 6) AS score FROM q, embeddings) WHERE score > 0) WHERE rank <= {K})"""


def _asked(spark, d):
    """Every vector whose id is divisible by 20, as a query."""
    return corpus.vectors(spark, d).where("doc_ord % 20 = 0").select(F.col("doc_ord").alias("query_id"), "embedding")


@query(f"WITH {_MANY} SELECT * FROM many")
def cosine_topk_many(spark, d):
    """Many queries against all vectors, exactly."""
    return vector.search_many(corpus.vectors(spark, d), _asked(spark, d), K).drop("doc_ord")


@query(f"WITH {_MANY} SELECT query_id, count(*) AS n_exact, true AS recall_reached FROM many GROUP BY query_id")
def vector_lists_recall(spark, d):
    """Searches of lists against exact ones: the neighbours of each query, and whether nine tenths of all are found."""
    root = _folder(spark)
    lists = vector_lists.write(corpus.vectors(spark, d), root)
    found = lists.search_many(_asked(spark, d), K).select("query_id", "doc_id", F.lit(1).alias("hit"))
    exact = vector.search_many(corpus.vectors(spark, d), _asked(spark, d), K).join(found, ["query_id", "doc_id"], "left")
    # Written, as it is read twice: a row for each query.
    exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_hit")).write.parquet(f"{root}/recall")
    each = spark.read.parquet(f"{root}/recall")
    return each.crossJoin(each.agg((F.sum("n_hit") >= 0.9 * F.sum("n_exact")).alias("recall_reached"))).select("query_id", "n_exact", "recall_reached")


@query("""SELECT CAST(a.vec_id AS VARCHAR) AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    from noteloom.functions.similarity import cosine

    v = corpus.vectors(spark, d)
    other = v.select((F.col("doc_ord") - 1).alias("doc_ord"), F.col("embedding").alias("other"))
    return v.join(other, "doc_ord").select("doc_id", F.round(cosine("embedding", "other"), 6).alias("similarity"))


@query(f"WITH kept AS (SELECT * FROM embeddings WHERE vec_id NOT IN (0, 3, 7)), {_cosine(K, source='kept')} SELECT * FROM vec")
def vector_remove(spark, d):
    return vector.search(vector.remove(corpus.vectors(spark, d), ["0", "3", "7", "absent"]), corpus.query_vector(spark, d), K)


@query("""SELECT CAST(count(*) AS BIGINT) AS n_vectors, CAST(min_by(len(embedding), vec_id) AS INTEGER) AS dimension, count(DISTINCT len(embedding)) > 1 AS mixed, count(*) = 0 AS is_empty
  FROM (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT 1000000, [1.0, 2.0]::FLOAT[])""")
def vector_dimension(spark, d):
    more = spark.createDataFrame([("new", [1.0, 2.0], 1_000_000)], "doc_id string, embedding array<float>, doc_ord long")
    return vector.statistics(vector.add(corpus.vectors(spark, d), more))


@query("SELECT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = 3) AS has_it, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = -1) AS has_other, EXISTS (SELECT 1 FROM embeddings) AS has_index, false AS empty_has_index")
def vector_contains(spark, d):
    s = _searcher(spark, d)
    without = S.Searcher(s.docs, s.index, vector.empty(spark))
    row = (vector.contains(s.vectors, "3"), vector.contains(s.vectors, "-1"), s.has_vector_index(), without.has_vector_index())
    return spark.createDataFrame([row], "has_it boolean, has_other boolean, has_index boolean, empty_has_index boolean")


@query("SELECT CAST(vec_id AS VARCHAR) AS doc_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return vector.with_norms(corpus.vectors(spark, d)).select("doc_id", F.round("norm", 6).alias("norm"))


def _lists(spark, d, k):
    s = _searcher(spark, d)
    return [s.bm25(QUERY, k), s.by_vector(corpus.query_vector(spark, d), k)]


@query(f"WITH {_POSTINGS}, {_bm25(QUERY, 50)}, {_cosine(50)}, {_fused(60)} SELECT * FROM fused")
def rrf_fusion(spark, d):
    return fusion.fuse(_lists(spark, d, 50))


@query(f"WITH {_POSTINGS}, {_bm25(QUERY, 50)}, {_cosine(50)}, {_fused(30)} SELECT * FROM fused")
def rrf_custom_k(spark, d):
    return fusion.fuse(_lists(spark, d, 50), 30)


@query(f"""WITH {_POSTINGS}, {_bm25(QUERY, 20)}, {_cosine(20)}, {_fused(60)}, named AS (
    SELECT doc_id, title, 1 AS l, rank FROM bm25 JOIN docs ON docs.id = doc_id UNION ALL SELECT doc_id, 'vector ' || doc_id, 2, rank FROM vec)
  SELECT rank, doc_id, score, title FROM fused JOIN (SELECT doc_id, min_by(title, (l, rank)) AS title FROM named GROUP BY doc_id) USING (doc_id)""")
def rrf_details(spark, d):
    first, second = _lists(spark, d, 20)
    titles = corpus.documents(spark, d).select(F.col("id").alias("doc_id"), "title")
    return fusion.fuse([first.join(titles, "doc_id"), second.withColumn("title", F.concat(F.lit("vector "), "doc_id"))])


@query(f"WITH {_POSTINGS}, {_bm25(QUERY, 2 * K)}, {_cosine(2 * K)}, {_fused(60, K)} SELECT * FROM fused")
def hybrid_topk(spark, d):
    return _searcher(spark, d).hybrid(QUERY, K, corpus.query_vector(spark, d))


@query(f"WITH {_POSTINGS}, {_bm25(QUERY, 2 * K)}, {_cosine(2 * K)}, {_fused(60, K)} SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, doc_id, score FROM fused JOIN docs ON docs.id = doc_id WHERE list_contains(docs.tags, '{TAG}')")
def hybrid_tag_filter(spark, d):
    s = _searcher(spark, d)
    return S.tag_filter(s.hybrid(QUERY, K, corpus.query_vector(spark, d)), s.docs, TAG)


@query(f"WITH {_POSTINGS}, {_bm25(QUERY, 2 * K)}, vec AS (SELECT 1 AS rank, '' AS doc_id WHERE false), {_fused(60, K)} SELECT * FROM fused")
def hybrid_without_embedder(spark, d):
    return _searcher(spark, d).search(QUERY)


# ---- document store -----------------------------------------------------------------
@query(f"WITH {_DOCS} SELECT DISTINCT unnest(tags) AS tag FROM docs")
def list_tags(spark, d):
    return docstore.all_tags(corpus.documents(spark, d))


@query(f"WITH {_DOCS} SELECT tag, count(*) AS n_docs FROM (SELECT unnest(list_distinct(list_concat(tags, tags))) AS tag FROM docs) GROUP BY tag")
def tag_counts(spark, d):
    return docstore.tag_counts(corpus.documents(spark, d).withColumn("tags", F.concat("tags", "tags")))


@query(f"WITH {_DOCS} SELECT id, title FROM docs WHERE list_contains(tags, 'src3')")
def docs_by_tag(spark, d):
    return docstore.by_tag(corpus.documents(spark, d), "src3").select("id", "title")


@query(f"WITH {_DOCS} SELECT id, title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM docs ORDER BY docs.date DESC, id LIMIT 20")
def recent_docs(spark, d):
    return docstore.recent(corpus.documents(spark, d), 20).select("id", "title", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


@query(f"WITH {_DOCS} SELECT id, title, text FROM docs WHERE id = '17'")
def doc_lookup(spark, d):
    return docstore.get(corpus.documents(spark, d), "17").select("id", "title", "text")


@query(f"WITH {_DOCS} SELECT count(*) AS n_docs, count(*) = 0 AS is_empty FROM docs")
def docstore_size(spark, d):
    return docstore.size(corpus.documents(spark, d))


@query(f"WITH {_DOCS} SELECT id, CASE WHEN doc_ord % 3 = 0 THEN 'new ' || title ELSE title END AS title FROM docs UNION ALL SELECT 'extra', 'an extra one'")
def docstore_upsert(spark, d):
    docs = corpus.documents(spark, d)
    newer = docs.where("doc_ord % 3 = 0").withColumn("title", F.concat(F.lit("new "), "title"))
    extra = docs.where("doc_ord = 0").withColumns({"id": F.lit("extra"), "title": F.lit("an extra one")})
    return docstore.upsert(docs, newer, extra).select("id", "title")


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE doc_ord % 4 <> 0")
def docstore_remove(spark, d):
    docs = corpus.documents(spark, d)
    return docstore.ids(docstore.remove(docs, docs.where("doc_ord % 4 = 0").select("id").unionByName(spark.createDataFrame([("absent",)], "id string"))))


# ---- scalars ------------------------------------------------------------------------
@query(f"WITH {_DOCS} SELECT doc_ord, left(sha256(title || chr(0) || text), 16) AS id FROM docs")
def content_ids(spark, d):
    return docstore.with_content_ids(corpus.documents(spark, d)).select("doc_ord", "id")


@query(f"WITH {_DOCS} SELECT count(DISTINCT id) AS n_ids, 36 AS id_length FROM docs")
def random_ids(spark, d):
    """As many ids as documents."""
    ids = docstore.with_random_ids(corpus.documents(spark, d)).select("id")
    return ids.agg(F.count_distinct("id").alias("n_ids"), F.max(F.length("id")).alias("id_length"))


@query(f"WITH {_DOCS} SELECT id, left(sha256(title || chr(0) || text), 16) AS content_hash FROM docs")
def content_hash(spark, d):
    return incremental.hashes(corpus.documents(spark, d))


@query(f"""WITH {_DOCS}, t AS (SELECT id, unnest([title, lang, '', lang || ' / ' || title]) AS title FROM docs JOIN documents ON doc_id = doc_ord)
  SELECT id, title, CASE WHEN title <> '' THEN split_part(title, ' / ', 1) END AS category, CASE WHEN contains(title, ' / ') THEN split_part(title, ' / ', 2) END AS subcategory FROM t""")
def category_subcategory(spark, d):
    docs = corpus.documents(spark, d).select("id", F.explode(F.array("title", F.get("tags", F.lit(0)), F.lit(""), F.concat_ws(" / ", F.get("tags", F.lit(0)), "title"))).alias("title"))
    return docs.select("id", "title", D.category("title").alias("category"), D.subcategory("title").alias("subcategory"))


@query(f"WITH {_DOCS} SELECT id, '# ' || title || chr(10) || CASE WHEN doc_ord % 2 = 0 THEN 'タグ: ' || array_to_string(tags, ', ') || chr(10) ELSE '' END || chr(10) || text AS embedding_text FROM docs")
def embedding_text(spark, d):
    docs = corpus.documents(spark, d).withColumn("tags", F.when(F.col("doc_ord") % 2 == 0, F.col("tags")).otherwise(F.array().cast("array<string>")))
    return docs.select("id", D.embedding_text("title", "tags", "text").alias("embedding_text"))


@query(f"WITH {_DOCS}, t AS (SELECT id, {_trim('x')} AS x FROM (SELECT id, CASE WHEN doc_ord % 5 = 0 THEN chr(12288) || chr(9) ELSE chr(10) || text || ' ' END AS x FROM docs)) SELECT id, CASE WHEN x = '' THEN '(empty)' WHEN length(x) > 6000 THEN left(x, 5997) || '...' ELSE x END AS clamped FROM t")
def embedding_clamp(spark, d):
    x = F.when(F.col("doc_ord") % 5 == 0, F.lit("　\t")).otherwise(F.concat(F.lit("\n"), "text", F.lit(" ")))
    return corpus.documents(spark, d).select("id", D.embedding_clamp(x).alias("clamped"))


@query(f"WITH {_DOCS} SELECT id, list_contains(tags, 'fr') AS is_fr, list_contains(tags, 'FR') AS is_upper FROM docs")
def has_tag(spark, d):
    return corpus.documents(spark, d).select("id", D.has_tag("tags", "fr").alias("is_fr"), D.has_tag("tags", "FR").alias("is_upper"))


# ---- extraction ---------------------------------------------------------------------
def _content_columns(c, *first):
    return [*first, F.col(f"{c}.text").alias("text"), *(F.col(f"{c}.{x}").alias(x) for x in ("truncated", "total_chars", "total_lines", "extracted_chars"))]


def _content_sql(cut: str, truncated: str, text: str = "text") -> str:
    return f"{cut} AS text, {truncated} AS truncated, CAST(length({text}) AS BIGINT) AS total_chars, CAST({_LINES.format(text)} AS BIGINT) AS total_lines, CAST(length({cut}) AS BIGINT) AS extracted_chars"


@query(f"WITH {_DOCS} SELECT id, {_content_sql('left(text, 150)', 'length(text) > 150')} FROM docs")
def extract_head(spark, d):
    return corpus.documents(spark, d).select("id", X.head("text", 150).alias("c")).select(*_content_columns("c", "id"))


@query(f"WITH {_DOCS} SELECT id, {_content_sql('left(text, 5000)', 'length(text) > 5000')} FROM docs")
def extract_full(spark, d):
    return corpus.documents(spark, d).select("id", X.full("text").alias("c")).select(*_content_columns("c", "id"))


_RENDERED = """rendered AS (SELECT id, doc_ord, entry, entry || chr(10) || '* Second ' || id || ' 2024-02-03 04:05:06 [x]' || chr(10) || 'tail of it' AS text FROM (
  SELECT id, doc_ord, '* ' || title || ' ' || strftime(date, '%Y-%m-%d %H:%M:%S') || ' [' || tags[1] || ']:[' || tags[2] || ']:' || chr(10) || text || chr(10) AS entry FROM docs)"""


def _rendered(spark, d):
    docs = corpus.documents(spark, d)
    second = F.concat(F.lit("\n* Second "), "id", F.lit(" 2024-02-03 04:05:06 [x]\ntail of it"))
    return changelog.render(docs).select("id", "doc_ord", F.concat("value", second).alias("text"))


@query(f"WITH {_DOCS}, {_RENDERED}), e AS (SELECT id, text, regexp_replace(entry, '{_SPACE}+$', '') AS entry FROM rendered) SELECT id, {_content_sql('left(entry, 5000)', 'length(entry) > 5000')} FROM e".replace("CAST(length(text) AS BIGINT) AS total_chars", "CAST(length(e.text) AS BIGINT) AS total_chars"))
def extract_entry(spark, d):
    return _rendered(spark, d).select("id", X.current_entry("text").alias("c")).select(*_content_columns("c", "id"))


@query(f"WITH {_DOCS} SELECT id, {_content_sql('left(text, 5000)', 'length(text) > 5000')} FROM docs")
def extract_entry_fallback(spark, d):
    return corpus.documents(spark, d).select("id", X.extract("text", "entry").alias("c")).select(*_content_columns("c", "id"))


@query(f"WITH {_DOCS}, {_RENDERED}) SELECT id, '* Second ' || id || ' 2024-02-03 04:05:06 [x]' || chr(10) || 'tail of it' AS text FROM rendered")
def entry_by_title(spark, d):
    return _rendered(spark, d).select("id", X.entry_by_title("text", "Second ").alias("c")).select("id", "c.text")


@query(f"WITH {_DOCS}, {_RENDERED}) SELECT id, unnest([0, 1]) AS n, unnest([title, 'Second ' || id]) AS title, unnest([strftime(date, '%Y-%m-%d'), '2024-02-03']) AS date, unnest([array_to_string(tags, ','), 'x']) AS tags FROM rendered JOIN docs USING (id)")
def parse_entries(spark, d):
    rows = _rendered(spark, d).select("id", F.posexplode(X.entries("text")).alias("n", "e"))
    return rows.select("id", "n", "e.title", "e.date", F.array_join("e.tags", ",").alias("tags"))


@query(f"WITH {_DOCS}, t AS (SELECT id, CASE WHEN doc_ord % 4 = 0 THEN '' WHEN doc_ord % 4 = 1 THEN text || chr(10) ELSE text END AS text FROM docs) SELECT id, CAST(length(text) AS BIGINT) AS n_chars, CAST({_LINES.format('text')} AS BIGINT) AS n_lines FROM t")
def content_stats(spark, d):
    t = F.when(F.col("doc_ord") % 4 == 0, "").when(F.col("doc_ord") % 4 == 1, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return corpus.documents(spark, d).select("id", t.alias("text")).select("id", F.length("text").cast("long").alias("n_chars"), D.line_count("text").alias("n_lines"))


@query(f"WITH {_DOCS}, f AS (SELECT id, left(text, 5000) AS x, length(text) AS c, {_LINES.format('text')} AS l FROM docs) SELECT id, CASE WHEN length(x) > 200 THEN left(x, 200) || '...' || chr(10) || '[' || c || ' chars, ' || l || ' lines]' ELSE x END AS summary, 'rule-based' AS summary_method FROM f")
def summary_rule(spark, d):
    return remote.summarise(corpus.documents(spark, d).select("id", X.full("text").alias("content"))).select("id", "summary", "summary_method")


def _stub_chat(text: str) -> str:
    if len(text) % 3 == 0:
        raise remote.RemoteError("network")
    return f"{len(text)} characters"


@query(_SQL["summary_rule"].replace("SELECT id, CASE WHEN length(x) > 200", "SELECT id, CASE WHEN length(x) % 3 <> 0 THEN length(x) || ' characters' WHEN length(x) > 200").replace("'rule-based' AS", "CASE WHEN length(x) % 3 <> 0 THEN 'llm' ELSE 'rule-based' END AS"))
def summary_chat(spark, d):
    """Summaries by a chat service; by rule where it fails."""
    return remote.summarise(corpus.documents(spark, d).select("id", X.full("text").alias("content")), _stub_chat).select("id", "summary", "summary_method")


@query("SELECT * FROM (VALUES ('known', 'from the cache', false), ('new', 'NEW', true), ('fails', 'fails', true)) v(query, rewritten, is_new)")
def query_rewrites(spark, d):
    """A query from the cache, by the service, and as it is where the service fails; the last two are to be cached."""

    def chat(q):
        if q == "fails":
            raise remote.RemoteError("api")
        return f" {q.upper()} "

    valid = spark.createDataFrame([("known", "from the cache")], "query string, rewritten string")
    return spark.createDataFrame([(q, *remote.rewrite(q, valid, chat)) for q in ("known", "new", "fails")], "query string, rewritten string, is_new boolean")


# ---- sources ------------------------------------------------------------------------
@query(f"WITH {_DOCS}, {_RENDERED}), e AS (SELECT id, unnest([0, 1]) AS n FROM rendered), r AS (SELECT e.n, CASE WHEN n = 0 THEN title ELSE 'Second ' || id END AS title, CASE WHEN n = 0 THEN date ELSE TIMESTAMP '2024-02-03 04:05:06' END AS date, CASE WHEN n = 0 THEN array_to_string(tags, ',') ELSE '' END AS tags, CASE WHEN n = 0 THEN {_trim('text')} ELSE 'tail of it' END AS text FROM e JOIN docs USING (id)) SELECT title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, tags, text, left(sha256(title || chr(0) || text), 16) AS id FROM r")
def changelog_parse(spark, d):
    parsed = changelog.parse(_rendered(spark, d).select(F.col("id").alias("file"), F.col("text").alias("value")))
    return parsed.select("title", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.array_join("tags", ",").alias("tags"), "text", "id")


def _note_files(spark, docs) -> list[str]:
    """A folder of change-log files for each language, the last language first."""
    folder = _folder(spark)
    notes = changelog.render(docs).join(docs.select("id", F.get("tags", F.lit(0)).alias("lang")), "id")
    # Part files are numbered in the order of the ranges, so their names sort as the documents do.
    notes.repartitionByRange("lang", "doc_ord").sortWithinPartitions("lang", "doc_ord").select("lang", "value").write.partitionBy("lang").text(folder)
    return [f"{folder}/lang={r.lang}" for r in docs.select(F.get("tags", F.lit(0)).alias("lang")).distinct().orderBy(F.desc("lang")).collect()]


@query(f"WITH {_DOCS}, t AS (SELECT *, {_trim('text')} AS x FROM docs) SELECT CAST(row_number() OVER (ORDER BY tags[1] DESC, doc_ord) AS INTEGER) AS n, title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, x AS text, left(sha256(title || chr(0) || x), 16) AS id FROM t")
def changelog_files(spark, d):
    """Files read in the order given; documents are numbered in that order."""
    found = changelog.documents(spark, _note_files(spark, corpus.documents(spark, d)))
    return lines.ranked(found, "doc_ord", "n").select(F.col("n").cast("int").alias("n"), "title", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "text", "id")


@query(f"WITH {_DOCS} SELECT CAST(row_number() OVER (ORDER BY tags[1] DESC, doc_ord) AS INTEGER) AS rank, 'T' || id AS title FROM docs ORDER BY rank LIMIT {K}")
def changelog_ties(spark, d):
    """Documents from files that all score alike rank in the order of the files."""
    docs, root = corpus.documents(spark, d), _folder(spark)
    alike = docs.withColumns({"title": F.concat(F.lit("T"), "id"), "text": F.lit("the same words")})
    build.from_changelog(spark, _note_files(spark, alike), root, "t")
    s = S.Searcher.open(spark, root)
    return S.enrich(s.bm25("same", K), s.docs).select("rank", "title")


def _json_store(spark, d) -> str:
    docs, folder = corpus.documents(spark, d), _folder(spark)
    rows = lexical.tokenised(docs)
    index_files.export_store(rows, docs, corpus.vectors(spark, d), incremental.metadata(docs, "2024-01-01T00:00:00Z", "stub"), incremental.hashes(docs), folder)
    return folder


@query(f"WITH {_POSTINGS}, n AS (SELECT doc_ord, row_number() OVER (ORDER BY doc_ord) - 1 AS at FROM docs), {_bm25(QUERY, K)} SELECT rank, doc_id, score, title FROM bm25 JOIN docs ON docs.id = doc_id")
def json_store_search(spark, d):
    """A search over a store of JSON files that this engine wrote."""
    s = S.Searcher.from_json(spark, _json_store(spark, d))
    return S.enrich(s.bm25(QUERY, K), s.docs).select("rank", "doc_id", "score", "title")


@query(f"WITH {_DOCS} SELECT id, title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, array_to_string(tags, ',') AS tags, text, CAST(row_number() OVER (ORDER BY doc_ord) - 1 AS BIGINT) AS doc_ord, left(sha256(title || chr(0) || text), 16) AS h FROM docs")
def json_store_documents(spark, d):
    folder = _json_store(spark, d)
    docs = index_files.load_documents(spark, f"{folder}/{index_files.DOCUMENT_FILE}")
    hashes = index_files.load_hashes(spark, f"{folder}/{index_files.METADATA_FILE}").withColumnRenamed("content_hash", "h")
    return docs.join(hashes, "id").select("id", "title", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.array_join("tags", ",").alias("tags"), "text", "doc_ord", "h")


@query("SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS doc_ord, len(embedding) AS n, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings")
def json_store_vectors(spark, d):
    v = index_files.load_store(spark, _json_store(spark, d))[2]
    return v.select("doc_id", "doc_ord", F.size("embedding").cast("long").alias("n"), F.round("norm", 4).alias("norm"))


@query("SELECT 0 AS n_found, 0 AS n_docs, 0 AS n_vectors, false AS has_metadata")
def json_store_missing(spark, d):
    """A folder without any index file is an empty index."""
    folder = _folder(spark)
    s = S.Searcher.from_json(spark, folder)
    row = (s.bm25(QUERY, K).count(), s.docs.count(), s.vectors.count(), index_files.load_store(spark, folder)[3] is not None)
    return spark.createDataFrame([row], "n_found int, n_docs int, n_vectors int, has_metadata boolean")


@query(f"WITH {_DOCS} SELECT id, title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, array_to_string(tags, ',') AS tags, text FROM docs")
def jsonl_roundtrip(spark, d):
    lines = changelog.to_jsonl(corpus.documents(spark, d)).select(F.lit(1).alias("line_no"), "value")
    return jsonl.parse(lines).select("id", "title", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.array_join("tags", ",").alias("tags"), "text")


@query(f"WITH {_DOCS} SELECT id, title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, array_to_string(tags, ',') AS tags, text, 1 AS n_same_place FROM docs")
def jsonl_files(spark, d):
    """Documents written as folders of JSON lines, a folder for each language, and loaded from all files at once."""
    docs, folder = corpus.documents(spark, d), _folder(spark)
    line = changelog.to_jsonl(docs)
    line.select(F.get(F.from_json("value", "metadata struct<tags array<string>>")["metadata"]["tags"], F.lit(0)).alias("lang"), "value").write.partitionBy("lang").text(folder)
    found = jsonl.load(spark, folder).withColumn("n_same_place", F.count(F.lit(1)).over(W.partitionBy("doc_ord")).cast("int"))
    return found.select("id", "title", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.array_join("tags", ",").alias("tags"), "text", "n_same_place")


@query("""SELECT title, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT lang || ' / ' || source AS title, text FROM documents
  UNION ALL SELECT url, html FROM pages UNION ALL SELECT role, text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY title""")
def union_inputs(spark, d):
    inputs = [f(spark, d) for f in (corpus.documents, corpus.pages, corpus.conversations, corpus.benchmark)]
    return files.union(inputs).groupBy("title").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


# ---- incremental maintenance --------------------------------------------------------
@query(f"WITH {_OLD} SELECT id, status FROM diff")
def incremental_diff(spark, d):
    docs = corpus.documents(spark, d)
    return incremental.diff(docs, corpus.old_hashes(docs))


@query(f"WITH {_OLD}, c AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'unchanged') AS unchanged FROM diff) SELECT *, added + modified AS embeddings_needed, added + modified + removed > 0 AS has_changes FROM c")
def diff_counts(spark, d):
    return incremental.counts(incremental_diff(spark, d))


@query(f"WITH {_OLD} SELECT id, status FROM diff WHERE status IN ('added', 'modified')")
def needs_embedding(spark, d):
    docs = corpus.documents(spark, d)
    return incremental.needing_embedding(docs, incremental.diff(docs, corpus.old_hashes(docs))).select("id", "status")


@query(f"WITH {_OLD} SELECT id, h AS content_hash FROM new WHERE doc_ord % 2 = 0 UNION ALL SELECT id, h FROM old WHERE id NOT IN (SELECT id FROM new WHERE doc_ord % 2 = 0) AND id NOT LIKE 'gone-%'")
def metadata_hashes(spark, d):
    docs = corpus.documents(spark, d)
    old = corpus.old_hashes(docs)
    gone = old.where(F.col("id").startswith("gone-"))
    return incremental.remove_hashes(incremental.update_hashes(old, incremental.hashes(docs.where("doc_ord % 2 = 0"))), gone)


@query("""SELECT p_partkey, v AS version, coalesce(TRY_CAST(v AS DOUBLE), 0) < 2.0 AS needs_rebuild FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '2.0' WHEN 1 THEN '1.0' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'x' ELSE '10' END AS v FROM part)""")
def metadata_rebuild_flag(spark, d):
    v = F.when(F.col("p_size") % 6 == 0, "2.0").when(F.col("p_size") % 6 == 1, "1.0").when(F.col("p_size") % 6 == 2, "").when(F.col("p_size") % 6 == 3, F.lit(None)).when(F.col("p_size") % 6 == 4, "x").otherwise("10")
    return corpus.table(spark, d, "part").select("p_partkey", v.alias("version")).select("p_partkey", "version", incremental.needs_full_rebuild("version").alias("needs_rebuild"))


@query(f"WITH {_DOCS} SELECT count(*) AS doc_count, '2024-01-01T00:00:00Z' AS created_at, 'stub' AS embedding_model, '2.0' AS schema_version FROM docs")
def index_metadata(spark, d):
    return incremental.metadata(corpus.documents(spark, d), "2024-01-01T00:00:00Z", "stub")


@query(f"""WITH {_OLD}, rows AS (SELECT doc_ord, id AS doc_id, CAST(len({_tokens("title || ' ' || text")}) AS BIGINT) AS dl FROM docs) SELECT doc_id, dl FROM rows""")
def incremental_lengths(spark, d):
    """Lengths kept for unchanged documents and made anew for the others: those of a full build."""
    docs = corpus.documents(spark, d)
    statuses = incremental.diff(docs, corpus.old_hashes(docs))
    lengths = lexical.tokenised(docs).select("doc_id", F.size("tokens").cast("long").alias("dl"))
    stale = lengths.join(corpus.old_hashes(docs).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    fresh = lexical.tokenised(incremental.needing_embedding(docs, statuses)).select("doc_id", F.size("tokens").cast("long").alias("dl"))
    return incremental.apply_changes(stale, fresh, statuses, "doc_id")


def _folder(spark) -> str:
    """A new folder in the cluster's shared folder."""
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def _older(docs):
    """An earlier state of the documents: some missing, some with other text, some since removed."""
    older = docs.where("doc_ord % 10 <> 0").withColumn("text", F.when(F.col("doc_ord") % 7 == 0, F.concat("text", F.lit(" older words"))).otherwise(F.col("text")))
    return older.unionByName(docs.where("doc_ord % 20 = 1").withColumn("id", F.concat(F.lit("gone-"), "id")))


@query(f"WITH {_POSTINGS}, {_bm25(QUERY, K)} SELECT * FROM bm25")
def stored_search_after_changes(spark, d):
    """A stored index of an earlier state, brought up to date incrementally, then searched: the rows of a search in the documents themselves."""
    docs, root = corpus.documents(spark, d), _folder(spark)
    build.full(spark, _older(docs), root, "2024-01-01T00:00:00Z")
    build.incremental_build(spark, docs, root, "2024-01-02T00:00:00Z")
    return S.Searcher.open(spark, root).bm25(QUERY, K)


@query(f"WITH {_POSTINGS} SELECT term, df FROM term_stats")
def stored_term_stats_after_changes(spark, d):
    """Document frequencies of an index that was changed three times, by what each change added and took away."""
    docs, root = corpus.documents(spark, d), _folder(spark)
    build.full(spark, _older(docs), root, "t1")
    build.upsert(spark, docs.where("doc_ord % 2 = 0"), root, "t2")
    build.remove(spark, docs.where("doc_ord % 20 = 1").select(F.concat(F.lit("gone-"), "id").alias("id")), root, "t3")
    build.incremental_build(spark, docs, root, "t4")
    return Stored.open(spark, root).term_stats


@query(f"WITH {_POSTINGS} SELECT term, doc_ord, doc_id, CAST(tf AS BIGINT) AS tf, CAST(dl AS BIGINT) AS dl FROM postings")
def stored_postings_after_compaction(spark, d):
    docs, root = corpus.documents(spark, d), _folder(spark)
    build.full(spark, _older(docs), root, "t1")
    build.incremental_build(spark, docs, root, "t2")
    build.compact(spark, root)
    return Stored.open(spark, root).postings


@query(f"WITH {_DOCS} SELECT id, title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, array_to_string(tags, ',') AS tags, CASE WHEN doc_ord % 3 = 0 THEN text || ' again' ELSE text END AS text FROM docs WHERE doc_ord % 5 <> 4")
def stored_documents_after_batches(spark, d):
    """Batches put into a stored index one after the other, as a stream does it, and documents taken out."""
    docs, root = corpus.documents(spark, d), _folder(spark)
    for k in range(3):
        build.upsert(spark, docs.where(F.col("doc_ord") % 3 == k), root, f"t{k}")
    build.upsert(spark, docs.where("doc_ord % 3 = 0").withColumn("text", F.concat("text", F.lit(" again"))), root, "t3")
    build.remove(spark, docs.where("doc_ord % 5 = 4").select("id"), root, "t4")
    return Stored.open(spark, root).documents.select("id", "title", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.array_join("tags", ",").alias("tags"), "text")


@query(f"""WITH {_OLD}, c AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'removed') AS removed FROM diff)
  SELECT CAST(step AS INTEGER) AS step, mode, CAST(added AS BIGINT) AS added, CAST(modified AS BIGINT) AS modified, CAST(removed AS BIGINT) AS removed FROM (
    SELECT 1 AS step, 'full' AS mode, NULL AS added, NULL AS modified, NULL AS removed UNION ALL SELECT 2, 'skipped', 0, 0, 0 UNION ALL SELECT 3, 'incremental', added, modified, removed FROM c UNION ALL SELECT 4, 'full', NULL, NULL, NULL)""")
def build_modes(spark, d):
    """What a build decides: all anew, nothing, what changed, all anew when told so."""
    docs, root = corpus.documents(spark, d), _folder(spark)
    old = _older(docs)
    built = [build.incremental_build(spark, x, root, "t", force=force) for x, force in ((old, False), (old, False), (docs, False), (docs, True))]
    rows = [(k + 1, b.mode, *((b.counts or {}).get(c) for c in ("added", "modified", "removed"))) for k, b in enumerate(built)]
    return spark.createDataFrame(rows, "step int, mode string, added long, modified long, removed long")


@query(f"WITH {_DOCS} SELECT count(*) AS doc_count, '2024-01-02T00:00:00Z' AS created_at, 'stub' AS embedding_model, '2.0' AS schema_version, 6 AS n_steps, true AS in_order FROM docs")
def stored_metadata(spark, d):
    """Metadata of a build with embeddings, and the steps that it tells its caller."""
    root, steps = _folder(spark), []
    build.full(spark, corpus.documents(spark, d), root, "2024-01-02T00:00:00Z", _stub_embedder, "stub", lambda step, total, _: steps.append((step, total)))
    found = Stored.open(spark, root).metadata
    return found.select("*", F.lit(len(steps)).alias("n_steps"), F.lit(steps == [(k + 1, len(steps)) for k in range(len(steps))]).alias("in_order"))


def _stub_embedder(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("\n")), float(t.count("e"))] for t in texts]


@query(f"""WITH {_DOCS}, t AS (SELECT id, {_trim("'# ' || title || chr(10) || 'タグ: ' || array_to_string(tags, ', ') || chr(10) || chr(10) || text")} AS x FROM docs),
  c AS (SELECT id, CASE WHEN length(x) > 6000 THEN left(x, 5997) || '...' ELSE x END AS x FROM t)
  SELECT id AS doc_id, CAST(length(x) AS DOUBLE) AS n_chars, CAST(length(x) - length(replace(x, chr(10), '')) AS DOUBLE) AS n_breaks, CAST(length(x) - length(replace(x, 'e', '')) AS DOUBLE) AS n_e FROM c""")
def embed_documents(spark, d):
    """Vectors by an injected embedder; this one counts characters."""
    return _embedded(vector.embed(corpus.documents(spark, d), _stub_embedder))


def _embedded(v):
    return v.select("doc_id", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("n_chars", "n_breaks", "n_e"))))


@query(_SQL["embed_documents"])
def stored_vectors_after_changes(spark, d):
    """Vectors of a stored index of an earlier state, after an incremental build that embeds what changed."""
    docs, root = corpus.documents(spark, d), _folder(spark)
    build.full(spark, _older(docs), root, "t1", _stub_embedder)
    build.incremental_build(spark, docs, root, "t2", _stub_embedder)
    return _embedded(Stored.open(spark, root).vectors)


# ---- caches and telemetry -----------------------------------------------------------
@query(f"WITH {_DOCS} SELECT id, sha256(text || 'stub') AS key FROM docs")
def cache_key(spark, d):
    return corpus.documents(spark, d).select("id", cache.key("text", F.lit("stub")).alias("key"))


def _cached(spark, d):
    log = corpus.cache_log(spark, d)
    return cache.latest(log, "key", "cache", order=("created_at", "event_id")), log.agg(F.max("created_at").alias("now"))


@query(f"WITH {_CACHE} SELECT key, cache, event_id FROM latest, now WHERE epoch_us(t) - epoch_us(latest.ts) <= 86400 * 1000000::BIGINT")
def cache_ttl(spark, d):
    rows, now = _cached(spark, d)
    return cache.live(rows.crossJoin(F.broadcast(now)), F.col("now"), 86_400).select("key", "cache", "event_id")


@query(f"WITH {_CACHE} SELECT count(*) AS n_expired FROM latest, now WHERE epoch_us(t) - epoch_us(latest.ts) > 86400 * 1000000::BIGINT")
def cache_cleanup(spark, d):
    rows, now = _cached(spark, d)
    return cache.expired(rows.crossJoin(F.broadcast(now)), F.col("now"), 86_400).agg(F.count(F.lit(1)).alias("n_expired"))


@query(f"WITH {_CACHE} SELECT key, cache, event_id FROM latest QUALIFY row_number() OVER (PARTITION BY cache ORDER BY ts DESC, event_id DESC) <= 100")
def cache_evict(spark, d):
    return cache.evict(_cached(spark, d)[0], order=("created_at", "event_id")).select("key", "cache", "event_id")


_LOOKUP = f"""{_CACHE}, found AS (SELECT c.c_custkey, CASE WHEN l.ts IS NULL THEN 'miss' WHEN epoch_us(t) - epoch_us(l.ts) > 604800 * 1000000::BIGINT THEN 'expired' ELSE 'hit' END AS outcome
  FROM now, (SELECT c_custkey, 'view:' || CAST(c_custkey AS VARCHAR) AS key FROM customer) c LEFT JOIN latest l ON l.key = c.key)"""


def _outcomes(spark, d):
    rows, now = _cached(spark, d)
    requests = corpus.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("view:"), F.col("c_custkey").cast("string")).alias("key")).crossJoin(F.broadcast(now))
    return cache.lookups(requests, rows, F.col("now"), 604_800)


@query(f"WITH {_LOOKUP} SELECT outcome, count(*) AS n FROM found GROUP BY outcome")
def cache_lookups(spark, d):
    return _outcomes(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOOKUP} SELECT count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome <> 'hit') AS misses, count(*) FILTER (outcome = 'expired') AS expirations, round(100.0::DOUBLE * count(*) FILTER (outcome = 'hit') / count(*), 6) AS hit_rate FROM found")
def hit_rate(spark, d):
    return cache.hit_rate(_outcomes(spark, d))


@query(f"WITH {_CACHE} SELECT key, event_id FROM latest, now WHERE epoch_us(t) - epoch_us(latest.ts) < 86400 * 1000000::BIGINT")
def rewrite_cache_valid(spark, d):
    rows, now = _cached(spark, d)
    return cache.rewrites_valid(rows.crossJoin(F.broadcast(now)), F.col("now")).select("key", "event_id")


@query(f"WITH {_CACHE} SELECT key, cache, max_by(event_id, (ts, event_id % 2, event_id)) AS event_id FROM log GROUP BY key, cache")
def cache_put(spark, d):
    """Entries put into a cache: the newest of each key, of equal times the one put in last."""
    old, new = (cache.latest(corpus.cache_log(spark, d).where(F.col("event_id") % 2 == k), "key", "cache", order=("created_at", "event_id")) for k in (0, 1))
    return cache.put(old, new, "key", "cache").select("key", "cache", "event_id")


@query(f"""WITH {_CACHE}, l AS (SELECT key, cache, max_by(event_id, (ts, event_id % 2, event_id)) AS event_id, max(ts) AS ts FROM log GROUP BY key, cache)
  SELECT key, cache, event_id FROM l, now WHERE epoch_us(t) - epoch_us(l.ts) <= 7200 * 1000000::BIGINT QUALIFY row_number() OVER (PARTITION BY cache ORDER BY l.ts DESC, key DESC) <= 200""")
def summary_cache(spark, d):
    """The summary cache after insertions, with its own lifetime and room."""
    log = corpus.cache_log(spark, d)
    old, new = (cache.latest(log.where(F.col("event_id") % 2 == k), "key", "cache", order=("created_at", "event_id")) for k in (0, 1))
    now = log.agg(F.max("created_at").cast("string")).first()[0]
    return cache.summaries(old, new, now).select("key", "cache", "event_id")


@query(f"WITH {_CACHE} SELECT (SELECT count(*) FROM latest) AS n_entries, (SELECT count(*) FROM latest WHERE cache <> 'view') AS n_left, 0 AS n_cleared, true AS is_cleared")
def cache_size(spark, d):
    """Entries of a cache, after some were taken out, and after all were."""
    rows = _cached(spark, d)[0]
    n = lambda frame, c: cache.size(frame).select(F.col("n_entries").alias(c))
    left = cache.drop(rows, rows.where("cache = 'view'").select("key").distinct())
    cleared = cache.size(cache.clear(rows)).select(F.col("n_entries").cast("int").alias("n_cleared"), F.col("is_empty").alias("is_cleared"))
    return n(rows, "n_entries").crossJoin(n(left, "n_left")).crossJoin(cleared)


@query(f"WITH {_CACHE} SELECT count(*) AS n_entries, count(*) FILTER (epoch_us(t) - epoch_us(latest.ts) >= 86400 * 1000000::BIGINT) AS n_expired FROM latest, now")
def rewrite_cache_cleanup(spark, d):
    rows, now = _cached(spark, d)
    rows = rows.crossJoin(F.broadcast(now))
    return cache.size(rows).select("n_entries").crossJoin(cache.size(cache.rewrites_expired(rows, F.col("now"))).select(F.col("n_entries").alias("n_expired")))


@query(f"WITH {_CALLS}, r AS (SELECT max(ts) - INTERVAL 7 DAY AS ts FROM calls) SELECT count(*) AS total_calls, count(*) FILTER (ok) AS successful_calls FROM calls WHERE ts > (SELECT ts FROM r)")
def usage_since_reset(spark, d):
    calls = corpus.api_calls(spark, d)
    resets = calls.agg((F.max("ts") - F.make_dt_interval(F.lit(7))).alias("ts"))
    return telemetry.usage(telemetry.since(calls, resets)).select("total_calls", "successful_calls")


@query(f"""WITH {_CALLS} SELECT count(*) AS total_calls, count(*) FILTER (ok) AS successful_calls, count(*) FILTER (NOT ok) AS failed_calls, CAST(sum(prompt) FILTER (ok) AS BIGINT) AS prompt_tokens, CAST(sum(completion) FILTER (ok) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt + completion) FILTER (ok) AS BIGINT) AS total_tokens, round(min(latency) FILTER (ok), 6) AS min_latency_ms, round(max(latency) FILTER (ok), 6) AS max_latency_ms, round(avg(latency) FILTER (ok), 4) AS avg_latency_ms, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 6) AS success_rate FROM calls""")
def api_usage(spark, d):
    return telemetry.usage(corpus.api_calls(spark, d))


@query(f"WITH {_CALLS} SELECT category, count(*) AS n_errors FROM calls WHERE NOT ok GROUP BY category")
def error_counts(spark, d):
    return telemetry.error_counts(corpus.api_calls(spark, d))


@query(f"WITH {_CALLS} SELECT round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 6) AS success_rate FROM calls")
def success_rate(spark, d):
    return telemetry.usage(corpus.api_calls(spark, d)).select("success_rate")


@query(f"WITH {_CALLS} SELECT event_id, category, 'call ' || CAST(event_id AS VARCHAR) AS message FROM calls WHERE NOT ok ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_errors(spark, d):
    return telemetry.recent_errors(corpus.api_calls(spark, d)).select("event_id", "category", "message")


# ---- front ends ---------------------------------------------------------------------
@query(f"WITH {_POSTINGS}, {_bm25(QUERY, K)} SELECT rank, doc_id, printf('%.4f', round(score, 4)) AS score, title, strftime(date, '%Y-%m-%d') AS date, array_to_string(tags, ',') AS tags, left(text, 150) AS text FROM bm25 JOIN docs ON docs.id = doc_id")
def memo_results(spark, d):
    s = _searcher(spark, d)
    rows = S.memo_results(s.bm25(QUERY, K), s.docs)
    return rows.select("rank", "doc_id", "score", "title", "date", F.array_join("tags", ",").alias("tags"), "content.text")


@query(f"""WITH {_POSTINGS}, {_bm25(QUERY, K)}, f AS (SELECT rank, doc_id, left(text, 300) AS x, length(text) AS c, {_LINES.format('text')} AS l FROM bm25 JOIN docs ON docs.id = doc_id)
  SELECT rank, doc_id, x AS text, c > 300 AS truncated, CASE WHEN length(x) > 200 THEN left(x, 200) || '...' || chr(10) || '[' || c || ' chars, ' || l || ' lines]' ELSE x END AS summary, 'rule-based' AS summary_method FROM f""")
def memo_results_full(spark, d):
    """Search results with whole content, cut at a length, and summaries."""
    return api.query_memos(_searcher(spark, d), QUERY, mode="bm25", top_k=K, extraction_mode="full", max_chars=300).select("rank", "doc_id", "text", "truncated", "summary", "summary_method")


@query(f"WITH {_DOCS} SELECT id, title, strftime(date, '%Y-%m-%d %H:%M') AS date, array_to_string(tags, ',') AS tags, left(text, 150) AS snippet FROM docs ORDER BY docs.date DESC, id LIMIT 10")
def recent_memos(spark, d):
    return S.recent_memos(corpus.documents(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {_DOCS}, {_cosine(20)} SELECT rank, doc_id, score, title FROM vec LEFT JOIN docs ON docs.id = doc_id")
def enrichment(spark, d):
    s = _searcher(spark, d)
    return S.enrich(s.by_vector(corpus.query_vector(spark, d), 20), s.docs).select("rank", "doc_id", "score", "title")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
