"""Schemas of the data model."""
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("tags", T.ArrayType(T.StringType(), False)),
    T.StructField("text", T.StringType()),
    T.StructField("doc_ord", T.LongType()),
])
DOCUMENT_JSON = "id string, metadata struct<title string, date string, tags array<string>>, text string"
VECTOR = "doc_id string, embedding array<float>"
POSTING = "term string, doc_ord long, doc_id string, tf long, dl long"
CORPUS_STATS = "n_docs long, avg_dl double"
RANKED = "rank int, doc_ord long, doc_id string, score double"
DOC_HASH = "id string, content_hash string"
METADATA = "doc_count long, created_at string, embedding_model string, schema_version string, doc_hashes map<string,string>"
LEGACY_BM25 = "version string, doc_ids array<string>, corpus array<array<string>>"
CACHE_ROW = "key string, value string, created_at timestamp"
REWRITE_ROW = "query string, rewritten string, created_at timestamp"
API_CALL = "ts timestamp, ok boolean, prompt_tokens long, completion_tokens long, latency_ms double, category string, message string, model string"
