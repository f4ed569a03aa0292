"""The queries of this subpackage, and SQL for those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noteloom.llm import alignment, bpe, byte_cnn, crossparse, decontaminate, html_text, pii, ppm, quality_rules, sharding, simhash, suffix_dedup
from noteloom.llm.common import spread_table, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread_table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(spread_table(spark, sf_dir, "documents"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.score_documents(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(spread_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(spread_table(spark, sf_dir, "documents"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_digests(spread_table(spark, sf_dir, "documents"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.identify(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_html_text, op3_pii, op4_quality_cnn, op5_bpe, op6_sharding, op7_decontaminate, op8_quality_rules, op9_ppm, op10_simhash, op11_alignment, op12_language)}


_QUALITY_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE n > 1) GROUP BY doc_id),
counts AS (SELECT base.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, coalesce(repeats.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper_, length(regexp_replace(text, '[^\p{Ll}]', '', 'g')) AS lower_
  FROM base LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND upper_ / greatest(1, upper_ + lower_) <= 0.3 AND 2 * n_dup_lines <= len(lines) AS kept
FROM judged
"""


#: Every window of 100 bytes by its digest; texts are cut into pieces first, as cutting a window out of a long text takes time in proportion to the text.
_REPEATS_SQL = r"""
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
pieces AS (SELECT r, c, least(512, n - 99 - 512 * c) AS m, substr(h, 1024 * c + 1, 1222) AS x FROM (SELECT r, h, n, unnest(range(0, (n - 99 + 511) // 512)) AS c FROM n WHERE n >= 100)),
windows AS (SELECT r * 1099511627776 + 512 * c + p AS w, md5_number(substr(x, 2 * p + 1, 200)) AS k FROM (SELECT r, c, x, unnest(range(0, m)) AS p FROM pieces)),
earliest AS (SELECT k, min(w) AS f FROM windows GROUP BY k HAVING count(*) > 1),
again AS (SELECT w // 1099511627776 AS r, w % 1099511627776 AS p FROM windows JOIN earliest USING (k) WHERE w > f),
edges AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 1 ELSE 0 END AS new FROM again),
spans AS (SELECT r, min(p) AS a, max(p) + 100 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM edges) GROUP BY r, g),
gone AS (SELECT r, sum(b - a) AS removed, count(*) AS n_spans, max(b) AS b FROM spans GROUP BY r),
parts AS (SELECT r, a AS turn, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS low, a AS high FROM spans UNION ALL SELECT r, n + 1, coalesce(b, 0), n FROM n LEFT JOIN gone USING (r)),
kept AS (SELECT r, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY turn) AS x FROM parts JOIN n USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM n JOIN kept USING (r) LEFT JOIN gone USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": _REPEATS_SQL, "op6_sharding": sharding.ORACLE_SQL, "op8_quality_rules": _QUALITY_SQL}
