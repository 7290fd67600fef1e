"""Query on quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .rules import judge


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
keyed AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS k FROM win),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed),
spans AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM twice WHERE c > 1),
rep AS (SELECT rid, sum(n) AS n FROM spans GROUP BY rid),
f AS (SELECT w.rid, doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON w.rid = rep.rid),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed, greatest(n_words, 1) AS n FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols * 10 > n OR n_dup_lines * 10 > n_lines * 3 OR word_chars < n * 2 OR word_chars > n * 15
         OR len(regexp_extract_all(text, '\b\p{Lu}{3,}\b')) * 2 > n
         OR regexp_matches(text, '[^\x20\x09-\x0D]{1000}[^\x20\x09-\x0D]')) AS kept
FROM b
"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL = {"op9_quality_rules": OP9_SQL}
