"""Query op4: base counts of all documents, and whether the adaptive rules keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.quality_rules import judge_quality


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


_W = "[\\x20\\x09-\\x0D]+"
ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_W}'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (SELECT doc_id, i, list_slice(words, i, i + 2) AS k FROM w, LATERAL unnest(range(1, len(words) - 1)) AS t(i)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM twice, LATERAL unnest(range(i, i + 3)) AS t(j) GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
vals AS (SELECT lang, source, unnest([{{'m': 'symbol_share', 'v': 10000 * n_symbols // word_chars}}, {{'m': 'long_words', 'v': 100 * word_chars // n_words}},
    {{'m': 'repeat_share', 'v': 1000 * n_repeat_words // n_words}}]) AS x FROM judged WHERE n_words > 0),
b AS (SELECT lang, source, x.m AS m, (x.v >> greatest(length(bin(x.v)) - 6, 0)::INT) << greatest(length(bin(x.v)) - 6, 0)::INT AS bucket FROM vals),
q0 AS (SELECT lang, source, m, count(*) AS n, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM b GROUP BY ALL),
q1 AS (SELECT lang, m, count(*) AS n, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM b GROUP BY ALL),
q2 AS (SELECT m, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM b GROUP BY ALL),
q AS (SELECT q0.lang, q0.source, q0.m, CASE WHEN q0.n >= 200 THEN q0.q WHEN q1.n >= 200 THEN q1.q ELSE q2.q END AS q
    FROM q0 JOIN q1 ON q0.lang = q1.lang AND q0.m = q1.m JOIN q2 ON q0.m = q2.m),
bounds AS (SELECT lang, source, max(CASE WHEN m = 'symbol_share' THEN q[2] + 8 * greatest(q[2] - q[1], 60) END) AS sym,
    max(CASE WHEN m = 'long_words' THEN q[2] + 8 * greatest(q[2] - q[1], 25) END) AS longest, max(CASE WHEN m = 'long_words' THEN q[2] - 8 * greatest(q[3] - q[2], 25) END) AS shortest,
    max(CASE WHEN m = 'repeat_share' THEN q[2] + 8 * greatest(q[2] - q[1], 40) END) AS rep FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 10000 * n_symbols // word_chars <= sym AND 100 * word_chars // n_words BETWEEN shortest AND longest AND 1000 * n_repeat_words // n_words <= rep AS kept
FROM judged LEFT JOIN bounds USING (lang, source)
"""
