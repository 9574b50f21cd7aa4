"""Query op6: a verdict on every page's URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.url_filter import judge_urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op6_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical forms of all page URLs that came through a feed (parameter utm_source)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(F.col("url").contains("utm_source=")).select("url")
    return judge_urls(pages, listed, RULES)


ORACLE = r"""
WITH parts AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS params FROM pages),
canon AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM parts),
known AS (SELECT DISTINCT canonical FROM canon WHERE contains(url, 'utm_source=') AND canonical <> ''),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM canon)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN known.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
    known.canonical IS NOT NULL AS listed
FROM ruled LEFT JOIN known ON ruled.canonical = known.canonical
"""
