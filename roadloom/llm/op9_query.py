"""Query op9: groups of similar documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.jaccard_join import similar_groups


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS g FROM w, LATERAL unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS n, doc_id AS m FROM n UNION SELECT reach.n, b FROM reach JOIN link ON m = a),
c AS (SELECT n AS doc_id, min(m) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
