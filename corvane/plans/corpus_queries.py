"""Queries over the corpus tables themselves: references, manifests, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import references
from corvane.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    refs = references.corpus_references(table(spark, d, "golden_queries"), table(spark, d, "enrichment"))
    return references.orphan_references(refs, references.corpus_parents(table(spark, d, "atoms"), table(spark, d, "atom_files")))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(p3_found(spark, d))


_P3_SQL = r"""
WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'atom' AS kind, 'golden_queries' AS ref_table, 'relevant_atom_ids' AS ref_field, query_id AS ref_key,
           lower(regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS ref_value, frozen_at AS ref_at
    FROM (SELECT query_id, frozen_at, unnest(relevant_atom_ids) AS v FROM golden_queries)
    UNION ALL
    SELECT 'atom', 'enrichment', 'atom_id', CAST(record_no AS VARCHAR), lower(regexp_replace(atom_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), created_at FROM enrichment
    UNION ALL
    SELECT 'file', 'enrichment', 'source_path', CAST(record_no AS VARCHAR), regexp_replace(replace(lower(regexp_replace(source_path, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '\', '/'), '^\./', ''), created_at FROM enrichment
  ) WHERE ref_value IS NOT NULL AND ref_value <> ''
), parents AS (
  SELECT 'atom' AS kind, lower(regexp_replace(atom_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS key, ingested_at AS t0, removed_at AS t1 FROM atoms
  UNION ALL
  SELECT 'file', regexp_replace(replace(lower(regexp_replace(file_path, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '\', '/'), '^\./', ''), written_at, removed_at FROM atom_files
), judged AS (
  SELECT r.kind, r.ref_table, r.ref_field, r.ref_key, r.ref_value, r.ref_at, count(p.key) AS n, min(p.t0) AS first_start,
         coalesce(bool_or(p.t0 <= r.ref_at AND (p.t1 IS NULL OR r.ref_at < p.t1)), false) AS covered
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.key = r.ref_value
  GROUP BY ALL
)
SELECT DISTINCT ref_table, ref_field, ref_key, ref_value,
       CASE WHEN n = 0 THEN 'missing' WHEN ref_at < first_start THEN 'late' ELSE 'removed' END AS orphan_kind,
       strftime(ref_at, '%Y-%m') AS period
FROM judged WHERE NOT covered
"""

QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
ORACLES = {
    "p3_found": _P3_SQL,
    "p3_counts": f"SELECT ref_table, ref_field, period, orphan_kind, count(*) AS n_references, count(DISTINCT ref_value) AS n_values FROM ({_P3_SQL}) GROUP BY 1, 2, 3, 4",
}
