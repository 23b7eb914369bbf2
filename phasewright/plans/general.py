"""Queries and SQL of the general data-pipeline problems (4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewright.operators.references import segment_references
from phasewright.operators.skew import strongest_partner
from phasewright.plans.tables import load


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return segment_references(*[load(spark, sf, t) for t in ("segments", "shared_segments", "links", "uz_segments")])


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references counted per table, field, month and reason."""
    return p4_found(spark, sf).groupBy("tab", "field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return strongest_partner(load(spark, sf, "contacts")).select("u", "v")


def p5_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The winning column of every row with its total."""
    return strongest_partner(load(spark, sf, "contacts"))


P4_SQL = r"""
WITH seg AS (SELECT node_id, trim(name, E' \t\r') AS name, line_no, loaded_at, deleted_at FROM segments),
byid AS (
  SELECT node_id AS k, min(loaded_at) AS first_loaded, arg_max_null(deleted_at, line_no) AS gone FROM seg
  WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT node_id FROM shared_segments) GROUP BY 1
  UNION ALL SELECT node_id, NULL, NULL FROM shared_segments),
byname AS (
  SELECT name AS k, min(loaded_at) AS first_loaded, arg_max_null(deleted_at, line_no) AS gone FROM seg
  WHERE name <> '' AND name NOT IN (SELECT name FROM shared_segments) GROUP BY 1
  UNION ALL SELECT name, NULL, NULL FROM shared_segments),
idrefs AS (
  SELECT 'links' AS tab, 'source_id' AS field, link_no AS row_key, source_id AS k, loaded_at AS t FROM links WHERE source_id IS NOT NULL
  UNION ALL SELECT 'links', 'target_id', link_no, target_id, loaded_at FROM links WHERE target_id IS NOT NULL),
namerefs AS (
  SELECT seg_idx AS row_key, trim(name, E' \t\r') AS k, built_at AS t FROM uz_segments WHERE trim(name, E' \t\r') <> ''),
judged AS (
  SELECT r.tab, r.field, r.row_key, r.t, p.k IS NULL AS absent, p.gone, p.first_loaded FROM idrefs r LEFT JOIN byid p ON p.k = r.k
  UNION ALL
  SELECT 'uz_segments', 'name', r.row_key, r.t, coalesce(a.k, b.k) IS NULL,
    CASE WHEN a.k IS NULL THEN b.gone ELSE a.gone END, CASE WHEN a.k IS NULL THEN b.first_loaded ELSE a.first_loaded END
  FROM namerefs r LEFT JOIN byname a ON a.k = r.k LEFT JOIN byname b ON b.k = regexp_replace(r.k, '_ph[01]$', '')),
orphans AS (
  SELECT tab, field, row_key, strftime(t, '%Y-%m') AS period,
    CASE WHEN absent THEN 'missing' WHEN gone <= t THEN 'deleted' WHEN first_loaded > t THEN 'late' END AS reason FROM judged)
"""

P5_SQL = """
WITH once AS (SELECT DISTINCT entry_no, u, v, w FROM contacts WHERE u IS NOT NULL AND v IS NOT NULL AND w > 0 AND u <> v),
sums AS (SELECT u, v, CAST(sum(w) AS BIGINT) AS total FROM once GROUP BY u, v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY total DESC, v) AS k FROM sums)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_totals": p5_totals}

SQL = {
    "p4_found": P4_SQL + "SELECT tab, field, row_key, period, reason FROM orphans WHERE reason IS NOT NULL",
    "p4_report": P4_SQL + "SELECT tab, field, period, reason, count(*) AS orphans FROM orphans WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p5_found": P5_SQL + "SELECT u, v FROM ranked WHERE k = 1",
    "p5_totals": P5_SQL + "SELECT u, v, total FROM ranked WHERE k = 1",
}
