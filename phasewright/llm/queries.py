"""Queries of the numbered problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewright.llm.components import group_links, links_of_lists
from phasewright.llm.cooccurrence import contig_rows, contigs_together, count_together
from phasewright.llm.leakage import leaked_items
from phasewright.llm.mixing import mix_sources
from phasewright.llm.neardup import graph_records, near_duplicates
from phasewright.llm.spam import score_pages, spam_pages
from phasewright.plans.tables import load


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of contigs that meets in five reads of a library or more, with its surprise under the null."""
    return contigs_together(load(spark, sf, "alignments")).select(
        F.col("s").alias("library_id"), F.col("lo").alias("name_lo"), F.col("hi").alias("name_hi"), "n_both", "n_lo", "n_hi", "n_records", "expected", "log_p", "log_q"
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of the fixed definition, by their counts; ``p1_surprising`` takes the surprise."""
    big = lambda c: F.col(c).cast("decimal(18,0)")
    often = (F.col("n_both") >= 5) & (big("n_both") * big("n_records") >= 4 * (big("n_lo") * big("n_hi")))
    return p1_pairs(spark, sf).where(often).select("library_id", "name_lo", "name_hi")


def p1_surprising(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs that meet more often than the null allows, at a false-discovery rate of one in twenty."""
    return p1_pairs(spark, sf).where(F.col("log_q") <= math.log(0.05)).select("library_id", "name_lo", "name_hi", "n_both", "expected", "log_q")


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The exact counts alone, without the null."""
    together = count_together(contig_rows(load(spark, sf, "alignments")), "library_id", "qname", "rname", 5)
    names = {"s": "library_id", "lo": "name_lo", "hi": "name_hi"}
    return together.named(together.counts).withColumnsRenamed(names).select("library_id", "name_lo", "name_hi", "n_both", "n_lo", "n_hi", "n_records")


def _similar(spark: SparkSession, sf: str):
    return near_duplicates(graph_records(load(spark, sf, "bubbles"), load(spark, sf, "links")), "kind", "id", "member")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _similar(spark, sf).record_pairs().withColumnRenamed("s", "kind")


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record: its class of equal contents and the class's links to similar ones."""
    return _similar(spark, sf).classes().withColumnRenamed("s", "kind")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    nodes = load(spark, sf, "alt_map").select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("alt_id").alias("b"))
    bubbles = links_of_lists(load(spark, sf, "meta_bubbles").withColumn("kind", F.lit("bubble")), "kind", "orig_indices")
    return group_links(nodes.unionByName(bubbles), "kind", "a", "b")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture: every copy of every drawn page, with its text."""
    return mix_sources(load(spark, sf, "documents"), load(spark, sf, "mix_targets")).emitted().withColumnRenamed("doc", "doc_id")


def p7_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn pages with their tokens and the number of copies of each."""
    return mix_sources(load(spark, sf, "documents"), load(spark, sf, "mix_targets")).copies.withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached per source beside those aimed at."""
    return mix_sources(load(spark, sf, "documents"), load(spark, sf, "mix_targets")).shares()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(load(spark, sf, "documents"), load(spark, sf, "test_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam_pages(load(spark, sf, "documents"))


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The features and the distance of every page."""
    return score_pages(load(spark, sf, "documents"))


QUERIES = {
    q.__name__: q for q in (p1_found, p1_pairs, p1_surprising, p1_counts, p2_found, p2_classes, p3_found, p6_found, p7_mixture, p7_copies, p7_shares, p8_found, p8_scores)
}

P1_SQL = """
WITH inc AS (
  SELECT DISTINCT library_id, qname, rname FROM alignments
  WHERE qname IS NOT NULL AND rname IS NOT NULL AND rname <> '*' AND (coalesce(flag, 0) & 1284) = 0),
n AS (SELECT library_id, count(DISTINCT qname) AS n_records FROM inc GROUP BY 1),
c AS (SELECT library_id, rname, count(*) AS k FROM inc GROUP BY 1, 2),
p AS (
  SELECT a.library_id, a.rname AS name_lo, b.rname AS name_hi, count(*) AS n_both
  FROM inc a JOIN inc b ON a.library_id = b.library_id AND a.qname = b.qname AND a.rname < b.rname GROUP BY 1, 2, 3 HAVING count(*) >= 5),
pairs AS (
  SELECT p.*, x.k AS n_lo, y.k AS n_hi, n.n_records FROM p JOIN n USING (library_id)
  JOIN c x ON x.library_id = p.library_id AND x.rname = p.name_lo JOIN c y ON y.library_id = p.library_id AND y.rname = p.name_hi)
"""

P2_SQL = """
WITH rows AS (
  SELECT DISTINCT 'bubble' AS kind, bubble_id AS id, m FROM (
    SELECT bubble_id, unnest(branch_a) AS m FROM bubbles UNION ALL SELECT bubble_id, unnest(branch_b) FROM bubbles) WHERE m IS NOT NULL
  UNION ALL SELECT DISTINCT 'graph', graph_id, source_id FROM links WHERE source_id IS NOT NULL),
size AS (SELECT kind, id, count(*) AS n FROM rows GROUP BY 1, 2),
met AS (
  SELECT a.kind, a.id AS id_lo, b.id AS id_hi, count(*) AS k FROM rows a JOIN rows b ON a.kind = b.kind AND a.m = b.m AND a.id < b.id GROUP BY 1, 2, 3),
similar_pairs AS (
  SELECT met.kind, id_lo, id_hi FROM met JOIN size x ON x.kind = met.kind AND x.id = id_lo JOIN size y ON y.kind = met.kind AND y.id = id_hi
  WHERE k::DOUBLE / (x.n + y.n - k) >= 0.7)
"""

P3_SQL = """
WITH RECURSIVE lists AS (SELECT unnest(orig_indices) AS id, list_min(orig_indices) AS low FROM meta_bubbles),
pairs AS (
  SELECT 'node' AS kind, node_id AS a, alt_id AS b FROM alt_map WHERE node_id IS NOT NULL AND alt_id IS NOT NULL
  UNION SELECT 'bubble', low, id FROM lists WHERE id IS NOT NULL),
edges AS (SELECT kind, a, b FROM pairs UNION SELECT kind, b, a FROM pairs),
ids AS (
  SELECT DISTINCT 'node' AS kind, node_id AS id FROM alt_map WHERE node_id IS NOT NULL UNION SELECT 'node', alt_id FROM alt_map WHERE alt_id IS NOT NULL
  UNION SELECT 'bubble', id FROM lists WHERE id IS NOT NULL),
reach(kind, id, low) AS (
  SELECT kind, id, id FROM ids
  UNION SELECT r.kind, e.b, r.low FROM reach r JOIN edges e ON e.kind = r.kind AND e.a = r.id WHERE r.low < e.b)
"""

SQL = {
    "p1_found": P1_SQL + "SELECT library_id, name_lo, name_hi FROM pairs WHERE n_both * n_records >= 4 * n_lo * n_hi",
    "p1_counts": P1_SQL + "SELECT library_id, name_lo, name_hi, n_both, n_lo, n_hi, n_records FROM pairs",
    "p2_found": P2_SQL + "SELECT kind, id_lo, id_hi FROM similar_pairs",
    "p2_classes": P2_SQL.rstrip()
    + """,
content AS (SELECT kind, id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS c FROM rows GROUP BY 1, 2),
cls AS (SELECT kind, id, min(id) OVER (PARTITION BY kind, c) AS class_id, count(*) OVER (PARTITION BY kind, c) AS copies FROM content),
ways AS (SELECT kind, id_lo AS x, id_hi AS y FROM similar_pairs UNION ALL SELECT kind, id_hi, id_lo FROM similar_pairs),
met_classes AS (
  SELECT w.kind, a.class_id, count(DISTINCT b.class_id) AS links FROM ways w JOIN cls a ON a.kind = w.kind AND a.id = w.x JOIN cls b ON b.kind = w.kind AND b.id = w.y
  WHERE a.class_id <> b.class_id GROUP BY 1, 2)
SELECT cls.kind, id AS record_id, cls.class_id, copies, coalesce(links, 0) AS links FROM cls LEFT JOIN met_classes m ON m.kind = cls.kind AND m.class_id = cls.class_id""",
    "p3_found": P3_SQL + "SELECT kind, id AS member_id, min(low) AS group_id FROM reach GROUP BY kind, id",
}
