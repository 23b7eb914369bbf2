"""Graph tables made from the given ones, and the same as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasewright.functions.text import cigar_length
from phasewright.operators.graph import last_segments, mirrored_edges
from phasewright.plans.tables import load


def segment_records(spark: SparkSession, sf: str) -> DataFrame:
    """All S records; shared contigs count as line 0."""
    own = load(spark, sf, "segments").select("line_no", "node_id", "name", "seq", "ln", "rc")
    return own.unionByName(load(spark, sf, "shared_segments").select(F.lit(0).cast("long").alias("line_no"), "node_id", "name", "seq", "ln", "rc"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return last_segments(segment_records(spark, sf))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """L records with the overlap given or read off the CIGAR."""
    return load(spark, sf, "links").withColumn("overlap", F.coalesce("overlap_length", cigar_length(F.col("cigar"))))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return mirrored_edges(links(spark, sf))


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the contact matrix: equal rows of one entry count once, rows without an entry number each."""
    own = load(spark, sf, "contacts").groupBy("entry_no", "u", "v", "w").agg(F.count(F.lit(1)).alias("n"))
    times = F.when(F.col("entry_no").isNull(), F.col("n")).otherwise(F.lit(1))
    return own.select("u", "v", (F.col("w") * times).alias("w"))


def alts(spark: SparkSession, sf: str) -> DataFrame:
    """(node_id, alt_id) in both directions, unique on node_id: of several alts the last row's wins."""
    own = load(spark, sf, "alt_map").where("node_id IS NOT NULL AND alt_id IS NOT NULL AND node_id <> alt_id")
    turn = lambda x, y: F.struct(F.col(x).alias("n"), F.col(y).alias("alt"))
    rows = own.select("pair_no", F.explode(F.array(turn("node_id", "alt_id"), turn("alt_id", "node_id"))).alias("p"))
    return rows.groupBy(F.col("p.n").alias("node_id")).agg(F.max_by("p.alt", F.struct("pair_no", "p.alt")).alias("alt_id"))


def phased(spark: SparkSession, sf: str) -> DataFrame:
    """(node_id, phase): the lower id of each alt pair on haplotype 0, the higher on 1."""
    return alts(spark, sf).select("node_id", F.when(F.col("node_id") < F.col("alt_id"), 0).otherwise(1).cast("byte").alias("phase"))


def locks(spark: SparkSession, sf: str) -> DataFrame:
    """(node_id, phase) of the nodes that were unzipped on one haplotype only."""
    own = load(spark, sf, "uz_segments").where("src_id IS NOT NULL").groupBy(F.col("src_id").alias("node_id")).agg(F.min("phase").alias("phase"), F.max("phase").alias("high"))
    return own.where("phase = high AND phase >= 0").select("node_id", F.col("phase").cast("byte").alias("phase"))


def chain_table(spark: SparkSession, sf: str) -> DataFrame:
    """(graph_id, part, chain_idx, pos, node_id): the unzipped segments of a graph file and phase, in order, as one chain."""
    own = load(spark, sf, "uz_segments").where("src_id IS NOT NULL AND graph_id IS NOT NULL")
    part = F.when(F.col("phase") >= 0, F.col("phase").cast("int")).otherwise(2)
    place = Window.partitionBy("graph_id", part).orderBy("seg_idx")
    pos = (F.row_number().over(place) - 1).cast("long")
    return own.select("graph_id", part.alias("part"), F.lit(0).cast("long").alias("chain_idx"), pos.alias("pos"), F.col("src_id").alias("node_id"))


def bubble_rows(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "bubbles").select(F.col("bubble_id").alias("bubble"), "branch_a", "branch_b")


SEGMENTS = "segs AS (SELECT line_no, node_id, name, seq, ln, rc FROM segments UNION ALL SELECT 0, node_id, name, seq, ln, rc FROM shared_segments)"
NODES = (
    SEGMENTS
    + """,
nodes AS (
  SELECT node_id, name, coalesce(seq, '') AS seq, coalesce(ln, len(coalesce(seq, ''))) AS length, coalesce(rc, 0) AS coverage FROM (
    SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY line_no DESC) AS k FROM segs WHERE node_id IS NOT NULL) WHERE k = 1)"""
)
CIGAR = r"CAST(coalesce(list_sum(list_transform(regexp_extract_all({0}, '(\d+)\D', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT)"
EDGES = (
    "l AS (SELECT graph_id, link_no, source_id AS u, target_id AS v, coalesce(source_rev, false) AS ur, coalesce(target_rev, false) AS vr, coalesce(overlap_length, "
    + CIGAR.format("coalesce(cigar, '')")
    + """) AS overlap FROM links WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
edges AS (
  SELECT graph_id, u AS src, v AS dst, ur AS src_rev, vr AS dst_rev, link_no * 2 AS edge_ord, overlap FROM l
  UNION ALL SELECT graph_id, v, u, NOT vr, NOT ur, link_no * 2 + 1, overlap FROM l)"""
)
CONTACTS = """once AS (
  SELECT DISTINCT entry_no, u, v, w FROM contacts WHERE entry_no IS NOT NULL UNION ALL SELECT entry_no, u, v, w FROM contacts WHERE entry_no IS NULL),
summed AS (SELECT least(u, v) AS u, greatest(u, v) AS v, CAST(sum(coalesce(w, 0)) AS BIGINT) AS w FROM once WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2)"""
ALTS = """turned AS (
  SELECT pair_no, node_id AS n, alt_id AS alt FROM alt_map WHERE node_id <> alt_id
  UNION ALL SELECT pair_no, alt_id, node_id FROM alt_map WHERE node_id <> alt_id),
alts AS (SELECT n AS node_id, alt AS alt_id FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY pair_no DESC, alt DESC) AS k FROM turned) WHERE k = 1)"""
PHASED = ALTS + ",\nphased AS (SELECT node_id, CASE WHEN node_id < alt_id THEN 0 ELSE 1 END AS phase FROM alts)"
LOCKS = """locks AS (
  SELECT src_id AS node_id, min(phase) AS phase FROM uz_segments WHERE src_id IS NOT NULL GROUP BY src_id HAVING min(phase) = max(phase) AND min(phase) >= 0)"""
CHAIN = """chain AS (
  SELECT graph_id, CASE WHEN phase >= 0 THEN phase ELSE 2 END AS part, 0 AS chain_idx,
    row_number() OVER (PARTITION BY graph_id, CASE WHEN phase >= 0 THEN phase ELSE 2 END ORDER BY seg_idx) - 1 AS pos, src_id AS node_id
  FROM uz_segments WHERE src_id IS NOT NULL AND graph_id IS NOT NULL)"""
