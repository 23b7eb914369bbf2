"""Unzipping chains into segments and links, and stitching their sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewright.functions.text import phase_suffix, reverse_complement
from phasewright.operators.graph import numbered


def best_edges(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, src_rev, dst_rev, overlap): for each ordered pair the first edge that leaves forwards, else the first of all."""
    kept = F.min_by(F.struct("src_rev", "dst_rev", "overlap"), F.struct("src_rev", "edge_ord")).alias("e")
    return edges.groupBy("graph_id", "src", "dst").agg(kept).select("graph_id", "src", "dst", "e.*")


def unzip_segments(chains: DataFrame, nodes: DataFrame, phasing: DataFrame) -> DataFrame:
    """(graph_id, part, chain_idx, pos, node_id, name, length, coverage, phase): one segment per node of a chain.

    In the chains of a haplotype (part 0 or 1) nodes outside all bubbles get
    the haplotype's suffix; a length of 0 falls back on the sequence's.
    """
    inside = phasing.select("node_id", F.lit(True).alias("in_bubble")).distinct()
    own = chains.join(nodes, "node_id").join(inside, "node_id", "left")
    suffix = F.when(F.col("in_bubble"), "").otherwise(phase_suffix(F.col("part")))
    return own.select(
        "graph_id", "part", "chain_idx", "pos", "node_id", F.concat("name", suffix).alias("name"),
        F.when(F.col("length") == 0, F.length("seq").cast("long")).otherwise(F.col("length")).alias("length"), "coverage",
        F.when(F.col("part") < 2, F.col("part")).otherwise(-1).alias("phase"),
    )


def numbered_segments(segments: DataFrame) -> DataFrame:
    """Segments with a dense ``seg_idx``: haplotype 0, haplotype 1, unphased; then by graph, chain and place."""
    return numbered(segments.withColumn("__o", F.struct("part", "graph_id", "chain_idx", "pos")), "__o", "seg_idx").drop("__o")


def unzip_links(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, part, chain_idx, pos, src, dst, src_rev, dst_rev, overlap, is_synthetic): each node of a chain to the next.

    Where the graph has no edge between them the link is forward, without
    overlap, and marked synthetic.
    """
    place = Window.partitionBy("graph_id", "part", "chain_idx").orderBy("pos")
    pairs = chains.withColumn("dst", F.lead("node_id").over(place)).where("dst IS NOT NULL").withColumnRenamed("node_id", "src")
    known = pairs.join(best_edges(edges), ["graph_id", "src", "dst"], "left")
    default = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return known.select("graph_id", "part", "chain_idx", "pos", "src", "dst", default("src_rev", False), default("dst_rev", False), default("overlap", 0), F.col("overlap").isNull().alias("is_synthetic"))


def chain_sequences(chains: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, part, chain_idx, seq): the sequences of a chain's nodes, each without what it overlaps its predecessor.

    ``chains`` may have a column ``reverse``; such nodes are reverse
    complemented.  A node no longer than the overlap adds nothing.
    """
    turned = F.col("reverse") if "reverse" in chains.columns else F.lit(False)
    own = chains.withColumn("__r", turned).join(nodes.select("node_id", "seq"), "node_id")
    over = unzip_links(chains.select("graph_id", "part", "chain_idx", "pos", "node_id"), edges)
    place = Window.partitionBy("graph_id", "part", "chain_idx").orderBy("pos")
    own = own.withColumn("__prev", F.lag("pos").over(place))
    own = own.join(over.select("graph_id", "part", "chain_idx", F.col("pos").alias("__prev"), "overlap"), ["graph_id", "part", "chain_idx", "__prev"], "left")
    oriented = F.when(F.col("__r"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    piece = F.substring(oriented, (F.coalesce("overlap", F.lit(0)) + 1).cast("int"), F.length("seq"))
    parts = own.groupBy("graph_id", "part", "chain_idx").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("p"))
    return parts.select("graph_id", "part", "chain_idx", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))
