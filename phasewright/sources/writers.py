"""Writing graphs, sequences and labels as text.

Every output is a folder of part files that are in order by name, so that
``cat part-*`` is the whole file and no task has to write all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewright.sources.fasta import fasta_lines
from phasewright.sources.gfa import link_line, path_line, segment_line

PARTS = ("ph0", "ph1", "un")
#: The FASTA files of the parts (fixed names of the format).
FILES = ("phase_0", "phase_1", "unphased")


def write_lines(lines: DataFrame, path: str) -> None:
    """``lines``: order (any comparable column), line."""
    lines.repartitionByRange("order").sortWithinPartitions("order").select("line").write.mode("overwrite").text(path)


def _order(kind: int, *columns):
    """A key that sorts by record type, then by up to four numbers."""
    cols = [F.col(c).cast("long") for c in columns] + [F.lit(0).cast("long")] * (4 - len(columns))
    return F.struct(F.lit(kind).alias("kind"), *[c.alias(f"k{i}") for i, c in enumerate(cols)]).alias("order")


def chained_gfa(nodes: DataFrame, phases: DataFrame, edges: DataFrame, chains: DataFrame) -> DataFrame:
    """(order, line): all nodes with their phase, one link per unordered pair (the first at the lower id), one path per chain."""
    own = nodes.join(phases.select("node_id", "phase"), "node_id", "left").withColumn("length", F.when(F.col("length") == 0, F.length("seq").cast("long")).otherwise(F.col("length")))
    s = own.select(_order(0, "node_id"), segment_line(F.col("name"), F.col("seq"), F.col("length"), F.col("coverage"), F.coalesce("phase", F.lit(-1))).alias("line"))
    low = edges.where("src <= dst").groupBy("src", "dst").agg(F.min_by(F.struct("src_rev", "dst_rev", "overlap", "edge_ord"), "edge_ord").alias("e"))
    n = nodes.select("node_id", "name")
    low = low.join(n.select(F.col("node_id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("b")), "dst").withColumn("ord", F.col("e.edge_ord"))
    links = low.select(_order(1, "src", "ord"), link_line(F.col("a"), F.col("e.src_rev"), F.col("b"), F.col("e.dst_rev"), F.col("e.overlap")).alias("line"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: F.concat(x["name"], F.lit("+")))
    walks = chains.join(n, "node_id").groupBy("part", "chain_idx").agg(steps.alias("steps"))
    tag = F.concat_ws("_", F.lit("chain"), F.element_at(F.array(*[F.lit(p) for p in PARTS]), F.col("part") + 1), F.col("chain_idx").cast("string"))
    return s.unionByName(links).unionByName(walks.select(_order(2, "part", "chain_idx"), path_line(tag, F.col("steps")).alias("line")))


def unzipped_gfa(segments: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(order, line) of the unzipped graph; segments carry the sequence of their node."""
    own = segments.join(nodes.select("node_id", "seq"), "node_id")
    s = own.select(_order(0, "part", "graph_id", "chain_idx", "pos"), segment_line(F.col("name"), F.col("seq"), F.col("length"), F.col("coverage"), F.col("phase")).alias("line"))
    key = ["graph_id", "part", "chain_idx"]
    a = segments.select(*key, "pos", F.col("name").alias("a"))
    b = segments.select(*key, (F.col("pos") - 1).alias("pos"), F.col("name").alias("b"))
    both = links.join(a, [*key, "pos"]).join(b, [*key, "pos"])
    return s.unionByName(both.select(_order(1, "part", "graph_id", "chain_idx", "pos"), link_line(F.col("a"), F.col("src_rev"), F.col("b"), F.col("dst_rev"), F.col("overlap")).alias("line")))


def haplotype_fasta(sequences: DataFrame, part: int) -> DataFrame:
    """(order, line) of one haplotype's chains; chains without a sequence are left out and keep their number."""
    own = sequences.where(F.col("part") == part).withColumn("name", F.concat_ws("_", F.lit(PARTS[part]), F.col("chain_idx").cast("string")))
    return fasta_lines(own).select("chain_idx", F.posexplode("lines").alias("k", "line")).select(_order(0, "chain_idx", "k"), "line")


def phase_labels(nodes: DataFrame, phases: DataFrame) -> DataFrame:
    """(contig_id, phase) of the nodes on a haplotype."""
    return nodes.join(phases.where("phase >= 0"), "node_id").select(F.col("name").alias("contig_id"), F.col("phase").cast("int").alias("phase"))
