"""Command line: from a graph and read pairs to phased graphs, sequences and labels."""

from __future__ import annotations

import argparse
import functools
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewright.operators import bubbles as B
from phasewright.operators import chain as H
from phasewright.operators import contacts as C
from phasewright.operators import graph as G
from phasewright.operators import kmers as K
from phasewright.operators import names as N
from phasewright.operators import phase as P
from phasewright.operators import unzip as U
from phasewright.plans.shipping import ship
from phasewright.plans.tables import is_empty, keep, release
from phasewright.sources import bam, writers
from phasewright.sources.fasta import parse_fasta
from phasewright.sources.gfa import parse_links, parse_segments
from phasewright.sources.lines import read_lines
from phasewright.sources.pairs import listed_pairs, phasing_pairs, table_of
from phasewright.sources.sam import parse_sam


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="phasewright", description=__doc__)
    p.add_argument("-g", "--gfa", required=True, help="assembly graph")
    p.add_argument("-b", "--bam", required=True, help="read pairs: a SAM or BAM file, or a folder of BAM files")
    p.add_argument("-f", "--fasta", help="sequences for segments that have none")
    p.add_argument("-p", "--pat", help="paternal sequences (FASTA)")
    p.add_argument("-m", "--mat", help="maternal sequences (FASTA)")
    p.add_argument("--bubble-mode", choices=("name", "minhash", "csv"), default="minhash")
    p.add_argument("--csv-file", help="pair list or phasing table for the mode csv")
    p.add_argument("--kmer-size", type=int, default=16)
    p.add_argument("--sketch-size", type=int, default=1000)
    p.add_argument("--jaccard-threshold", type=float, default=0.9)
    way = p.add_mutually_exclusive_group()
    way.add_argument("--simple-chainer", action="store_true", help="greedy chains")
    way.add_argument("--hamiltonian", action="store_true", help="Hamiltonian paths (default)")
    p.add_argument("-t", "--samples", type=int, default=4, help="phasing samples per round")
    p.add_argument("--out-dir", default=".")
    p.add_argument("--prefix", help="default: the graph's file name without its ending")
    return p


def load_graph(lines: DataFrame, fasta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GFA lines; ids follow the order in which names appear, and FASTA records fill what is empty."""
    s, links = keep(parse_segments(lines)).df, keep(parse_links(lines)).df
    ids = keep(G.node_dictionary(s.select("line_no", "name"), links.select("line_no", "src", "dst"))).df
    nodes = ids.join(G.last_segments(s.withColumn("key", F.col("name")), "key").drop("name").withColumnRenamed("key", "name"), "name", "left")
    nodes = nodes.select("node_id", "name", F.coalesce("seq", F.lit("")).alias("seq"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("length", "coverage")])
    if fasta is not None:
        nodes = G.filled_sequences(nodes, fasta, "name", "rec_no")
    end = lambda name, id_: ids.select(F.col("name").alias(name), F.col("node_id").alias(id_))
    own = links.join(end("src", "source_id"), "src").join(end("dst", "target_id"), "dst")
    own = own.select(F.lit(0).cast("long").alias("graph_id"), F.col("line_no").alias("link_no"), "source_id", "target_id", F.col("src_rev").alias("source_rev"), F.col("dst_rev").alias("target_rev"), "overlap")
    return keep(nodes).df, keep(G.mirrored_edges(own)).df


def find_alts(spark: SparkSession, nodes: DataFrame, edges: DataFrame, mode: str, csv_file: str | None = None, k: int = 16, size: int = 1000, threshold: float = 0.9) -> DataFrame:
    """(node_id, alt_id) of all phasing nodes; the alt may be null."""
    if mode == "name":
        return N.name_pairs(nodes)
    if mode == "csv":
        kind, rows = table_of(read_lines(spark, csv_file))
        return N.pairs_of_names(phasing_pairs(rows) if kind == "phasing" else listed_pairs(rows), nodes)
    if is_empty(nodes.where("seq <> ''")):
        raise ValueError("the graph has no sequences to compare")
    found = B.superbubbles(edges).select(F.col("emit_seq").alias("bubble"), "branch_a", "branch_b")
    return B.unlabelled_alts(keep(found).df, edges, nodes, k, size, threshold)


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, total): the rows of a run's tables, the weight of its contacts, nodes per phase and chains per part."""
    count = F.count(F.lit(1))
    parts = [tables[name].agg(count.alias("total")).select(F.lit(name).alias("name"), "total") for name in ("nodes", "edges", "contacts", "alts", "locked", "segments", "links")]
    parts.append(tables["contacts"].agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("total")).select(F.lit("contact weight").alias("name"), "total"))
    parts.append(tables["phases"].groupBy("phase").agg(count.alias("total")).select(F.format_string("nodes of phase %d", F.col("phase").cast("int")).alias("name"), "total"))
    parts.append(tables["chains"].where("pos = 0").groupBy("part").agg(count.alias("total")).select(F.format_string("chains of part %d", "part").alias("name"), "total"))
    return functools.reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """All stages; writes the outputs and returns the tables behind them."""
    fasta = parse_fasta(read_lines(spark, a.fasta)) if a.fasta else None
    nodes, edges = load_graph(read_lines(spark, a.gfa), fasta)
    if a.bam.endswith(".sam"):
        records = parse_sam(read_lines(spark, a.bam))
    else:
        bam.register(spark)
        records = spark.read.format("bam").load(a.bam)
    contacts = C.contact_counts(records, nodes.select("name", "node_id"))
    alts = keep(find_alts(spark, nodes, edges, a.bubble_mode, a.csv_file, a.kmer_size, a.sketch_size, a.jaccard_threshold)).df
    contacts = keep(C.among(contacts, alts)).df
    locked = spark.createDataFrame([], "node_id long, phase byte")
    if a.pat:
        parents = [K.kmer_set(parse_fasta(read_lines(spark, path))) for path in (a.pat, a.mat)]
        locked = keep(K.trio_locks(K.trio_scores(nodes, *parents), alts)).df
    pairs = alts.where("alt_id IS NOT NULL")
    phases = keep(P.assign_phases(contacts, pairs, locked, P.PhaserConfig(samples=a.samples))).df
    members = nodes.select(F.lit(0).cast("long").alias("graph_id"), "node_id")
    own, kept = H.phase_subgraph(edges, members, phases, alts)
    chains = keep(H.chains(own, kept, contacts, not a.simple_chainer).unionByName(H.unphased_chains(members, phases, alts))).df
    segments = keep(U.numbered_segments(U.unzip_segments(chains, nodes, alts))).df
    links = keep(U.unzip_links(chains, edges)).df
    sequences = keep(U.chain_sequences(chains, nodes, edges)).df
    at = os.path.join(a.out_dir, a.prefix or os.path.splitext(os.path.basename(a.gfa))[0])
    writers.write_lines(writers.chained_gfa(nodes, phases, edges, chains), f"{at}.chained.gfa")
    writers.write_lines(writers.unzipped_gfa(segments, links, nodes), f"{at}.unzipped.gfa")
    for part, name in enumerate(writers.FILES):
        writers.write_lines(writers.haplotype_fasta(sequences, part), f"{at}.{name}.fasta")
    writers.phase_labels(nodes, phases).write.mode("overwrite").csv(f"{at}.labels.csv", header=True)
    out = {"nodes": nodes, "edges": edges, "contacts": contacts, "alts": alts, "locked": locked, "phases": phases, "chains": chains, "segments": segments, "links": links, "sequences": sequences}
    return out | {"totals": totals(out)}


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if bool(a.pat) != bool(a.mat):
        parser().error("--pat and --mat belong together")
    if a.bubble_mode == "csv" and not a.csv_file:
        parser().error("--bubble-mode csv needs --csv-file")
    try:
        spark = SparkSession.builder.appName("phasewright").getOrCreate()
        ship(spark)
        for row in run(spark, a)["totals"].sort("name").collect():
            print(f"{row['name']}: {row['total']}")
        release(spark)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
