"""File formats, graph tables, contacts and naming on small inputs."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from phasewright.functions.text import cigar_length, phase_suffix, reverse_complement, wrapped
from phasewright.operators import contacts as C
from phasewright.operators import graph as G
from phasewright.operators import names as N
from phasewright.operators.evaluate import assignments, evaluation_lines, evaluation_table, parse_report, readable_length, readable_value, wide_metrics
from phasewright.pipeline import load_graph
from phasewright.plans.tables import keep, shared_dir
from phasewright.sources import bam
from phasewright.sources.fasta import fasta_lines, parse_fasta
from phasewright.sources.gfa import parse_links, parse_segments
from phasewright.sources.lines import lines_of, read_lines
from phasewright.sources.pairs import header_kind, listed_pairs, phasing_pairs, split_csv, table_of
from phasewright.sources.sam import contact_records, parse_sam
from phasewright.streaming.contacts import windowed_contacts

GFA = "H\tVN:Z:1.0\nS\ta\tACGTAC\tLN:i:9\tRC:i:4\r\nS\tb\t*\nL\ta\t+\tb\t-\t3M\nL\tz\t-\tb\t+\t2M1I\n\nS\tz\tgg\nS\ta\t*\tXX:i:3\nL\ta\t+\ta\t+\n"


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_cigars(spark):
    df = spark.createDataFrame([("10M2D5",), ("10",), ("*",), ("",), (None,), ("4M3I2S",)], "c string")
    assert [r[0] for r in df.select(cigar_length(F.col("c"))).collect()] == [12, 0, 0, 0, 0, 9]


def test_sequence_text(spark):
    df = spark.createDataFrame([("acgTN-",), ("",), ("A" * 60,), ("C" * 120,), ("G" * 61,)], "s string")
    got = df.select(reverse_complement(F.col("s")).alias("r"), F.size(wrapped(F.col("s"))).alias("n")).collect()
    assert got[0].r == "NNACGT" and [g.n for g in got] == [1, 0, 1, 2, 2]
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (-1,)], "p int").select(phase_suffix(F.col("p"))).collect()] == ["_ph0", "_ph1", ""]


def test_gfa_records(spark):
    lines = lines_of(spark, GFA)
    s = sorted(values(parse_segments(lines), "line_no", "name", "seq", "ln", "rc"))
    assert s == [(2, "a", "ACGTAC", 9, 4), (3, "b", "", None, None), (7, "z", "gg", None, None), (8, "a", "", None, None)]
    links = sorted(values(parse_links(lines), "src", "src_rev", "dst", "dst_rev", "overlap"))
    assert links == [("a", False, "a", False, 0), ("a", False, "b", True, 3), ("z", True, "b", False, 3)]


def test_load_graph(spark):
    fasta = parse_fasta(lines_of(spark, "junk\n>b x\nAC\nGT\n>\nTTT\n>b\nGG\n>a\n\n"))
    nodes, edges = load_graph(lines_of(spark, GFA), fasta)
    assert sorted(values(nodes, "node_id", "name", "seq", "length")) == [(0, "a", "", 0), (1, "b", "ACGT", 0), (2, "z", "gg", 2)]
    e = sorted(values(edges, "edge_ord", "src", "dst", "src_rev", "dst_rev", "overlap"))
    assert e[:2] == [(8, 0, 1, False, True, 3), (9, 1, 0, False, True, 3)] and len(e) == 6 and e[4][1:3] == (0, 0)
    assert sorted(values(G.degrees(edges), "node_id", "out_degree", "in_degree")) == [(0, 3, 3), (1, 2, 2), (2, 1, 1)]
    assert sorted(values(G.split_graph(edges), "src", "dst"))[0] == (0, 0)
    assert sorted(values(G.neighbours(edges, nodes.where("name = 'z'")), "dst")) == [(1,)]
    with pytest.raises(KeyError):
        G.ids_of(spark.createDataFrame([("nobody",)], "name string"), nodes, strict=True)


def test_lines_and_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {k}\n" for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = sorted(values(read_lines(spark, str(tmp_path / "t.txt")), "line_no", "value"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k + 1, f"line {k}") for k in range(500)]


def test_components(spark):
    nodes = spark.createDataFrame([(0, k) for k in range(12)] + [(1, 3)], "graph_id long, node_id long")
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(7)] + [(0, 9, 8), (0, 5, 5)], "graph_id long, src long, dst long")
    got = {(g, n): c for g, n, c in values(G.weak_components(nodes, edges), "graph_id", "node_id", "component")}
    assert got == {**{(0, k): 0 for k in range(8)}, (0, 8): 8, (0, 9): 8, (0, 10): 10, (0, 11): 11, (1, 3): 3}
    assert G.weak_components(nodes.where("false"), edges.where("false")).collect() == []


SAM = "@SQ\tSN:a\nr1\t99\ta\t1\t60\t5M\tb\t9\t0\t*\t*\nr1\t147\tb\t9\t60\t5M\ta\t1\t0\t*\t*\nr2\t65\ta\t1\t0\t5M\t=\t3\t0\t*\t*\n" + "".join(
    f"r{k}\t{65 + flag}\ta\t1\t0\t5M\tb\t3\t0\t*\t*\n" for k, flag in enumerate((0x100, 0x800, 0x4, 0x8, 0x200, 0x400))
)


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    links = [(g, r.randrange(300), r.randrange(300)) for g in (1, 2) for _ in range(170)] + [(3, k, k + 1) for k in range(500)] + [(4, 0, k) for k in range(1, 200)] + [(5, 7, 7), (5, 8, None), (None, 1, 2)]
    nodes = [(5, 9), (5, None), (1, 900), (None, 3)]
    want = {}
    for g, *ends in links + nodes:
        for x in ends:
            if g is not None and x is not None:
                want[g, x] = x
    changed = True
    while changed:
        changed = False
        for g, u, v in links:
            if None not in (g, u, v) and want[g, u] != want[g, v]:
                want[g, u] = want[g, v] = min(want[g, u], want[g, v])
                changed = True
    e = spark.createDataFrame(links, "graph_id long, src long, dst long")
    got = {(x.graph_id, x.node_id): x.component for x in G.weak_components(spark.createDataFrame(nodes, "graph_id long, node_id long"), e).collect()}
    assert got == want
    none = e.where("false")
    assert G.weak_components(none.select("graph_id", F.col("src").alias("node_id")), none).collect() == []


def test_shared_folder(spark):
    from types import SimpleNamespace

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(RuntimeError):
        shared_dir(far)
    far.conf.get = lambda *a: "hdfs:///shared/"
    assert shared_dir(far) == "hdfs:///shared"
    kept = keep(spark.range(5), n=F.count(F.lit(1)))
    assert kept.stats["n"] == 5 and kept.df.count() == 5 and spark.sparkContext.applicationId in kept.path


def test_contacts(spark):
    records = parse_sam(lines_of(spark, SAM + "r9\t65\tq\t1\t0\t5M\tb\t3\t0\t*\t*\n"))
    assert contact_records(records).count() == 5
    names = spark.createDataFrame([("a", 4), ("b", 2)], "name string, node_id long")
    counts = C.contact_counts(records, names)
    assert sorted(values(counts, "u", "v", "w")) == [(2, 4, 3), (4, 4, 1)]
    assert sorted(values(C.symmetric(counts), "u", "v", "w")) == [(2, 4, 3), (4, 2, 3), (4, 4, 1)]
    weighted = spark.createDataFrame([(0, 1, 7), (0, 2, 4), (1, 2, 2), (0, 3, 9), (2, 4, 6), (3, 4, 5), (4, 5, 1)], "u long, v long, w long")
    kept = C.among(weighted, spark.createDataFrame([(0,), (1,), (2,)], "node_id long"))
    assert sorted(values(kept, "w")) == [(2,), (4,), (7,)]
    asked = C.looked_up(spark.createDataFrame([(3, 0), (1, 5)], "a long, b long"), weighted)
    assert sorted(values(asked, "a", "b", "w")) == [(1, 5, 0), (3, 0, 9)]
    summed = C.summed(spark.createDataFrame([(2, 1, 3), (1, 2, None), (None, 1, 2), (1, 2, 4)], "u long, v long, w long"))
    assert values(summed, "u", "v", "w") == [(1, 2, 7)]


def test_streamed_contacts(spark, tmp_path):
    rows = spark.createDataFrame([(65, "a", "b", f"2024-01-01 0{k % 3}:10:00") for k in range(9)], "flag int, rname string, rnext string, t string").selectExpr("*", "CAST(t AS TIMESTAMP) AS aligned_at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_contacts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(values(spark.table("streamed"), "n")) == sorted(values(windowed_contacts(rows), "n")) == [(3,), (3,), (3,)]


def test_bam(spark, tmp_path):
    def record(name, flag, ref, mate):
        body = struct.pack("<iiBBHHHiiii", ref, 4, len(name) + 1, 60, 0, 0, flag, 0, mate, 8, 0) + name.encode() + b"\0"
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 2) + n + b"\0" + struct.pack("<i", 100) for n in (b"a", b"b"))
    with open(tmp_path / "x.bam", "wb") as out:
        out.write(gzip.compress(head) + gzip.compress(record("r1", 65, 0, 1) + record("r2", 69, -1, 1)))
    bam.register(spark)
    got = spark.read.format("bam").load(str(tmp_path / "x.bam"))
    assert sorted(values(got, "qname", "flag", "rname", "rnext", "pos")) == [("r1", 65, "a", "b", 5), ("r2", 69, "*", "b", 5)]
    assert contact_records(got).count() == 1


NAMES = ["PR.1.0", "PR.1.1", "contig1.0", "contig1.1", "base.0", "base.1", "base.2", "000001F", "000001F_003", "unique"]


def test_names(spark):
    nodes = spark.createDataFrame(list(enumerate(NAMES)), "node_id long, name string")
    assert N.style_votes(nodes).first().asDict() == {"classic": 2, "pr": 2, "dot": 7, "hifiasm": 0, "verkko": 0}
    assert sorted(values(N.name_pairs(nodes), "node_id", "alt_id")) == [(0, 1), (1, 0), (2, 3), (3, 2)]
    utg = spark.createDataFrame([(0, "utg_1"), (1, "utg_2"), (2, "x")], "node_id long, name string")
    assert N.detect_style(utg) == "classic" and sorted(values(N.name_pairs(utg), "node_id", "alt_id")) == [(0, 1), (1, 0)]
    assert N.name_pairs(utg, "verkko").count() == 0


def test_pair_lists(spark):
    nodes = spark.createDataFrame([(k, n) for k, n in enumerate("abcd")], "node_id long, name string")
    kind, rows = table_of(lines_of(spark, "name_a,name_b,x\na,b,1\nb,a,2\na,nobody\nc,c,\nc,d\n,d"))
    assert kind == "pairs"
    assert sorted(values(N.pairs_of_names(listed_pairs(rows), nodes), "node_id", "alt_id")) == [(0, 1), (1, 0), (2, 3), (3, 2)]
    kind, rows = table_of(lines_of(spark, "Name,Position in bubble chain,Ploidy,Bubble chain,Component,Haplotype\na,0,2,1,0,0\nb,0,2,1,0,1\nc,1,2,1,0,0\nd,1,1,1,0,1\nc,0,2,1,0,1\n,2,2,1,0,0"))
    assert kind == "phasing" and sorted(values(phasing_pairs(rows), "name_a", "name_b")) == [("a", "c")]
    for bad in ("foo,bar,baz", None, ""):
        with pytest.raises(ValueError):
            header_kind(bad)
    assert spark.range(1).select(split_csv(F.lit('a,"b,,'))).first()[0] == ["a", '"b', "", ""]


def test_fasta(spark):
    rows = spark.createDataFrame([("x", "A" * 61), ("y", "")], "name string, seq string")
    assert [len(r.lines) for r in fasta_lines(rows).collect()] == [3]
    assert sorted(values(parse_fasta(lines_of(spark, ">x d\nAA\n>y\tz\n\nC\n"), chunk=2), "rec_no", "name", "seq")) == [(1, "x", "AA"), (2, "y", "C")]


def test_evaluation(spark):
    report = parse_report(lines_of(spark, "Assembly\tx\n# contigs\t12\nN50\tn/a\nUnknown\t3\n# contigs\t13\nalone"))
    assert {r.metric: (r.raw, r.value) for r in report.collect()} == {"contig_count": ("13", 13.0), "half_length": ("n/a", None)}
    rows = [("t", p, r, g, 0.0, 0.0) for p, r, g in ((0, "pat", 90.0), (1, "mat", 80.0), (0, "mat", 10.0), (1, "pat", None))] + [("u", 0, "pat", 1.0, 1.0, 1.0)]
    got = {r.tool: r.phase0_parent for r in assignments(spark.createDataFrame(rows, "tool string, phase int, ref string, genome_fraction double, mismatches double, indels double")).collect()}
    assert got == {"t": "PATERNAL", "u": "?"}
    assert [r[0] for r in spark.createDataFrame([(2_500_000,), (None,)], "n long").select(readable_length(F.col("n"))).collect()] == ["2.50 Mb", "-"]


def test_evaluation_report(spark):
    figures = {("x", 0, "pat"): 90, ("x", 1, "mat"): 80, ("x", 0, "mat"): 20, ("x", 1, "pat"): 30, ("y", 0, "pat"): 10, ("y", 1, "mat"): 10, ("y", 0, "mat"): 60, ("y", 1, "pat"): 50.5, ("z", 0, "pat"): 99}
    lines = [(*key, k, v) for key, g in figures.items() for k, v in enumerate(["junk", "N50\t1", f"Genome fraction (%)\t{g}", "N50\t2500000", "# mismatches per 100 kbp\t0", "# indels per 100 kbp\t-", "Total length\t"])]
    parsed = parse_report(spark.createDataFrame(lines, "tool string, phase int, ref string, line_no int, value string"), "tool", "phase", "ref")
    wide = wide_metrics(parsed, "tool", "phase", "ref")
    table = {(r.tool, r.phase, r.ref): r for r in evaluation_table(wide).collect()}
    assert len(table) == 9 and table["x", 0, "pat"].parent == "PATERNAL" and table["x", 1, "pat"].parent == "MATERNAL" and table["y", 0, "mat"].parent == "MATERNAL" and table["z", 0, "pat"].parent == "?"
    assert [table[t, 0, "pat"].place for t in "xyz"] == [1, 2, 3]
    row = table["y", 1, "pat"]
    assert (row.genome_fraction, row.half_length, row.mismatches, row.indels, row.assembly_bases) == ("50.500", "2.50 Mb", "0", "-", "-")
    text = {(r.tool, r.line_no): r.line for r in evaluation_lines(evaluation_table(wide)).collect()}
    assert text["x", 0] == "1. x: phase 0 PATERNAL, phase 1 MATERNAL" and text["z", 2] == "  phase 0 against mat: no data" and "genome_fraction 50.500" in text["y", 3] and len(text) == 15
    v = spark.createDataFrame([(3.0,), (2.5,), (None,)], "v double")
    assert [r[0] for r in v.select(readable_value(F.col("v"))).collect()] == ["3", "2.500", "-"]
    assert evaluation_table(wide.where("false")).collect() == []
