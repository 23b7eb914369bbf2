"""Queries over text: records of the tables written as lines of a format and parsed again, and the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewright.functions.text import wrapped
from phasewright.operators import evaluate as E
from phasewright.operators.graph import numbered
from phasewright.pipeline import load_graph
from phasewright.plans import domain as D
from phasewright.plans.tables import keep, load
from phasewright.sources.fasta import parse_fasta
from phasewright.sources.gfa import parse_links, parse_segments, segment_line
from phasewright.sources.pairs import phasing_pairs, table_of
from phasewright.sources.sam import parse_sam

#: L lines come after all S lines.
AFTER = 1_000_000_000_000
COLUMNS = ("Name", "Position in bubble chain", "Ploidy", "Bubble chain", "Component", "Haplotype", "Length", "Color")


def _segment_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = load(spark, sf, "segments")
    none = F.lit(0).cast("long")
    return own.select("line_no", segment_line(F.col("name"), F.col("seq"), F.coalesce("ln", none), F.coalesce("rc", none)).alias("value"))


def _link_lines(spark: SparkSession, sf: str) -> DataFrame:
    """L lines whose ends are the names of segments; ends without a segment get the name ``node`` and their number, a carriage return ends each line."""
    names = D.nodes(spark, sf).select("node_id", "name")
    of = lambda end, name: names.select(F.col("node_id").alias(end), F.col("name").alias(name))
    own = load(spark, sf, "links").where("source_id IS NOT NULL AND target_id IS NOT NULL").join(of("source_id", "a"), "source_id", "left").join(of("target_id", "b"), "target_id", "left")
    name = lambda n, i: F.coalesce(n, F.concat(F.lit("node"), F.col(i).cast("string")))
    sign = lambda rev: F.when(F.col(rev), "-").otherwise("+")
    line = F.concat_ws("\t", F.lit("L"), name("a", "source_id"), sign("source_rev"), name("b", "target_id"), sign("target_rev"), F.coalesce("cigar", F.lit("*")))
    return own.select((F.col("link_no") + AFTER).alias("line_no"), F.concat(line, F.lit("\r")).alias("value"))


def gfa_segments(spark: SparkSession, sf: str) -> DataFrame:
    """S lines read back; lines of other kinds between them are ignored."""
    lines = _segment_lines(spark, sf)
    others = lines.select("line_no", F.explode(F.array(F.lit("H\tVN:Z:1.0"), F.lit("# S a comment"), F.lit(""))).alias("value"))
    return parse_segments(lines.unionByName(others))


def gfa_links(spark: SparkSession, sf: str) -> DataFrame:
    return parse_links(_link_lines(spark, sf)).select((F.col("line_no") - AFTER).alias("link_no"), "src", "src_rev", "dst", "dst_rev", "cigar", "overlap")


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return load_graph(_segment_lines(spark, sf).unionByName(_link_lines(spark, sf)))


def gfa_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes of a graph loaded from lines, those that only links name among them."""
    return _graph(spark, sf)[0].select("node_id", "name", "seq", "length", "coverage")


def gfa_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of a graph loaded from lines, both ways, by name."""
    nodes, edges = _graph(spark, sf)
    of = lambda end, name: nodes.select(F.col("node_id").alias(end), F.col("name").alias(name))
    return edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("a", "b", "src_rev", "dst_rev", "overlap")


def fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    """FASTA records read back, in order; what stands behind the name in a header is no part of it."""
    own = load(spark, sf, "segments").select("line_no", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), F.col("name"), F.lit(" segment"))), wrapped(F.col("seq")))).alias("k", "value"))
    lines = numbered(own.select(F.struct("line_no", "k").alias("__o"), "value"), "__o", "line_no", 1).select("line_no", "value")
    return parse_fasta(lines, 1000)


def sam_records(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment lines read back; header lines are skipped."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext")]
    rows = load(spark, sf, "alignments").select(F.lit(1).alias("line_no"), F.concat_ws("\t", *text, F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*")).alias("value"))
    heads = load(spark, sf, "segments").select(F.lit(0).alias("line_no"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name")).alias("value"))
    return parse_sam(rows.unionByName(heads)).select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext")


def csv_phasing_table(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names read from the lines of a phasing table; rows of another ploidy, without a name, or without a partner give none."""
    uz = load(spark, sf, "uz_segments").where("name IS NULL OR NOT name RLIKE '[,\\n\\r]'")
    word = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = (word(F.col("name")), word(F.col("length")), F.when(F.col("phase") >= 0, "2").otherwise("1"), word(F.col("graph_id")), F.lit("0"), word(F.col("phase")), word(F.col("length")), F.lit("red"))
    rows = uz.select((F.col("seg_idx") + 2).alias("line_no"), F.concat_ws(",", *fields).alias("value"))
    head = spark.range(1).select(F.lit(1).cast("long").alias("line_no"), F.lit(",".join(COLUMNS)).alias("value"))
    kind, table = table_of(keep(head.unionByName(rows)).df)
    assert kind == "phasing"
    return phasing_pairs(table).select("name_a", "name_b")


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """(tool, phase, ref, line_no, value): a report for each naming prefix, phase and parity of the coverage, from figures of the unzipped segments."""
    uz = load(spark, sf, "uz_segments").where("phase >= 0 AND length(name) >= 3")
    of = uz.groupBy(F.substring("name", 1, 3).alias("tool"), "phase", F.when(F.col("coverage") % 2 == 0, "pat").otherwise("mat").alias("ref"))
    per = of.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.max("length").alias("longest"), F.max("coverage").alias("c"))
    text = lambda c: c.cast("string")
    lines = [
        ("Assembly", F.lit("given")), ("# contigs", F.lit("0")), ("# contigs", text(F.col("n"))), ("Total length", text(F.col("total"))), ("Largest contig", text(F.col("longest"))), ("N50", F.lit("-")),
        ("Genome fraction (%)", text(F.col("total") % 100)), ("# mismatches per 100 kbp", text(F.col("n") % 7)), ("# indels per 100 kbp", text(F.col("c") % 5)), ("Reference length", text(F.col("total") * 2)),
        ("Duplication ratio", text(F.when(F.col("n") > 3, F.col("n") % 9 / 8))), ("not known", F.lit("5")),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("line_no"), F.concat_ws("\t", F.lit(label), value).alias("value")) for k, (label, value) in enumerate(lines)])).alias("x")
    return per.select("tool", "phase", "ref", rows).select("tool", "phase", "ref", "x.*")


def report_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics read from the lines of evaluation reports."""
    return E.parse_report(_reports(spark, sf), "tool", "phase", "ref")


def evaluation_table(spark: SparkSession, sf: str) -> DataFrame:
    """The reports side by side as text, with the parent given to each phase and the place of each tool."""
    return E.evaluation_table(E.wide_metrics(report_metrics(spark, sf), "tool", "phase", "ref"))


QUERIES = {q.__name__: q for q in (gfa_segments, gfa_links, gfa_nodes, gfa_edges, fasta_records, sam_records, csv_phasing_table, report_metrics, evaluation_table)}

_ENDS = f"""{D.NODES},
ends AS (
  SELECT link_no, coalesce(a.name, 'node' || source_id) AS src, coalesce(source_rev, false) AS src_rev, coalesce(b.name, 'node' || target_id) AS dst, coalesce(target_rev, false) AS dst_rev,
    coalesce(cigar, '*') AS cigar, {D.CIGAR.format("coalesce(cigar, '')")} AS overlap
  FROM links LEFT JOIN nodes a ON a.node_id = source_id LEFT JOIN nodes b ON b.node_id = target_id WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"""
_FILE = f"""{_ENDS},
seen AS (
  SELECT name, line_no * 4 AS place FROM segments
  UNION ALL SELECT src, (link_no + {AFTER}) * 4 + 1 FROM ends UNION ALL SELECT dst, (link_no + {AFTER}) * 4 + 2 FROM ends),
ids AS (SELECT name, row_number() OVER (ORDER BY min(place)) - 1 AS node_id FROM seen GROUP BY name),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY line_no DESC) AS k FROM segments) WHERE k = 1)"""
_REPORTS = """per AS (
  SELECT substr(name, 1, 3) AS tool, phase, CASE WHEN coverage % 2 = 0 THEN 'pat' ELSE 'mat' END AS ref, count(*) AS n, CAST(sum(length) AS BIGINT) AS total, max(length) AS longest, max(coverage) AS c
  FROM uz_segments WHERE phase >= 0 AND length(name) >= 3 GROUP BY 1, 2, 3),
metrics AS (
  SELECT tool, phase, ref, n::DOUBLE AS contig_count, total::DOUBLE AS assembly_bases, longest::DOUBLE AS longest_contig, (total % 100)::DOUBLE AS genome_fraction, (n % 7)::DOUBLE AS mismatches,
    (c % 5)::DOUBLE AS indels, (total * 2)::DOUBLE AS reference_bases, CASE WHEN n > 3 THEN (n % 9)::DOUBLE / 8 END AS duplication FROM per)"""
_LONG = lambda m, raw: f"SELECT tool, phase, ref, '{m}' AS metric, CAST({raw} AS VARCHAR) AS raw FROM per WHERE {raw} IS NOT NULL"
_NUMBER = lambda m: f"CASE WHEN {m} IS NULL THEN '-' WHEN {m} = floor({m}) THEN CAST(CAST({m} AS BIGINT) AS VARCHAR) ELSE printf('%.3f', {m}) END AS {m}"
_LENGTH = lambda m: f"CASE WHEN {m} IS NULL THEN '-' ELSE printf('%.2f Mb', {m} / 1e6) END AS {m}"

SQL = {
    "gfa_segments": "SELECT line_no, name, seq, CASE WHEN ln > 0 THEN ln END AS ln, CASE WHEN rc > 0 THEN rc END AS rc FROM segments",
    "gfa_links": f"WITH {_ENDS} SELECT link_no, src, src_rev, dst, dst_rev, cigar, overlap FROM ends",
    "gfa_nodes": f"""WITH {_FILE}
SELECT ids.node_id, ids.name, coalesce(seq, '') AS seq, coalesce(CASE WHEN ln > 0 THEN ln END, len(seq), 0) AS length, coalesce(rc, 0) AS coverage FROM ids LEFT JOIN last ON last.name = ids.name""",
    "gfa_edges": f"""WITH {_ENDS}
SELECT src AS a, dst AS b, src_rev, dst_rev, overlap FROM ends UNION ALL SELECT dst, src, NOT dst_rev, NOT src_rev, overlap FROM ends""",
    "fasta_records": "SELECT row_number() OVER (ORDER BY line_no) AS rec_no, name, seq FROM segments",
    "sam_records": "SELECT coalesce(qname, '*') AS qname, flag, coalesce(rname, '*') AS rname, pos, mapq, coalesce(cigar, '*') AS cigar, coalesce(rnext, '*') AS rnext, 0::BIGINT AS pnext FROM alignments",
    "csv_phasing_table": """WITH own AS (
  SELECT seg_idx, name, coalesce(graph_id, -1) AS g, coalesce(length, -1) AS l, phase FROM uz_segments WHERE phase >= 0 AND name <> '' AND NOT regexp_matches(name, '[,\n\r]')),
slot AS (SELECT g, l, phase, arg_max(name, seg_idx) AS name FROM own GROUP BY 1, 2, 3)
SELECT x.name AS name_a, y.name AS name_b FROM slot x JOIN slot y ON x.g = y.g AND x.l = y.l AND x.phase = 0 AND y.phase = 1""",
    "report_metrics": f"""WITH {_REPORTS},
long AS ({" UNION ALL ".join([_LONG("contig_count", "n"), _LONG("assembly_bases", "total"), _LONG("longest_contig", "longest"), _LONG("half_length", "'-'"), _LONG("genome_fraction", "total % 100"), _LONG("mismatches", "n % 7"), _LONG("indels", "c % 5"), _LONG("reference_bases", "total * 2"), _LONG("duplication", "CASE WHEN n > 3 THEN (n % 9)::DOUBLE / 8 END")])})
SELECT tool, phase, ref, metric, raw, TRY_CAST(raw AS DOUBLE) AS value FROM long""",
    "evaluation_table": f"""WITH {_REPORTS},
s AS (SELECT tool, phase, ref, coalesce(genome_fraction, 0) - 0.1::DOUBLE * mismatches - 0.05::DOUBLE * indels AS score FROM metrics),
wide AS (
  SELECT tool, max(score) FILTER (phase = 0 AND ref = 'pat') + max(score) FILTER (phase = 1 AND ref = 'mat') AS straight,
    max(score) FILTER (phase = 0 AND ref = 'mat') + max(score) FILTER (phase = 1 AND ref = 'pat') AS crossed FROM s GROUP BY tool),
given AS (SELECT *, CASE WHEN straight IS NULL OR crossed IS NULL THEN '?' WHEN straight >= crossed THEN 'PATERNAL' ELSE 'MATERNAL' END AS p0 FROM wide),
ranked AS (SELECT tool, p0, rank() OVER (ORDER BY CASE WHEN p0 <> '?' THEN greatest(straight, crossed) END DESC NULLS LAST) AS place FROM given)
SELECT m.tool, m.phase, m.ref, CASE WHEN m.phase = 0 THEN p0 WHEN p0 = 'PATERNAL' THEN 'MATERNAL' WHEN p0 = 'MATERNAL' THEN 'PATERNAL' ELSE '?' END AS parent, place,
  {", ".join([_NUMBER("contig_count"), _LENGTH("assembly_bases"), _LENGTH("longest_contig"), "'-' AS half_length", "'-' AS half_length_of_reference", "'-' AS misassembly_count", _NUMBER("genome_fraction"), _NUMBER("duplication"), _NUMBER("mismatches"), _NUMBER("indels"), "'-' AS aligned_bases", _LENGTH("reference_bases")])}
FROM metrics m JOIN ranked USING (tool)""",
}
