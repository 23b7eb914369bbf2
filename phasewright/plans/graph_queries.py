"""Queries and SQL of graph loading, contacts and naming."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewright.functions.text import cigar_length, reverse_complement, wrapped
from phasewright.operators import contacts as C
from phasewright.operators import graph as G
from phasewright.operators import names as N
from phasewright.plans import domain as D
from phasewright.plans.tables import load
from phasewright.sources.pairs import listed_pairs, phasing_pairs
from phasewright.sources.sam import contact_records


def segment_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return D.nodes(spark, sf)


def node_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Dense ids in the order in which names first appear in S and L lines."""
    names = D.nodes(spark, sf).select("node_id", "name")
    lines = load(spark, sf, "links").select("link_no", "source_id", "target_id")
    named = lambda df, id_, as_: df.join(names.select(F.col("node_id").alias(id_), F.col("name").alias(as_)), id_, "left")
    ends = named(named(lines, "source_id", "src"), "target_id", "dst")
    return G.node_dictionary(load(spark, sf, "segments").select("line_no", "name"), ends.select((F.col("link_no") + 1_000_000_000_000).alias("line_no"), "src", "dst"))


def cigar_overlap_length(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "links").select("link_no", cigar_length(F.col("cigar")).alias("overlap"))


def link_mirroring(spark: SparkSession, sf: str) -> DataFrame:
    return D.edges(spark, sf)


def fasta_fill_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose last record has no sequence, filled from the first record that has one."""
    records = D.segment_records(spark, sf).select("node_id", "seq", F.col("line_no").alias("rec_no"))
    return G.filled_sequences(D.nodes(spark, sf), records).select("node_id", "seq", "length")


def alignment_flag_filter(spark: SparkSession, sf: str) -> DataFrame:
    return contact_records(load(spark, sf, "alignments")).groupBy("library_id", "name_a", "name_b").agg(F.count(F.lit(1)).alias("n"))


def contact_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.contact_counts(load(spark, sf, "alignments"), D.nodes(spark, sf).select("name", "node_id"))


def contact_sums(spark: SparkSession, sf: str) -> DataFrame:
    return C.summed(D.contacts(spark, sf))


def contact_symmetrize(spark: SparkSession, sf: str) -> DataFrame:
    return C.symmetric(contact_sums(spark, sf))


def contact_filter_both_ends(spark: SparkSession, sf: str) -> DataFrame:
    return C.among(contact_sums(spark, sf), D.alts(spark, sf))


def contact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The contact between each node and its alt."""
    return C.looked_up(D.alts(spark, sf).select(F.col("node_id").alias("a"), F.col("alt_id").alias("b")), contact_sums(spark, sf))


def contact_row_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the symmetric matrix as row offsets: for each u the number of columns, the first and last one, and the row's total."""
    return contact_symmetrize(spark, sf).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first_v"), F.max("v").alias("last_v"), F.sum("w").alias("total"))


def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(D.edges(spark, sf))


def split_graph(spark: SparkSession, sf: str) -> DataFrame:
    return G.split_graph(D.edges(spark, sf))


def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    return G.weak_components(e.select("graph_id", F.col("src").alias("node_id")), e)


def homozygous_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.homozygous(D.nodes(spark, sf), D.alts(spark, sf)).select("node_id", "name")


def name_style_votes(spark: SparkSession, sf: str) -> DataFrame:
    return N.style_votes(D.nodes(spark, sf))


def name_alt_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Alt pairs by name, in the style that most names have."""
    return N.name_pairs(D.nodes(spark, sf))


def name_pairs_of_styles(spark: SparkSession, sf: str) -> DataFrame:
    """The alt pairs that each style would give."""
    nodes = D.nodes(spark, sf)
    return functools.reduce(DataFrame.unionByName, [N.name_pairs(nodes, style).withColumn("style", F.lit(style)) for style in N.STYLES])


def base_names(spark: SparkSession, sf: str) -> DataFrame:
    """The name without its suffix, for every node and style that has one."""
    nodes = D.nodes(spark, sf)
    return functools.reduce(DataFrame.unionByName, [N.with_base(nodes, style).select("node_id", F.lit(style).alias("style"), "base") for style in N.STYLES])


def name_style(spark: SparkSession, sf: str) -> DataFrame:
    """The style that most names have, the first on a tie."""
    votes = N.style_votes(D.nodes(spark, sf))
    best = F.greatest(*N.STYLES)
    return votes.select(F.coalesce(*[F.when(F.col(s) == best, s) for s in N.STYLES]).alias("style"))


def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the names that alignments mention; names without a segment are dropped."""
    asked = load(spark, sf, "alignments").select(F.col("rname").alias("name")).distinct()
    return G.ids_of(asked, D.nodes(spark, sf).select("name", "node_id"))


def neighbours_of_alts(spark: SparkSession, sf: str) -> DataFrame:
    """The edges that leave nodes with an alt, in adjacency order."""
    return G.neighbours(D.edges(spark, sf), D.alts(spark, sf)).select("graph_id", "src", "dst", "src_rev", "dst_rev", "edge_ord")


def table_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals that a run reports: nodes, edges, contacts, alt pairs, locked nodes and unzipped segments per phase."""
    def total(df: DataFrame, name: str, value=F.count(F.lit(1))) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("name"), "total")

    parts = [total(D.nodes(spark, sf), "nodes"), total(D.edges(spark, sf), "edges"), total(contact_sums(spark, sf), "contacts"), total(contact_sums(spark, sf), "contact weight", F.sum("w"))]
    parts += [total(D.alts(spark, sf), "alts"), total(D.locks(spark, sf), "locked nodes")]
    uz = load(spark, sf, "uz_segments")
    parts += [total(uz.where(F.col("phase") == p), f"segments of phase {p}") for p in (-1, 0, 1)]
    return functools.reduce(DataFrame.unionByName, parts)


def csv_haplotype_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names at the two haplotypes of a bubble: a phasing table made from the unzipped segments, by graph and length."""
    rows = load(spark, sf, "uz_segments").select(
        F.col("seg_idx").alias("line_no"), F.coalesce("name", F.lit("")).alias("Name"), F.col("graph_id").cast("string").alias("Bubble chain"),
        F.col("length").cast("string").alias("Position in bubble chain"), F.lit("0").alias("Component"),
        F.when(F.col("phase") >= 0, "2").otherwise("1").alias("Ploidy"), F.col("phase").cast("string").alias("Haplotype"),
    )
    return phasing_pairs(rows).select("name_a", "name_b")


def csv_name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Alt pairs from a list of names: the rows of the alt map by name, each unordered pair once."""
    n = D.nodes(spark, sf).select("node_id", "name")
    rows = load(spark, sf, "alt_map").select(F.col("pair_no").alias("line_no"), "node_id", "alt_id")
    rows = rows.join(n.withColumnRenamed("name", "name_a"), "node_id").join(n.select(F.col("node_id").alias("alt_id"), F.col("name").alias("name_b")), "alt_id")
    return N.pairs_of_names(listed_pairs(rows.select("line_no", "name_a", "name_b")), n)


def reverse_complements(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "segments").select("line_no", reverse_complement(F.col("seq")).alias("seq"))


def fasta_wrap60(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "segments").where("seq <> ''").select("line_no", F.array_join(wrapped(F.col("seq")), "\n").alias("lines"))


QUERIES = {
    q.__name__: q
    for q in (
        segment_last_wins, node_dictionary, cigar_overlap_length, link_mirroring, fasta_fill_sequence, alignment_flag_filter, contact_counts, contact_sums, contact_symmetrize,
        contact_filter_both_ends, contact_lookup, contact_row_cursor, degrees, split_graph, weak_components, homozygous_nodes, name_style_votes, name_alt_pairs, csv_haplotype_pairs,
        csv_name_pairs, reverse_complements, fasta_wrap60, name_pairs_of_styles, base_names, name_style, node_ids, neighbours_of_alts, table_totals,
    )
}

_RECORDS = """rec AS (
  SELECT library_id, rname AS name_a, CASE WHEN rnext = '=' THEN rname ELSE rnext END AS name_b FROM alignments
  WHERE (flag & 2381) = 65 AND rname <> '*' AND CASE WHEN rnext = '=' THEN rname ELSE rnext END <> '*')"""
_STYLE = (
    "votes AS (SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(name, '{p}')) AS {s}" for s, p in N.STYLES.items()) + " FROM nodes),\n"
    + "style AS (SELECT CASE greatest(" + ", ".join(N.STYLES) + ") " + " ".join(f"WHEN {s} THEN '{s}'" for s in N.STYLES) + " END AS style FROM votes)"
)
_BASES = r"""bases AS (
  SELECT node_id, 'classic' AS style, regexp_replace(name, '_\d+$', '') AS base FROM nodes
  UNION ALL SELECT node_id, style, regexp_replace(name, '\.\d+$', '') FROM nodes, (SELECT unnest(['pr', 'dot']) AS style) WHERE regexp_matches(name, '\.\d+$')),
two AS (SELECT style, base, min(node_id) AS a, max(node_id) AS b FROM bases GROUP BY 1, 2 HAVING count(*) = 2)"""
_SYM = D.CONTACTS + ",\nsym AS (SELECT u, v, w FROM summed UNION ALL SELECT v, u, w FROM summed WHERE u <> v)"

SQL = {
    "segment_last_wins": f"WITH {D.NODES} SELECT node_id, name, seq, length, coverage FROM nodes",
    "node_dictionary": f"""WITH {D.NODES},
seen AS (
  SELECT name, line_no AS line, 0 AS slot FROM segments
  UNION ALL SELECT n.name, link_no + 1000000000000, 1 FROM links JOIN nodes n ON n.node_id = source_id
  UNION ALL SELECT n.name, link_no + 1000000000000, 2 FROM links JOIN nodes n ON n.node_id = target_id),
low AS (SELECT name, min(line * 4 + slot) AS place FROM seen WHERE name IS NOT NULL GROUP BY name)
SELECT row_number() OVER (ORDER BY place) - 1 AS node_id, name FROM low""",
    "cigar_overlap_length": "SELECT link_no, " + D.CIGAR.format("coalesce(cigar, '')") + " AS overlap FROM links",
    "link_mirroring": f"WITH {D.EDGES} SELECT graph_id, src, dst, src_rev, dst_rev, edge_ord, overlap FROM edges",
    "fasta_fill_sequence": f"""WITH {D.NODES},
first AS (SELECT node_id, arg_min(seq, line_no) AS seq FROM segs WHERE seq <> '' GROUP BY node_id)
SELECT n.node_id, coalesce(nullif(n.seq, ''), f.seq, '') AS seq, n.length FROM nodes n LEFT JOIN first f ON f.node_id = n.node_id""",
    "alignment_flag_filter": f"WITH {_RECORDS} SELECT library_id, name_a, name_b, count(*) AS n FROM rec GROUP BY 1, 2, 3",
    "contact_counts": f"""WITH {D.NODES}, {_RECORDS}
SELECT least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v, count(*) AS w
FROM rec JOIN nodes a ON a.name = name_a JOIN nodes b ON b.name = name_b GROUP BY 1, 2""",
    "contact_sums": f"WITH {D.CONTACTS} SELECT u, v, w FROM summed",
    "contact_symmetrize": f"WITH {_SYM} SELECT u, v, w FROM sym",
    "contact_filter_both_ends": f"WITH {D.CONTACTS}, {D.ALTS} SELECT u, v, w FROM summed WHERE u IN (SELECT node_id FROM alts) AND v IN (SELECT node_id FROM alts)",
    "contact_lookup": f"""WITH {D.CONTACTS}, {D.ALTS}
SELECT node_id AS a, alt_id AS b, coalesce(w, 0) AS w FROM alts LEFT JOIN summed ON u = least(node_id, alt_id) AND v = greatest(node_id, alt_id)""",
    "contact_row_cursor": f"WITH {_SYM} SELECT u, count(*) AS n, min(v) AS first_v, max(v) AS last_v, CAST(sum(w) AS BIGINT) AS total FROM sym GROUP BY u",
    "degrees": f"""WITH {D.EDGES},
ends AS (SELECT graph_id, src AS n, 1 AS o, 0 AS i FROM edges UNION ALL SELECT graph_id, dst, 0, 1 FROM edges)
SELECT graph_id, n AS node_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM ends GROUP BY 1, 2""",
    "split_graph": f"WITH {D.EDGES} SELECT graph_id, src * 2 + CAST(src_rev AS INT) AS src, dst * 2 + CAST(dst_rev AS INT) AS dst, edge_ord FROM edges",
    "weak_components": f"""WITH RECURSIVE {D.EDGES},
e AS (SELECT DISTINCT graph_id, src, dst FROM edges),
reach(graph_id, node_id, low) AS (
  SELECT DISTINCT graph_id, src, src FROM e
  UNION SELECT r.graph_id, e.dst, r.low FROM reach r JOIN e ON e.graph_id = r.graph_id AND e.src = r.node_id WHERE r.low < e.dst)
SELECT graph_id, node_id, min(low) AS component FROM reach GROUP BY 1, 2""",
    "homozygous_nodes": f"WITH {D.NODES}, {D.ALTS} SELECT node_id, name FROM nodes WHERE node_id NOT IN (SELECT node_id FROM alts)",
    "name_style_votes": f"WITH {D.NODES} SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(name, '{p}')) AS {s}" for s, p in N.STYLES.items()) + " FROM nodes",
    "name_style": f"WITH {D.NODES}, {_STYLE} SELECT style FROM style",
    "base_names": f"WITH {D.NODES}, {_BASES} SELECT node_id, style, base FROM bases",
    "name_pairs_of_styles": f"WITH {D.NODES}, {_BASES} SELECT a AS node_id, b AS alt_id, style FROM two UNION ALL SELECT b, a, style FROM two",
    "name_alt_pairs": f"WITH {D.NODES}, {_STYLE}, {_BASES} SELECT a AS node_id, b AS alt_id FROM two JOIN style USING (style) UNION ALL SELECT b, a FROM two JOIN style USING (style)",
    "node_ids": f"WITH {D.NODES} SELECT name, node_id FROM nodes WHERE name IN (SELECT rname FROM alignments)",
    "neighbours_of_alts": f"WITH {D.EDGES}, {D.ALTS} SELECT graph_id, src, dst, src_rev, dst_rev, edge_ord FROM edges WHERE src IN (SELECT node_id FROM alts)",
    "table_totals": f"""WITH {D.NODES}, {D.EDGES}, {D.CONTACTS}, {D.ALTS}, {D.LOCKS}
SELECT 'nodes' AS name, count(*) AS total FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'contacts', count(*) FROM summed
UNION ALL SELECT 'contact weight', CAST(coalesce(sum(w), 0) AS BIGINT) FROM summed UNION ALL SELECT 'alts', count(*) FROM alts UNION ALL SELECT 'locked nodes', count(*) FROM locks
UNION ALL SELECT 'segments of phase ' || p, (SELECT count(*) FROM uz_segments WHERE phase = p) FROM (SELECT unnest([-1, 0, 1]) AS p)""",
    "csv_haplotype_pairs": """WITH own AS (SELECT seg_idx, name, graph_id, length, phase FROM uz_segments WHERE phase >= 0 AND name <> ''),
slot AS (SELECT graph_id, length, phase, arg_max(name, seg_idx) AS name FROM own GROUP BY 1, 2, 3)
SELECT x.name AS name_a, y.name AS name_b FROM slot x JOIN slot y ON x.graph_id IS NOT DISTINCT FROM y.graph_id AND x.length IS NOT DISTINCT FROM y.length AND x.phase = 0 AND y.phase = 1""",
    "csv_name_pairs": f"""WITH {D.NODES},
named AS (
  SELECT pair_no, a.name AS name_a, b.name AS name_b FROM alt_map JOIN nodes a ON a.node_id = alt_map.node_id JOIN nodes b ON b.node_id = alt_id
  WHERE a.name <> b.name AND a.name <> '' AND b.name <> ''),
first AS (SELECT *, row_number() OVER (PARTITION BY least(name_a, name_b), greatest(name_a, name_b) ORDER BY pair_no, name_a, name_b) AS k FROM named),
ids AS (SELECT pair_no, a.node_id AS a, b.node_id AS b FROM first JOIN nodes a ON a.name = name_a JOIN nodes b ON b.name = name_b WHERE k = 1),
ways AS (SELECT pair_no, a AS node_id, b AS alt_id FROM ids UNION ALL SELECT pair_no, b, a FROM ids)
SELECT node_id, alt_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY pair_no DESC, alt_id DESC) AS k FROM ways) WHERE k = 1""",
    "reverse_complements": "SELECT line_no, reverse(regexp_replace(translate(seq, 'ACGTacgt', 'TGCATGCA'), '[^ACGT]', 'N', 'g')) AS seq FROM segments",
    "fasta_wrap60": "SELECT line_no, rtrim(regexp_replace(seq, '(.{60})', E'\\\\1\\n', 'g'), E'\\n') AS lines FROM segments WHERE seq <> ''",
}
