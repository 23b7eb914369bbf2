"""Queries and SQL of k-mers, bubbles, phasing, chains, unzipping and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewright.operators import bubbles as B
from phasewright.operators import chain as H
from phasewright.operators import kmers as K
from phasewright.operators import phase as P
from phasewright.operators import unzip as U
from phasewright.operators.evaluate import assignments
from phasewright.plans import domain as D
from phasewright.plans.graph_queries import contact_sums
from phasewright.plans.tables import keep, load
from phasewright.sources.gfa import link_line, path_line, segment_line

K16 = 16
K_TRIO = 31
SKETCH = 1000


def canonical_kmers(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 16 bases per node: how many, how many different, the smallest and the largest canonical code."""
    rows = K.canonical_kmers(D.nodes(spark, sf), K16).select("node_id", F.explode("kmers").alias("h"))
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("h").alias("different"), F.min("h").alias("low"), F.max("h").alias("high"))


def kmer_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return K.sketches(D.nodes(spark, sf), K16, SKETCH).select("node_id", F.posexplode("hashes").alias("place", "hash"))


def _alt_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return D.alts(spark, sf).select(F.least("node_id", "alt_id").alias("a"), F.greatest("node_id", "alt_id").alias("b")).distinct()


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return K.similarities(_alt_pairs(spark, sf), K.sketches(D.nodes(spark, sf), K16, SKETCH))


def sibling_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return B.sibling_candidates(D.edges(spark, sf))


def reciprocal_best_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return B.reciprocal_best(B.sibling_candidates(D.edges(spark, sf)), D.nodes(spark, sf), K16, SKETCH, 0.1)


def simple_bubbles(spark: SparkSession, sf: str) -> DataFrame:
    return B.simple_bubbles(D.edges(spark, sf))


def superbubbles(spark: SparkSession, sf: str) -> DataFrame:
    return B.superbubbles(D.edges(spark, sf))


def superbubble_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Per graph file with superbubbles: that they are numbered from 0 without gaps, that no member is missing in the graph, and no branch is empty but the second."""
    found = keep(superbubbles(spark, sf)).df
    nodes = D.edges(spark, sf).select("graph_id", F.col("src").alias("m")).distinct()
    members = found.select("graph_id", F.explode(F.concat("branch_a", "branch_b")).alias("m")).distinct()
    lost = members.join(nodes, ["graph_id", "m"], "left_anti").groupBy("graph_id").agg(F.count(F.lit(1)).alias("lost"))
    per = found.groupBy("graph_id").agg((F.max("emit_seq") + 1 - F.count_distinct("emit_seq")).alias("gaps"), F.count_if(F.size("branch_a") == 0).alias("empty"))
    every = D.edges(spark, sf).select("graph_id").distinct().join(per, "graph_id", "left").join(lost, "graph_id", "left")
    return every.select("graph_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "empty", "lost")])


def branch_sequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.bubble_rows(spark, sf)
    sides = rows.select("bubble", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("branch_a").alias("members")), F.struct(F.lit(1).alias("side"), F.col("branch_b").alias("members")))).alias("x"))
    return B.branch_sequences(sides.select("bubble", "x.*"), D.nodes(spark, sf))


def bubble_alts(spark: SparkSession, sf: str) -> DataFrame:
    return B.bubble_alts(D.bubble_rows(spark, sf), D.nodes(spark, sf))


def unlabelled_alts(spark: SparkSession, sf: str) -> DataFrame:
    return B.unlabelled_alts(D.bubble_rows(spark, sf), D.edges(spark, sf), D.nodes(spark, sf))


def _marked(spark: SparkSession, sf: str, nodes: DataFrame, scored: Column) -> DataFrame:
    """``nodes`` with the mark of ``sequence_scores``: whose parents' k-mers they give, and whether they are scored."""
    bit = lambda p, value: F.max(F.when(F.col("phase") == p, value).otherwise(0))
    parents = load(spark, sf, "uz_segments").where("src_id IS NOT NULL AND phase IN (0, 1)").groupBy(F.col("src_id").alias("node_id")).agg((bit(0, K.PATERNAL) + bit(1, K.MATERNAL)).alias("parents"))
    return nodes.join(parents, "node_id", "left").select("node_id", "seq", (F.coalesce("parents", F.lit(0)) + F.when(scored, K.SCORED).otherwise(0)).alias("mark"))


def trio_scores(spark: SparkSession, sf: str) -> DataFrame:
    """K-mer hits of every node; a parent's k-mers are those of the nodes unzipped on one haplotype."""
    nodes = D.nodes(spark, sf)
    return K.sequence_scores(nodes, _marked(spark, sf, nodes, F.lit(True)), K_TRIO)


def trio_locks(spark: SparkSession, sf: str) -> DataFrame:
    alts = D.alts(spark, sf).select("node_id")
    nodes = D.nodes(spark, sf).join(alts.withColumn("phasing", F.lit(True)), "node_id", "left")
    return K.trio_locks(K.sequence_scores(alts, _marked(spark, sf, nodes, F.col("phasing")), K_TRIO), alts)


def free_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.free_pairs(D.alts(spark, sf), D.locks(spark, sf))


def _energy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = keep(free_pairs(spark, sf)).df
    weights, field = P.meta_weights(contact_sums(spark, sf), P.node_map(pairs), D.locks(spark, sf))
    signs = pairs.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample"), F.col("pair_idx").alias("meta"))
    return weights, field, signs.select("sample", "meta", P.random_sign(42, F.col("sample"), F.col("meta")).alias("sign"))


def meta_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return P.meta_adjacency(_energy(spark, sf)[0])


def flip_delta(spark: SparkSession, sf: str) -> DataFrame:
    weights, field, signs = _energy(spark, sf)
    return P.flip_delta(signs, weights, field)


def agreement_pairs(spark: SparkSession, sf: str) -> DataFrame:
    weights, _, signs = _energy(spark, sf)
    return P.agreement(signs, P.meta_adjacency(weights))


def phase_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return P.assign_phases(contact_sums(spark, sf), D.alts(spark, sf), D.locks(spark, sf))


def phase_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Of the assigned phases: every node that has one, the locked ones with theirs, and whether the two nodes of a free pair that is nobody else's lie on different haplotypes."""
    phases = keep(phase_assignment(spark, sf)).df
    pairs, locked = free_pairs(spark, sf), D.locks(spark, sf).withColumnRenamed("phase", "locked")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node_id")
    own = pairs.join(ends.withColumnRenamed("node_id", "a"), "a").join(ends.withColumnRenamed("node_id", "b"), "b")
    side = lambda n, as_: phases.select(F.col("node_id").alias(n), F.col("phase").alias(as_))
    apart = own.join(side("a", "pa"), "a").join(side("b", "pb"), "b").select(F.col("a").alias("node_id"), (F.col("pa") != F.col("pb")).alias("apart"))
    kept = phases.join(locked, "node_id", "left").select("node_id", F.when(F.col("locked").isNotNull(), F.col("phase")).alias("locked"))
    return kept.join(apart, "node_id", "left").select("node_id", "locked", "apart")


def phase_fixed_point(spark: SparkSession, sf: str) -> DataFrame:
    """After an ascent of two samples: for every meta and sample, whether flipping it alone would gain."""
    weights, field, signs = _energy(spark, sf)
    weights, field = keep(weights).df, keep(field).df
    ended = P.ascend(signs.where("sample < 2"), weights, field, 300)
    return P.flip_delta(ended, weights, field).select("sample", "meta", (F.col("delta") > 0).alias("gains"))


def phase_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return P.propagate(D.locks(spark, sf), D.alts(spark, sf))


def _graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("src").alias("node_id")).distinct()


def phase_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    return H.phase_subgraph(e, _graph_nodes(e), D.phased(spark, sf), D.alts(spark, sf))[1]


def _chains(spark: SparkSession, sf: str, exact: bool) -> DataFrame:
    e = D.edges(spark, sf)
    n = _graph_nodes(e)
    members, kept = H.phase_subgraph(e, n, D.phased(spark, sf), D.alts(spark, sf))
    return H.chains(members, kept, contact_sums(spark, sf), exact).unionByName(H.unphased_chains(n, D.phased(spark, sf), D.alts(spark, sf)))


def greedy_chains(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf, False)


def hamiltonian_chains(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf, True)


def chain_cover(spark: SparkSession, sf: str) -> DataFrame:
    """How often each member of a haplotype stands in its greedy chains and in its exact ones."""
    parts = [f(spark, sf).where("part < 2").select("graph_id", "part", "node_id", F.lit(kind).alias("kind")) for kind, f in (("greedy", greedy_chains), ("exact", hamiltonian_chains))]
    return parts[0].unionByName(parts[1]).groupBy("graph_id", "part", "node_id").pivot("kind", ["greedy", "exact"]).agg(F.count(F.lit(1)))


def chain_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every exact chain with its number, its smallest node and its nodes: one for each weak component, in the order of their smallest nodes."""
    return hamiltonian_chains(spark, sf).where("part < 2").groupBy("graph_id", "part", "chain_idx").agg(F.min("node_id").alias("smallest"), F.count(F.lit(1)).alias("nodes"))


def greedy_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Of the greedy chains per haplotype: steps along no edge, and first nodes without a parent that stand inside a chain (none of either), chains and members."""
    own = keep(greedy_chains(spark, sf).where("part < 2")).df
    kept = keep(phase_subgraph(spark, sf)).df
    edges = kept.select("graph_id", "part", "src", "dst").distinct()
    steps = own.select("graph_id", "part", "chain_idx", F.col("pos"), F.col("node_id").alias("src")).join(
        own.select("graph_id", "part", "chain_idx", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("dst")), ["graph_id", "part", "chain_idx", "pos"]
    )
    off = steps.join(edges, ["graph_id", "part", "src", "dst"], "left_anti").groupBy("graph_id", "part").agg(F.count(F.lit(1)).alias("off"))
    heads = own.join(edges.select("graph_id", "part", F.col("dst").alias("node_id")).distinct(), ["graph_id", "part", "node_id"], "left_anti")
    inside = heads.where("pos > 0").groupBy("graph_id", "part").agg(F.count(F.lit(1)).alias("inside"))
    sizes = own.groupBy("graph_id", "part").agg(F.count(F.lit(1)).alias("members"))
    out = sizes.join(off, ["graph_id", "part"], "left").join(inside, ["graph_id", "part"], "left")
    return out.select("graph_id", "part", "members", F.coalesce("off", F.lit(0)).alias("off"), F.coalesce("inside", F.lit(0)).alias("inside"))


def unphased_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The chains of the nodes without a phase, if only locked nodes had one, numbered per graph file."""
    n = _graph_nodes(D.edges(spark, sf))
    return H.unphased_chains(n, D.locks(spark, sf), D.alts(spark, sf)).select("graph_id", "chain_idx", "node_id")


def segment_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Unzipped segments with their dense number: haplotype 0, haplotype 1, unphased."""
    return U.numbered_segments(unzip_segments(spark, sf)).select("seg_idx", "graph_id", "part", "pos", "name")


def unzip_segments(spark: SparkSession, sf: str) -> DataFrame:
    return U.unzip_segments(D.chain_table(spark, sf), D.nodes(spark, sf), D.alts(spark, sf))


def unzip_links(spark: SparkSession, sf: str) -> DataFrame:
    return U.unzip_links(D.chain_table(spark, sf), D.edges(spark, sf))


def chain_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return U.chain_sequences(D.chain_table(spark, sf), D.nodes(spark, sf), D.edges(spark, sf))


def gfa_segment_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = D.nodes(spark, sf).join(D.phased(spark, sf), "node_id", "left")
    length = F.when(F.col("length") == 0, F.length("seq").cast("long")).otherwise(F.col("length"))
    return own.select("node_id", segment_line(F.col("name"), F.col("seq"), length, F.col("coverage"), F.coalesce("phase", F.lit(-1))).alias("line"))


def gfa_link_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One link per graph file and unordered pair: the first edge at the lower id."""
    n = D.nodes(spark, sf).select("node_id", "name")
    low = D.edges(spark, sf).where("src <= dst").groupBy("graph_id", "src", "dst").agg(F.min_by(F.struct("src_rev", "dst_rev", "overlap"), "edge_ord").alias("e"))
    named = low.join(n.select(F.col("node_id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("b")), "dst")
    return named.select("graph_id", "src", "dst", link_line(F.col("a"), F.col("e.src_rev"), F.col("b"), F.col("e.dst_rev"), F.col("e.overlap")).alias("line"))


def gfa_path_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = D.chain_table(spark, sf).join(D.nodes(spark, sf).select("node_id", "name"), "node_id")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: F.concat(x["name"], F.lit("+")))
    tag = F.concat_ws("_", F.lit("chain"), F.element_at(F.array(F.lit("ph0"), F.lit("ph1"), F.lit("un")), F.col("part") + 1), F.col("graph_id").cast("string"))
    return own.groupBy("graph_id", "part").agg(steps.alias("steps")).select("graph_id", "part", path_line(tag, F.col("steps")).alias("line"))


def phase_labels(spark: SparkSession, sf: str) -> DataFrame:
    return D.phased(spark, sf).where("phase >= 0").join(D.nodes(spark, sf), "node_id").select(F.col("name").alias("contig_id"), "phase")


def assignment_score(spark: SparkSession, sf: str) -> DataFrame:
    """Parents by score, on figures of the unzipped segments: a tool is a naming prefix, a reference the parity of the coverage."""
    uz = load(spark, sf, "uz_segments").where("phase >= 0 AND name IS NOT NULL")
    ref = F.when(F.col("coverage") % 2 == 0, "pat").otherwise("mat")
    metrics = uz.groupBy(F.substring("name", 1, 3).alias("tool"), "phase", ref.alias("ref")).agg(
        (F.sum("length") / 100).alias("genome_fraction"), F.count(F.lit(1)).alias("mismatches"), F.max("coverage").alias("indels")
    )
    return assignments(metrics)


QUERIES = {
    q.__name__: q
    for q in (
        canonical_kmers, kmer_sketch, jaccard_pairs, sibling_candidates, reciprocal_best_siblings, simple_bubbles, superbubbles, branch_sequences, bubble_alts, unlabelled_alts, trio_scores,
        trio_locks, free_pairs, meta_adjacency, flip_delta, agreement_pairs, phase_assignment, phase_propagation, phase_subgraph, greedy_chains, hamiltonian_chains, unzip_segments, superbubble_sequence,
        phase_cover, phase_fixed_point, chain_cover, chain_components, greedy_steps, unphased_numbers, segment_numbers,
        unzip_links, chain_sequences, gfa_segment_lines, gfa_link_lines, gfa_path_lines, phase_labels, assignment_score,
    )
}

_RC = "reverse(translate(upper({0}), 'ACGT', 'TGCA'))"
_WINDOWS = """at AS (SELECT node_id, seq, unnest(range(1, len(seq) - {k} + 2)) AS i FROM nodes WHERE len(seq) >= {k}),
win AS (SELECT node_id, upper(substr(seq, i, {k})) AS s FROM at WHERE regexp_full_match(substr(seq, i, {k}), '[ACGTacgt]{{{k}}}'))"""
_CODE = "list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT)), lambda a, b: a * 4 + b)"
_CODES = (
    _WINDOWS.format(k=K16).replace("at AS", "positions AS").replace("FROM at", "FROM positions")
    + f",\nkm AS (SELECT node_id, least({_CODE.format('s')}, {_CODE.format(_RC.format('s'))}) AS code FROM win)"
)
_M = "18446744073709551615::UHUGEINT"
_SKETCH = (
    _CODES
    + f""",
m1 AS (SELECT node_id, xor(code::UBIGINT, code::UBIGINT // 8589934592) AS x FROM km),
m2 AS (SELECT node_id, ((x::UHUGEINT * 18397679294719823053::UHUGEINT) & {_M})::UBIGINT AS x FROM m1),
m3 AS (SELECT node_id, xor(x, x // 8589934592) AS x FROM m2),
m4 AS (SELECT node_id, ((x::UHUGEINT * 14181476777654086739::UHUGEINT) & {_M})::UBIGINT AS x FROM m3),
m5 AS (SELECT node_id, xor(x, x // 8589934592) AS x FROM m4),
sk AS (SELECT node_id, x, k FROM (SELECT node_id, x, row_number() OVER (PARTITION BY node_id ORDER BY x) - 1 AS k FROM m5) WHERE k < {SKETCH})"""
)
_SIM = """size AS (SELECT node_id, count(*) AS n FROM sk GROUP BY 1),
mult AS (SELECT node_id, x, count(*) AS m FROM sk GROUP BY 1, 2),
common AS (
  SELECT p.a, p.b, sum(least(u.m, v.m)) AS shared FROM asked p JOIN mult u ON u.node_id = p.a JOIN mult v ON v.node_id = p.b AND v.x = u.x GROUP BY 1, 2),
sim AS (
  SELECT p.a, p.b, CASE WHEN x.n > 0 AND y.n > 0 THEN coalesce(shared, 0)::DOUBLE / (x.n + y.n - coalesce(shared, 0)) ELSE 0.0 END AS jaccard
  FROM asked p LEFT JOIN common s ON s.a = p.a AND s.b = p.b LEFT JOIN size x ON x.node_id = p.a LEFT JOIN size y ON y.node_id = p.b)"""
_SIBLINGS = """fwd AS (SELECT DISTINCT graph_id, src, dst FROM edges WHERE NOT src_rev AND NOT dst_rev),
sib AS (
  SELECT x.graph_id, x.dst AS a, y.dst AS b FROM fwd x JOIN fwd y ON x.graph_id IS NOT DISTINCT FROM y.graph_id AND x.src = y.src AND x.dst <> y.dst
  UNION SELECT x.graph_id, x.src, y.src FROM fwd x JOIN fwd y ON x.graph_id IS NOT DISTINCT FROM y.graph_id AND x.dst = y.dst AND x.src <> y.src)"""
_SPLIT = "split AS (SELECT DISTINCT graph_id, src * 2 + CAST(src_rev AS INT) AS s, dst * 2 + CAST(dst_rev AS INT) AS t FROM edges)"
_PAIRS = """pairs AS (
  SELECT row_number() OVER (ORDER BY a, b) - 1 AS pair_idx, a, b FROM (
    SELECT DISTINCT node_id AS a, alt_id AS b FROM alts
    WHERE node_id < alt_id AND node_id NOT IN (SELECT node_id FROM locks) AND alt_id NOT IN (SELECT node_id FROM locks)))"""
_ENERGY = f"""{D.CONTACTS}, {D.ALTS}, {D.LOCKS}, {_PAIRS},
sym AS (SELECT u, v, w FROM summed UNION ALL SELECT v, u, w FROM summed WHERE u <> v),
sides AS (SELECT pair_idx, a AS node_id, 1 AS side FROM pairs UNION ALL SELECT pair_idx, b, -1 FROM pairs),
nmap AS (SELECT node_id, pair_idx AS meta, side FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY pair_idx DESC, side DESC) AS k FROM sides) WHERE k = 1),
half AS (SELECT x.meta AS i, x.side AS su, v, w FROM sym JOIN nmap x ON x.node_id = u),
wt AS (SELECT i, y.meta AS j, sum(w * su * y.side) AS w FROM half JOIN nmap y ON y.node_id = v WHERE i <> y.meta GROUP BY 1, 2),
fld AS (
  SELECT i, sum(w * su * CASE WHEN phase = 0 THEN 1 ELSE -1 END) AS w FROM half JOIN locks l ON l.node_id = v
  WHERE v NOT IN (SELECT node_id FROM nmap) GROUP BY 1),
signs AS (
  SELECT sample, pair_idx AS meta, CASE WHEN substr(md5('42:' || sample || ':' || pair_idx), 1, 1) < '8' THEN 1 ELSE -1 END AS sign
  FROM pairs, (SELECT unnest(range(0, 4)) AS sample))"""
_TRIO = f"""{D.NODES}, {_WINDOWS.format(k=K_TRIO).replace("at AS", "positions AS").replace("FROM at", "FROM positions")},
km AS (SELECT node_id, least(s, {_RC.format('s')}) AS h FROM win),
uz AS (SELECT DISTINCT src_id AS node_id, phase FROM uz_segments WHERE src_id IS NOT NULL AND phase >= 0),
par AS (SELECT h, max(CASE WHEN phase = 0 THEN 1 ELSE 0 END) AS pat, max(CASE WHEN phase = 1 THEN 1 ELSE 0 END) AS mat FROM km JOIN uz USING (node_id) GROUP BY h),
hit AS (SELECT node_id, CAST(sum(pat) AS BIGINT) AS p, CAST(sum(mat) AS BIGINT) AS m FROM km JOIN par USING (h) GROUP BY node_id),
scores AS (SELECT n.node_id, coalesce(p, 0) AS pat_count, coalesce(m, 0) AS mat_count FROM nodes n LEFT JOIN hit USING (node_id))"""
_SUBGRAPH = f"""{D.EDGES}, {D.PHASED},
gn AS (SELECT DISTINCT graph_id, src AS node_id FROM edges),
own AS (
  SELECT node_id, phase AS part FROM phased
  UNION ALL SELECT DISTINCT node_id, part FROM gn, (SELECT unnest([0, 1]) AS part) WHERE node_id NOT IN (SELECT node_id FROM alts)),
members AS (SELECT graph_id, part, node_id FROM gn JOIN own USING (node_id))"""
_BEST = """best AS (
  SELECT graph_id, src, dst, src_rev, dst_rev, overlap FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_id, src, dst ORDER BY src_rev, edge_ord) AS k FROM edges) WHERE k = 1),
steps AS (SELECT graph_id, part, chain_idx, pos, node_id AS src, lead(node_id) OVER (PARTITION BY graph_id, part, chain_idx ORDER BY pos) AS dst FROM chain),
lnk AS (
  SELECT s.graph_id, part, chain_idx, pos, s.src, s.dst, coalesce(src_rev, false) AS src_rev, coalesce(dst_rev, false) AS dst_rev, coalesce(overlap, 0) AS overlap, overlap IS NULL AS is_synthetic
  FROM steps s LEFT JOIN best b ON b.graph_id = s.graph_id AND b.src = s.src AND b.dst = s.dst WHERE s.dst IS NOT NULL)"""

_BRANCHES = f"""{D.NODES.replace("nodes AS (", "own_nodes AS (")},
clean AS (
  SELECT bubble_id AS bubble, list_filter(coalesce(branch_a, []), lambda x: x IS NOT NULL) AS a, list_filter(coalesce(branch_b, []), lambda x: x IS NOT NULL) AS b FROM bubbles),
two AS (SELECT * FROM clean WHERE len(b) > 0),
sides AS (SELECT bubble, 0 AS side, unnest(list_distinct(a)) AS node_id FROM two UNION ALL SELECT bubble, 1, unnest(list_distinct(b)) FROM two),
branch AS (SELECT bubble, side, string_agg(seq, '' ORDER BY s.node_id) AS seq FROM sides s JOIN own_nodes n ON n.node_id = s.node_id GROUP BY 1, 2)"""
_CLAIMED = """filled AS (SELECT bubble, count(*) AS n FROM branch WHERE seq <> '' GROUP BY 1),
kept AS (
  SELECT two.* FROM two LEFT JOIN filled f ON f.bubble = two.bubble JOIN sim ON sim.a = -2 * two.bubble - 1 AND sim.b = -2 * two.bubble - 2 WHERE coalesce(f.n, 0) < 2 OR jaccard >= 0.9),
ways AS (
  SELECT bubble, unnest(a) AS node_id, list_min(b) AS alt_id FROM kept UNION ALL SELECT bubble, unnest(b), list_min(a) FROM kept
  UNION ALL SELECT bubble, unnest(a), NULL FROM clean WHERE len(b) = 0),
claimed AS (
  SELECT node_id, alt_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY alt_id IS NULL, bubble DESC, alt_id DESC) AS k FROM ways) WHERE k = 1)"""
_MEMBERS = """ways AS (SELECT graph_id, part, src AS a, dst AS b FROM sub UNION SELECT graph_id, part, dst, src FROM sub),
reach(graph_id, part, node_id, low) AS (
  SELECT graph_id, part, node_id, node_id FROM members
  UNION SELECT r.graph_id, r.part, w.b, r.low FROM reach r JOIN ways w ON w.graph_id = r.graph_id AND w.part = r.part AND w.a = r.node_id WHERE r.low < w.b),
comp AS (SELECT graph_id, part, node_id, min(low) AS smallest FROM reach GROUP BY 1, 2, 3)"""

SQL = {
    "bubble_alts": f"""WITH {_BRANCHES},
nodes AS (SELECT -2 * bubble - 1 - side AS node_id, seq FROM branch), {_SKETCH},
asked AS (SELECT -2 * bubble - 1 AS a, -2 * bubble - 2 AS b FROM two), {_SIM}, {_CLAIMED} SELECT node_id, alt_id FROM claimed""",
    "unlabelled_alts": f"""WITH {_BRANCHES}, {D.EDGES}, {_SIBLINGS},
nodes AS (SELECT -2 * bubble - 1 - side AS node_id, seq FROM branch UNION ALL SELECT node_id, seq FROM own_nodes), {_SKETCH},
asked AS (SELECT -2 * bubble - 1 AS a, -2 * bubble - 2 AS b FROM two UNION ALL SELECT DISTINCT a, b FROM sib), {_SIM}, {_CLAIMED},
fit AS (SELECT node_id FROM own_nodes WHERE length >= {K16} AND node_id NOT IN (SELECT node_id FROM claimed WHERE node_id IS NOT NULL)),
best AS (
  SELECT graph_id, a, b FROM (
    SELECT c.*, row_number() OVER (PARTITION BY graph_id, c.a ORDER BY jaccard DESC, c.b) AS k FROM sib c JOIN sim s ON s.a = c.a AND s.b = c.b
    WHERE jaccard >= 0.9 AND c.a IN (SELECT node_id FROM fit) AND c.b IN (SELECT node_id FROM fit)) WHERE k = 1),
met AS (SELECT x.a, x.b FROM best x JOIN best y ON x.graph_id = y.graph_id AND x.a = y.b AND x.b = y.a)
SELECT node_id, alt_id FROM claimed UNION ALL SELECT a, min(b) FROM met GROUP BY a""",
    "superbubble_sequence": f"WITH {D.EDGES} SELECT DISTINCT graph_id, 0::BIGINT AS gaps, 0::BIGINT AS empty, 0::BIGINT AS lost FROM edges",
    "phase_cover": "WITH "
    + f"{D.ALTS}, {D.LOCKS}, {_PAIRS}, ends AS (SELECT a AS n FROM pairs UNION ALL SELECT b FROM pairs), once AS (SELECT n FROM ends GROUP BY n HAVING count(*) = 1)"
    + ", p0 AS (SELECT node_id FROM locks UNION SELECT n FROM ends)"
    + "".join(f", p{k + 1} AS (SELECT node_id FROM p{k} UNION SELECT node_id FROM alts WHERE alt_id IN (SELECT node_id FROM p{k}))" for k in range(4))
    + """
SELECT p.node_id, CAST(l.phase AS TINYINT) AS locked, CASE WHEN q.a IS NOT NULL THEN true END AS apart FROM p4 p LEFT JOIN locks l ON l.node_id = p.node_id
LEFT JOIN (SELECT a FROM pairs WHERE a IN (SELECT n FROM once) AND b IN (SELECT n FROM once)) q ON q.a = p.node_id""",
    "phase_fixed_point": f"WITH {D.ALTS}, {D.LOCKS}, {_PAIRS} SELECT sample, pair_idx AS meta, false AS gains FROM pairs, (SELECT unnest([0, 1]) AS sample)",
    "chain_cover": f"WITH {_SUBGRAPH} SELECT graph_id, part, node_id, 1::BIGINT AS greedy, 1::BIGINT AS exact FROM members",
    "chain_components": f"""WITH RECURSIVE {_SUBGRAPH},
sub AS (
  SELECT e.graph_id, x.part, e.src, e.dst FROM edges e JOIN members x ON x.graph_id = e.graph_id AND x.node_id = e.src
  JOIN members y ON y.graph_id = e.graph_id AND y.node_id = e.dst AND y.part = x.part WHERE NOT e.src_rev), {_MEMBERS},
per AS (SELECT graph_id, part, smallest, count(*) AS nodes FROM comp GROUP BY 1, 2, 3)
SELECT graph_id, part, row_number() OVER (PARTITION BY graph_id, part ORDER BY smallest) - 1 AS chain_idx, smallest, nodes FROM per""",
    "greedy_steps": f"WITH {_SUBGRAPH} SELECT graph_id, part, count(*) AS members, 0::BIGINT AS off, 0::BIGINT AS inside FROM members GROUP BY 1, 2",
    "unphased_numbers": f"""WITH {D.EDGES}, {D.ALTS}, {D.LOCKS}, gn AS (SELECT DISTINCT graph_id, src AS node_id FROM edges)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS chain_idx, node_id FROM gn
WHERE node_id IN (SELECT node_id FROM alts) AND node_id NOT IN (SELECT node_id FROM locks)""",
    "segment_numbers": f"""WITH {D.NODES}, {D.ALTS}, {D.CHAIN}
SELECT row_number() OVER (ORDER BY part, graph_id, chain_idx, pos) - 1 AS seg_idx, graph_id, part, pos,
  name || CASE WHEN c.node_id IN (SELECT node_id FROM alts) OR part = 2 THEN '' ELSE '_ph' || part END AS name FROM chain c JOIN nodes n ON n.node_id = c.node_id""",
    "canonical_kmers": f"WITH {D.NODES}, {_CODES} SELECT node_id, count(*) AS windows, count(DISTINCT code) AS different, min(code) AS low, max(code) AS high FROM km GROUP BY node_id",
    "kmer_sketch": f"WITH {D.NODES}, {_SKETCH} SELECT node_id, k AS place, CAST(CASE WHEN x >= 9223372036854775808 THEN x::HUGEINT - 18446744073709551616 ELSE x::HUGEINT END AS BIGINT) AS hash FROM sk",
    "jaccard_pairs": f"""WITH {D.NODES}, {D.ALTS}, {_SKETCH},
asked AS (SELECT DISTINCT least(node_id, alt_id) AS a, greatest(node_id, alt_id) AS b FROM alts), {_SIM} SELECT a, b, jaccard FROM sim""",
    "sibling_candidates": f"WITH {D.EDGES}, {_SIBLINGS} SELECT graph_id, a, b FROM sib",
    "reciprocal_best_siblings": f"""WITH {D.NODES}, {D.EDGES}, {_SIBLINGS}, {_SKETCH},
fit AS (SELECT node_id FROM nodes WHERE length >= {K16}),
cand AS (SELECT * FROM sib WHERE a IN (SELECT node_id FROM fit) AND b IN (SELECT node_id FROM fit)),
asked AS (SELECT DISTINCT a, b FROM cand), {_SIM},
best AS (
  SELECT graph_id, a, b FROM (
    SELECT c.*, row_number() OVER (PARTITION BY graph_id, c.a ORDER BY jaccard DESC, c.b) AS k FROM cand c JOIN sim s ON s.a = c.a AND s.b = c.b WHERE jaccard >= 0.1) WHERE k = 1)
SELECT x.graph_id, x.a, x.b FROM best x JOIN best y ON x.graph_id = y.graph_id AND x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "simple_bubbles": f"""WITH {D.EDGES}, {_SPLIT},
o AS (SELECT graph_id, s AS n, count(*) AS c FROM split GROUP BY 1, 2), i AS (SELECT graph_id, t AS n, count(*) AS c FROM split GROUP BY 1, 2),
mid AS (SELECT o.graph_id, o.n FROM o JOIN i ON i.graph_id = o.graph_id AND i.n = o.n WHERE o.c = 1 AND i.c = 1),
via AS (
  SELECT m.graph_id, x.s, y.t, m.n FROM mid m JOIN split x ON x.graph_id = m.graph_id AND x.t = m.n JOIN split y ON y.graph_id = m.graph_id AND y.s = m.n
  WHERE x.s <> y.t AND x.s <> m.n AND y.t <> m.n),
two AS (SELECT graph_id, s, t, min(n) AS node_a, max(n) AS node_b FROM via GROUP BY 1, 2, 3 HAVING count(*) = 2)
SELECT two.graph_id, s AS source, t AS sink, node_a, node_b FROM two JOIN o ON o.graph_id = two.graph_id AND o.n = s AND o.c = 2 JOIN i ON i.graph_id = two.graph_id AND i.n = t AND i.c = 2""",
    "branch_sequences": f"""WITH {D.NODES},
sides AS (SELECT bubble_id AS bubble, 0 AS side, unnest(list_distinct(branch_a)) AS node_id FROM bubbles UNION ALL SELECT bubble_id, 1, unnest(list_distinct(branch_b)) FROM bubbles)
SELECT bubble, side, string_agg(seq, '' ORDER BY s.node_id) AS seq FROM sides s JOIN nodes n ON n.node_id = s.node_id GROUP BY 1, 2""",
    "trio_scores": f"WITH {_TRIO} SELECT node_id, pat_count, mat_count FROM scores",
    "trio_locks": f"""WITH {_TRIO}, {D.ALTS},
share AS (SELECT node_id, pat_count::DOUBLE / (pat_count + mat_count) AS p, mat_count::DOUBLE / (pat_count + mat_count) AS m FROM scores WHERE pat_count + mat_count >= 1)
SELECT node_id, CAST(CASE WHEN p >= 0.8 THEN 0 ELSE 1 END AS TINYINT) AS phase FROM share WHERE (p >= 0.8 OR m >= 0.8) AND node_id IN (SELECT node_id FROM alts)""",
    "free_pairs": f"WITH {D.ALTS}, {D.LOCKS}, {_PAIRS} SELECT pair_idx, a, b FROM pairs",
    "meta_adjacency": f"WITH {_ENERGY} SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM wt",
    "flip_delta": f"""WITH {_ENERGY},
pull AS (SELECT sample, i, sum(w * sign) AS p FROM wt JOIN signs ON meta = j GROUP BY 1, 2)
SELECT s.sample, s.meta, s.sign, CAST(-2 * s.sign * (coalesce(p, 0) + coalesce(f.w, 0)) AS BIGINT) AS delta
FROM signs s LEFT JOIN pull ON pull.sample = s.sample AND pull.i = s.meta LEFT JOIN fld f ON f.i = s.meta""",
    "agreement_pairs": f"""WITH {_ENERGY},
adj AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM wt),
per AS (
  SELECT adj.i, adj.j, count(*) FILTER (x.sign = y.sign) AS same, count(*) AS samples FROM adj JOIN signs x ON x.meta = adj.i JOIN signs y ON y.meta = adj.j AND y.sample = x.sample GROUP BY 1, 2)
SELECT i, j, same, samples, greatest(same, samples - same)::DOUBLE / samples AS agreement FROM per""",
    "phase_propagation": "WITH "
    + D.ALTS
    + ", "
    + D.LOCKS
    + ", p0 AS (SELECT node_id, phase FROM locks)"
    + "".join(
        f", p{k + 1} AS (SELECT * FROM p{k} UNION ALL SELECT a.node_id, 1 - max(p.phase) FROM alts a JOIN p{k} p ON p.node_id = a.alt_id WHERE a.node_id NOT IN (SELECT node_id FROM p{k}) GROUP BY a.node_id)"
        for k in range(4)
    )
    + " SELECT node_id, CAST(phase AS TINYINT) AS phase FROM p4",
    "phase_subgraph": f"""WITH {_SUBGRAPH}
SELECT e.graph_id, x.part, e.src, e.dst, e.edge_ord FROM edges e JOIN members x ON x.graph_id = e.graph_id AND x.node_id = e.src
JOIN members y ON y.graph_id = e.graph_id AND y.node_id = e.dst AND y.part = x.part WHERE NOT e.src_rev""",
    "unzip_segments": f"""WITH {D.NODES}, {D.ALTS}, {D.CHAIN}
SELECT graph_id, part, chain_idx, pos, c.node_id,
  name || CASE WHEN c.node_id IN (SELECT node_id FROM alts) OR part = 2 THEN '' ELSE '_ph' || part END AS name,
  CASE WHEN length = 0 THEN len(seq) ELSE length END AS length, coverage, CASE WHEN part < 2 THEN part ELSE -1 END AS phase
FROM chain c JOIN nodes n ON n.node_id = c.node_id""",
    "unzip_links": f"WITH {D.EDGES}, {D.CHAIN}, {_BEST} SELECT * FROM lnk",
    "chain_sequences": f"""WITH {D.NODES}, {D.EDGES}, {D.CHAIN}, {_BEST},
own AS (SELECT c.*, seq, lag(pos) OVER (PARTITION BY graph_id, part, chain_idx ORDER BY pos) AS prev FROM chain c JOIN nodes n ON n.node_id = c.node_id),
piece AS (
  SELECT o.graph_id, o.part, o.chain_idx, o.pos, substr(seq, coalesce(overlap, 0) + 1) AS s FROM own o
  LEFT JOIN lnk l ON l.graph_id = o.graph_id AND l.part = o.part AND l.chain_idx = o.chain_idx AND l.pos = o.prev)
SELECT graph_id, part, chain_idx, string_agg(s, '' ORDER BY pos) AS seq FROM piece GROUP BY 1, 2, 3""",
    "gfa_segment_lines": f"""WITH {D.NODES}, {D.PHASED},
own AS (SELECT n.node_id, name, seq, CASE WHEN length = 0 THEN len(seq) ELSE length END AS ln, coverage, coalesce(phase, -1) AS ph FROM nodes n LEFT JOIN phased p ON p.node_id = n.node_id)
SELECT node_id, 'S' || chr(9) || name || chr(9) || CASE WHEN seq = '' THEN '*' ELSE seq END || CASE WHEN ln > 0 THEN chr(9) || 'LN:i:' || ln ELSE '' END
  || CASE WHEN coverage > 0 THEN chr(9) || 'RC:i:' || coverage ELSE '' END || chr(9) || 'PH:i:' || ph AS line FROM own""",
    "gfa_link_lines": f"""WITH {D.NODES}, {D.EDGES},
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, src, dst ORDER BY edge_ord) AS k FROM edges WHERE src <= dst) WHERE k = 1)
SELECT graph_id, src, dst, 'L' || chr(9) || a.name || chr(9) || CASE WHEN src_rev THEN '-' ELSE '+' END || chr(9) || b.name || chr(9) || CASE WHEN dst_rev THEN '-' ELSE '+' END
  || chr(9) || overlap || 'M' AS line FROM low JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst""",
    "gfa_path_lines": f"""WITH {D.NODES}, {D.CHAIN}
SELECT graph_id, part, 'P' || chr(9) || 'chain_' || CASE part WHEN 0 THEN 'ph0' WHEN 1 THEN 'ph1' ELSE 'un' END || '_' || graph_id || chr(9) || string_agg(name || '+', ',' ORDER BY pos)
  || chr(9) || '*' AS line FROM chain c JOIN nodes n ON n.node_id = c.node_id GROUP BY graph_id, part""",
    "phase_labels": f"WITH {D.NODES}, {D.PHASED} SELECT name AS contig_id, CAST(phase AS TINYINT) AS phase FROM phased p JOIN nodes n ON n.node_id = p.node_id",
    "assignment_score": """WITH m AS (
  SELECT substr(name, 1, 3) AS tool, phase, CASE WHEN coverage % 2 = 0 THEN 'pat' ELSE 'mat' END AS ref,
    coalesce(sum(length)::DOUBLE / 100, 0) - 0.1::DOUBLE * count(*)::DOUBLE - 0.05::DOUBLE * max(coverage)::DOUBLE AS score
  FROM uz_segments WHERE phase >= 0 AND name IS NOT NULL GROUP BY 1, 2, 3),
wide AS (
  SELECT tool, max(score) FILTER (phase = 0 AND ref = 'pat') + max(score) FILTER (phase = 1 AND ref = 'mat') AS straight,
    max(score) FILTER (phase = 0 AND ref = 'mat') + max(score) FILTER (phase = 1 AND ref = 'pat') AS crossed FROM m GROUP BY tool)
SELECT tool, straight, crossed, CASE WHEN straight IS NULL OR crossed IS NULL THEN '?' WHEN straight >= crossed THEN 'PATERNAL' ELSE 'MATERNAL' END AS phase0_parent FROM wide""",
}
