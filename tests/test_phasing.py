"""K-mers, bubbles, phasing, chains and the whole pipeline on small graphs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phasewright.functions import kmers as KF
from phasewright.operators import bubbles as B
from phasewright.operators import chain as H
from phasewright.operators import graph as G
from phasewright.operators import kmers as K
from phasewright.operators import phase as P
from phasewright.operators import unzip as U
from phasewright.pipeline import main, parser, run
from phasewright.plans import phase_queries as Q


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_kmer_codes():
    random.seed(2)
    seq = "".join(random.choice("ACGT") for _ in range(80)) + "NA" + "".join(random.choice("acgt") for _ in range(40))
    code = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
    for k in (1, 3, 16, 31, 32):
        want = [min(code(w), code(revcomp(w))) for i in range(len(seq) - k + 1) if set(w := seq[i : i + k].upper()) <= set("ACGT")]
        assert KF.canonical(seq, k).tolist() == want
    assert len(KF.sketch("ACGT", 16, 5)) == 0 and len(KF.sketch("A" * 40, 16, 10)) == 10
    for k in (0, 33):
        with pytest.raises(ValueError):
            KF.canonical(seq, k)
    x = np.array([1, 2**63 + 5], np.uint64)
    assert len(set(KF.mix64(x).tolist())) == 2 and KF.mix64(np.array([0], np.uint64))[0] == 0
    assert len(set(KF.invertible(np.arange(4**5, dtype=np.uint64), 5).tolist())) == 4**5


def test_similarity_and_trio(spark):
    nodes = spark.createDataFrame([(1, "ACGTTGCATCAGGCTA" * 3), (2, "ACGTTGCATCAGGCTA" * 3), (3, "C" * 50), (4, ""), (5, None)], "node_id long, seq string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 5)], "a long, b long")
    got = {(a, b): j for a, b, j in rows(K.similarities(pairs, K.sketches(nodes, 16, 1000)))}
    assert got == {(1, 2): 1.0, (1, 3): 0.0, (1, 4): 0.0, (4, 5): 0.0}
    pat, mat = K.kmer_set(nodes.where("node_id = 1"), 31), K.kmer_set(nodes.where("node_id = 3"), 31)
    scores = K.trio_scores(nodes, pat, mat, 31)
    assert rows(scores) == [(1, 18, 0), (2, 18, 0), (3, 0, 20), (4, 0, 0), (5, 0, 0)]
    assert rows(K.trio_locks(scores, nodes.where("node_id <> 2"))) == [(1, 0), (3, 1)]
    by_hand = spark.createDataFrame([(6, 100, 5), (7, 5, 100), (8, 50, 50), (9, 0, 0)], "node_id long, pat_count long, mat_count long")
    assert rows(K.trio_locks(by_hand, by_hand)) == [(6, 0), (7, 1)]


PAT, MAT, SCORED = 1, 2, 4


def test_runs_score_as_kmer_sets(spark):
    """Strands, letter cases, ambiguous letters, repeats, nodes without windows: as with sets of k-mers."""
    random.seed(5)
    core = "".join(random.choice("ACGT") for _ in range(400))
    marked = [(None, core[:100], PAT | SCORED), (None, "A" * 50, MAT)]
    for n in range(60):
        s = core[(i := random.randrange(350)) : i + random.randrange(120)]
        s = random.choice([s, revcomp(s), s.lower(), s[:20] + random.choice("N漢") + s[20:], s * 3, "AT" * 40, "T" * 40])
        marked.append((n, s, random.choice([0, PAT, MAT, SCORED, SCORED, PAT | SCORED, PAT | MAT | SCORED])))
    marked += [(100, "ACGT", SCORED), (101, "", SCORED), (102, None, SCORED | MAT)]
    df = spark.createDataFrame(marked, "node_id long, seq string, mark int")
    nodes = df.where(F.col("node_id").isNotNull())
    for k in (5, 31):
        parents = [K.kmer_set(df.where(F.col("mark").bitwiseAND(bit) > 0), k) for bit in (PAT, MAT)]
        want = {n: (p, m) for n, p, m in rows(K.trio_scores(nodes, *parents, k))}
        got = {n: (p, m) for n, p, m in rows(K.sequence_scores(nodes, df, k))}
        assert got == {n: want[n] if mark & SCORED else (0, 0) for n, _, mark in marked if n is not None}
        assert sum(map(sum, got.values())) > 0
    assert rows(K.sequence_scores(nodes, df.where("false"), 31)) == [(n, 0, 0) for n, _, _ in marked if n is not None]


def test_runs_in_parts(monkeypatch):
    """Sequences longer than what is worked on at once lose no window where they are cut."""
    random.seed(6)
    seqs = ["".join(random.choice("ACGT") for _ in range(n)) for n in (500, 20, 31, 200)]
    seqs.append(revcomp(seqs[0])[100:400])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(seqs), pa.array([SCORED, 7, 6, 5, 6], pa.int32())], names=["node_id", "seq", "mark"])

    def scores():
        table = pa.Table.from_batches(list(K._classed(batch, 31, 1)))
        return sorted(map(tuple, (r.values() for r in K._met(table, 31).to_pylist())))

    whole = scores()
    monkeypatch.setattr(K, "AT_ONCE", 64)
    parts = pa.Table.from_batches(list(K._classed(batch, 31, 1)))
    assert len(parts) > 10 and sum(r >> 3 for x in parts.column("runs").to_pylist() for r in x) == 470 + 1 + 170 + 270
    assert scores() == whole == [(0, 0, 270), (2, 0, 1), (3, 170, 0), (4, 0, 270)]


def trio_run(spark, query, folder):
    """What the query gives, and how often Python goes through sequences, on 3000 nodes of 60 bases, a third unzipped on each haplotype."""
    random.seed(7)
    seqs = ["".join(random.choice("ACGT") for _ in range(60)) for _ in range(3000)]
    none = "CAST(NULL AS BIGINT)"
    spark.createDataFrame(list(enumerate(seqs)), "node_id long, seq string").selectExpr("node_id AS line_no", "node_id", "CAST(node_id AS STRING) AS name", "seq", f"{none} AS ln", f"{none} AS rc").write.parquet(f"{folder}/segments.parquet")
    spark.read.parquet(f"{folder}/segments.parquet").limit(0).write.parquet(f"{folder}/shared_segments.parquet")
    spark.range(3000).selectExpr("id AS src_id", "CAST(id % 3 - 1 AS TINYINT) AS phase").write.parquet(f"{folder}/uz_segments.parquet")
    spark.range(3000).selectExpr("id AS pair_no", "id AS node_id", "id + 3000 AS alt_id").write.parquet(f"{folder}/alt_map.parquet")
    df = query(spark, str(folder))
    got = rows(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    return got, plan.partition("Initial Plan")[0].count("MapInArrow")


def test_trio_locks_reads_each_sequence_once(spark, tmp_path):
    got, python_steps = trio_run(spark, Q.trio_locks, tmp_path)
    assert got == [(n, n % 3 - 1) for n in range(3000) if n % 3]
    assert python_steps == 1


def test_trio_scores_reads_each_sequence_once(spark, tmp_path):
    got, python_steps = trio_run(spark, Q.trio_scores, tmp_path)
    assert got == [(n, 30 * (n % 3 == 1), 30 * (n % 3 == 2)) for n in range(3000)]
    assert python_steps == 1


def edges_of(spark, pairs, graph=0):
    links = spark.createDataFrame([(graph, k, u, v, False, False, 0) for k, (u, v) in enumerate(pairs)], "graph_id long, link_no long, source_id long, target_id long, source_rev boolean, target_rev boolean, overlap long")
    return G.mirrored_edges(links)


SNP = [(0, 1), (0, 2), (1, 3), (2, 3)]
LONG = [(3, 4), (4, 5), (4, 6), (5, 7), (6, 8), (7, 9), (8, 9)]
THREE = [(9, 10), (10, 11), (10, 12), (10, 13), (11, 14), (12, 14), (13, 14)]
NESTED = [(14, 15), (15, 16), (15, 17), (17, 18), (17, 19), (18, 20), (19, 20), (16, 21), (20, 21)]
TAIL = [(21, 22), (22, 23), (22, 24)]
INDEL = [(30, 31), (31, 32), (30, 32)]
CYCLE = [(40, 41), (41, 40)]


def test_superbubbles(spark):
    found = B.superbubbles(edges_of(spark, SNP + LONG + THREE + NESTED + TAIL + INDEL + CYCLE)).collect()
    got = {(frozenset((r.source, r.sink)), frozenset((tuple(r.branch_a), tuple(r.branch_b)))) for r in found}
    assert got == {
        (frozenset((0, 3)), frozenset(((1,), (2,)))), (frozenset((4, 9)), frozenset(((5, 7), (6, 8)))), (frozenset((10, 14)), frozenset(((11, 12, 13), ()))),
        (frozenset((15, 21)), frozenset(((16,), (17, 18, 19, 20)))), (frozenset((17, 20)), frozenset(((18,), (19,)))),
    }
    seq = {frozenset((r.source, r.sink)): r.emit_seq for r in found}
    assert seq[frozenset((15, 21))] < seq[frozenset((17, 20))]
    simple = {(r.source // 2, r.node_a // 2, r.node_b // 2, r.sink // 2) for r in B.simple_bubbles(edges_of(spark, SNP + LONG + NESTED)).collect() if r.source % 2 == 0}
    assert simple == {(0, 1, 2, 3), (17, 18, 19, 20)}


def brute_bubbles(pairs):
    """(s, t) by definition, on a graph without cycles: what is reached from s before t is what reaches t after s."""
    out, into = {}, {}
    for u, v in pairs:
        out.setdefault(u, set()).add(v)
        into.setdefault(v, set()).add(u)

    def reach(a, step, stop):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for y in step.get(x, ()):
                if y != stop and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    found = set()
    nodes = set(out) | set(into)
    for s, t in itertools.permutations(nodes, 2):
        inside = reach(s, out, t)
        if len(inside) >= 1 and s not in inside and inside == reach(t, into, s) and t in set().union(*(out.get(x, set()) for x in inside | {s})):
            found.add((s, t, frozenset(inside)))
    return {(s, t) for s, t, i in found if not any(s == a and j < i for a, b, j in found) and not any(t == b and j < i for a, b, j in found)}


def test_superbubbles_against_the_definition():
    random.seed(5)
    for _ in range(200):
        n = random.randint(4, 9)
        pairs = sorted({tuple(sorted(random.sample(range(n), 2))) for _ in range(random.randint(4, 14))})
        got = {(s, t) for s, t, _, _ in B.superbubbles_of(np.array([2 * u for u, _ in pairs]), np.array([2 * v for _, v in pairs]))}
        want = {(s, t) for s, t in brute_bubbles(pairs) if sum(1 for u, v in pairs if u == s and v != t) >= 2}
        assert want <= got, (pairs, want, got)


def test_interleaved_components_change_no_bubble(spark):
    """Two graphs whose node ids alternate give the bubbles of each one alone."""
    shape = SNP + LONG + NESTED + [(21, 5), (30, 31)]
    ids = [lambda n: 2 * n, lambda n: 2 * n + 1]
    alone = [B.superbubbles(edges_of(spark, [(f(u), f(v)) for u, v in shape])).drop("emit_seq").collect() for f in ids]
    both = B.superbubbles(edges_of(spark, [(f(u), f(v)) for u, v in shape for f in ids]))
    assert sorted(both.drop("emit_seq").collect()) == sorted(alone[0] + alone[1])
    assert sorted(r.emit_seq for r in both.collect()) == list(range(both.count()))
    assert B.superbubbles(edges_of(spark, SNP).where("false")).collect() == []


def test_alts(spark):
    a, b = "ACGTTGCATCAGGCTAACGGT", "TTGACCAGTAGACCATAGCCA"
    nodes = spark.createDataFrame([(k, {1: a, 2: a, 5: a, 6: b}.get(k, ""), 21) for k in range(12)], "node_id long, seq string, length long")
    found = spark.createDataFrame([(0, [1], [2]), (1, [5], [6]), (2, [3, None, 4], [8, 7]), (3, [9, 10, 11], None), (4, [3], [1])], "bubble long, branch_a array<long>, branch_b array<long>")
    got = dict(rows(B.bubble_alts(found, nodes, 16, 100, 0.5).where("alt_id IS NOT NULL")))
    assert got == {1: 3, 2: 1, 3: 1, 4: 7, 7: 3, 8: 3}
    every = {r.node_id for r in B.bubble_alts(found, nodes, 16, 100, 0.5).collect()}
    assert every == {1, 2, 3, 4, 7, 8, 9, 10, 11}
    e = edges_of(spark, [(0, 5), (0, 6), (0, 1), (2, 9)])
    assert rows(B.sibling_candidates(e))[:2] == [(0, 1, 5), (0, 1, 6)]
    pairs = B.reciprocal_best(B.sibling_candidates(e), nodes, 16, 100, 0.9)
    assert rows(pairs) == [(0, 1, 5)]
    assert rows(B.reciprocal_best(B.sibling_candidates(e), nodes, 16, 100, 0.0)) == [(0, 1, 5)]


def test_phasing_reaches_a_fixed_point(spark):
    random.seed(3)
    pairs = [(2 * k, 2 * k + 1) for k in range(12)]
    contacts = {}
    for _ in range(60):
        u, v = sorted(random.sample(range(24), 2))
        contacts[u, v] = random.randint(1, 9)
    c = spark.createDataFrame([(u, v, w) for (u, v), w in contacts.items()], "u long, v long, w long")
    alts = spark.createDataFrame([(a, b) for p in pairs for a, b in (p, p[::-1])], "node_id long, alt_id long")
    locked = spark.createDataFrame([(0, 1), (1, 0)], "node_id long, phase byte")
    alone = P.PhaserConfig(sweeps=50, rounds=1, merge_threshold=1.1)  # metas are merged as wholes, so only single ones end where no flip gains
    got = dict(rows(P.assign_phases(c, alts, locked, alone)))
    assert got[0] == 1 and got[1] == 0 and all(got[a] + got[b] == 1 for a, b in pairs)
    score = lambda phase: sum(w if phase[u] == phase[v] else -w for (u, v), w in contacts.items())
    for a, b in pairs[1:]:
        assert score({**got, a: got[b], b: got[a]}) <= score(got)
    assert rows(P.assign_phases(c, alts, locked, alone)) == sorted(got.items())
    merged = dict(rows(P.assign_phases(c, alts, locked, P.PhaserConfig(sweeps=50))))
    assert set(merged) == set(got) and all(merged[a] + merged[b] == 1 for a, b in pairs)


def test_shared_and_locked_pairs(spark):
    alts = spark.createDataFrame([(5, 10), (6, 10), (10, 6)], "node_id long, alt_id long")
    none = spark.createDataFrame([], "node_id long, phase byte")
    pairs = P.free_pairs(alts, none)
    assert rows(pairs) == [(0, 5, 10), (1, 6, 10)]
    assert rows(P.node_map(pairs)) == [(5, 0, 1), (6, 1, 1), (10, 1, -1)]
    signs = spark.createDataFrame([(0, 1), (1, 1)], "meta long, sign int")
    assert rows(P.write_back(pairs, signs, none)) == [(5, 0), (6, 0), (10, 1)]
    half = spark.createDataFrame([(10, 0)], "node_id long, phase byte")
    contacts = spark.createDataFrame([], "u long, v long, w long")
    assert rows(P.assign_phases(contacts, alts, half)) == [(10, 0)]
    assert rows(P.assign_phases(contacts, alts, half, P.PhaserConfig(propagate_always=True))) == [(5, 1), (6, 1), (10, 0)]
    assert rows(P.assign_phases(contacts, alts.where("false"), none)) == []


def test_hamiltonian_path():
    one = H.hamiltonian_path([3, 4, 5, 7], {4: [3], 3: [5], 5: [7]}, [4], [7])
    assert one.solved and one.path == one.unique_prefix == [4, 3, 5, 7]
    none = H.hamiltonian_path([1, 2, 3, 4], {1: [2], 3: [4]})
    assert none.solved and none.path == []
    assert not H.hamiltonian_path(list(range(23)), {k: [k + 1] for k in range(22)}).solved
    assert H.hamiltonian_path(list(range(22)), {k: [k + 1] for k in range(21)}).path == list(range(22))
    full = {k: [m for m in range(12) if m != k] for k in range(12)}
    cut = H.hamiltonian_path(list(range(12)), full, max_states=50)
    assert not cut.solved and cut.states == 50
    two = H.hamiltonian_path([0, 1, 2, 3], {0: [1], 1: [2, 3], 2: [3], 3: [2]}, [0])
    assert two.path == [0, 1, 3, 2] and two.unique_prefix == [0, 1]
    assert H.hamiltonian_path([], {}).solved and H.hamiltonian_path([9], {}).path == [9]
    alone = H.hamiltonian_path([9], {}, [8])
    assert not alone.solved and alone.path == [] and H.hamiltonian_path([9], {}, [9], [9]).path == [9]
    outside = H.hamiltonian_path([1, 2], {1: [2]}, [7])
    assert outside.solved and outside.path == []  # starts that are given but lie outside allow no path
    assert H.hamiltonian_path([1, 2, 3], {1: [2], 2: [3]}, [1], max_states=2).path == [1, 2, 3]  # starts are no states
    assert not H.hamiltonian_path([1, 2, 3, 4], {1: [2], 2: [3]}, [1], max_states=2).solved
    random.seed(4)
    for _ in range(100):
        n = random.randint(2, 6)
        succ = {u: [v for v in range(n) if v != u and random.random() < 0.4] for u in range(n)}
        exists = any(all(b in succ[a] for a, b in itertools.pairwise(p)) for p in itertools.permutations(range(n)))
        assert bool(H.hamiltonian_path(list(range(n)), succ).path) == exists


def test_chains(spark):
    e = edges_of(spark, SNP + [(3, 4), (8, 9)])
    nodes = e.select("graph_id", F.col("src").alias("node_id")).distinct()
    alts = spark.createDataFrame([(1, 2), (2, 1)], "node_id long, alt_id long")
    phases = spark.createDataFrame([(1, 0), (2, 1)], "node_id long, phase byte")
    members, kept = H.phase_subgraph(e, nodes, phases, alts)
    contacts = spark.createDataFrame([(0, 1, 5)], "u long, v long, w long")
    for exact in (False, True):
        got = rows(H.chains(members, kept, contacts, exact).where("graph_id = 0"))
        walks = {}
        for _, part, chain, pos, node in got:
            walks.setdefault((part, chain), []).append(node)
        assert walks == {(0, 0): [0, 1, 3, 4], (0, 1): [8, 9], (1, 0): [0, 2, 3, 4], (1, 1): [8, 9]}
    assert rows(H.unphased_chains(nodes, phases.where("false"), alts)) == [(0, 2, 0, 0, 1), (0, 2, 1, 0, 2)]
    full = H.chains(members, kept, contacts)
    table = spark.createDataFrame([(k, f"n{k}", "ACGTACGTAC"[:k], k, 0) for k in range(10)], "node_id long, name string, seq string, length long, coverage long")
    segments = rows(U.unzip_segments(full, table, alts).select("part", "name"))
    assert (0, "n0_ph0") in segments and (1, "n0_ph1") in segments and (0, "n1") in segments and (1, "n2") in segments
    links = U.unzip_links(full, e)
    assert links.where("is_synthetic").count() == 0 and links.count() == 8


def walked(nodes, edges, weight):
    """Greedy chains of a whole haplotype, by one walk through it."""
    succ, into, seen, out = {}, {v for _, v in edges}, set(), []
    for u, v in edges:
        succ.setdefault(u, []).append(v)
    for seed in [u for u in sorted(nodes) if u not in into] + sorted(nodes):
        walk, u = [], seed
        while u is not None and u not in seen:
            seen.add(u)
            walk.append(u)
            free = [v for v in succ.get(u, []) if v not in seen]
            u = min(free, key=lambda v, u=u: (-weight.get((min(u, v), max(u, v)), 0), v), default=None)
        if walk:
            out.append(walk)
    return out


def test_chains_by_component_are_those_of_one_walk(spark):
    r = random.Random(6)
    nodes = list(range(60))
    edges = sorted({(r.randrange(60), r.randrange(60)) for _ in range(45)} | {(5, 5), (59, 59)})
    weight = {tuple(sorted(r.sample(nodes, 2))): r.randint(1, 4) for _ in range(300)}
    members = spark.createDataFrame([(g, p, n) for g in (3, -1) for p in (0, 1) for n in nodes], "graph_id long, part int, node_id long")
    kept = spark.createDataFrame([(g, p, u, v, k) for g in (3, -1) for p in (0, 1) for k, (u, v) in enumerate(edges)], "graph_id long, part int, src long, dst long, edge_ord long")
    contacts = spark.createDataFrame([(u, v, w) for (u, v), w in weight.items()], "u long, v long, w long")
    want = walked(nodes, edges, weight)
    got = {}
    for g, p, c, k, n in rows(H.chains(members, kept, contacts)):
        got.setdefault((g, p), {}).setdefault(c, []).append((k, n))
    assert set(got) == {(g, p) for g in (3, -1) for p in (0, 1)}
    for chains in got.values():
        assert [[n for _, n in sorted(chains[c])] for c in sorted(chains)] == want and sorted(chains) == list(range(len(want)))
    exact = {}
    for g, p, c, _, n in rows(H.chains(members, kept, contacts, True)):
        exact.setdefault((g, p, c), set()).add(n)
    first = [min(exact[3, 0, c]) for c in range(len({c for g, p, c in exact if (g, p) == (3, 0)}))]
    assert first == sorted(first) and not {(u, v) for u, v in edges for s in exact.values() if (u in s) != (v in s)}
    assert H.chains(members.where("false"), kept.where("false"), contacts).collect() == []


def test_stitching(spark):
    chain = spark.createDataFrame([(0, 0, 0, k, n, r) for k, (n, r) in enumerate([(1, False), (2, True), (3, False), (4, False)])], "graph_id long, part int, chain_idx long, pos long, node_id long, reverse boolean")
    nodes = spark.createDataFrame([(1, "AACC"), (2, "GTTT"), (3, "AC"), (4, "GG")], "node_id long, seq string")
    links = spark.createDataFrame([(0, 1, 1, 2, False, False, 2), (0, 2, 2, 3, False, False, 5)], "graph_id long, link_no long, source_id long, target_id long, source_rev boolean, target_rev boolean, overlap long")
    got = U.chain_sequences(chain, nodes, G.mirrored_edges(links)).collect()
    assert [r.seq for r in got] == ["AACC" + "AC" + "" + "GG"]
    assert U.unzip_links(chain.drop("reverse"), G.mirrored_edges(links)).where("is_synthetic").count() == 1


def test_pipeline(spark, tmp_path):
    random.seed(7)
    seqs = {k: "".join(random.choice("ACGT") for _ in range(60)) for k in range(25)}
    seqs[2], seqs[24] = seqs[1][:59] + "A", seqs[23]
    pairs = SNP + LONG + [(9, 23), (9, 24)]
    used = sorted({x for p in pairs for x in p})
    gfa = "".join(f"S\ts{k}\t{seqs[k]}\n" for k in used) + "".join(f"L\ts{u}\t+\ts{v}\t+\t0M\n" for u, v in pairs)
    (tmp_path / "g.gfa").write_text(gfa)
    (tmp_path / "r.sam").write_text("".join(f"q{k}\t65\ts{a}\t1\t60\t5M\ts{b}\t1\t0\t*\t*\n" for k, (a, b) in enumerate([(1, 5), (1, 5), (2, 6), (5, 7), (6, 8), (5, 23)])))
    a = parser().parse_args(["-g", str(tmp_path / "g.gfa"), "-b", str(tmp_path / "r.sam"), "--out-dir", str(tmp_path / "out"), "--jaccard-threshold", "0.0"])
    out = run(spark, a)
    assert out["nodes"].count() == len(used)
    name = {r.node_id: int(r["name"][1:]) for r in out["nodes"].collect()}
    phase = {name[n]: p for n, p in rows(out["phases"])}
    assert phase[1] + phase[2] == 1 and phase[5] == phase[7] == phase[1] and phase[6] == phase[8] == phase[2]
    total = {r["name"]: r["total"] for r in out["totals"].collect()}
    assert total["nodes"] == len(used) and total["edges"] == 2 * len(pairs) and total["contact weight"] == 6 and total["segments"] == out["segments"].count() and total["locked"] == 0
    assert sorted(r.seg_idx for r in out["segments"].collect()) == list(range(out["segments"].count()))
    kinds = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert kinds == ["g.chained.gfa", "g.labels.csv", "g.phase_0.fasta", "g.phase_1.fasta", "g.unphased.fasta", "g.unzipped.gfa"]
    text = lambda n: "".join(p.read_text() for p in sorted((tmp_path / "out" / n).glob("part-*")))
    assert text("g.chained.gfa").count("S\t") == len(used)
    again = text("g.unzipped.gfa")
    assert again.count("S\t") == out["segments"].count() and again.count("L\t") == out["links"].count()
    assert "s0_ph0" in again and "s0_ph1" in again and "s1_ph" not in again
    assert text("g.phase_0.fasta").startswith(">ph0_0\n")
    assert main(["-g", str(tmp_path / "none.gfa"), "-b", str(tmp_path / "r.sam")]) == 1
    for bad in (["-g", "x"], ["-g", "x", "-b", "y", "-p", "z"], ["-g", "x", "-b", "y", "--bubble-mode", "csv"], ["-g", "x", "-b", "y", "--what"]):
        with pytest.raises(SystemExit):
            main(bad)
