"""Problems 1 to 3 against brute force: nulls, ties, repeats, hot keys, empty inputs, clashing columns."""

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from phasewright.llm.components import group_links, links_of_lists, shuffled, unshuffled
from phasewright.llm.cooccurrence import contigs_together, fit_null, log_tail, pairs_together
from phasewright.llm.neardup import BKTree, Forest, graph_records, near_duplicates

ROW = "g string, r long, i string, s string, n_both long"


def baskets(seed, n=400):
    random.seed(seed)
    rows = [(random.choice(["a", "b", None]), random.randint(0, 60), f"i{min(random.randint(0, 30), random.randint(0, 30))}", "x", 1) for _ in range(n)]
    return rows + rows[:40] + [("a", None, "i1", "x", 1), ("a", 1, None, "x", 1)]


def brute(rows, least):
    sets = {}
    for g, r, i, *_ in rows:
        if r is not None and i is not None:
            sets.setdefault((g, r), set()).add(i)
    single, both, n = Counter(), Counter(), Counter()
    for (g, _), items in sets.items():
        n[g] += 1
        single.update((g, i) for i in items)
        both.update((g, *p) for p in itertools.combinations(sorted(items), 2))
    return {(g, a, b): (c, single[g, a], single[g, b], n[g]) for (g, a, b), c in both.items() if c >= least}


def test_pairs_together(spark):
    # in scope a more giant records than the least count, in b fewer, in none as many
    rows = baskets(1) + [("a", 99, f"i{k}", "x", 1) for k in range(31)]
    rows += [(g, 200 + r, f"j{(k * (r + 3)) % 29}", "x", 1) for g, giants in (("a", 6), ("b", 1), (None, 3)) for r in range(giants) for k in range(27)]
    df = spark.createDataFrame(rows, ROW)
    for block, giant, least in ((64, 4096, 2), (4, 4096, 2), (4, 8, 2), (4, 20, 3), (8, 16, 5)):
        got = {(r.s, r.lo, r.hi): (r.n_both, r.n_lo, r.n_hi, r.n_records) for r in pairs_together(df, "g", "r", "i", least, block, giant).collect()}
        assert got == brute(rows, least)
    assert pairs_together(df.where("false"), "g", "r", "i").collect() == []


def test_surprise_of_a_planted_pair(spark):
    random.seed(2)
    rows = [("a", r, f"i{random.randint(0, 60)}", "x", 0) for r in range(400) for _ in range(4)]
    rows += [("a", r, i, "x", 0) for r in range(0, 200, 10) for i in ("p", "q")]
    got = {(r.lo, r.hi): r for r in pairs_together(spark.createDataFrame(rows, ROW), "g", "r", "i").collect()}
    found = {k for k, r in got.items() if r.log_q < math.log(0.01)}
    assert found == {("p", "q")}
    assert all(r.log_q >= r.log_p - 1e-9 for r in got.values())
    assert abs(got["p", "q"].expected - 20 * 20 / 400) < 1


def test_surprise_of_every_kind_of_pair(spark):
    rows = baskets(5)
    df = spark.createDataFrame(rows, ROW)
    got = pairs_together(df, "g", "r", "i", 2).collect()
    assert {(r.s, r.lo, r.hi) for r in got} == set(brute(rows, 2))
    sets = {}
    for g, r, i, *_ in rows:
        if r is not None and i is not None:
            sets.setdefault(g, {}).setdefault(r, set()).add(i)
    for r in got:
        sizes = Counter(len(x) for x in sets[r.s].values())
        degrees = Counter(Counter(i for x in sets[r.s].values() for i in x).values())
        d, z = sorted(degrees), sorted(sizes)
        x, y = fit_null(np.array(d, float), np.array([degrees[k] for k in d], float), np.array(z, float), np.array([sizes[k] for k in z], float))
        a, b, n = x[d.index(r.n_lo)] * y, x[d.index(r.n_hi)] * y, np.array([sizes[k] for k in z], float)
        p = a / (1 + a) * b / (1 + b)
        assert abs(r.expected - (n * p).sum()) < 1e-6 and abs(r.log_p - log_tail(np.array([r.n_both]), p[None], n)[0]) < 1e-6


def test_null_keeps_degrees():
    items, n_items = np.array([1.0, 3, 40]), np.array([50.0, 20, 1])
    records, n_records = np.array([1.0, 2, 5]), np.array([60.0, 25, 8])
    x, y = fit_null(items, n_items, records, n_records)
    meet = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((meet * n_records).sum(1), items, rtol=1e-4) and np.allclose((meet.T * n_items).sum(1), records, rtol=1e-4)


def test_tail_against_convolution():
    random.seed(3)
    for _ in range(60):
        n = [random.randint(1, 40) for _ in range(3)]
        p = [random.choice([0.001, 0.02, 0.1, 0.4, 0.9]) for _ in range(3)]
        dist = np.array([1.0])
        for m, q in zip(n, p, strict=True):
            for _ in range(m):
                dist = np.convolve(dist, [1 - q, q])
        mean = sum(m * q for m, q in zip(n, p, strict=True))
        for k in range(int(mean) + 2, min(len(dist), int(mean) + 12)):
            want = math.log(dist[k:].sum()) if dist[k:].sum() > 0 else -1e9
            if want > -30 or k == len(dist) - 1:
                got = log_tail(np.array([k]), np.array([p]), np.array(n, float))[0]
                assert abs(got - want) < 0.15 + 0.02 * abs(want), (n, p, k, want, got)


def test_contigs_together_ignores_flags(spark):
    rows = [(1, f"q{k}", flag, n) for k in range(6) for n in ("a", "b") for flag in (0, None, 2048)]
    rows += [(1, f"z{k}", f, n) for k in range(6) for n, f in (("a", 4), ("c", 256), ("c", 1024), ("*", 0), (None, 0))]
    got = contigs_together(spark.createDataFrame(rows, "library_id long, qname string, flag int, rname string")).collect()
    assert [(r.s, r.lo, r.hi, r.n_both, r.n_records) for r in got] == [(1, "a", "b", 6, 6)]


def sets_of(seed, n):
    random.seed(seed)
    base = [set(random.sample(range(300), random.choice([1, 2, 3, 6, 12, 30]))) for _ in range(n // 4)]
    out = []
    for k in range(n):
        s = set(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 3])):
            s ^= {random.randint(0, 300)}
        out.append((k, s | {7} if k % 3 else s))
    return [(k, s) for k, s in out if s]


def similar(sets, t):
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets), 2) if len(x & y) / len(x | y) >= t}


def member_rows(spark, sets, kind="k"):
    rows = [(kind, k, m, 0) for k, s in sets for m in s]
    rows += rows[:20] + [(kind, 1, None, 0), (kind, None, 5, 0), (kind, 100_000, None, 0)]
    return spark.createDataFrame(rows, "kind string, id long, m long, n long")


def test_near_duplicates(spark):
    sets = sets_of(4, 160)
    want = similar(sets, 0.7)
    for tree, large, forest in ((4096, 4096, 128), (8, 4096, 2), (16, 10, 4)):  # id 7 stands in two of three records
        found = near_duplicates(member_rows(spark, sets), "kind", "id", "m", 0.7, tree, large, forest)
        assert {(r.id_lo, r.id_hi) for r in found.record_pairs().collect()} == want
        classes = {r.record_id: (r.class_id, r.copies, r.links) for r in found.classes().collect()}
        same = {k: min(j for j, y in sets if y == x) for k, x in sets}
        assert {k: v[0] for k, v in classes.items()} == same
        links = Counter()
        for a, b in {tuple(sorted((same[a], same[b]))) for a, b in want if same[a] != same[b]}:
            links.update((a, b))
        assert {k: v[2] for k, v in classes.items()} == {k: links[same[k]] for k, _ in sets}
    empty = near_duplicates(member_rows(spark, []).where("false"), "kind", "id", "m")
    assert empty.record_pairs().collect() == [] and empty.classes().collect() == []


def test_scopes_stay_apart(spark):
    rows = member_rows(spark, [(1, {1, 2}), (2, {1, 2})], None).unionByName(member_rows(spark, [(3, {1, 2})], "x"))
    got = near_duplicates(rows, "kind", "id", "m").record_pairs().collect()
    assert [tuple(r) for r in got] == [(None, 1, 2)]


def test_bk_tree():
    random.seed(6)
    sigs = [random.getrandbits(20) for _ in range(300)] + [0, 0]
    tree = BKTree()
    for k, s in enumerate(sigs):
        tree.add(s, k)
    for radius in (0, 2, 5, 20):
        q = random.getrandbits(20)
        assert {k for _, k in tree.within(q, radius)} == {k for k, s in enumerate(sigs) if (s ^ q).bit_count() <= radius}
    assert list(BKTree().within(1, 3)) == []


def signature(ids):
    sig = 0
    for i in ids:
        sig ^= 1 << random.Random(i).randrange(Forest.BITS)
    return sig


def test_forest_visits_few_nodes_and_loses_none():
    r = random.Random(9)
    share = {}
    for n, size in ((5, 1500), (20, 1500), (50, 4096), (200, 600)):
        sets = [set(r.sample(range(10**6), r.randint(max(1, n * 3 // 4), n))) for _ in range(size)]
        for k in range(0, 300, 3):  # some are near
            sets[k] = set(r.sample(sorted(sets[k + 1]), max(1, len(sets[k + 1]) * 19 // 20))) | {-k}
        order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        forest, before, found, asked = Forest(0.7), [], set(), 0
        for k in order:
            sig = signature(sets[k])
            found |= {(min(k, j), max(k, j)) for _, j in forest.within(len(sets[k]), sig)}
            asked += len(before)
            forest.add(len(sets[k]), sig, k)
            before.append(k)
        assert {(a, b) for a, b in itertools.combinations(range(0, 300), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])} <= found
        share[n] = forest.visited / asked
    assert max(share[n] for n in (5, 20, 50)) <= 0.2, share  # beyond 90 ids a single tree is left, which visits nearly all


def test_a_hot_id_is_cut_by_a_second(spark):
    r = random.Random(10)
    sets = []
    for k in range(120):
        base = {7, 8, *r.sample(range(100, 400), r.choice([1, 2, 4, 9, 20]))}
        sets += [(3 * k, base), (3 * k + 1, base ^ {r.randint(100, 400)}), (3 * k + 2, base)]
    sets = [(k, s) for k, s in sets if s] + [(1000, {7}), (1001, {8}), (1002, {7, 8})]
    want = similar(sets, 0.7)
    for tree, forest in ((4096, 128), (50, 16)):
        got = near_duplicates(member_rows(spark, sets), "kind", "id", "m", 0.7, tree, 4096, forest).record_pairs()
        assert {(x.id_lo, x.id_hi) for x in got.collect()} == want


def test_graph_records(spark):
    bubbles = spark.createDataFrame([(1, [1, None, 2], None), (2, [], [3]), (3, None, None)], "bubble_id long, branch_a array<long>, branch_b array<long>")
    links = spark.createDataFrame([(9, 4), (9, None)], "graph_id long, source_id long")
    got = {tuple(r) for r in graph_records(bubbles, links).where("member IS NOT NULL").collect()}
    assert got == {("bubble", 1, 1), ("bubble", 1, 2), ("bubble", 2, 3), ("graph", 9, 4)}


def groups(edges, ids):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_group_links(spark):
    random.seed(8)
    chain = [(k, k + 1) for k in range(0, 60)] + [(500 + random.randint(0, 80), 500 + random.randint(0, 80)) for _ in range(50)] + [(900, k) for k in range(901, 960)]
    rows = [("n", a, b) for a, b in chain] + [("n", b, a) for a, b in chain[:9]] + [("n", 999, None), ("n", None, 998), ("n", None, None), ("n", 997, 997), ("m", 60, 61), (None, 60, 62)]
    got = {(r.kind, r.member_id): r.group_id for r in group_links(spark.createDataFrame(rows, "kind string, a long, b long"), "kind", "a", "b").collect()}
    want = {("n", k): v for k, v in groups(chain, {x for e in chain for x in e}).items()}
    want |= {("n", k): k for k in (997, 998, 999)} | {("m", 60): 60, ("m", 61): 60, (None, 60): 60, (None, 62): 60}
    assert got == want
    assert group_links(spark.createDataFrame([], "kind string, a long, b long"), "kind", "a", "b").collect() == []


def test_numbers_are_shuffled_one_to_one(spark):
    ids = spark.range(3000).select((F.col("id") * 7 - 9000).alias("n")).unionByName(spark.createDataFrame([(2**63 - 1,), (-(2**63),), (2**32,)], "n long"))
    got = ids.select("n", shuffled(F.col("n")).alias("x")).select("n", "x", unshuffled(F.col("x")).alias("back")).collect()
    assert all(r.n == r.back for r in got) and len({r.x for r in got}) == len(got)
    up = sum(a.x < b.x for a, b in itertools.pairwise(got))
    assert 0.4 < up / len(got) < 0.6


def test_links_of_lists(spark):
    lists = spark.createDataFrame([("b", [3, 1, None, 3]), ("b", []), ("b", None), ("b", [7]), ("b", [None])], "kind string, ids array<long>")
    assert sorted(tuple(r) for r in links_of_lists(lists, "kind", "ids").collect()) == [("b", 1, 1), ("b", 1, 3), ("b", 7, 7)]
