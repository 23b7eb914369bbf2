"""Superbubbles by topology and homologous siblings by sequence similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewright.operators.chain import by_component
from phasewright.operators.graph import numbered_within, split_graph, weak_components
from phasewright.operators.kmers import similarities, sketches
from phasewright.plans.tables import keep


def _ranks(n: int, start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Rank of each vertex in the reverse post-order of a depth-first search with ascending roots; every vertex has one."""
    seen, order, place = bytearray(n), [], start[:-1].tolist()
    end, to = start[1:].tolist(), to.tolist()
    for root in range(n):
        if seen[root]:
            continue
        seen[root], path = 1, [root]
        while path:
            u = path[-1]
            k = place[u]
            if k < end[u]:
                place[u] = k + 1
                v = to[k]
                if not seen[v]:
                    seen[v] = 1
                    path.append(v)
            else:
                order.append(path.pop())
    rank = np.empty(n, np.int64)
    rank[np.array(order[::-1], np.int64)] = np.arange(n)
    return rank


def superbubbles_of(src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int, list[int], list[int]]]:
    """(source, sink, branch_a, branch_b) in split ids of one graph, its edges in adjacency order.

    A superbubble (s, t) closes where the furthest child reached from the
    ranks s..t-1 is t and no vertex of s+1..t has a parent before s; edges
    that go back in rank are ignored and tips inside are allowed.  From each
    entrance the ranks are followed until the first such t, or until a parent
    before s shows that there is none.  Outer bubbles come before inner ones.
    Two heads make two branches, more make one branch of all that is inside.
    """
    ids, flat = np.unique(np.concatenate((src, dst)), return_inverse=True)
    n = len(ids)
    if n < 4:
        return []
    a, b = flat[: len(src)], flat[len(src) :]
    by = np.argsort(a, kind="stable")
    rank = _ranks(n, np.searchsorted(a[by], np.arange(n + 1)), b[by])
    u, v = rank[a[by]], rank[b[by]]
    ahead = u < v
    u, v = u[ahead], v[ahead]
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    first = np.searchsorted(u, np.arange(n + 1))
    child, parent = np.full(n, -1), np.full(n, n)
    np.maximum.at(child, u, v)
    np.minimum.at(parent, v, u)
    ins, outs = np.bincount(v, minlength=n), np.bincount(u, minlength=n)
    entrance, exit_ = np.zeros(n, bool), np.zeros(n, bool)
    entrance[u[ins[v] == 1]] = True
    exit_[v[outs[u] == 1]] = True
    physical = np.empty(n, np.int64)
    physical[rank] = ids // 2
    child, parent, nbr = child.tolist(), parent.tolist(), [v[first[k] : first[k + 1]].tolist() for k in range(n)]

    found = []
    for s in np.flatnonzero(entrance).tolist():
        reach, t = child[s], s + 1
        while t < n and parent[t] >= s and t < reach:
            reach = max(reach, child[t])
            t += 1
        if t < n and t == reach and t > s + 1 and parent[t] >= s and exit_[t]:
            found.append((s, t))
    found.sort(key=lambda st: (-st[1], st[0]))

    def branch(head: int, s: int, t: int) -> set[int]:
        inside, todo = {head}, [head]
        while todo:
            for w in nbr[todo.pop()]:
                if s < w < t and w not in inside:
                    inside.add(w)
                    todo.append(w)
        return inside

    out = []
    for s, t in found:
        heads = [w for w in nbr[s] if s < w < t]
        if len(heads) < 2:
            continue
        sides = [branch(h, s, t) for h in heads] if len(heads) == 2 else [set(range(s + 1, t)), set()]
        nodes = [sorted({int(physical[w]) for w in side}) for side in sides]
        out.append((int(physical[s]), int(physical[t]), *nodes))
    return out


def superbubbles(edges: DataFrame) -> DataFrame:
    """Superbubbles of every graph file: graph_id, emit_seq, source, sink, branch_a, branch_b (node ids, ascending).

    A bubble is found on both strands of the split graph; only the first of
    those with the same two ends and members is kept.  ``branch_b`` is empty
    where there are more than two branches.

    A bubble and all its branches lie in one weak component, and roots of
    other components change no order inside it, so a task takes one component
    at a time.  ``emit_seq`` numbers the bubbles of a graph file by component
    (its smallest node), outer before inner ones.
    """
    nodes = edges.select("graph_id", F.col("src").alias("node_id"))
    parts = keep(weak_components(nodes, edges)).df
    # one node with links to itself is no bubble
    work = split_graph(edges).withColumn("node_id", F.floor(F.col("src") / 2)).join(parts, ["graph_id", "node_id"])
    work = work.select("graph_id", "component", "src", "edge_ord", "dst").repartition("graph_id", "component").sortWithinPartitions("graph_id", "component", "src", "edge_ord")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"graph_id": pa.int64(), "component": pa.int64(), "k": pa.int64(), "source": pa.int64(), "sink": pa.int64(), "branch_a": pa.list_(pa.int64()), "branch_b": pa.list_(pa.int64())}
        for graph, component, rows in by_component(batches):
            found, seen = [], set()
            src, _, dst = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            for source, sink, a, b in superbubbles_of(src, dst):
                key = (min(source, sink), max(source, sink), *sorted((tuple(a), tuple(b))))
                if key not in seen:
                    seen.add(key)
                    found.append((graph, component, len(found), source, sink, a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types.values(), strict=True)], names=list(types))

    found = keep(work.mapInArrow(search, "graph_id long, component long, k long, source long, sink long, branch_a array<long>, branch_b array<long>")).df
    order = F.struct("graph_id", "component", "k")
    return numbered_within(found.withColumn("__o", order), "graph_id", "__o", "emit_seq").select("graph_id", "emit_seq", "source", "sink", "branch_a", "branch_b")


def simple_bubbles(edges: DataFrame) -> DataFrame:
    """Bubbles of two single-node branches by joins alone: graph_id, source, sink, node_a, node_b (split ids, node_a < node_b).

    The source has exactly two children and the sink exactly two parents,
    the branch nodes one parent and one child each, all five being different.
    """
    e = split_graph(edges).select("graph_id", "src", "dst").distinct()
    outs = e.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("o"))
    ins = e.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("i"))
    mid = outs.where("o = 1").select("graph_id", F.col("src").alias("m")).join(ins.where("i = 1").select("graph_id", F.col("dst").alias("m")), ["graph_id", "m"])
    via = mid.join(e.select("graph_id", F.col("src").alias("s"), F.col("dst").alias("m")), ["graph_id", "m"]).join(e.select("graph_id", F.col("src").alias("m"), F.col("dst").alias("t")), ["graph_id", "m"])
    two = via.where("s <> t AND s <> m AND t <> m").groupBy("graph_id", "s", "t").agg(F.min("m").alias("node_a"), F.max("m").alias("node_b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    two = two.join(outs.where("o = 2").select("graph_id", F.col("src").alias("s")), ["graph_id", "s"]).join(ins.where("i = 2").select("graph_id", F.col("dst").alias("t")), ["graph_id", "t"])
    return two.select("graph_id", F.col("s").alias("source"), F.col("t").alias("sink"), "node_a", "node_b")


def branch_sequences(branches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bubble, side, seq): the sequences of a branch's nodes put together in ascending order of their ids, as they are."""
    rows = branches.select("bubble", "side", F.explode(F.array_distinct("members")).alias("node_id")).join(nodes.select("node_id", "seq"), "node_id")
    parts = rows.groupBy("bubble", "side").agg(F.array_sort(F.collect_list(F.struct("node_id", "seq"))).alias("p"))
    return parts.select("bubble", "side", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


def bubble_alts(bubbles: DataFrame, nodes: DataFrame, k: int = 16, size: int = 1000, threshold: float = 0.9) -> DataFrame:
    """(node_id, alt_id) of all members of the bubbles that are kept; a null alt where there is no second branch.

    ``bubbles``: bubble (a number that orders them as found), branch_a,
    branch_b.  A bubble of two branches is kept if one of its sequences is
    empty or their sketches reach ``threshold``; a member's alt is then the
    smallest id of the other branch.  Of several bubbles of a node the last wins.
    """
    none = F.array().cast("array<bigint>")
    clean = lambda c: F.filter(F.coalesce(F.col(c), none), lambda x: x.isNotNull())
    own = bubbles.select("bubble", clean("branch_a").alias("a"), clean("branch_b").alias("b"))
    single = own.where(F.size("b") == 0).select("bubble", F.explode("a").alias("node_id"), F.lit(None).cast("long").alias("alt_id"))
    two = own.where(F.size("b") > 0)
    sides = two.select("bubble", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("members")), F.struct(F.lit(1).alias("side"), F.col("b").alias("members")))).alias("x")).select("bubble", "x.*")
    seqs = branch_sequences(sides, nodes).select((F.col("bubble") * 2 + F.col("side")).alias("node_id"), "seq")
    seqs = keep(seqs).df
    score = similarities(two.select((F.col("bubble") * 2).alias("a"), (F.col("bubble") * 2 + 1).alias("b")), sketches(seqs, k, size)).select(F.floor(F.col("a") / 2).alias("bubble"), "jaccard")
    full = seqs.where("seq <> ''").groupBy(F.floor(F.col("node_id") / 2).alias("bubble")).agg(F.count(F.lit(1)).alias("filled"))
    kept = two.join(score, "bubble").join(full, "bubble", "left").where((F.coalesce("filled", F.lit(0)) < 2) | (F.col("jaccard") >= threshold))
    way = lambda x, y: F.transform(F.col(x), lambda m: F.struct(m.alias("node_id"), F.array_min(y).alias("alt_id")))
    pairs = kept.select("bubble", F.explode(F.concat(way("a", "b"), way("b", "a"))).alias("p")).select("bubble", "p.*")
    rows = pairs.unionByName(single)
    # a bubble without a second branch claims a node but sets no alt, so an alt from any bubble stays
    return rows.groupBy("node_id").agg(F.max_by("alt_id", F.when(F.col("alt_id").isNotNull(), F.struct("bubble", "alt_id"))).alias("alt_id"))


def sibling_candidates(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b): different nodes with a common parent or a common child over forward edges."""
    e = edges.where("NOT src_rev AND NOT dst_rev").select("graph_id", "src", "dst").distinct()
    up = e.select("graph_id", F.col("src").alias("hub"), F.col("dst").alias("x"))
    down = e.select("graph_id", F.col("dst").alias("hub"), F.col("src").alias("x"))
    pairs = lambda one: one.withColumnRenamed("x", "a").join(one.withColumnRenamed("x", "b"), ["graph_id", "hub"]).where("a <> b").select("graph_id", "a", "b")
    return pairs(up).unionByName(pairs(down)).distinct()


def reciprocal_best(candidates: DataFrame, nodes: DataFrame, k: int = 16, size: int = 1000, threshold: float = 0.9) -> DataFrame:
    """(graph_id, a, b), a < b: siblings that are each other's most similar one, at least ``threshold``; the lower id on ties.

    Candidates without a common hash stay candidates, at similarity 0.  Nodes shorter than ``k`` are none.
    """
    fit = nodes.where(F.col("length") >= k)
    both = candidates.join(fit.select(F.col("node_id").alias("a")), "a", "left_semi").join(fit.select(F.col("node_id").alias("b")), "b", "left_semi")
    both, sketched = keep(both).df, keep(sketches(fit, k, size)).df
    # each unordered pair is scored once and read from both ends
    half = similarities(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sketched).where(F.col("jaccard") >= threshold).select(F.col("a").alias("x"), F.col("b").alias("y"), "jaccard")
    scored = both.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(half, ["x", "y"])
    rank = Window.partitionBy("graph_id", "a").orderBy(F.desc("jaccard"), "b")
    best = scored.withColumn("k", F.row_number().over(rank)).where("k = 1").select("graph_id", "a", "b")
    back = best.select("graph_id", F.col("a").alias("b"), F.col("b").alias("a"))
    return best.where("a < b").join(back, ["graph_id", "a", "b"], "left_semi")


def unlabelled_alts(bubbles: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 16, size: int = 1000, threshold: float = 0.9) -> DataFrame:
    """(node_id, alt_id): alts by topology, then reciprocal siblings among the nodes that no bubble claims."""
    claimed = keep(bubble_alts(bubbles, nodes, k, size, threshold)).df
    free = keep(nodes.join(claimed, "node_id", "left_anti")).df
    pairs = reciprocal_best(sibling_candidates(edges), free, k, size, threshold)
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m")))).alias("p"))
    return claimed.unionByName(ways.groupBy(F.col("p.n").alias("node_id")).agg(F.min("p.m").alias("alt_id")))
