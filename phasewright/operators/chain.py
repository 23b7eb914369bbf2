"""Walking each haplotype into chains, greedily or along Hamiltonian paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewright.operators.graph import homozygous, numbered_within, weak_components
from phasewright.plans.tables import keep

#: Nodes, and states beside those of the starts, up to which a component is searched for a Hamiltonian path.
MAX_NODES, MAX_STATES = 22, 5000
UNPHASED = 2


def phase_subgraph(edges: DataFrame, nodes: DataFrame, phases: DataFrame, phasing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((graph_id, part, node_id), (graph_id, part, src, dst, edge_ord)) of both haplotypes.

    Haplotype k has the nodes of phase k and the homozygous ones without a
    phase; its edges leave their source forwards, whatever the target's
    orientation, and have both ends in it.  ``nodes``: graph_id, node_id.
    """
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    free = homozygous(nodes.select("node_id").distinct(), phasing).join(phases.where("phase >= 0").select("node_id"), "node_id", "left_anti").select("node_id", both.alias("part"))
    own = phases.where("phase >= 0").select("node_id", F.col("phase").cast("int").alias("part")).unionByName(free)
    members = nodes.select("graph_id", "node_id").distinct().join(own, "node_id").select("graph_id", "part", "node_id")
    src = members.withColumnRenamed("node_id", "src")
    dst = members.withColumnRenamed("node_id", "dst")
    kept = edges.where("NOT src_rev").select("graph_id", "src", "dst", "edge_ord").join(src, ["graph_id", "src"]).join(dst, ["graph_id", "part", "dst"], "left_semi")
    return members, kept.select("graph_id", "part", "src", "dst", "edge_ord")


@dataclass
class PathSearch:
    """What a search for a Hamiltonian path found: ``solved`` says that ``path`` (maybe empty) is the answer."""

    solved: bool
    path: list = field(default_factory=list)
    unique_prefix: list = field(default_factory=list)
    states: int = 0


def hamiltonian_path(nodes: list, succ: dict, starts: list | None = None, ends: list | None = None, max_states: int = MAX_STATES) -> PathSearch:
    """A path over all nodes, by dynamic programming over (set of nodes, last node), shortest sets first.

    No starts or ends means any; if there are some, the path begins and ends
    with one of them.  Of several end nodes the smallest gives the path; the
    unique prefix is what the paths of all end nodes, one each, have in common.
    More than ``MAX_NODES`` nodes, or ``max_states`` states that are no starts
    without a path, are unsolved, and so is a single node that is no allowed
    start or end.
    """
    n = len(nodes)
    if n == 0:
        return PathSearch(True)
    if n > MAX_NODES:
        return PathSearch(False)
    place = {node: k for k, node in enumerate(nodes)}
    out = [[place[m] for m in succ.get(node, ()) if m in place] for node in nodes]
    first = [place[s] for s in starts or nodes if s in place]
    last = {place[e] for e in ends or nodes if e in place}
    if n == 1:
        return PathSearch(True, list(nodes), list(nodes)) if first and last else PathSearch(False)
    came = {(1 << s, s): None for s in first}
    layer, states, cut = list(came), 0, False
    while layer and not cut:
        ahead = []
        for mask, u in layer:
            for v in out[u]:
                state = (mask | 1 << v, v)
                if mask >> v & 1 or state in came:
                    continue
                came[state] = (mask, u)
                ahead.append(state)
                states += 1
                if states >= max_states:
                    cut = True
                    break
            if cut:
                break
        layer = ahead
    full = (1 << n) - 1
    paths = []
    for e in sorted((e for e in last if (full, e) in came), key=lambda k: nodes[k]):
        state, path = (full, e), []
        while state is not None:
            path.append(nodes[state[1]])
            state = came[state]
        paths.append(path[::-1])
    if not paths:
        return PathSearch(not cut, states=states)
    prefix = [steps[0] for steps in zip(*paths, strict=True)]
    common = next((k for k, steps in enumerate(zip(*paths, strict=True)) if len(set(steps)) > 1), n)
    return PathSearch(True, paths[0], prefix[:common], states)


def _walks(nodes: list, succ: dict, weight: dict, seeds: list) -> list[list]:
    """Walks from the seeds, then from what is left in ascending order, each to the free successor of most contact."""
    seen, out = set(), []
    for seed in [*seeds, *nodes]:
        if seed in seen:
            continue
        walk, u = [], seed
        while u is not None:
            seen.add(u)
            walk.append(u)
            free = [v for v in succ.get(u, ()) if v not in seen]
            u = min(free, key=lambda v, u=u: (-weight.get((u, v), 0), v), default=None)
        out.append(walk)
    return out


def component_chains(edges: list[tuple[int, int, int]], exact: bool) -> list[tuple[int, list[int]]]:
    """(0 if it starts at a node without a parent or is all there is, else 1; nodes) of the chains of one component.

    ``edges``: (src, dst, contact) in adjacency order.
    """
    nodes = sorted({u for u, _, _ in edges} | {v for _, v, _ in edges})
    succ: dict = {}
    for u, v, _ in edges:
        if v not in succ.setdefault(u, []):
            succ[u].append(v)
    weight = {(u, v): w for u, v, w in edges}
    into = {v for _, v, _ in edges}
    starts = [u for u in nodes if u not in into]
    if not exact:
        return [(int(walk[0] in into), walk) for walk in _walks(nodes, succ, weight, starts)]
    found = hamiltonian_path(nodes, succ, starts, [u for u in nodes if u not in succ])
    return [(0, found.path or [u for walk in _walks(nodes, succ, weight, starts) for u in walk])]


def by_component(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(scope, component, rows) of sorted batches whose first two columns are scope and component; a component may run over several batches."""
    at, rows = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:2] != at:
                if rows:
                    yield *at, rows
                at, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield *at, rows


def chains(members: DataFrame, edges: DataFrame, contacts: DataFrame, exact: bool = False) -> DataFrame:
    """(graph_id, part, chain_idx, pos, node_id) of both haplotypes of every graph file.

    ``members`` and ``edges`` as of ``phase_subgraph``.  Greedy chains start at nodes
    without a parent, then at what is left, and go to the successor of most
    contact (the lower id on ties); each walk is a chain.  With ``exact`` each
    weak component becomes one chain: a Hamiltonian path where one is found
    within bounds, else its greedy walks one after the other.  Chains are
    numbered as one walk over the whole haplotype would: those from nodes
    without a parent first, by their first node; exact ones by their smallest.

    No walk leaves its weak component, so a task takes one component of a
    haplotype at a time; nodes without edges to others never reach Python.
    Contacts are looked up by a join beforehand.
    """
    scope = (F.col("graph_id") * 2 + F.col("part")).alias("scope")
    own, links = members.select(scope, "node_id"), keep(edges.select(scope, "src", "dst", "edge_ord")).df
    parts = keep(weak_components(own, links, "scope")).df
    c = contacts.select(F.col("u").alias("x"), F.col("v").alias("y"), "w")
    weighed = links.withColumns({"x": F.least("src", "dst"), "y": F.greatest("src", "dst")}).join(c, ["x", "y"], "left")
    placed = weighed.join(parts.select("scope", F.col("node_id").alias("src"), "component"), ["scope", "src"])
    # a node with no link but to itself is a chain, and comes late if it has one to itself
    apart = links.where("src <> dst").select("scope", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    alone = parts.join(apart, ["scope", "node_id"], "left_anti").join(links.where("src = dst").select("scope", F.col("src").alias("node_id"), F.lit(1).alias("loop")).distinct(), ["scope", "node_id"], "left")
    kind = F.lit(0) if exact else F.coalesce("loop", F.lit(0))
    alone = alone.select("scope", kind.alias("kind"), F.col("node_id").alias("first"), F.lit(0).cast("long").alias("pos"), "node_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["scope", "kind", "first", "pos", "node_id"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        out = []
        for at, component, rows in by_component(batches):
            for late, chain in component_chains([(u, v, w) for _, u, v, w in rows], exact):
                first = component if exact else chain[0]
                out += [(at, late, first, k, u) for k, u in enumerate(chain)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    more = placed.where(F.col("src") != F.col("dst")).select("scope", "component").distinct()
    work = placed.join(more, ["scope", "component"], "left_semi").select("scope", "component", "edge_ord", "src", "dst", F.coalesce("w", F.lit(0)).cast("long").alias("w"))
    work = work.repartition("scope", "component").sortWithinPartitions("scope", "component", "edge_ord")
    walked = keep(work.mapInArrow(walk, "scope long, kind int, first long, pos long, node_id long").unionByName(alone)).df
    heads = walked.where("pos = 0").select("scope", "first", F.struct("scope", "kind", "first").alias("__o"))
    idx = numbered_within(heads, "scope", "__o", "chain_idx").select("scope", "first", "chain_idx")
    return walked.join(idx, ["scope", "first"]).select(F.floor(F.col("scope") / 2).alias("graph_id"), F.pmod("scope", F.lit(2)).cast("int").alias("part"), "chain_idx", "pos", "node_id")


def unphased_chains(nodes: DataFrame, phases: DataFrame, phasing: DataFrame) -> DataFrame:
    """A chain of its own, numbered from 0 in the order of ids, for every phasing node without a phase."""
    left = nodes.select("graph_id", "node_id").distinct().join(phasing.select("node_id").distinct(), "node_id", "left_semi").join(phases.where("phase >= 0").select("node_id"), "node_id", "left_anti")
    own = numbered_within(left.withColumn("__o", F.struct("graph_id", "node_id")), "graph_id", "__o", "chain_idx")
    return own.select("graph_id", F.lit(UNPHASED).alias("part"), F.col("chain_idx"), F.lit(0).cast("long").alias("pos"), "node_id")
