"""The graph as tables: nodes, mirrored edges, the split graph, degrees and weak components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewright.plans.tables import keep


def last_segments(segments: DataFrame, key: str = "node_id", order: str = "line_no") -> DataFrame:
    """One row per node: name, seq, length and coverage of its last record.

    The length is the record's LN tag or, without it, that of its sequence;
    a later record without a sequence blanks an earlier one.  Records with a
    null key are skipped; ties go to the greater record.
    """
    seq = F.coalesce("seq", F.lit(""))
    record = F.struct("name", seq.alias("seq"), F.coalesce(F.col("ln"), F.length(seq).cast("long")).alias("length"), F.coalesce("rc", F.lit(0)).cast("long").alias("coverage"))
    last = segments.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(record, F.struct(order, record)).alias("r"))
    return last.select(key, "r.*")


def filled_sequences(nodes: DataFrame, records: DataFrame, key: str = "node_id", order: str = "rec_no") -> DataFrame:
    """``nodes`` whose empty sequences are taken from the first non-empty record of the same key; lengths stay as they are."""
    first = records.where("seq <> ''").groupBy(key).agg(F.min_by("seq", F.struct(order, "seq")).alias("found"))
    return nodes.join(first, key, "left").withColumn("seq", F.coalesce(F.expr("nullif(seq, '')"), "found", F.lit(""))).drop("found")


def node_dictionary(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, name) with ids from 0 in the order in which names first appear in S lines and, source first, L lines.

    ``segments``: line_no, name; ``links``: line_no, src, dst.  Names are
    range-partitioned by their place, and each range adds the counts of those
    before it, so no task sees all of them.
    """
    seen = segments.select("name", F.col("line_no").alias("line"), F.lit(0).alias("at")).unionByName(
        links.select("line_no", F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit(1).alias("at")), F.struct(F.col("dst").alias("name"), F.lit(2).alias("at")))).alias("e"))
        .select("e.name", F.col("line_no").alias("line"), "e.at")
    )
    first = seen.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("line", "at")).alias("place"))
    return numbered(first, "place", "node_id").select("node_id", "name")


def numbered(df: DataFrame, order: str, number: str, start: int = 0) -> DataFrame:
    """``df`` with a dense number in the order of one unique column, without a global sort in one task."""
    from pyspark.sql import Window

    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    kept = keep(ranged).df
    parts = kept.groupBy("__part").agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = kept.join(F.broadcast(parts), "__part")  # one row per partition
    return placed.withColumn(number, F.col("__base") + F.col("__at") - F.col("__low") + start).drop("__part", "__at", "__low", "__base")


def mirrored_edges(links: DataFrame) -> DataFrame:
    """Two rows per link: itself and its reverse complement; repeated links and self-loops stay.

    ``links``: graph_id, link_no, source_id, target_id, source_rev, target_rev,
    overlap.  Links with a null end are no edges; a null orientation is
    forward.  ``edge_ord`` keeps the order of an adjacency list.
    """
    sr, tr = F.coalesce("source_rev", F.lit(False)), F.coalesce("target_rev", F.lit(False))
    twin = lambda u, v, ur, vr, k: F.struct(u.alias("src"), v.alias("dst"), ur.alias("src_rev"), vr.alias("dst_rev"), (F.col("link_no") * 2 + k).alias("edge_ord"))
    u, v = F.col("source_id"), F.col("target_id")
    both = F.explode(F.array(twin(u, v, sr, tr, 0), twin(v, u, ~tr, ~sr, 1))).alias("e")
    return links.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("graph_id", "overlap", both).select("graph_id", "e.*", "overlap")


def split_graph(edges: DataFrame) -> DataFrame:
    """Each node as two: 2u forward, 2u + 1 reverse."""
    half = lambda n, rev: F.col(n) * 2 + F.col(rev).cast("long")
    return edges.select("graph_id", half("src", "src_rev").alias("src"), half("dst", "dst_rev").alias("dst"), "edge_ord")


def degrees(edges: DataFrame, scope: str = "graph_id") -> DataFrame:
    """(scope, node_id, out_degree, in_degree) of every node with an edge; parallel edges count each."""
    ends = edges.select(scope, F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(scope, F.col("e.n").alias("node_id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def numbered_within(df: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """``df`` with a dense number from 0 in each group; ``order`` is one unique column that sorts by the group first."""
    every = numbered(df, order, "__n")
    first = every.groupBy(group).agg(F.min("__n").alias("__first"))
    return every.join(first, group).withColumn(number, F.col("__n") - F.col("__first")).drop("__n", "__first")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (s, a, b) of each batch as stars: every end linked to the smallest one it reaches within the batch."""
    for batch in batches:
        s, a, b = (np.asarray(batch.column(c)) for c in ("s", "a", "b"))
        scope, end = np.concatenate((s, s)), np.concatenate((a, b))
        by = np.lexsort((end, scope))
        new = np.ones(len(by), bool)
        new[1:] = (scope[by][1:] != scope[by][:-1]) | (end[by][1:] != end[by][:-1])
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1
        scope, end = scope[by][new], end[by][new]
        u, v = place[: len(s)], place[len(s) :]
        low = np.arange(len(end))
        while True:
            least = np.minimum(low[u], low[v])
            after = low.copy()
            np.minimum.at(after, u, least)
            np.minimum.at(after, v, least)
            after = after[after]
            if (after == low).all():
                break
            low = after
        far = np.flatnonzero(low != np.arange(len(end)))
        yield pa.RecordBatch.from_arrays([pa.array(scope[far]), pa.array(end[low[far]]), pa.array(end[far])], names=["s", "a", "b"])


def weak_components(nodes: DataFrame, edges: DataFrame, scope: str = "graph_id", node: str = "node_id", max_rounds: int = 60) -> DataFrame:
    """(scope, node, component): the smallest node reached over edges in either direction; nodes without edges stay alone.

    Scope and nodes are whole numbers; rows where one is null are skipped.
    Links are first made stars within each batch of them.  Then each round
    moves every node to that neighbour, or itself, whose hash is least, and
    goes on with the links between the nodes moved to, about half as many,
    until no link is left; the moves, read backwards, tell where each node
    ended.  Minima are combined before they are shuffled and a hub's links are
    split by the skew join.  Each round is a table in the shared folder.
    """
    s = F.col(scope).cast("long").alias("s")
    v = nodes.select(s, F.col(node).cast("long").alias("v")).unionByName(edges.select(s, F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("v"))).where("s IS NOT NULL AND v IS NOT NULL").distinct()
    raw = edges.where("src <> dst").select(s, F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).where("s IS NOT NULL")
    link = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
    state = keep(raw.mapInArrow(_contracted, "s long, a long, b long").distinct(), n=F.count(F.lit(1)))
    moves = []
    while state.stats["n"]:
        if len(moves) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = state.df.select("s", F.explode(F.array(link("a", "b"), link("b", "a"))).alias("e")).select("s", "e.a", "e.b")
        to = keep(both.groupBy("s", "a").agg(F.min(rank("b")).alias("r")).select("s", F.col("a").alias("v"), F.least("r", rank("a"))["to"].alias("to"))).df
        moves.append(to)
        of = lambda c, as_, to=to: to.select("s", F.col("v").alias(c), F.col("to").alias(as_))
        moved = state.df.join(of("a", "x"), ["s", "a"]).join(of("b", "y"), ["s", "b"]).where("x <> y")
        after = keep(moved.select("s", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n=F.count(F.lit(1)))
        state.drop()
        state = after
    ended = state.df.select("s", F.col("a").alias("v"), F.col("b").alias("end"))
    for to in reversed(moves):
        ended = to.join(ended.withColumnRenamed("v", "to"), ["s", "to"], "left").select("s", "v", F.coalesce("end", "to").alias("end"))
    known = keep(v.join(ended, ["s", "v"], "left").withColumn("end", F.coalesce("end", "v"))).df
    least = known.groupBy("s", "end").agg(F.min("v").alias("component"))
    return known.join(least, ["s", "end"]).select(F.col("s").alias(scope), F.col("v").alias(node), "component")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that leave the given nodes."""
    return edges.join(nodes.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")


def ids_of(names: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """``names`` (column name) with the id of each; unknown names are dropped or, if ``strict``, an error."""
    known = names.join(nodes.select("name", "node_id"), "name")
    if strict and (missing := names.join(nodes, "name", "left_anti").first()):
        raise KeyError(missing["name"])
    return known


def homozygous(nodes: DataFrame, phasing: DataFrame) -> DataFrame:
    """Nodes that belong to no bubble."""
    return nodes.join(phasing.select("node_id").distinct(), "node_id", "left_anti")


