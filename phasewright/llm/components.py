"""Consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewright.plans.tables import keep

MAX_ROUNDS = 100


def group_links(links: DataFrame, scope: str, a: str, b: str) -> DataFrame:
    """One row (scope, ``member_id``, ``group_id``) per id that occurs, with the smallest id it is linked to directly or through others.

    A row with both ends links them; a row with one end only declares that
    id, which may stay alone.  Ids of different scopes never meet.  Rows with
    a null scope form a scope of their own.  Selves, repeats and mirror images
    change nothing.  An empty input gives an empty result.

    Hash-to-min: every vertex keeps a cluster of ids, at first itself and its
    neighbours; in each round it sends its cluster to the smallest id in it and
    that smallest id to all others.  Clusters are kept as rows (vertex, member),
    so that no cluster has to fit in a task; the minimum per vertex is combined
    before it is shuffled.  A vertex with many members is split by the skew
    join when it meets its minimum.

    Ids are shuffled beforehand by a one-to-one map, so "smallest" means smallest
    of those numbers: along a chain of ascending ids clusters would otherwise
    double in every round.  The smallest id of each group is taken at the end.

    Settled groups leave.  A vertex that knows nobody but its minimum sends
    nothing, as the minimum keeps it; one that knows others too marks what it
    sends.  A minimum that got no marked row knows its whole group, and every
    member of it knows only the minimum: its rows are the result and take no
    part in further rounds, which end when no rows are left.
    """
    s, v, m = F.col("s"), F.col("v"), F.col("m")
    base = links.select(F.col(scope).alias("s"), shuffled(F.col(a).cast("long")).alias("x"), shuffled(F.col(b).cast("long")).alias("y"))
    pair = lambda i, j: F.struct(F.col(i).alias("v"), F.col(j).alias("m"))
    rows = base.select("s", F.explode(F.array(pair("x", "x"), pair("y", "y"), pair("x", "y"), pair("y", "x"))).alias("p"))
    rows = rows.select("s", "p.v", "p.m").where("v IS NOT NULL AND m IS NOT NULL").distinct().withColumn("marked", v != m)
    state = keep(rows, n=F.count(F.lit(1)))
    done: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if not state.stats["n"]:
            out = functools.reduce(DataFrame.unionByName, done, state.df.select("s", "v", "m"))
            out = out.select("s", "v", unshuffled(m).alias("member_id"))
            low = out.groupBy("s", "v").agg(F.min("member_id").alias("group_id")).withColumnsRenamed({"s": "ls", "v": "lv"})
            return out.join(low, s.eqNullSafe(F.col("ls")) & (v == F.col("lv"))).select(s.alias(scope), "member_id", "group_id")
        of = state.df.groupBy("s", "v").agg(F.min(m).alias("low"), F.max(F.when(m != v, m)).alias("high"), F.max("marked").alias("told"))
        met = state.df.drop("marked").alias("c").join(of.alias("l"), F.col("c.s").eqNullSafe(F.col("l.s")) & (F.col("c.v") == F.col("l.v")))
        met = met.select(F.col("c.s").alias("s"), F.col("c.v").alias("v"), "m", F.least("low", F.col("c.v")).alias("low"), "high", "told")
        is_low = v == F.col("low")
        met = keep(met.where(is_low | (F.col("high") != F.col("low"))).withColumn("settled", is_low & ~F.col("told"))).df
        done.append(met.where("settled").select("s", "v", "m"))
        low = F.col("low")
        sent = met.where("NOT settled").select("s", (~is_low).alias("marked"), F.explode(F.array(F.struct(low.alias("v"), m.alias("m")), F.struct(m.alias("v"), low.alias("m")))).alias("p"))
        after = keep(sent.select("s", "p.v", "p.m", "marked").groupBy("s", "v", "m").agg(F.max("marked").alias("marked")), n=F.count(F.lit(1)))
        state.drop()
        state = after
    raise RuntimeError(f"groups did not settle in {MAX_ROUNDS} rounds")


def _halves(number: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(number, 32), number.bitwiseAND(0xFFFFFFFF)


def _mixed(half: Column, key: int) -> Column:
    """32 bits that depend on 32 bits."""
    return F.xxhash64(half, F.lit(key)).bitwiseAND(0xFFFFFFFF)


def shuffled(number: Column, rounds: int = 3) -> Column:
    """A one-to-one map of the 64-bit numbers that leaves no order: each round swaps the halves and flips one by a hash of the other."""
    for key in range(rounds):
        left, right = _halves(number)
        number = F.shiftleft(right, 32).bitwiseOR(left.bitwiseXOR(_mixed(right, key)))
    return number


def unshuffled(number: Column, rounds: int = 3) -> Column:
    """The number that ``shuffled`` maps to this one."""
    for key in reversed(range(rounds)):
        left, right = _halves(number)
        number = F.shiftleft(right.bitwiseXOR(_mixed(left, key)), 32).bitwiseOR(left)
    return number


def links_of_lists(lists: DataFrame, scope: str, members: str) -> DataFrame:
    """Links (scope, a, b) that join all non-null ids of each list: every id to the smallest of its list.

    Null and empty lists give nothing; a list of one id gives that id linked to itself.
    """
    return (
        lists.select(scope, F.array_min(members).alias("a"), F.explode(members).alias("b")).where(F.col("b").isNotNull()).distinct()
    )
