"""Homologous pairs from the way an assembler names its contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Naming styles in the order in which they win ties (fixed values).
STYLES = {
    "classic": r"^\d+[FR](_\d+)?$",
    "pr": r"^PR\.\d+\.\d+$",
    "dot": r"^.+\.\d+$",
    "hifiasm": r"^h[12]tg\d+l$",
    "verkko": r"^haplotype[12]-\d+$",
}


def style_votes(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: how many of the nodes fit each style; with ``limit`` only those with an id below it, as the reference looks at the first 1000."""
    some = nodes if limit is None else nodes.where(F.col("node_id") < limit)
    return some.agg(*[F.count_if(F.col("name").rlike(p)).alias(s) for s, p in STYLES.items()])


def detect_style(nodes: DataFrame, limit: int | None = None) -> str:
    """The style with most votes; the first on a tie, so ``classic`` if there are none."""
    votes = style_votes(nodes, limit).first()
    return max(STYLES, key=lambda s: votes[s])


def with_base(nodes: DataFrame, style: str) -> DataFrame:
    """``nodes`` with the column base: the name without its suffix.

    ``classic`` takes the name itself where there is no suffix; dotted styles
    leave such nodes out; the other styles give no pairs.
    """
    if style == "classic":
        return nodes.withColumn("base", F.regexp_replace("name", r"_\d+$", ""))
    if style in ("pr", "dot"):
        return nodes.where(F.col("name").rlike(r"\.\d+$")).withColumn("base", F.regexp_replace("name", r"\.\d+$", ""))
    return nodes.where(F.lit(False)).withColumn("base", F.lit(None).cast("string"))


def name_pairs(nodes: DataFrame, style: str | None = None) -> DataFrame:
    """(node_id, alt_id) in both directions for the bases that exactly two nodes share."""
    style = style or detect_style(nodes)
    two = with_base(nodes, style).groupBy("base").agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return both_ways(two)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(node_id, alt_id) for each pair (a, b), in both directions."""
    turn = lambda x, y: F.struct(F.col(x).alias("node_id"), F.col(y).alias("alt_id"))
    return pairs.select(F.explode(F.array(turn("a", "b"), turn("b", "a"))).alias("p")).select("p.*")


def pairs_of_names(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, alt_id) from rows (line_no, name_a, name_b); unknown names are dropped, and of several alts the last row's wins."""
    of = lambda side, id_: nodes.select(F.col("name").alias(side), F.col("node_id").alias(id_))
    known = pairs.join(of("name_a", "a"), "name_a").join(of("name_b", "b"), "name_b")
    turn = lambda x, y: F.struct(F.col(x).alias("node_id"), F.col(y).alias("alt_id"))
    rows = known.select("line_no", F.explode(F.array(turn("a", "b"), turn("b", "a"))).alias("p")).select("line_no", "p.*")
    return rows.groupBy("node_id").agg(F.max_by("alt_id", F.struct("line_no", "alt_id")).alias("alt_id"))
