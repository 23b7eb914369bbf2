"""The contact table: counting, summing, mirroring, filtering and looking up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewright.sources.sam import contact_records


def contact_counts(alignments: DataFrame, names: DataFrame) -> DataFrame:
    """(u, v, w) with u <= v: pairs of nodes by the number of contact records between them.

    Records whose names are not among ``names`` (name, node_id) are dropped;
    contacts of a node with itself stay on the diagonal.  Names are counted
    before they are looked up, so only distinct pairs are joined.
    """
    pairs = contact_records(alignments).groupBy(F.least("name_a", "name_b").alias("x"), F.greatest("name_a", "name_b").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda side, id_: names.select(F.col("name").alias(side), F.col("node_id").alias(id_))
    known = pairs.join(of("x", "a"), "x").join(of("y", "b"), "y")
    return known.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("n").alias("w"))


def summed(contacts: DataFrame) -> DataFrame:
    """(u, v, w) with u <= v: total weight; rows with a null end are skipped and null weights add nothing."""
    own = contacts.where("u IS NOT NULL AND v IS NOT NULL")
    return own.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum(F.coalesce("w", F.lit(0))).alias("w"))


def symmetric(contacts: DataFrame) -> DataFrame:
    """Canonical contacts and their mirror images; the diagonal once."""
    return contacts.select("u", "v", "w").unionByName(contacts.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def among(contacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Contacts with both ends among the given nodes."""
    few = nodes.select("node_id").distinct()
    return contacts.join(few.withColumnRenamed("node_id", "u"), "u", "left_semi").join(few.withColumnRenamed("node_id", "v"), "v", "left_semi").select("u", "v", "w")


def looked_up(pairs: DataFrame, contacts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the weight of the contact in either order, 0 where there is none."""
    asked = pairs.withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")})
    return asked.join(contacts.select("u", "v", "w"), ["u", "v"], "left").withColumn("w", F.coalesce("w", F.lit(0))).drop("u", "v")
