"""Per-key results when a handful of keys hold most of the rows.

Heavy keys are found with a Misra-Gries sketch (``freqItems``), whose answer
holds every key above the support and never more than ``1/support`` keys per
column, so the list may be broadcast.  Rows of heavy keys are shuffled on a
finer key, all others on the key alone, and both results are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the rows above which a key may be heavy; smaller where there are so many partitions that it would outweigh one of them.
SUPPORT, LEAST_SUPPORT = 0.001, 0.0001


def support_of(df: DataFrame) -> float:
    """A quarter of what an even partition of a shuffle holds, between ``LEAST_SUPPORT`` and ``SUPPORT``."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_SUPPORT, min(SUPPORT, 1 / (4 * partitions)))


def heavy_keys(df: DataFrame, key: str, support: float | None = None) -> DataFrame:
    """A table with the one column ``key``: all keys that may hold more than ``support`` of the rows (by default that of ``support_of``).

    Null keys are never heavy.  An empty input gives an empty table.  At most
    ``1/support`` rows, whatever the size of the input.
    """
    kind, support = df.schema[key].dataType, support or support_of(df)
    found = df.where(F.col(key).isNotNull()).stat.freqItems([key], support).first()
    keys = [k for k in (found[0] or []) if k is not None]
    return df.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(key, kind)]))


def split_by_weight(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the heavy keys, and all other rows (null keys among the latter)."""
    few = F.broadcast(heavy)
    return df.join(few, key, "left_semi"), df.join(few, key, "left_anti")


def strongest_partner(
    entries: DataFrame,
    entry: str = "entry_no",
    key: str = "u",
    partner: str = "v",
    weight: str = "w",
    support: float | None = None,
) -> DataFrame:
    """For each key the partner with the largest total weight, the smaller partner on ties.

    Rows with a null key, partner or weight, a weight of zero or less, or key =
    partner do not count.  Equal rows with the same entry number count once;
    rows without an entry number cannot be told apart and all count.  Columns:
    ``key``, ``partner``, ``total``.  Other columns of the input are ignored.

    Heavy keys: rows are spread by all they hold to count once, partial sums
    then by (key, partner), and only one row per partner and task reaches the
    key, so not even a heavy pair stays together.  Other keys: one shuffle on
    the key serves the deduplication, the sums and the choice.
    """
    rows = entries.select(
        F.col(entry).alias("__e"), F.col(key).alias("__k"), F.col(partner).alias("__p"), F.col(weight).cast("long").alias("__w")
    ).where("__k IS NOT NULL AND __p IS NOT NULL AND __w > 0 AND __k <> __p")
    heavy, light = split_by_weight(rows, "__k", heavy_keys(rows, "__k", support))

    def totals(part: DataFrame) -> DataFrame:
        once = part.groupBy("__e", "__k", "__p", "__w").agg(F.count(F.lit(1)).alias("__n"))
        worth = F.when(F.col("__e").isNull(), F.col("__w") * F.col("__n")).otherwise(F.col("__w"))
        return once.groupBy("__k", "__p").agg(F.sum(worth).alias("__t"))

    def best(sums: DataFrame) -> DataFrame:
        return sums.groupBy("__k").agg(
            F.min_by("__p", F.struct(-F.col("__t"), F.col("__p"))).alias("__p"), F.max("__t").alias("__t")
        )

    found = best(totals(heavy)).unionByName(best(totals(light.repartition("__k"))))
    return found.select(F.col("__k").alias(key), F.col("__p").alias(partner), F.col("__t").alias("total"))
