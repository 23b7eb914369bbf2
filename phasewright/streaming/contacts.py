"""Contact counts over a stream of alignments (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewright.sources.sam import contact_records


def windowed_contacts(alignments: DataFrame, time: str = "aligned_at", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, name_a, name_b, n) per window of event time; records later than ``late`` behind the newest are dropped.

    Works on a stream and on a table alike.
    """
    own = contact_records(alignments.withColumn(time, F.col(time).cast("timestamp")))
    if own.isStreaming:
        own = own.withWatermark(time, late)
    pair = [F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")]
    per = own.groupBy(F.window(time, length).alias("w"), *pair).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("w.start").alias("start"), "name_a", "name_b", "n")
