"""Text lines with their place in the file, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of one or more text files, numbered from 1 in the order of file name and line.

    Every split numbers its own lines; only one row per split is brought
    together to add what comes before it.  Trailing carriage returns are
    dropped; empty lines are kept and numbered.
    """
    raw = spark.read.text(path).select(
        "value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("at")
    )
    split = raw.groupBy("file", "start").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = raw.join(split.select("file", "start", "low", "base"), ["file", "start"])
    return placed.select((F.col("base") + F.col("at") - F.col("low") + 1).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))


def lines_of(spark: SparkSession, content: str) -> DataFrame:
    """(line_no, value) of a text held in memory."""
    rows = [(k + 1, v.rstrip("\r")) for k, v in enumerate(content.split("\n"))]
    return spark.createDataFrame(rows, "line_no long, value string")
