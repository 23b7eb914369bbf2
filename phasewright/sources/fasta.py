"""FASTA records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewright.functions.text import wrapped


def parse_fasta(lines: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(rec_no, name, seq): one row per header line, in order; the name ends at the first blank or tab.

    Lines before the first header and records without a name are left out.
    Lines are numbered in chunks of ``chunk``; only one row per chunk is
    brought together to number the records.
    """
    head = F.col("value").startswith(">")
    cut = lines.withColumn("chunk", F.floor(F.col("line_no") / chunk)).withColumn("head", head.cast("int"))
    per = cut.groupBy("chunk").agg(F.sum("head").alias("n"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rec = cut.withColumn("own", F.sum("head").over(within)).join(per, "chunk").withColumn("rec_no", F.col("base") + F.col("own")).where("rec_no > 0")
    parts = rec.groupBy("rec_no").agg(
        F.max(F.when(head, F.regexp_extract("value", r"^>([^ \t]*)", 1))).alias("name"),
        F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", F.trim("value").alias("part"))))).alias("parts"),
    )
    return parts.where("name <> ''").select("rec_no", "name", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"))


def fasta_lines(records: DataFrame, name: str = "name", seq: str = "seq", width: int = 60) -> DataFrame:
    """``records`` with the column ``lines``: the header and the wrapped sequence; records without a sequence are left out."""
    head = F.array(F.concat(F.lit(">"), F.col(name)))
    return records.where(F.col(seq) != "").withColumn("lines", F.concat(head, wrapped(F.col(seq), width)))
