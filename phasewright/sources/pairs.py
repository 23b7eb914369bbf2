"""Pair lists and phasing tables in plain comma-separated text, without quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns by which the two kinds of table are told apart (fixed values of the formats).
PHASING = ("Name", "Ploidy", "Bubble chain")
PAIRS = ("name_a", "name_b")


def split_csv(value: Column) -> Column:
    """Fields between commas; no quotes, nothing trimmed, empty fields kept."""
    return F.split(value, ",", -1)


def header_kind(header: str | None) -> str:
    """``phasing`` or ``pairs`` by the columns of a header line; the former wins."""
    names = (header or "").rstrip("\r").split(",")
    if all(c in names for c in PHASING):
        return "phasing"
    if all(c in names for c in PAIRS):
        return "pairs"
    raise ValueError(f"a table with neither {PHASING} nor {PAIRS}: {names}")


def table_of(lines: DataFrame) -> tuple[str, DataFrame]:
    """(kind, rows) of a table whose first line names the columns; a row keeps its line number, missing fields are null."""
    first = lines.where(F.col("line_no") == 1).select("value").first()
    kind = header_kind(first.value if first else None)
    names = first.value.rstrip("\r").split(",")
    cut = lines.where((F.col("line_no") > 1) & (F.col("value") != "")).withColumn("t", split_csv(F.col("value")))
    return kind, cut.select("line_no", *[F.get("t", F.lit(k)).alias(n) for k, n in enumerate(names)])


def phasing_pairs(rows: DataFrame) -> DataFrame:
    """(name_a, name_b) per place of a bubble chain that has both haplotypes.

    Only rows of ploidy ``2`` with a name count; of several rows for the same
    haplotype of a place the last line wins.
    """
    key = ["Bubble chain", "Position in bubble chain", "Component"]
    own = rows.where((F.col("Ploidy") == "2") & (F.col("Name") != "") & F.col("Haplotype").isNotNull())
    slot = lambda h: F.max_by(F.when(F.col("Haplotype") == h, F.col("Name")), F.when(F.col("Haplotype") == h, F.col("line_no")))
    both = own.groupBy(*key).agg(slot("0").alias("name_a"), slot("1").alias("name_b"), F.min("line_no").alias("line_no"))
    return both.where("name_a IS NOT NULL AND name_b IS NOT NULL").select("line_no", "name_a", "name_b")


def listed_pairs(rows: DataFrame) -> DataFrame:
    """(line_no, name_a, name_b) of the rows with two different names, each unordered pair once, at its first line."""
    own = rows.where("name_a <> '' AND name_b <> '' AND name_a <> name_b")
    return own.groupBy(F.least("name_a", "name_b").alias("x"), F.greatest("name_a", "name_b").alias("y")).agg(
        F.min(F.struct("line_no", "name_a", "name_b")).alias("first")
    ).select("first.*")
