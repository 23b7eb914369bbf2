"""SAM records and the filter that makes a record a contact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a record's flag bits, those looked at and those that must be set: paired and first in pair, but not unmapped, mate unmapped,
#: secondary or supplementary (fixed values of the SAM format).
LOOKED_AT, WANTED = 2381, 65


def parse_sam(lines: DataFrame) -> DataFrame:
    """The eleven fields of every alignment line; header lines and lines with fewer fields are skipped."""
    cut = lines.where(~F.col("value").startswith("@")).select("line_no", F.split("value", "\t").alias("t")).where(F.size("t") >= 11)
    kinds = {"qname": "string", "flag": "int", "rname": "string", "pos": "long", "mapq": "int", "cigar": "string", "rnext": "string", "pnext": "long", "tlen": "long", "seq": "string", "qual": "string"}
    return cut.select("line_no", *[F.col("t")[k].try_cast(kind).alias(name) for k, (name, kind) in enumerate(kinds.items())])


def contact_records(alignments: DataFrame) -> DataFrame:
    """``alignments`` that count as a contact, with the two names: ``name_a`` and ``name_b``.

    First of a pair, both mates mapped, neither secondary nor supplementary,
    both with a reference (``=`` stands for the same one).  Quality, duplicate
    and quality-check flags do not matter.  A null flag or name is no contact.
    """
    mate = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    good = (F.col("flag").bitwiseAND(LOOKED_AT) == WANTED) & (F.col("rname") != "*") & (mate != "*")
    return alignments.where(good).withColumns({"name_a": F.col("rname"), "name_b": mate})
