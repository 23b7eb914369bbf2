"""Column functions on sequences and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cigar_length(cigar: Column) -> Column:
    """Sum of the numbers before every sign that is no digit; trailing digits do not count.  Null, ``*`` and empty give 0."""
    numbers = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)(?=\D)"), F.lit(1))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))


def reverse_complement(seq: Column) -> Column:
    """Upper case; what is no base becomes N."""
    return F.reverse(F.regexp_replace(F.translate(seq, "ACGTacgt", "TGCATGCA"), "[^ACGT]", "N"))


def wrapped(seq: Column, width: int = 60) -> Column:
    """The lines of a sequence, ``width`` letters each; none for the empty one."""
    starts = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(seq, i, F.lit(width)))


def phase_suffix(phase: Column) -> Column:
    """``_ph0`` or ``_ph1`` for a haplotype, nothing otherwise."""
    return F.when(phase == 0, "_ph0").when(phase == 1, "_ph1").otherwise("")
