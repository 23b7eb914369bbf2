"""GFA 1: segment and link records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewright.functions.text import cigar_length


def _tag(tokens: Column, tag: str) -> Column:
    """The whole number in the last optional field of that tag, or null."""
    own = F.filter(tokens, lambda t: t.startswith(tag))
    return F.regexp_extract(F.get(own, F.size(own) - 1), r"^.{5}(\d+)", 1).try_cast("long")


def parse_segments(lines: DataFrame) -> DataFrame:
    """(line_no, name, seq, ln, rc) of the S records.

    A record is told by its first letter and cut at white space of any kind.
    ``*`` is the empty sequence.  Records without a name are skipped; one
    without a sequence field has the empty sequence.
    """
    cut = lines.where(F.col("value").startswith("S")).select("line_no", F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") >= 2)
    tags = F.slice("t", 4, F.greatest(F.size("t") - 3, F.lit(0)))
    seq = F.coalesce(F.get("t", F.lit(2)), F.lit("*"))
    return cut.select(
        "line_no", F.col("t")[1].alias("name"), F.when(seq == "*", "").otherwise(seq).alias("seq"), _tag(tags, "LN:i:").alias("ln"), _tag(tags, "RC:i:").alias("rc")
    )


def parse_links(lines: DataFrame) -> DataFrame:
    """(line_no, src, src_rev, dst, dst_rev, cigar, overlap) of the L records; an end is reverse only if its field is ``-``."""
    cut = lines.where(F.col("value").startswith("L")).select("line_no", F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") >= 5)
    cigar = F.coalesce(F.get("t", F.lit(5)), F.lit("*"))
    return cut.select(
        "line_no", F.col("t")[1].alias("src"), (F.col("t")[2] == "-").alias("src_rev"), F.col("t")[3].alias("dst"), (F.col("t")[4] == "-").alias("dst_rev"),
        cigar.alias("cigar"), cigar_length(cigar).alias("overlap"),
    )


def segment_line(name: Column, seq: Column, length: Column, coverage: Column, phase: Column | None = None) -> Column:
    """An S record: ``*`` for the empty sequence, LN and RC where positive, PH where a phase is given."""
    parts = [F.lit("S"), name, F.when(seq == "", "*").otherwise(seq), F.when(length > 0, F.concat(F.lit("LN:i:"), length.cast("string")))]
    parts.append(F.when(coverage > 0, F.concat(F.lit("RC:i:"), coverage.cast("string"))))
    if phase is not None:
        parts.append(F.concat(F.lit("PH:i:"), phase.cast("string")))
    return F.concat_ws("\t", *parts)


def link_line(src: Column, src_rev: Column, dst: Column, dst_rev: Column, overlap: Column) -> Column:
    """An L record with the overlap as matches."""
    sign = lambda rev: F.when(rev, "-").otherwise("+")
    return F.concat_ws("\t", F.lit("L"), src, sign(src_rev), dst, sign(dst_rev), F.concat(overlap.cast("string"), F.lit("M")))


def path_line(name: Column, steps: Column) -> Column:
    """A P record; ``steps`` is the array of oriented names."""
    return F.concat_ws("\t", F.lit("P"), name, F.array_join(steps, ","), F.lit("*"))
