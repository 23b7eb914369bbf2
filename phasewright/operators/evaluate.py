"""Scoring assemblies against parental references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of the external report (fixed values of its format), and our columns for them.
REPORT_KEYS = {
    "# contigs": "contig_count",
    "Total length": "assembly_bases",
    "Largest contig": "longest_contig",
    "N50": "half_length",
    "NG50": "half_length_of_reference",
    "# misassemblies": "misassembly_count",
    "Genome fraction (%)": "genome_fraction",
    "Duplication ratio": "duplication",
    "# mismatches per 100 kbp": "mismatches",
    "# indels per 100 kbp": "indels",
    "Total aligned length": "aligned_bases",
    "Reference length": "reference_bases",
}
#: Metrics that are lengths; the others are plain figures.
LENGTHS = ("assembly_bases", "longest_contig", "half_length", "half_length_of_reference", "aligned_bases", "reference_bases")
NO_MISMATCHES, NO_INDELS = 9999.0, 9999.0


def parse_report(lines: DataFrame, *report: str) -> DataFrame:
    """(*report, metric, raw, value) of tab-separated reports (*report, line_no, value): known labels only; the last line of a label wins.

    ``report`` are the columns that tell one report from another, if there are
    several; a null in them makes a report like any other value.
    """
    cut = lines.select(*report, "line_no", F.split("value", "\t").alias("t")).where(F.size("t") >= 2)
    known = F.create_map(*[F.lit(x) for pair in REPORT_KEYS.items() for x in pair])
    own = cut.select(*report, "line_no", known[F.trim(F.col("t")[0])].alias("metric"), F.trim(F.col("t")[1]).alias("raw")).where("metric IS NOT NULL")
    return own.groupBy(*report, "metric").agg(F.max_by("raw", F.struct("line_no", "raw")).alias("raw")).withColumn("value", F.col("raw").try_cast("double"))


def wide_metrics(parsed: DataFrame, *report: str) -> DataFrame:
    """One row per report with a column for each metric, null where the report lacks it."""
    value = {m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in REPORT_KEYS.values()}
    return parsed.groupBy(*report).agg(*value.values())


def score(genome_fraction: Column, mismatches: Column, indels: Column) -> Column:
    """Share of the genome less a tenth of the mismatches and a twentieth of the indels; what is missing counts 0, 9999 and 9999."""
    missing = lambda c, v: F.coalesce(c.cast("double"), F.lit(v))
    return missing(genome_fraction, 0.0) - 0.1 * missing(mismatches, NO_MISMATCHES) - 0.05 * missing(indels, NO_INDELS)


def assignments(metrics: DataFrame) -> DataFrame:
    """(tool, straight, crossed, phase0_parent) from metrics (tool, phase, ref, genome_fraction, mismatches, indels).

    Haplotype 0 is ``PATERNAL`` if it against the paternal and 1 against the
    maternal reference score at least as much as the other way round, else
    ``MATERNAL``; ``?`` unless all four are there.
    """
    scored = metrics.withColumn("score", score(F.col("genome_fraction"), F.col("mismatches"), F.col("indels")))
    of = lambda p, r: F.max(F.when((F.col("phase") == p) & (F.col("ref") == r), F.col("score")))
    wide = scored.groupBy("tool").agg(of(0, "pat").alias("p0"), of(1, "mat").alias("m1"), of(0, "mat").alias("m0"), of(1, "pat").alias("p1"))
    straight, crossed = F.col("p0") + F.col("m1"), F.col("m0") + F.col("p1")
    name = F.when(straight.isNull() | crossed.isNull(), "?").when(straight >= crossed, "PATERNAL").otherwise("MATERNAL")
    return wide.select("tool", straight.alias("straight"), crossed.alias("crossed"), name.alias("phase0_parent"))


def readable_length(bases: Column) -> Column:
    """A length in Mb with two places, or ``-`` if there is none."""
    return F.when(bases.isNull(), "-").otherwise(F.format_string("%.2f Mb", bases.cast("double") / 1e6))


def readable_value(value: Column) -> Column:
    """A whole figure without a point, any other with three places, ``-`` if there is none."""
    whole = value == F.floor(value)
    return F.when(value.isNull(), "-").when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.3f", value.cast("double")))


def evaluation_table(metrics: DataFrame) -> DataFrame:
    """(tool, phase, ref, parent, place, every metric as text) from wide metrics (tool, phase, ref, metrics).

    ``parent`` is the parent given to the phase (see ``assignments``), ``place``
    ranks the tools by the better of their two sums of scores, ties sharing a
    place and tools without both sums coming last.
    """
    given = assignments(metrics)
    best = F.greatest("straight", "crossed")
    # one row per tool
    ranked = given.select("tool", "phase0_parent", F.rank().over(Window.orderBy(F.desc_nulls_last(F.when(F.col("phase0_parent") != "?", best)))).cast("long").alias("place"))
    other = F.when(F.col("phase0_parent") == "PATERNAL", "MATERNAL").when(F.col("phase0_parent") == "MATERNAL", "PATERNAL").otherwise("?")
    text = [(readable_length(F.col(m)) if m in LENGTHS else readable_value(F.col(m))).alias(m) for m in REPORT_KEYS.values()]
    return metrics.join(ranked, "tool").select("tool", "phase", "ref", F.when(F.col("phase") == 0, F.col("phase0_parent")).otherwise(other).alias("parent"), "place", *text)


def evaluation_lines(table: DataFrame, refs: tuple[str, ...] = ("pat", "mat")) -> DataFrame:
    """(tool, line_no, line) of a report to read: per tool its place and parents, then a line per phase and reference with its metrics, ``no data`` where there is none."""
    tools = table.groupBy("tool").agg(F.min("place").alias("place"), *[F.max(F.when(F.col("phase") == p, F.col("parent"))).alias(f"p{p}") for p in (0, 1)])
    head = tools.select("tool", F.lit(0).alias("line_no"), F.format_string("%d. %s: phase 0 %s, phase 1 %s", "place", "tool", F.coalesce("p0", F.lit("?")), F.coalesce("p1", F.lit("?"))).alias("line"))
    slots = tools.select("tool", F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(r).alias("ref"), F.lit(1 + p * len(refs) + k).alias("line_no")) for p in (0, 1) for k, r in enumerate(refs)])).alias("x"))
    figures = F.concat_ws(", ", *[F.concat(F.lit(f"{m} "), F.col(m)) for m in REPORT_KEYS.values()])
    body = slots.select("tool", "x.*").join(table.select("tool", "phase", "ref", figures.alias("figures")), ["tool", "phase", "ref"], "left")
    return head.unionByName(body.select("tool", "line_no", F.concat_ws("", F.format_string("  phase %d against %s: ", "phase", "ref"), F.coalesce("figures", F.lit("no data"))).alias("line")))
