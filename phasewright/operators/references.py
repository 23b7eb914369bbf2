"""References to records that do not exist, were deleted, or came later."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewright.operators.skew import heavy_keys
from phasewright.plans.tables import keep

#: Most parent keys that one range is planned for; they are held as sorted arrays by the task that probes them.
RANGE_KEYS = 1_000_000
#: References that one range is planned for.
RANGE_REFS = 5_000_000
MISSING, DELETED, LATE = "missing", "deleted", "late"
_NEVER = np.iinfo(np.int64).max


def clean_name(name: Column) -> Column:
    """A name without spaces, tabs and carriage returns around it; blank becomes null."""
    bare = F.regexp_replace(name, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.when(bare != "", bare)


def without_phase(name: Column) -> Column:
    """A name without one final phase suffix."""
    return F.regexp_replace(name, "_ph[01]$", "")


def parents_of(versions: DataFrame, key: str, order: str, loaded: str, deleted: str) -> DataFrame:
    """One row per parent key: when it was first loaded and when its last version was deleted.

    The version with the largest ``order`` is the last.  Versions with a null key are no parents.
    """
    return (
        versions.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(
            F.min(loaded).cast("timestamp_ntz").alias("first_loaded"),
            F.max_by(deleted, F.struct(F.col(order), F.col(deleted))).cast("timestamp_ntz").alias("deleted_at"),
        )
    )


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its parents come first and become sorted arrays; the references after them are looked up batch by batch."""
    keys: list[np.ndarray] = []
    first: list[np.ndarray] = []
    gone: list[np.ndarray] = []
    table = None

    def arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not keys:
            return np.empty(0, object), np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.concatenate(keys)
        by = np.argsort(k, kind="stable")
        return k[by], np.concatenate(first)[by], np.concatenate(gone)[by]

    def values(column: pa.Array) -> np.ndarray:
        if pa.types.is_integer(column.type):
            return column.fill_null(0).to_numpy(zero_copy_only=False)
        return np.asarray(column.fill_null("").to_pylist(), dtype=object)

    def times(column: pa.Array, empty: int) -> np.ndarray:
        return column.cast(pa.int64()).fill_null(empty).to_numpy(zero_copy_only=False)

    def find(sought: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Place of each sought key among the sorted ones, -1 where it is not."""
        if not len(have) or not len(sought):
            return np.full(len(sought), -1)
        at = np.minimum(np.searchsorted(have, sought), len(have) - 1)
        return np.where(have[at] == sought, at, -1)

    for batch in batches:
        parent = np.asarray(batch.column("is_ref").to_numpy(zero_copy_only=False)) == 0
        if parent.any():
            own = batch.filter(pa.array(parent))
            keys.append(values(own.column("key")))
            first.append(times(own.column("first_loaded"), -_NEVER))
            gone.append(times(own.column("deleted_at"), _NEVER))
        refs = batch.filter(pa.array(~parent))
        if not refs.num_rows:
            continue
        if table is None:
            table = arrays()
        have, loaded, deleted = table
        at = find(values(refs.column("key")), have)
        other = refs.column("fallback")
        retry = (at < 0) & ~np.asarray(other.is_null())
        if retry.any():
            at[retry] = find(values(other)[retry], have)
        when = refs.column("at").cast(pa.int64())
        dated = ~np.asarray(when.is_null())
        when = when.fill_null(0).to_numpy(zero_copy_only=False)
        reason = np.full(refs.num_rows, "", object)
        reason[at < 0] = MISSING
        if len(have):
            known = (at >= 0) & dated
            dead = known & (deleted[at] <= when)
            reason[dead] = DELETED
            reason[known & ~dead & (loaded[at] > when)] = LATE
        bad = reason != ""
        if bad.any():
            left = refs.filter(pa.array(bad))
            yield pa.RecordBatch.from_arrays(
                [left.column("tab"), left.column("field"), left.column("row_key"), left.column("period"), pa.array(reason[bad], pa.string())],
                names=["tab", "field", "row_key", "period", "reason"],
            )


def orphan_references(
    refs: DataFrame, parents: DataFrame, extension_of: Callable[[Column], Column] = lambda key: key, range_keys: int = RANGE_KEYS
) -> DataFrame:
    """References whose key no parent has, whose parent was deleted by then, or came only later.

    ``refs``: tab, field, row_key, key, fallback, at.  A key is looked up as it
    is and, if no parent has it, by ``fallback`` (null: no second try).  Where
    fallbacks are given, ``extension_of`` makes the fallback from a key, or
    returns the key if it has none; a reference goes to the range of its
    fallback, and a parent to the ranges of its key and of its key's fallback.  A null key refers to
    nothing.  A reference without a time can only be ``missing``; its period
    is null.  ``parents``: key, first_loaded, deleted_at, one row per key; a
    null ``deleted_at`` is never deleted and a null ``first_loaded`` was
    always there.  Result: tab, field, row_key, period (``yyyy-MM``), reason;
    repeated references come out as often as they are given.

    Both sides are range-partitioned on the key, into ranges of at most
    ``range_keys`` parents and ``RANGE_REFS`` references on average.  The references to a heavy key
    (one of at most 1/support, from a sketch, then counted) are spread over so
    many ranges that each holds a quarter of an average one, and its parent is copied to all of them.
    """
    spark = refs.sparkSession
    kept = keep(parents.select("key", "first_loaded", "deleted_at"), n=F.count(F.lit(1)))
    kind = parents.schema["key"].dataType
    refs = refs.where(F.col("key").isNotNull()).withColumn("rk", F.coalesce(F.col("fallback").cast(kind), F.col("key")))
    # at most 1/support rows and one for all the rest
    heavy = F.broadcast(heavy_keys(refs, "rk").withColumn("hot", F.lit(True)))
    counts = keep(refs.join(heavy, "rk", "left").groupBy(F.when(F.col("hot"), F.col("rk")).alias("rk")).agg(F.count(F.lit(1)).alias("n")), total=F.sum("n"))
    total = counts.stats["total"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.stats["n"] // range_keys), -(-total // RANGE_REFS))
    hot = F.broadcast(counts.df.where("rk IS NOT NULL").select("rk", F.greatest(F.ceil(F.col("n") * (4 * ranges) / max(total, 1)), F.lit(1)).cast("int").alias("salts")))
    left = (
        kept.df.withColumn("rk", F.explode(F.array_distinct(F.array("key", extension_of(F.col("key"))))))
        .join(hot, "rk", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .select(
            "rk", "salt", F.lit(0).alias("is_ref"), "key", F.lit(None).cast(kind).alias("fallback"), "first_loaded", "deleted_at",
            F.lit(None).cast("string").alias("tab"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("long").alias("row_key"),
            F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(None).cast("string").alias("period"),
        )
    )
    never = F.lit(None).cast("timestamp_ntz")
    right = refs.join(hot, "rk", "left").select(
        "rk", F.pmod(F.xxhash64("row_key", "field"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
        F.lit(1).alias("is_ref"), "key", F.col("fallback").cast(kind).alias("fallback"), never.alias("first_loaded"), never.alias("deleted_at"),
        "tab", "field", F.col("row_key").cast("long").alias("row_key"), F.col("at").cast("timestamp_ntz").alias("at"), F.substring(F.col("at").cast("timestamp_ntz").cast("string"), 1, 7).alias("period"),
    )
    return (
        left.unionByName(right)
        .repartitionByRange(ranges, "rk", "salt")
        .sortWithinPartitions("is_ref")
        .mapInArrow(_probe, "tab string, field string, row_key long, period string, reason string")
    )


def segment_references(segments: DataFrame, shared: DataFrame, links: DataFrame, uz: DataFrame) -> DataFrame:
    """Orphan references to segments: by id from both ends of the links, by name from the unzipped segments.

    Shared segments always exist.  A name stands for the segment of exactly
    that name or, if there is none, of the name without one final phase suffix.
    """
    always = shared.select("node_id", clean_name(F.col("name")).alias("name"))

    def parents(key: str) -> DataFrame:
        own = parents_of(segments.withColumn(key, F.col(key) if key == "node_id" else clean_name(F.col(key))), key, "line_no", "loaded_at", "deleted_at")
        steady = always.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
        few = steady.select("key", *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("first_loaded", "deleted_at")])
        return own.join(steady, "key", "left_anti").unionByName(few)

    ends = links.select(
        "link_no", "loaded_at", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key")) for f in ("source_id", "target_id")])).alias("end")
    ).select(
        F.lit("links").alias("tab"), F.col("end.field").alias("field"), F.col("link_no").alias("row_key"), F.col("end.key").alias("key"),
        F.lit(None).cast("long").alias("fallback"), F.col("loaded_at").alias("at"),
    )
    named = uz.withColumn("key", clean_name(F.col("name"))).select(
        F.lit("uz_segments").alias("tab"), F.lit("name").alias("field"), F.col("seg_idx").alias("row_key"), "key",
        F.when(F.col("key").rlike("_ph[01]$"), without_phase(F.col("key"))).alias("fallback"), F.col("built_at").alias("at"),
    )
    return orphan_references(ends, parents("node_id")).unionByName(orphan_references(named, parents("name"), without_phase))
