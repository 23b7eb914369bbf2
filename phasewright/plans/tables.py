"""Reading the given tables and cutting lineage with tables in the shared folder.

An intermediate result that is used more than once, or that an iterative
operator passes from round to round, is written to the folder the cluster names
in ``spark.checkpoint.dir`` and read back.  Such a table survives the loss of
any executor, and its plan is a plain Parquet scan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session that names none (a test) gets a folder of its own; on
    a cluster a folder that executors don't share would lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir() or named
    return named.rstrip("/")


class Kept:
    """A written table: ``df`` scans it, ``stats`` holds what was observed while writing."""

    def __init__(self, df: DataFrame, path: str, stats: dict):
        self.df, self.path, self.stats = df, path, stats

    def drop(self) -> None:
        """Delete the files; for tables of an earlier round that no later plan reads."""
        _delete(self.df.sparkSession, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is; PySpark has no function of its own for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables this application has kept; for its end, when no plan reads them any more."""
    _delete(spark, _own_dir(spark))


def keep(df: DataFrame, **stats) -> Kept:
    """Write ``df`` to the shared folder and read it back.

    ``stats`` are named aggregate columns, computed in the same job by an
    observation; their values come back in ``Kept.stats``.
    """
    from pyspark.sql import Observation

    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    seen = None
    if stats:
        seen = Observation()
        df = df.observe(seen, *[c.alias(n) for n, c in stats.items()])
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return Kept(back, path, seen.get if seen is not None else {})


def is_empty(df: DataFrame) -> bool:
    """Whether there are no rows; reads at most one."""
    return not df.select(F.lit(1)).take(1)


__all__ = ["Kept", "is_empty", "keep", "load", "release", "shared_dir"]
