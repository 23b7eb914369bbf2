"""Giving the executors the package, so that they need no installation of it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import phasewright

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(phasewright.__file__))
    if not os.path.isdir(root):  # the package came in an archive, so it was shipped with the application
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "phasewright.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("phasewright", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
