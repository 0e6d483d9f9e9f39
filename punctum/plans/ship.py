"""This package for the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import punctum

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each application; workers needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(punctum.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="punctum-"), "punctum.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("punctum", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
