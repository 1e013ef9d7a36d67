"""The package as a file that Spark gives to its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = __name__.split(".")[0]


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_wayfold_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="wayfold-"), f"{PACKAGE}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join(PACKAGE, os.path.relpath(p, root)))
    sc.addPyFile(target)
    sc._wayfold_shipped = True
