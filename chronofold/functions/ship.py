"""Puts this package on the executors, whatever they have on their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Sends the package's source, zipped, to all Python workers of the session's context; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_has_" + os.path.basename(_PACKAGE), False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), os.path.basename(_PACKAGE) + ".zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    setattr(sc, "_has_" + os.path.basename(_PACKAGE), True)
