"""Makes the package known to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the compiled package to the executors, once for each application.

    Spark's file server hands it to every executor, also to those that join later, so it
    needn't be installed there nor stand in their path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tallyloom-ship-"), "tallyloom.zip")
    with zipfile.PyZipFile(path, "w") as z:
        z.writepy(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
