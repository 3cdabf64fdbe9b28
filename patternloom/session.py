"""Making the package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each Spark application.

    Python workers import its modules; on a cluster they don't see the
    driver's path.  The archive is some tens of kilobytes.
    """
    context = spark.sparkContext
    if getattr(context, "_patternloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="patternloom-"), "patternloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._patternloom_shipped = True
