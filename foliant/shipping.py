"""Sends this package to the executors' Python."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a Python file, once for each Spark application; tasks then import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_foliant_shipped", False):
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="foliant-")) / "foliant_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(at))
    context._foliant_shipped = True
