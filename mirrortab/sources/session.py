"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if "mirrortab.zip" in context._python_includes:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="mirrortab-ship-"), "mirrortab")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(package), base_dir="mirrortab")
    context.addPyFile(archive)
