"""Send this package to Python workers that could not import it otherwise."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark distribute the package, once per application, unless workers inherit a path to it."""
    package = Path(__file__).resolve().parents[1]
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    application = spark.sparkContext.applicationId
    if application in _sent or any(p and Path(p).resolve() == package.parent for p in paths):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(made)  # the driver's copy; Spark hands it to every executor
    _sent.add(application)
