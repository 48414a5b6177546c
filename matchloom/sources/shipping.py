"""The package on its way to executors that don't share the driver's folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors as a zip, once for each application, wherever the driver found it."""
    context: SparkContext = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    own = Path(tempfile.mkdtemp(prefix="matchloom-zip-"))  # the driver serves the archive from there while it lives
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    copied = shutil.copytree(package, own / "tree" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(own / f"{package.name}-{context.applicationId}"), "zip", copied.parent, package.name))
    _shipped.add(context.applicationId)
