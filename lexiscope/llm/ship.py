"""Makes this package importable in Python workers that were not started beside it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to Spark's file server, once per application.

    Not needed where it is on ``PYTHONPATH`` or the application was submitted with it.
    """
    context = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in known or Path.cwd() == ROOT or context.applicationId in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lexiscope-package-"), "lexiscope")
    context.addPyFile(shutil.make_archive(archive, "zip", ROOT, "lexiscope"))
    _SHIPPED.add(context.applicationId)
