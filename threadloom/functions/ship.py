"""Sending this package to the Python workers, so that they need no shared source folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once."""
    sc = spark.sparkContext
    if getattr(sc, "_threadloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="threadloom-"), "threadloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f"{_PACKAGE.name}/{f.relative_to(_PACKAGE)}")
    sc.addPyFile(target)
    sc._threadloom_shipped = True
