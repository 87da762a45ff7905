"""Sends this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import glossmill

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: adds the package, a zip file of some 100 KB, to the workers' path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(glossmill.__file__).parent
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder, "tree", root.name)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp(), root.name)), "zip", copy.parent))
    _shipped.add(context.applicationId)
