"""Makes this package importable in Python workers, wherever the session was started from."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once per application (Spark serves the archive from the driver)."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as top:
        stage = Path(top, "stage")
        shutil.copytree(here, stage / here.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{here.name}", "zip", stage))
    _done.add(context.applicationId)
