"""Sessions and shipping: makes the package importable on every executor."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python functions load there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    where = Path(tempfile.mkdtemp(prefix="lexweave-ship-"))
    shutil.copytree(ROOT / "lexweave", where / "tree" / "lexweave", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(where / "lexweave"), "zip", where / "tree"))
    _shipped.add(app)
