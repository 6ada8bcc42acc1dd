"""Shipping this library to the executors of a running session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make the library importable on every executor, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, str(source.relative_to(top.parent)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
