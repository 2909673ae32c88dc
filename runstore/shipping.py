"""Sends the engine's modules to Python workers that do not have them on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; the subpackage of training-data operators sends itself."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        package = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="runstore-py-")) / "runstore_engine.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(to))
        _SENT.add(app)
