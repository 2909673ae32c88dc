"""Where tables that live no longer than their use are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset (tests, one machine) in a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="runstore-engine-"))
    return f"{where.rstrip('/')}/runstore-{name}-{uuid.uuid4().hex}"
