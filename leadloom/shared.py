"""Folders that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only where that is unset on a local master, as in tests, a temporary folder serves."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="leadloom-"))
        root = _OWN[0]
    return f"{root.rstrip('/')}/leadloom-{name}-{uuid.uuid4().hex}"
