"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder already set on the context. Where neither is set, a single machine
    gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sitewright-")
    if not held.isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")
