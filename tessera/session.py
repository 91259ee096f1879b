"""What a session provides: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine; a cluster must name one."""
    base = spark.conf.get(_FOLDER, None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{_FOLDER} is unset: name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(_FOLDER, base)
    return base.rstrip("/")
