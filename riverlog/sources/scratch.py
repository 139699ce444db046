"""Fresh folders that the driver and all executors share, for what a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, below a local temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riverlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/riverlog/{name}-{uuid.uuid4().hex[:12]}"
