"""Folders that the driver and all executors see, for datasets that a session makes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where unset, a temporary folder of a local session or a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_datasets"
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _local[0]


def own_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; the JVM removes what is there when it ends."""
    path = f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
