"""Small tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging(spark: SparkSession) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``; below a local folder only where the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/tickflow-stage"
    return f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage and is computed once."""
    path = staging(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
