"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir; removed when the driver ends. Where that is unset, local masters get a temporary folder, clusters are refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        root = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tidebar-')}")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that nothing later computes it anew."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
