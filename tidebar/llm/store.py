"""Tables that cut lineage: Parquet in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder for a local master (tests); clusters are refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tidebar-')}")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).deleteOnExit(target)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it again, so that nothing later computes it anew. Shuffle files of the plans before go first.

    Spark's context cleaner drops the shuffles of plans without references, which those of the table before this one are by now.
    """
    path, spark = scratch(df.sparkSession, name), df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(hadoop).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
