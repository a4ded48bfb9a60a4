"""Written intermediate tables.

Several operators read their input more than once (chunk totals, then rows).  Staging writes
such an input once, as Parquet, in the shared folder that ``spark.checkpoint.dir`` names, so a
lost executor costs a re-read and not a recomputation of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def make_dir(spark: SparkSession, path: str) -> None:
    """An empty folder reads as a table without rows; a missing one is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def drop_staged(spark: SparkSession) -> bool:
    """Delete what this application has staged; call it when the results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
