"""Written intermediate tables in the folder all executors share.

A written table survives the loss of any executor and cuts the lineage, so a later failure replays
one stage and not the whole history.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only where a local session has none."""
    sc = spark.sparkContext
    configured = sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Stores ``df`` as parquet in the shared folder; returns a scan of it and its path."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, label)[0]


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that a later one has replaced."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` unless a finished copy is there, then read it back.

    A finished copy carries the committer's ``_SUCCESS`` marker. What a broken earlier attempt left
    behind has none and is overwritten, so it is never taken for the data set.
    """
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
