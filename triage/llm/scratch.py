"""Tables in the shared checkpoint folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from triage.session import ensure_checkpoint_dir


def save(df: DataFrame, name: str, *partition_by: str) -> str:
    """Write a frame to a new parquet table in the shared folder; its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/triage-llm/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def saved(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The frame, read back from its table."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(save(df, name, *partition_by))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later result reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
