"""A17/A18, C11 — root-cause sink and source.

Records are a table partitioned by error type (parquet by default, JSON lines
optionally); writes overwrite atomically per job, so a retried job leaves one
copy.  Reading back uses the fixed record schema, never inference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSIFICATION = T.StructType(
    [
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("matched_patterns", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
    ]
)
DIAGNOSTICS = T.StructType(
    [
        T.StructField("missing_columns", T.ArrayType(T.StringType())),
        T.StructField("extra_columns", T.ArrayType(T.StringType())),
        T.StructField("instance_hint", T.StringType()),
        T.StructField("shuffle_bytes", T.LongType()),
        T.StructField("skew_ratio", T.DoubleType()),
        T.StructField("hotkey_count", T.LongType()),
        T.StructField("total_records", T.LongType()),
        T.StructField("missing_path", T.StringType()),
    ]
)
ROOT_CAUSE = T.StructType(
    [
        T.StructField("log_path", T.StringType()),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("root_cause", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("suggested_action_types", T.ArrayType(T.StringType())),
        T.StructField("diagnostics", DIAGNOSTICS),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("remediation_hint", T.StringType()),
        T.StructField("classification", CLASSIFICATION),
    ]
)


def write_root_causes(rc: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The root-cause table, partitioned by ``error_type``."""
    out = rc.withColumn("error_type", F.col("classification.error_type"))
    out.write.mode("overwrite").partitionBy("error_type").format(fmt).save(path)


def write_summaries(rc: DataFrame, path: str) -> None:
    """The classification summaries alone (JSON lines)."""
    rc.select("log_path", "classification.*").write.mode("overwrite").json(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The summaries back, with their fixed schema."""
    return spark.read.schema(T.StructType([ROOT_CAUSE["log_path"], *CLASSIFICATION.fields])).json(path)


def read_root_causes(spark: SparkSession, path: str, fmt: str = "parquet", multiline: bool = False) -> DataFrame:
    """Records back with the fixed schema (JSON documents need ``multiline``)."""
    if fmt == "json":
        back = spark.read.schema(ROOT_CAUSE).option("multiLine", str(multiline).lower()).json(path)
        return back.select(*ROOT_CAUSE.names)
    return spark.read.format(fmt).load(path).select(*[f.name for f in ROOT_CAUSE.fields])
