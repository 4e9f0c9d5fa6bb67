"""D1 — failure events (JSON) with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("dag_id", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("log_path", T.StringType()),
        T.StructField("job_file", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Events as JSON lines (or one document per file with ``multiline``).

    No inference: malformed records keep their text in ``_corrupt_record``.
    """
    return (
        spark.read.schema(EVENT_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", str(multiline).lower())
        .json(path)
    )


def write_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines; timestamps keep their microseconds."""
    digits = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"timestampNTZFormat": digits, "timestampFormat": digits + "XXX"}
    events.write.mode("overwrite").options(**options).json(path)


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same events as a Structured Streaming source over a folder."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.json(path)
