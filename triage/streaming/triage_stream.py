"""D10/D11 — streaming triage: failure events → logs → root causes.

Events arrive as JSON files (Kafka works the same through ``readStream``).
Duplicates are dropped in the stream (D11).

:func:`triage_arrivals` has two streams, events and log files: a batch lists and reads
the log files that are new since the one before and no others, analyses them, and an
outer stream join brings record and event together, whichever arrives first.  Both
sides wait in the join's state by arrival time and leave it when their time is over;
an event whose log doesn't come is then given out as missing.

:func:`triage_stream` joins the events with a table of logs instead.  Each
micro-batch asks once which of its events have a log and writes the answer, so a
log that lands meanwhile can't fall between the two outputs: records of the
events with a log, and the retry set of the others.  Everything is written under
``epoch=<id>`` with overwrite, so a replayed epoch replaces its own output
(idempotent sink).  Each batch unions the previous epoch's retry set with its new
events; :func:`triage_late_logs` serves the last retry set without new events.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, TriageConfig
from ..operators.events import ARRIVED, EVENT_KEYS, arriving, dedup_stream, resolve
from ..operators.rootcause import analyze
from ..sources.events import EVENT_SCHEMA, event_stream
from ..sources.log_source import log_arrivals, read_tails
from ..sources.logs import decoded_logs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields if f.name != "_corrupt_record"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def process_batch(
    spark: SparkSession,
    events: DataFrame,
    logs: DataFrame,
    out: str,
    epoch_id: int,
    cfg: TriageConfig = DEFAULT,
) -> None:
    """One micro-batch: resolve, analyse, write records and the retry set."""
    retry_prev = os.path.join(out, "retry", f"epoch={epoch_id - 1}")
    batch = events.select(*EVENT_COLUMNS)
    if _exists(spark, retry_prev):  # any error in reading it fails the batch
        batch = batch.unionByName(spark.read.schema(batch.schema).parquet(retry_prev))
    missing = _write_records(spark, batch, logs, out, "root_causes", epoch_id, cfg)
    missing.write.mode("overwrite").parquet(os.path.join(out, "retry", f"epoch={epoch_id}"))


def _write_records(spark, batch, logs, out, table, epoch_id, cfg) -> DataFrame:
    """Write the records of the events that have a log; the other events."""
    asked = os.path.join(out, f"{table}_events", f"epoch={epoch_id}")
    resolve(batch, logs.select("log_path", F.lit("").alias("log_text"))).select(*EVENT_COLUMNS, "ok").write.mode(
        "overwrite"
    ).parquet(asked)
    answered = spark.read.parquet(asked)
    found = answered.where("ok").drop("ok")
    wanted = found.select("log_path").distinct()
    texts = logs.select("log_path", "log_text").join(wanted, "log_path", "left_semi")
    rc = analyze(resolve(found, texts).where("ok"), cfg=cfg, keep=EVENT_KEYS)
    rc.write.mode("overwrite").parquet(os.path.join(out, table, f"epoch={epoch_id}"))
    return answered.where(~F.col("ok")).drop("ok")


def _last_epoch(spark: SparkSession, folder: str) -> int | None:
    if not _exists(spark, folder):
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    return max((int(name.split("=")[1]) for name in names if name.startswith("epoch=")), default=None)


def triage_late_logs(spark: SparkSession, logs: DataFrame, out: str, cfg: TriageConfig = DEFAULT) -> None:
    """Triage the last retry set against ``logs`` when no new event starts a batch.

    The records lie apart, under the epoch's number, and are overwritten by the next
    pass.  The next epoch goes through the same retry set and so replaces them:
    :func:`read_stream_output` reads those of the last epoch only.
    """
    last = _last_epoch(spark, os.path.join(out, "retry"))
    if last is not None:
        events = spark.read.parquet(os.path.join(out, "retry", f"epoch={last}"))
        _write_records(spark, events, logs, out, "late_root_causes", last, cfg)


def triage_stream(
    spark: SparkSession,
    events_path: str,
    logs: DataFrame,
    out: str,
    checkpoint: str,
    cfg: TriageConfig = DEFAULT,
    retention: str = "30 days",
    available_now: bool = True,
):
    """Start the streaming triage query; returns the ``StreamingQuery``.

    ``logs`` is a batch DataFrame of ``log_path, log_text`` (for example a log
    table maintained by ``read_logs``); it is re-read by every micro-batch.
    """
    ev = dedup_stream(event_stream(spark, events_path), EVENT_KEYS, retention)

    def handle(df: DataFrame, epoch_id: int) -> None:
        process_batch(spark, df, logs, out, epoch_id, cfg)

    w = ev.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def paired(events: DataFrame, records: DataFrame, wait: str, keep: str) -> DataFrame:
    """Events (``_arrived``, ``log_path``) with their record, as an outer join of two streams.

    An event waits ``wait`` for its log and a record ``keep`` for its event.
    ``records`` has ``log_path``; a released event has nulls in their columns.
    """
    log = records.withColumnsRenamed({"log_path": "_log_path", ARRIVED: "_log_arrived"})
    met = (
        (F.col("log_path") == F.col("_log_path"))
        & (F.col("_log_arrived") >= F.col(ARRIVED) - F.expr(f"INTERVAL {keep}"))
        & (F.col("_log_arrived") <= F.col(ARRIVED) + F.expr(f"INTERVAL {wait}"))
    )
    return events.join(log, met, "left_outer").drop("_log_arrived")


def triage_arrivals(
    spark: SparkSession,
    events_path: str,
    logs_root: str,
    out: str,
    checkpoint: str,
    cfg: TriageConfig = DEFAULT,
    retention: str = "30 days",
    wait: str = "1 day",
    keep: str = "1 day",
    pattern: str = "*.log",
    depth: int = 1,
    settle: float = 5,
    overlap: float = 0,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
):
    """Start the triage of two streams, events and log files; returns the ``StreamingQuery``.

    ``log_path`` of an event is relative to the folder that holds ``logs_root``
    (``logs/<task>/<run>.log`` for the root ``…/logs``).  ``retention``: how long a key
    is remembered for duplicates (D11); ``wait`` and ``keep``: see :func:`paired`.  A log
    that is written again while its event is in the state gives another record, with
    a later ``modified``.  Time passes with the batches that have rows, so released
    events come out with the first such batch after their time.

    Writes ``root_causes/epoch=<id>`` and ``log_missing/epoch=<id>`` under ``out``; a replayed
    epoch replaces its own output.
    """
    events = dedup_stream(arriving(event_stream(spark, events_path, max_files_per_trigger), retention), EVENT_KEYS)
    tails = read_tails(log_arrivals(spark, logs_root, pattern, depth, settle, overlap), logs_root, cfg.max_lines)
    records = analyze(decoded_logs(tails, cfg.max_lines), cfg=cfg, keep=["modified"])
    joined = paired(events.select(*EVENT_COLUMNS, ARRIVED), arriving(records, "0 seconds"), wait, keep)

    def handle(df: DataFrame, epoch_id: int) -> None:
        df = df.drop(ARRIVED).persist()
        found = df.where(F.col("_log_path").isNotNull()).drop("_log_path")
        missing = df.where(F.col("_log_path").isNull()).select(*EVENT_COLUMNS)
        found.write.mode("overwrite").parquet(os.path.join(out, "root_causes", f"epoch={epoch_id}"))
        missing.write.mode("overwrite").parquet(os.path.join(out, "log_missing", f"epoch={epoch_id}"))
        df.unpersist()

    w = joined.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    # The later of the two watermarks counts: arrival times are never late, and a stream
    # without rows must not hold back the other's state.  A query keeps the settings of its start.
    # Counting the rows of the state for the metrics would look up each row that is put.
    wanted = {"spark.sql.streaming.multipleWatermarkPolicy": "max", "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream_output(spark: SparkSession, out: str) -> DataFrame:
    """All records written by the stream (every epoch), and those of logs that
    landed after the last epoch."""
    records = spark.read.parquet(os.path.join(out, "root_causes"))
    last = _last_epoch(spark, os.path.join(out, "retry"))
    late = os.path.join(out, "late_root_causes", f"epoch={last}")
    if last is None or not _exists(spark, late):
        return records
    return records.unionByName(spark.read.parquet(late).withColumn("epoch", F.lit(last)))
