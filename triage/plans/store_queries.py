"""Registered queries that write a table in the shared checkpoint folder and read
it back: root causes and summaries (A17/A18), events (D1), jobs (C11/C12); and the
schema drift of many tables (C1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as D
from ..operators import repair as R
from ..operators import sinks as S
from ..operators.classify import classify
from ..operators.rootcause import flatten_record
from ..session import new_folder
from ..sources.events import event_stream, read_events, write_events
from ..sources.log_source import write_logs
from ..sources.logs import read_logs
from ..sources.sizes import input_bytes
from ..sources.synth import SYNTH_FAILURE_EVENTS_SQL, duck, synth_failure_events, synth_logs
from ..sources.tables import read_table, table_path
from ..streaming.triage_stream import read_stream_output, triage_arrivals
from .oracle import CLASSIFY_CTES, EVENTS_CTE, FLAT_COLUMNS, LOGS_CTE, with_rc
from .triage_queries import root_causes


def _stored(fmt):
    def q(spark, sf_dir):
        path = new_folder(spark, "root-causes")
        S.write_root_causes(root_causes(spark, sf_dir), path, fmt)
        flat = flatten_record(S.read_root_causes(spark, path, fmt))
        return flat.withColumn("n_evidence", F.col("n_evidence").cast("bigint"))

    return q


def q_stored_summaries(spark, sf_dir):
    """The summaries as JSON lines, read with their schema."""
    path = new_folder(spark, "summaries")
    S.write_summaries(root_causes(spark, sf_dir), path)
    return S.read_summaries(spark, path).select(
        "log_path", "error_type", "error_message", F.array_join("matched_patterns", ",").alias("matched_patterns"),
        F.col("confidence").alias("cls_confidence"),
    )


def _stored_events(spark, sf_dir):
    path = new_folder(spark, "events")
    with_metadata = synth_failure_events(spark, sf_dir).withColumn(
        "metadata", F.create_map(F.lit("event_id"), F.col("event_id").cast("string"), F.lit("dag"), F.col("dag_id"))
    )
    write_events(with_metadata.drop("event_id"), path)
    return read_events(spark, path)


def _scalars(events):
    return events.select(
        "source", "project", "dag_id", "task_id", "run_id", "attempt", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "log_path", "job_file", F.col("metadata")["event_id"].alias("event_id"), F.col("metadata")["dag"].alias("dag"),
        F.col("_corrupt_record").isNotNull().alias("corrupt"), *(["n_copies"] if "n_copies" in events.columns else []),
    )


def q_stored_events(spark, sf_dir):
    """The failure events as JSON lines, read with the event schema."""
    return _scalars(_stored_events(spark, sf_dir))


def q_stored_event_dedup(spark, sf_dir):
    """D11 over all columns of the event schema, the metadata map included."""
    once = D.dedup_events(_stored_events(spark, sf_dir))
    return _scalars(once.withColumn("n_copies", F.col("n_copies").cast("bigint")))


def _written_logs(spark, sf_dir):
    """The logs as files, a quarter of them in one folder; the folder of the logs."""
    path = new_folder(spark, "log-files")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that small logs are not merged into a few tasks
    write_logs(synth_logs(spark, sf_dir).repartition(parts, "log_path"), path)
    return f"{path}/logs"


def q_stored_logs(spark, sf_dir):
    """A1: the logs as files, listed and read in tasks, then classified."""
    read = classify(read_logs(spark, _written_logs(spark, sf_dir)))
    return read.select("log_path", "task_id", F.length("log_text").cast("bigint").alias("n_chars"), "error_type", "error_message", F.col("cls_confidence"))


EVENT_FILE_BYTES = 8 << 20  # of the events table, to a file of derived events


def _streamed_events(spark, sf_dir, path):
    """The failure events with a run each, as JSON files; every third one is sent twice."""
    events = synth_failure_events(spark, sf_dir).withColumn("run_id", F.concat("run_id", F.lit("_"), F.col("event_id").cast("string")))
    events = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    parts = max(4, input_bytes(events) // EVENT_FILE_BYTES)  # of events that share a key, files and their order decide which comes first
    write_events(events.union(events.where("event_id % 3 = 0")).drop("event_id").repartition(parts, "log_path"), path)


def q_stream_dedup(spark, sf_dir):
    """D11 as a stream: each event once, however often it came."""
    path = new_folder(spark, "event-stream")
    _streamed_events(spark, sf_dir, f"{path}/events")
    once = D.dedup_stream(event_stream(spark, f"{path}/events"))
    written = once.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/once")
    written.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/once").select("dag_id", "task_id", "run_id", "attempt", "log_path")


def q_streamed_root_causes(spark, sf_dir):
    """Events and log files as two streams, from the files to the records."""
    path = new_folder(spark, "triage-stream")
    _streamed_events(spark, sf_dir, f"{path}/events")
    triage_arrivals(spark, f"{path}/events", _written_logs(spark, sf_dir), f"{path}/out", f"{path}/checkpoint", settle=0).awaitTermination()
    records = read_stream_output(spark, f"{path}/out")
    return records.select("run_id", "log_path", F.col("classification.error_type").alias("error_type"), "root_cause", "confidence")


def q_catalog_drift(spark, sf_dir):
    """A catalog of (table, column) pairs against a later one; a brand plays the
    table, type and size the column, and parts above size 30 are new."""
    part = read_table(spark, sf_dir, "part")
    pairs = part.select(
        F.col("p_brand").alias("table_name"), F.concat_ws("_", "p_type", "p_size").alias("column_name"), "p_size"
    )
    expected = pairs.where("p_size <= 30").drop("p_size").distinct()
    incoming = pairs.where("p_size > 20").drop("p_size").distinct()
    drift = R.catalog_drift(expected, incoming)
    return drift.select("table_name", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def q_fact_dim_job(spark, sf_dir):
    """C11: orders joined with customer, counted per nation, written and read back."""
    path = new_folder(spark, "fact-dim")
    R.run_fact_dim_job(
        spark, table_path(sf_dir, "orders"), table_path(sf_dir, "customer"), path, "o_custkey", "c_nationkey", dim_on="c_custkey"
    )
    return spark.read.parquet(path)


def q_plan_application(spark, sf_dir):
    """A plan with rename, broadcast and repartition, run on orders and customer."""
    path = new_folder(spark, "plan")
    plan = {"rename_old": "o_custkey", "rename_new": "custkey", "broadcast": True, "repartition": 16}
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    customer = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    R.apply_plan(orders, customer, "custkey", plan, by="c_mktsegment").write.parquet(path)
    return spark.read.parquet(path)


QUERIES = {
    "stored_root_causes": _stored("parquet"),
    "stored_root_causes_json": _stored("json"),
    "stored_summaries": q_stored_summaries,
    "stored_events": q_stored_events,
    "stored_event_dedup": q_stored_event_dedup,
    "stored_logs": q_stored_logs,
    "stream_dedup": q_stream_dedup,
    "streamed_root_causes": q_streamed_root_causes,
    "catalog_drift": q_catalog_drift,
    "fact_dim_job": q_fact_dim_job,
    "plan_application": q_plan_application,
}

EVENTS_SQL = duck(SYNTH_FAILURE_EVENTS_SQL)
_FLAT = with_rc(f"SELECT {FLAT_COLUMNS} FROM flat")

ORACLE = {
    "stored_root_causes": _FLAT,
    "stored_root_causes_json": _FLAT,
    "stored_summaries": f"""WITH {LOGS_CTE},{CLASSIFY_CTES}
SELECT log_path, error_type, error_message, matched_patterns, cls_confidence FROM cls""",
    "stored_events": f"""WITH {EVENTS_CTE}
SELECT source, project, dag_id, task_id, run_id, attempt, timestamp, log_path, job_file,
  CAST(event_id AS VARCHAR) AS event_id, dag_id AS dag, false AS corrupt
FROM fevents""",
    "stored_event_dedup": f"""WITH {EVENTS_CTE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dag_id, task_id, run_id, attempt ORDER BY timestamp, log_path) AS r,
    count(*) OVER (PARTITION BY dag_id, task_id, run_id, attempt) AS n_copies
  FROM fevents)
SELECT source, project, dag_id, task_id, run_id, attempt, timestamp, log_path, job_file,
  CAST(event_id AS VARCHAR) AS event_id, dag_id AS dag, false AS corrupt, CAST(n_copies AS BIGINT) AS n_copies
FROM ranked WHERE r = 1""",
    "stored_logs": f"""WITH {LOGS_CTE},{CLASSIFY_CTES}
SELECT c.log_path, l.task_id, CAST(length(l.log_text) AS BIGINT) AS n_chars, c.error_type, c.error_message, c.cls_confidence
FROM cls c JOIN logs l ON l.log_path = c.log_path""",
    "stream_dedup": f"""WITH {EVENTS_CTE}
SELECT dag_id, task_id, run_id || '_' || CAST(event_id AS VARCHAR) AS run_id, attempt, log_path FROM fevents""",
    "streamed_root_causes": with_rc(f"""SELECT e.run_id || '_' || CAST(e.event_id AS VARCHAR) AS run_id, rc.log_path, rc.error_type, rc.root_cause, rc.confidence
FROM rc JOIN ({EVENTS_SQL}) e ON e.log_path = rc.log_path"""),
    "catalog_drift": """WITH e AS (SELECT DISTINCT p_brand, p_type || '_' || p_size AS c FROM part WHERE p_size <= 30),
i AS (SELECT DISTINCT p_brand, p_type || '_' || p_size AS c FROM part WHERE p_size > 20)
SELECT coalesce(e.p_brand, i.p_brand) AS table_name,
  coalesce(string_agg(CASE WHEN i.c IS NULL THEN e.c END, ',' ORDER BY e.c), '') AS missing,
  coalesce(string_agg(CASE WHEN e.c IS NULL THEN i.c END, ',' ORDER BY i.c), '') AS extra
FROM e FULL OUTER JOIN i ON e.p_brand = i.p_brand AND e.c = i.c GROUP BY 1""",
    "fact_dim_job": """SELECT c_nationkey, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_nationkey""",
    "plan_application": """SELECT c_mktsegment, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment""",
}
