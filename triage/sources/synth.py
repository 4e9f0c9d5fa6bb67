"""Failure logs and failure events derived from the ``events`` table.

The supplied tables hold no failure text, so test logs are derived from
``events`` rows with ``event_type = 'error'`` by one SQL expression that Spark
SQL and DuckDB evaluate identically; the same string feeds both engines, which
makes it the shared fixture of the correctness oracle.  The work grows with
``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table_path

# One log per error event; nine text shapes chosen by event_id % 10.
SYNTH_LOGS_SQL = """
SELECT event_id, ts, user_id,
  'task_' || CAST(user_id % 5 AS STRING) AS task_id,
  'logs/task_' || CAST(user_id % 5 AS STRING) || '/run_' || CAST(event_id AS STRING) || '.log' AS log_path,
  CASE event_id % 10
    WHEN 0 THEN 'Job failed: SchemaMismatchError: missing columns: [''amount'', ''ts'']; extra columns: [''amt'']'
    WHEN 1 THEN 'Starting heavy operation' || chr(10) || 'ERROR: executor_' || CAST(user_id AS STRING)
             || ' java.lang.OutOfMemoryError: Java heap space' || chr(10)
             || 'INFO: shuffle_bytes=' || CAST(event_id * 1000000 AS STRING)
    WHEN 2 THEN 'INFO: total_records=1000, hotkey_count=' || CAST(event_id % 1000 AS STRING) || chr(10)
             || 'WARN: PerformanceAlert: key skew detected'
    WHEN 3 THEN 'WARN: PerformanceAlert: skew_ratio=0.' || CAST(event_id % 100 AS STRING) || chr(10)
             || 'INFO: Estimated shuffle_bytes ~ ' || CAST(event_id * 1000000 AS STRING)
    WHEN 4 THEN 'java.io.FileNotFoundException: /data/in/part-' || CAST(event_id AS STRING) || '.parquet'
    WHEN 5 THEN 'AccessDenied: permission denied for user'
    WHEN 6 THEN 'WARN: Full GC (Allocation Failure)'
    WHEN 7 THEN 'ERROR: GC overhead limit exceeded on driver'
    WHEN 8 THEN 'all steps finished, exit code 3'
    ELSE 'step 1 ok' || chr(10) || 'step 2 ok' || chr(10) || 'step 3 ok' || chr(10)
      || 'ValueError: bad row' || chr(10) || 'retry' || chr(10) || 'stop' || chr(10) || 'exit 1'
  END AS log_text
FROM {events} WHERE event_type = 'error'
"""

# Every events row as a failure notification of a task run.  Logs exist only for
# error rows, so the other rows exercise the "log missing" path.  A run is one
# (user, day); its attempts are numbered by time.  Rows of a user's job 3 carry
# an explicit job file, the others rely on inference.
SYNTH_FAILURE_EVENTS_SQL = """
SELECT event_id,
  'scheduler' AS source,
  'triage-test' AS project,
  'dag_' || CAST(user_id % 3 AS STRING) AS dag_id,
  'task_' || CAST(user_id % 5 AS STRING) AS task_id,
  'run_' || CAST(user_id AS STRING) || '_' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
  CAST(event_id % 4 + 1 AS INT) AS attempt,
  ts AS timestamp,
  'logs/task_' || CAST(user_id % 5 AS STRING) || '/run_' || CAST(event_id AS STRING) || '.log' AS log_path,
  CASE WHEN user_id % 7 = 3 THEN 'jobs/custom_' || CAST(user_id % 5 AS STRING) || '.py' END AS job_file
FROM {events}
"""

# Job files present in the deployment (a dimension: one row per task that has one).
JOB_CATALOG_SQL = """
SELECT DISTINCT 'pipeline/jobs/task_' || CAST(user_id % 5 AS STRING) || '.py' AS job_path
FROM {events} WHERE user_id % 5 IN (0, 1, 2)
"""


def _events_ref(sf_dir: str) -> str:
    return "parquet.`" + table_path(sf_dir, "events") + "`"


def synth_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, user_id, task_id, log_path, log_text`` — one row per error event."""
    return spark.sql(SYNTH_LOGS_SQL.format(events=_events_ref(sf_dir)))


def synth_failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SYNTH_FAILURE_EVENTS_SQL.format(events=_events_ref(sf_dir)))


def job_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOB_CATALOG_SQL.format(events=_events_ref(sf_dir)))


def duck(sql: str) -> str:
    """The DuckDB form of a fixture query (reads the registered ``events`` view)."""
    return sql.format(events="events")
