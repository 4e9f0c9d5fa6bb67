"""Registered run-metric queries (family E), over task rows derived from ``lineitem``.

The supplied tables hold no Spark event logs, so finished tasks are derived from
order lines by one SQL string that Spark and DuckDB both run: twenty
applications of seven stages, with retries, stragglers, failures and
out-of-memory texts.  The work grows with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import runmetrics as E
from ..session import new_folder
from ..sources.log_source import write_rolls
from ..sources.tables import read_table

TASKS_SQL = """
SELECT concat('app-', CAST(l_suppkey % 20 AS STRING)) AS app_id,
  CAST(l_orderkey % 7 AS INT) AS stage_id,
  CAST(CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 97 = 0 THEN 1 ELSE 0 END AS INT) AS stage_attempt,
  CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS task_id,
  CAST(100 + l_partkey % 50 + CASE WHEN l_partkey % 101 = 0 THEN 5000 ELSE 0 END AS BIGINT) AS duration_ms,
  (l_partkey % 53 = 0) AS failed,
  CASE WHEN l_partkey % 53 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'ExceptionFailure' ELSE 'ExecutorLostFailure' END ELSE 'Success' END AS reason,
  CASE WHEN l_partkey % 106 = 0 THEN 'java.lang.OutOfMemoryError: Java heap space'
       WHEN l_partkey % 53 = 0 THEN 'java.io.IOException: closed' ELSE '' END AS failure_text,
  CAST(CASE WHEN l_suppkey % 4 = 0 THEN l_partkey % 5 ELSE 0 END AS BIGINT) AS memory_spilled,
  CAST(0 AS BIGINT) AS disk_spilled,
  CAST(CASE WHEN l_orderkey % 7 = 0 AND l_partkey % 89 = 0 THEN 900000 ELSE 1000 + l_partkey % 100 END AS BIGINT) AS shuffle_read,
  CAST(l_partkey % 1000 * 20000 AS BIGINT) AS shuffle_written
FROM lineitem
"""

#: Shuffle bytes a stage of the derived tasks has to write to count as blown up.
BLOWN = 4_300_000_000

RECORDS_SQL = """
SELECT DISTINCT app_id,
  CASE stage_id WHEN 0 THEN 'Skew' WHEN 1 THEN 'OOM' WHEN 2 THEN 'GC' ELSE 'Other' END AS error_type,
  CASE stage_id WHEN 0 THEN 'broadcast_or_repartition' WHEN 3 THEN 'optimize_join' ELSE 'monitor' END AS action
FROM tasks WHERE stage_id < 5
"""


def _tasks(spark, sf_dir):
    return spark.sql(TASKS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read_table(spark, sf_dir, "lineitem"))


def q_stage_retries(spark, sf_dir):
    return E.stage_retries(_tasks(spark, sf_dir))


def q_task_failures(spark, sf_dir):
    return E.task_failures(_tasks(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


def q_stragglers(spark, sf_dir):
    return E.stragglers(_tasks(spark, sf_dir)).select("app_id", "stage_id", "task_id", "duration_ms", "median_ms")


def q_stage_skew(spark, sf_dir):
    return E.stage_skew(_tasks(spark, sf_dir))


def q_oom_signals(spark, sf_dir):
    return E.oom_signals(_tasks(spark, sf_dir)).select("app_id", "stage_id", "task_id", "reason")


def q_shuffle_blowups(spark, sf_dir):
    return E.shuffle_blowups(_tasks(spark, sf_dir), BLOWN)


def q_confirm(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    records = spark.sql(RECORDS_SQL.replace("FROM tasks", "FROM {tasks}"), tasks=tasks)
    records = records.select("app_id", F.struct("error_type").alias("classification"), F.array("action").alias("suggested_action_types"))
    found = E.confirm(records, tasks, skew_factor=1.5)
    return found.select("app_id", F.col("classification.error_type").alias("error_type"), F.get("suggested_action_types", F.lit(0)).alias("action"), "oom_tasks", "spilled", "skewed", "shuffle_blowup", "confirmed")


LINES = 1_000  # events in a file of a derived log, about


def _event_log(spark, sf_dir):
    """The derived tasks and their stage attempts as rolling event logs; their folder."""
    tasks = _tasks(spark, sf_dir)
    task = F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"), F.col("stage_id").alias("Stage ID"), F.col("stage_attempt").alias("Stage Attempt ID"),
        F.struct(F.col("reason").alias("Reason"), F.col("failure_text").alias("Description")).alias("Task End Reason"),
        F.struct(F.col("task_id").alias("Task ID"), F.lit(1_000).cast("long").alias("Launch Time"), (F.col("duration_ms") + 1_000).alias("Finish Time"), F.col("failed").alias("Failed")).alias("Task Info"),
        F.struct(
            F.col("memory_spilled").alias("Memory Bytes Spilled"), F.col("disk_spilled").alias("Disk Bytes Spilled"),
            F.struct(F.col("shuffle_read").alias("Remote Bytes Read"), F.lit(0).alias("Local Bytes Read")).alias("Shuffle Read Metrics"),
            F.struct(F.col("shuffle_written").alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
        ).alias("Task Metrics"),
    )
    stages = tasks.groupBy("app_id", "stage_id", "stage_attempt").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("bad"))
    stage = F.struct(
        F.lit("SparkListenerStageCompleted").alias("Event"),
        F.struct(
            F.col("stage_id").alias("Stage ID"), F.col("stage_attempt").alias("Stage Attempt ID"), F.col("n").alias("Number of Tasks"),
            F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" tasks failed"))).alias("Failure Reason"),
        ).alias("Stage Info"),
    )
    # in order: a repeated task writes the same files
    ended = stages.sortWithinPartitions("app_id", "stage_id", "stage_attempt").select("app_id", F.to_json(stage).alias("line"))
    folder = new_folder(spark, "event-logs")
    write_rolls(tasks.select("app_id", F.to_json(task).alias("line")).union(ended), folder, LINES)
    return folder


def q_stored_run_log(spark, sf_dir):
    """Event logs as files, read back as tasks."""
    tasks = E.read_run_log(spark, _event_log(spark, sf_dir))
    return tasks.select("app_id", "stage_id", "stage_attempt", "task_id", "duration_ms", "failed", "reason", "failure_text", "memory_spilled", "shuffle_read", "shuffle_written")


def q_stored_stage_log(spark, sf_dir):
    """The same logs, read back as stage attempts."""
    stages = E.read_stage_log(spark, _event_log(spark, sf_dir))
    return stages.select("app_id", "stage_id", "stage_attempt", "n_tasks", "failure")


QUERIES = {
    "stored_run_log": q_stored_run_log,
    "stored_stage_log": q_stored_stage_log,
    "stage_retries": q_stage_retries,
    "task_failures": q_task_failures,
    "stragglers": q_stragglers,
    "stage_skew": q_stage_skew,
    "oom_signals": q_oom_signals,
    "shuffle_blowups": q_shuffle_blowups,
    "confirm": q_confirm,
}

_T = f"WITH tasks AS ({TASKS_SQL})"

ORACLE = {
    "stored_run_log": f"""{_T} SELECT app_id, CAST(stage_id AS BIGINT) AS stage_id, CAST(stage_attempt AS BIGINT) AS stage_attempt, task_id, duration_ms, failed, reason,
  failure_text, memory_spilled, shuffle_read, shuffle_written FROM tasks""",
    "stored_stage_log": f"""{_T} SELECT app_id, CAST(stage_id AS BIGINT) AS stage_id, CAST(stage_attempt AS BIGINT) AS stage_attempt, count(*) AS n_tasks,
  CASE WHEN count(*) FILTER (failed) > 0 THEN CAST(count(*) FILTER (failed) AS VARCHAR) || ' tasks failed' END AS failure FROM tasks GROUP BY 1, 2, 3""",
    "stage_retries": f"{_T} SELECT app_id, stage_id, max(stage_attempt) AS max_attempt FROM tasks GROUP BY 1, 2 HAVING max(stage_attempt) > 0",
    "task_failures": f"""{_T} SELECT app_id, stage_id, count(*) AS failed_tasks, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons
FROM tasks WHERE failed GROUP BY 1, 2""",
    "stragglers": f"""{_T} SELECT app_id, stage_id, task_id, duration_ms, median_ms FROM tasks
JOIN (SELECT app_id, stage_id, quantile_cont(duration_ms, 0.5) AS median_ms FROM tasks GROUP BY 1, 2) USING (app_id, stage_id)
WHERE duration_ms > median_ms * 2.0""",
    "stage_skew": f"""{_T} SELECT app_id, stage_id, CAST(sum(shuffle_read) AS BIGINT) AS total_read, max(shuffle_read) AS max_read, count(*) AS tasks,
  round(max(shuffle_read) / CAST(nullif(sum(shuffle_read), 0) AS DOUBLE), 4) AS skew_ratio FROM tasks GROUP BY 1, 2""",
    "oom_signals": f"{_T} SELECT app_id, stage_id, task_id, reason FROM tasks WHERE failed AND failure_text LIKE '%OutOfMemoryError%'",
    "shuffle_blowups": f"""{_T} SELECT app_id, stage_id, CAST(sum(shuffle_written) AS BIGINT) AS shuffle_written
FROM tasks GROUP BY 1, 2 HAVING sum(shuffle_written) > {BLOWN}""",
    "confirm": f"""{_T}, records AS ({RECORDS_SQL}),
stages AS (SELECT app_id, stage_id, max(shuffle_read) / nullif(avg(shuffle_read), 0) AS skew, sum(shuffle_written) AS written FROM tasks GROUP BY 1, 2),
apps AS (SELECT app_id, coalesce(max(skew) >= 1.5, false) AS skewed, max(written) > {C.SHUFFLE_BYTES_HIGH} AS shuffle_blowup FROM stages GROUP BY 1),
fails AS (SELECT app_id, count(*) FILTER (failed AND failure_text LIKE '%OutOfMemoryError%') AS oom_tasks,
  CAST(sum(memory_spilled + disk_spilled) AS BIGINT) AS spilled FROM tasks GROUP BY 1)
SELECT app_id, error_type, action, oom_tasks, spilled, skewed, shuffle_blowup,
  coalesce(CASE WHEN error_type = 'Skew' THEN skewed OR blown WHEN error_type IN ('OOM', 'GC') THEN oom_tasks > 0 OR spilled > 0 OR blown ELSE blown END, false) AS confirmed
FROM (SELECT *, action IN ('optimize_join', 'broadcast_or_repartition') AND shuffle_blowup AS blown
  FROM records LEFT JOIN apps USING (app_id) LEFT JOIN fails USING (app_id))""",
}
