"""Registered event and reporting queries (family D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as D
from ..operators.classify import parse_logs
from ..operators.rootcause import RECORD_FIELDS
from ..sources.synth import job_catalog, synth_failure_events, synth_logs
from . import fix_plans as B
from .oracle import CATALOG_CTE, EVENTS_CTE, LOGS_CTE, PLAN_CTES, RCA_CTES, _q
from .triage_queries import ACTIONS, RENAMES, root_causes
from .. import config as C


def _events(spark, sf_dir):
    return synth_failure_events(spark, sf_dir)


def q_event_resolution(spark, sf_dir):
    logs = synth_logs(spark, sf_dir).select("log_path")
    return D.resolve(_events(spark, sf_dir), logs).select("event_id", "log_path", "ok", "reason")


def q_orphan_events(spark, sf_dir):
    logs = synth_logs(spark, sf_dir).select("log_path")
    return D.orphan_events(_events(spark, sf_dir), logs).select("event_id", "log_path")


def q_job_inference(spark, sf_dir):
    return D.infer_job(_events(spark, sf_dir), job_catalog(spark, sf_dir)).select("event_id", "job_path", "note")


def _plan_state(spark, sf_dir):
    p = B.plan_fixes(root_causes(spark, sf_dir, ACTIONS + RENAMES), "local")
    empty = ~F.col("broadcast") & F.col("repartition").isNull() & F.col("rename_old").isNull()
    return p.select("log_path", empty.alias("plan_empty"))


def q_event_outcomes(spark, sf_dir):
    ev = D.resolve(_events(spark, sf_dir), _plan_state(spark, sf_dir))
    ev = D.infer_job(ev, job_catalog(spark, sf_dir))
    return ev.select(
        "event_id", D.outcome(F.col("ok"), F.col("job_path"), F.coalesce(F.col("plan_empty"), F.lit(True))).alias("outcome")
    )


def q_latest_logs(spark, sf_dir):
    return D.latest_logs(synth_logs(spark, sf_dir))


def q_log_index(spark, sf_dir):
    return D.log_index(synth_logs(spark, sf_dir)).withColumn("n_logs", F.col("n_logs").cast("bigint"))


def q_log_listing(spark, sf_dir):
    return D.log_listing(synth_logs(spark, sf_dir))


def q_log_view(spark, sf_dir):
    parsed = parse_logs(synth_logs(spark, sf_dir))
    stored = B.gate(root_causes(spark, sf_dir)).drop("task_id", "event_id")
    v = D.log_view(parsed, stored)
    return v.select(
        "log_path",
        F.get_json_object("summary_json", "$.error_type").alias("error_type"),
        F.length("sample_excerpt").cast("bigint").alias("excerpt_chars"),
        F.col("root_cause_json").isNotNull().alias("has_root_cause"),
        F.get_json_object("root_cause_json", "$.confidence").cast("double").alias("rc_confidence"),
    )


def q_reports(spark, sf_dir):
    return D.render_report(root_causes(spark, sf_dir, [f for f in RECORD_FIELDS if f not in ("detected_at", "classification")]))


def q_alerts(spark, sf_dir):
    return D.alerts(root_causes(spark, sf_dir, ["detected_at", "root_cause", "evidence", *ACTIONS, "confidence", "remediation_hint"])).drop("timestamp")


def q_event_dedup(spark, sf_dir):
    ev = _events(spark, sf_dir).select("dag_id", "task_id", "run_id", "attempt", "timestamp", "log_path")
    return D.dedup_events(ev).withColumn("n_copies", F.col("n_copies").cast("bigint"))


def q_last_attempt(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return D.last_attempt(ev).withColumn("n_events", F.col("n_events").cast("bigint"))


QUERIES = {
    "event_resolution": q_event_resolution,
    "orphan_events": q_orphan_events,
    "job_inference": q_job_inference,
    "event_outcomes": q_event_outcomes,
    "latest_logs": q_latest_logs,
    "log_index": q_log_index,
    "log_listing": q_log_listing,
    "log_view": q_log_view,
    "reports": q_reports,
    "alerts": q_alerts,
    "event_dedup": q_event_dedup,
    "last_attempt": q_last_attempt,
}

_W = f"WITH {LOGS_CTE}, {EVENTS_CTE}, {CATALOG_CTE}"
_WRC = f"WITH {LOGS_CTE}, {EVENTS_CTE}, {CATALOG_CTE}, {RCA_CTES}{PLAN_CTES}"

_DIAG = """list_filter([
  CASE WHEN miss_cols IS NOT NULL THEN 'missing_columns: ' || array_to_string(miss_cols, ', ') END,
  CASE WHEN extra_cols IS NOT NULL THEN 'extra_columns: ' || array_to_string(extra_cols, ', ') END,
  CASE WHEN instance_hint IS NOT NULL THEN 'instance_hint: ' || instance_hint END,
  CASE WHEN shuffle_bytes IS NOT NULL THEN 'shuffle_bytes: ' || CAST(shuffle_bytes AS VARCHAR) END,
  CASE WHEN skew_ratio IS NOT NULL THEN 'skew_ratio: ' || CAST(skew_ratio AS VARCHAR) END,
  CASE WHEN hotkey_count IS NOT NULL THEN 'hotkey_count: ' || CAST(hotkey_count AS VARCHAR) END,
  CASE WHEN total_records IS NOT NULL THEN 'total_records: ' || CAST(total_records AS VARCHAR) END,
  CASE WHEN missing_path IS NOT NULL THEN 'missing_path: ' || missing_path END], lambda x: x IS NOT NULL)"""


def _bul(x):
    return f"array_to_string(list_transform({x}, lambda b: '- ' || b), chr(10))"


ORACLE = {
    "event_resolution": f"""{_W}
SELECT e.event_id, e.log_path, l.log_path IS NOT NULL AS ok,
  CASE WHEN l.log_path IS NULL THEN {_q(C.LOG_NOT_FOUND)} || coalesce(e.log_path, 'None') END AS reason
FROM fevents e LEFT JOIN (SELECT DISTINCT log_path FROM logs) l ON e.log_path = l.log_path""",
    "orphan_events": f"""{_W}
SELECT event_id, log_path FROM fevents WHERE log_path NOT IN (SELECT log_path FROM logs)""",
    "job_inference": f"""{_W}
SELECT event_id, job_path, CASE WHEN job_path IS NULL THEN {_q(C.NO_JOB_FILE)} END AS note FROM (
  SELECT e.event_id, coalesce(nullif(e.job_file, ''), c.job_path) AS job_path
  FROM fevents e LEFT JOIN catalog c ON c.job_path = {_q(C.JOB_DIR)} || coalesce(e.task_id, 'None') || '.py')""",
    "event_outcomes": f"""{_WRC},
ps AS (
  SELECT log_path,
    NOT (len(list_filter(action_list, lambda x: contains(lower(x), 'broadcast'))) > 0)
    AND NOT list_has_any(action_list, ['repartition', 'salting'])
    AND NOT (len(miss_cols) > 0 AND len(extra_cols) > 0) IS TRUE AS plan_empty
  FROM rc)
SELECT e.event_id,
  CASE WHEN ps.log_path IS NULL THEN 'log_missing'
       WHEN coalesce(nullif(e.job_file, ''), c.job_path) IS NULL THEN 'rca_only'
       WHEN coalesce(ps.plan_empty, true) THEN 'plan_empty' ELSE 'plan_ready' END AS outcome
FROM fevents e LEFT JOIN ps ON e.log_path = ps.log_path
LEFT JOIN catalog c ON c.job_path = {_q(C.JOB_DIR)} || coalesce(e.task_id, 'None') || '.py'""",
    "latest_logs": f"{_W}\nSELECT task_id, max(log_path) AS log_path FROM logs GROUP BY task_id",
    "log_index": f"""{_W}
SELECT task_id, count(*) AS n_logs, min(log_path) AS first_log, max(log_path) AS latest_log FROM logs GROUP BY task_id""",
    "log_listing": f"{_W}\nSELECT task_id, log_path FROM logs",
    "log_view": f"""{_WRC}
SELECT f.log_path, f.error_type, CAST(length(substr(f.t, 1, {C.EXCERPT_CHARS})) AS BIGINT) AS excerpt_chars,
  g.log_path IS NOT NULL AS has_root_cause, g.confidence AS rc_confidence
FROM cls f LEFT JOIN (SELECT log_path, confidence FROM rc WHERE confidence >= {C.CONFIDENCE_GATE}) g
  ON f.log_path = g.log_path""",
    "reports": f"""{_WRC}
SELECT log_path,
  '## Root cause' || chr(10) || root_cause
  || chr(10) || chr(10) || '### Suggested actions' || chr(10) || {_bul('action_list')}
  || chr(10) || chr(10) || '### Evidence' || chr(10) || {_bul('ev')}
  || chr(10) || chr(10) || '### Diagnostics' || chr(10)
  || CASE WHEN len({_DIAG}) > 0 THEN {_bul(_DIAG)} ELSE '(none)' END
  || chr(10) || chr(10) || '### Confidence' || chr(10) || CAST(confidence AS VARCHAR)
  || chr(10) || chr(10) || '### Remediation' || chr(10) || remediation_hint AS report
FROM rc""",
    "alerts": f"""{_WRC}
SELECT log_path, CASE WHEN confidence >= {C.CONFIDENCE_GATE} THEN 'high' ELSE 'low' END AS severity,
  root_cause AS summary, ev[1] AS rca_snippet, remediation_hint AS action
FROM rc WHERE list_has_any(action_list, ['data_provider_alert', 'alert'])""",
    "event_dedup": f"""{_W}
SELECT dag_id, task_id, run_id, attempt, min(timestamp) AS timestamp,
  arg_min(log_path, (timestamp, log_path)) AS log_path, CAST(count(*) AS BIGINT) AS n_copies
FROM fevents GROUP BY dag_id, task_id, run_id, attempt""",
    "last_attempt": f"""{_W}
SELECT dag_id, task_id, run_id, max(attempt) AS last_attempt,
  arg_max(timestamp, (attempt, timestamp, log_path)) AS last_timestamp,
  arg_max(log_path, (attempt, timestamp, log_path)) AS last_log_path,
  CAST(count(*) AS BIGINT) AS n_events
FROM fevents GROUP BY dag_id, task_id, run_id""",
}
