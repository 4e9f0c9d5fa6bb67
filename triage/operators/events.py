"""D2–D9, D11–D12 — failure events, their logs, outcomes and reporting tables.

Joins between events and logs are key equi-joins on ``log_path`` that Spark
plans as shuffle joins (AQE splits a skewed path); the job catalog is a
dimension joined after a size check.  "Latest"/"last" selections are
aggregates over structs (partial aggregation, deterministic ties), never
windows over a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .repair import auto_join

EVENT_KEYS = ["dag_id", "task_id", "run_id", "attempt"]
RUN_KEYS = ["dag_id", "task_id", "run_id"]
ARRIVED = "_arrived"


def resolve(events: DataFrame, logs: DataFrame) -> DataFrame:
    """``ok`` and ``reason`` per event — the log must exist.

    ``logs`` needs ``log_path``; its other columns (e.g. analysis results) are
    carried to the matching events.  An absent path prints as ``None``.
    """
    present = logs.dropDuplicates(["log_path"]).withColumn("_log_found", F.lit(True))  # an event meets one log
    j = events.join(present, "log_path", "left")
    ok = F.coalesce(F.col("_log_found"), F.lit(False))
    return j.select(
        "*",
        ok.alias("ok"),
        F.when(~ok, F.concat(F.lit(C.LOG_NOT_FOUND), F.coalesce(F.col("log_path"), F.lit("None")))).alias("reason"),
    ).drop("_log_found")


def orphan_events(events: DataFrame, logs: DataFrame) -> DataFrame:
    """Events whose log does not exist (``left_anti``)."""
    return events.join(logs.select("log_path"), "log_path", "left_anti")


def infer_job(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """D3: ``job_path`` — the event's own ``job_file`` if non-empty, else
    ``pipeline/jobs/<task_id>.py`` when the catalog holds it; ``note`` says why
    there is nothing to patch otherwise."""
    cand = F.concat(F.lit(C.JOB_DIR), F.coalesce(F.col("task_id"), F.lit("None")), F.lit(".py"))
    e = events.withColumn("_candidate", cand)
    cat = catalog.select(F.col("job_path").alias("_candidate")).distinct().withColumn("_in_catalog", F.lit(True))
    j = auto_join(e, cat, "_candidate", "left")
    given = F.nullif(F.col("job_file"), F.lit(""))
    job = F.coalesce(given, F.when(F.col("_in_catalog"), F.col("_candidate")))
    return j.select("*", job.alias("job_path")).withColumn(
        "note", F.when(F.col("job_path").isNull(), F.lit(C.NO_JOB_FILE))
    ).drop("_candidate", "_in_catalog")


def outcome(ok: Column, job_path: Column, plan_empty: Column) -> Column:
    """``log_missing`` / ``rca_only`` / ``plan_empty`` / ``plan_ready``."""
    return (
        F.when(~ok, F.lit("log_missing"))
        .when(job_path.isNull(), F.lit("rca_only"))
        .when(plan_empty, F.lit("plan_empty"))
        .otherwise(F.lit("plan_ready"))
    )


def latest_logs(logs: DataFrame, key: str = "task_id") -> DataFrame:
    """The lexicographically last ``log_path`` per task."""
    return logs.groupBy(key).agg(F.max("log_path").alias("log_path"))


def log_index(logs: DataFrame, key: str = "task_id") -> DataFrame:
    """D6 summary: logs per task with first and latest path (partial aggregates)."""
    return logs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_logs"),
        F.min("log_path").alias("first_log"),
        F.max("log_path").alias("latest_log"),
    )


def log_listing(logs: DataFrame, key: str = "task_id") -> DataFrame:
    """D6 listing: ``(task, log_path)`` in sorted order.  A global range-partitioned
    sort, so one task with a third of the logs is split across partitions."""
    return logs.select(key, "log_path").orderBy(key, "log_path")


def log_view(parsed: DataFrame, stored_rc: DataFrame) -> DataFrame:
    """Summary + excerpt + the stored root cause (JSON) if any."""
    rc = stored_rc.select("log_path", F.to_json(F.struct(*[c for c in stored_rc.columns])).alias("root_cause_json"))
    return parsed.join(rc, "log_path", "left").select(
        "log_path",
        F.to_json("summary").alias("summary_json"),
        "sample_excerpt",
        "root_cause_json",
    )


def _bullets(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: F.concat(F.lit("- "), x)), "\n")


def render_report(rc: DataFrame) -> DataFrame:
    """One markdown report per record (cause, actions, evidence,
    diagnostics, confidence; confidence defaults to 0.75)."""
    d = F.col("diagnostics")
    diag_lines = F.filter(
        F.array(
            F.when(d["missing_columns"].isNotNull(), F.concat(F.lit("missing_columns: "), F.array_join(d["missing_columns"], ", "))),
            F.when(d["extra_columns"].isNotNull(), F.concat(F.lit("extra_columns: "), F.array_join(d["extra_columns"], ", "))),
            F.when(d["instance_hint"].isNotNull(), F.concat(F.lit("instance_hint: "), d["instance_hint"])),
            F.when(d["shuffle_bytes"].isNotNull(), F.concat(F.lit("shuffle_bytes: "), d["shuffle_bytes"].cast("string"))),
            F.when(d["skew_ratio"].isNotNull(), F.concat(F.lit("skew_ratio: "), d["skew_ratio"].cast("string"))),
            F.when(d["hotkey_count"].isNotNull(), F.concat(F.lit("hotkey_count: "), d["hotkey_count"].cast("string"))),
            F.when(d["total_records"].isNotNull(), F.concat(F.lit("total_records: "), d["total_records"].cast("string"))),
            F.when(d["missing_path"].isNotNull(), F.concat(F.lit("missing_path: "), d["missing_path"])),
        ),
        lambda x: x.isNotNull(),
    )
    conf = F.coalesce(F.col("confidence"), F.lit(C.DEFAULT_REPORT_CONFIDENCE)).cast("string")
    report = F.concat(
        F.lit("## Root cause\n"), F.col("root_cause"),
        F.lit("\n\n### Suggested actions\n"), _bullets(F.col("suggested_action_types")),
        F.lit("\n\n### Evidence\n"), _bullets(F.col("evidence")),
        F.lit("\n\n### Diagnostics\n"), F.when(F.size(diag_lines) > 0, _bullets(diag_lines)).otherwise(F.lit("(none)")),
        F.lit("\n\n### Confidence\n"), conf,
        F.lit("\n\n### Remediation\n"), F.col("remediation_hint"),
    )
    return rc.select("log_path", report.alias("report"))


def alerts(rc: DataFrame, threshold: float = C.CONFIDENCE_GATE) -> DataFrame:
    """One alert row per record routed to notification (actions
    ``data_provider_alert`` or ``alert``); severity ``high`` at or above the
    confidence gate, else ``low``.  The sink is a table."""
    routed = rc.where(F.exists("suggested_action_types", lambda a: a.isin("data_provider_alert", "alert")))
    return routed.select(
        "log_path",
        F.when(F.col("confidence") >= threshold, F.lit("high")).otherwise(F.lit("low")).alias("severity"),
        F.col("root_cause").alias("summary"),
        F.get(F.col("evidence"), 0).alias("rca_snippet"),
        F.col("remediation_hint").alias("action"),
        F.col("detected_at").alias("timestamp"),
    )


def dedup_events(events: DataFrame, keys: list[str] = EVENT_KEYS) -> DataFrame:
    """D11 (batch): one row per ``(dag_id, task_id, run_id, attempt)`` — the
    earliest by ``timestamp`` (ties: smallest ``log_path``, then the other
    columns; maps are compared by their sorted entries)."""
    others = [c for c in events.columns if c not in keys]
    order = ["timestamp", "log_path"] + [c for c in others if c not in ("timestamp", "log_path")]
    maps = {c for c, kind in events.dtypes if kind.startswith("map")}
    by = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in order]
    best = F.min_by(F.struct(*[F.col(c) for c in order]), F.struct(*by)).alias("_b")
    return events.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("n_copies")).select(
        *keys, *[F.col(f"_b.{c}").alias(c) for c in order], "n_copies"
    )


def arriving(stream: DataFrame, retention: str) -> DataFrame:
    """``stream`` with the time of its batch as ``_arrived``, the watermark's column.

    Arrival times only grow, so no row is late by this watermark, however old its own
    time is; it only tells for how long state is kept.
    """
    return stream.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, retention)


def dedup_stream(events: DataFrame, keys: list[str] = EVENT_KEYS, retention: str = "30 days") -> DataFrame:
    """D11 (stream): one event for each key; late events of new keys are kept.

    A key is remembered for ``retention`` after its event arrived and then leaves the
    state, so the state holds the keys of that time; a copy that comes later still
    counts as new.
    """
    timed = events if ARRIVED in events.columns else arriving(events, retention)
    once = timed.dropDuplicatesWithinWatermark(keys)
    return once if ARRIVED in events.columns else once.drop(ARRIVED)


def last_attempt(events: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Per run, the highest attempt (ties: latest timestamp, then largest
    path) and the number of event rows."""
    best = F.max(F.struct("attempt", "timestamp", "log_path")).alias("_b")
    return events.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("n_events")).select(
        *keys,
        F.col("_b.attempt").alias("last_attempt"),
        F.col("_b.timestamp").alias("last_timestamp"),
        F.col("_b.log_path").alias("last_log_path"),
        "n_events",
    )
