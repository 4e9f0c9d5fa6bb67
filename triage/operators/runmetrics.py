"""E0–E7 — run metrics from Spark event-log files (JSON lines).

A log mixes events of many types.  Each line is parsed once to a VARIANT, and the
fields of tasks, stages and jobs are taken from it by path, whatever else an event
or a later Spark version has.  All metrics are aggregates per (application, stage)
with partial aggregation; the straggler median is exact, by selection in histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import ci

TASK_END, STAGE_DONE, JOB_START, JOB_END = (f"SparkListener{name}" for name in ("TaskEnd", "StageCompleted", "JobStart", "JobEnd"))


def read_run_events(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """``app_id, event, body`` (VARIANT) of single-file and rolling event logs below
    ``path``; ``kinds`` keeps events of those types, before they are parsed.

    ``app_id`` comes from the folder ``eventlog_v2_<id>`` or the file's name,
    without attempt, codec and ``.inprogress``.  Lines that are no JSON are left out.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    event = F.regexp_extract(F.substring("value", 1, 200), r'^\s*\{\s*"Event"\s*:\s*"([^"]+)"', 1)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(\.(zstd|zst|lz4|lzf|snappy))?(\.inprogress)?$", "")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"eventlog_v2_([^/]+)/[^/]+$", 1)
    app_id = F.regexp_replace(F.when(folder != "", folder).otherwise(name), r"^(application_\d+_\d+)_\d+$", "$1")
    named = lines.select(app_id.alias("app_id"), event.alias("event"), "value")
    named = named.where(F.col("event").isin(*kinds) if kinds else F.col("event") != "")
    # a generated column: a filter on it stays above, and a line is parsed once
    parsed = named.select("app_id", "event", F.explode(F.array(F.try_parse_json("value"))).alias("body"))
    return parsed.where(F.col("body").isNotNull())


def _at(path: str, kind: str, base: str = "body") -> Column:
    """A field by its names, joined by ``/``; NULL if it is absent or of another kind."""
    steps = "".join(f"['{name}']" for name in path.split("/"))
    return F.try_variant_get(base, f"${steps}", kind)


def run_tasks(events: DataFrame) -> DataFrame:
    """A row for each finished task."""
    def metric(path: str) -> Column:
        return _at(f"Task Metrics/{path}", "bigint")

    read = F.coalesce(metric("Shuffle Read Metrics/Remote Bytes Read"), F.lit(0)) + F.coalesce(metric("Shuffle Read Metrics/Local Bytes Read"), F.lit(0))
    return events.where(F.col("event") == TASK_END).select(
        "app_id",
        _at("Stage ID", "bigint").alias("stage_id"),
        _at("Stage Attempt ID", "bigint").alias("stage_attempt"),
        _at("Task Info/Task ID", "bigint").alias("task_id"),
        (_at("Task Info/Finish Time", "bigint") - _at("Task Info/Launch Time", "bigint")).alias("duration_ms"),
        F.coalesce(_at("Task Info/Failed", "boolean"), F.lit(False)).alias("failed"),
        _at("Task End Reason/Reason", "string").alias("reason"),
        F.concat_ws("\n", _at("Task End Reason/Description", "string"), _at("Task End Reason/Full Stack Trace", "string")).alias("failure_text"),
        metric("Executor Run Time").alias("run_time_ms"),
        metric("Memory Bytes Spilled").alias("memory_spilled"),
        metric("Disk Bytes Spilled").alias("disk_spilled"),
        read.alias("shuffle_read"),
        F.coalesce(metric("Shuffle Write Metrics/Shuffle Bytes Written"), F.lit(0)).alias("shuffle_written"),
    )


def run_stages(events: DataFrame) -> DataFrame:
    """A row for each completed stage attempt; ``failure`` is NULL if it succeeded."""
    return events.where(F.col("event") == STAGE_DONE).select(
        "app_id",
        _at("Stage Info/Stage ID", "bigint").alias("stage_id"),
        _at("Stage Info/Stage Attempt ID", "bigint").alias("stage_attempt"),
        _at("Stage Info/Stage Name", "string").alias("stage_name"),
        _at("Stage Info/Number of Tasks", "bigint").alias("n_tasks"),
        (_at("Stage Info/Completion Time", "bigint") - _at("Stage Info/Submission Time", "bigint")).alias("duration_ms"),
        _at("Stage Info/Failure Reason", "string").alias("failure"),
    )


def run_jobs(events: DataFrame) -> DataFrame:
    """A row for each job: its stages, and how and when it ended (NULL while it runs)."""
    key = ["app_id", _at("Job ID", "bigint").alias("job_id")]
    starts = events.where(F.col("event") == JOB_START).select(*key, _at("Submission Time", "bigint").alias("started"), _at("Stage IDs", "array<bigint>").alias("stage_ids"))
    ends = events.where(F.col("event") == JOB_END).select(*key, _at("Completion Time", "bigint").alias("ended"), _at("Job Result/Result", "string").alias("result"))
    return starts.join(ends, ["app_id", "job_id"], "left").select(
        "app_id", "job_id", "stage_ids", (F.col("ended") - F.col("started")).alias("duration_ms"), "result"
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The finished tasks below ``path``."""
    return run_tasks(read_run_events(spark, path, TASK_END))


def read_stage_log(spark: SparkSession, path: str) -> DataFrame:
    """The completed stage attempts below ``path``."""
    return run_stages(read_run_events(spark, path, STAGE_DONE))


def exact_median(df: DataFrame, by: list[str], col: str, levels: tuple[int, ...] = (24, 12, 0)) -> DataFrame:
    """``by, median_ms``: the exact median of an integer column for each group (NULLs left out).

    The two middle ranks are found level by level: counts by the leading bits tell in
    which range each lies, those of the next bits within it tell a narrower one, and
    the last level has single values.  Counts are combined in each task; no buffer and no sort
    holds a group's values, only its bins of one level.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("long").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.floor((F.col("_n") - 1) / 2).alias("_rank")), F.struct(F.lit(1).alias("_side"), F.floor(F.col("_n") / 2).alias("_rank"))))
    wanted = total.select(*by, ranks.alias("_w")).select(*by, "_w._side", "_w._rank", F.lit(None).cast("long").alias("_bin"))
    above = None
    for shift in levels:
        bins = counts.select(*by, F.shiftright("_v", shift).alias("_b"), *([F.shiftright("_v", above).alias("_up")] if above is not None else []), "_c")
        inside = [F.col(f"b.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by] + ([F.col("b._up") == F.col("w._bin")] if above is not None else [])
        sums = bins.groupBy(*by, "_b", *(["_up"] if above is not None else [])).agg(F.sum("_c").alias("_c"))
        met = wanted.alias("w").join(sums.alias("b"), inside).select(*[F.col(f"w.{c}").alias(c) for c in by], "_side", "_rank", "_b", "_c")
        upto = F.sum("_c").over(Window.partitionBy(*by, "_side").orderBy("_b"))
        found = met.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        wanted = found.select(*by, "_side", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"), F.col("_b").alias("_bin"))
        above = shift
    return wanted.groupBy(*by).agg((F.sum("_bin") / 2).alias("median_ms"))


STAGE = ["app_id", "stage_id"]


def stage_retries(tasks: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """Stages that ran more than one attempt, by their tasks and, if given, by the
    stage attempts themselves, of which some may have ended no task."""
    columns = [*STAGE, "stage_attempt"]
    tried = tasks.select(*columns) if stages is None else tasks.select(*columns).unionByName(stages.select(*columns))
    return tried.groupBy(*STAGE).agg(F.max("stage_attempt").alias("max_attempt")).where("max_attempt > 0")


def task_failures(tasks: DataFrame) -> DataFrame:
    """Failed tasks and their distinct reasons per stage."""
    return tasks.groupBy(*STAGE).agg(
        F.count_if("failed").alias("failed_tasks"),
        F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("reason")))).alias("reasons"),
    ).where("failed_tasks > 0")


def stragglers(tasks: DataFrame, factor: float = 2.0) -> DataFrame:
    """Tasks slower than ``factor`` × their stage's exact median."""
    med = exact_median(tasks, STAGE, "duration_ms")
    return tasks.join(med, STAGE).where(F.col("duration_ms") > F.col("median_ms") * factor)


def stage_skew(tasks: DataFrame) -> DataFrame:
    """Largest task's share of the stage's shuffle read (as C3's ratio)."""
    return tasks.groupBy(*STAGE).agg(
        F.sum("shuffle_read").alias("total_read"), F.max("shuffle_read").alias("max_read"), F.count(F.lit(1)).alias("tasks")
    ).select("*", F.round(F.col("max_read") / F.nullif(F.col("total_read"), F.lit(0)), 4).alias("skew_ratio"))


def oom_signals(tasks: DataFrame) -> DataFrame:
    """E5: failed tasks whose failure text carries the OOM signature."""
    return tasks.where(F.col("failed") & F.col("failure_text").rlike(ci(C.SIGNATURES["OOM"])))


def shuffle_blowups(tasks: DataFrame, threshold: int = C.SHUFFLE_BYTES_HIGH) -> DataFrame:
    """Stages writing more shuffle bytes than ``threshold``."""
    return tasks.groupBy(*STAGE).agg(F.sum("shuffle_written").alias("shuffle_written")).where(
        F.col("shuffle_written") > threshold
    )


def app_signals(tasks: DataFrame, skew_factor: float = 1.5, threshold: int = C.SHUFFLE_BYTES_HIGH) -> DataFrame:
    """Per application: worst stage skew (:func:`stage_skew`'s share times the number
    of tasks, so largest read over mean read), OOM failures, spill and whether any stage's shuffle write
    exceeds ``threshold``."""
    share = F.max("shuffle_read") / F.nullif(F.sum("shuffle_read"), F.lit(0))
    st = tasks.groupBy(*STAGE).agg((share * F.count("shuffle_read")).alias("stage_skew"), F.sum("shuffle_written").alias("written"))
    per_stage = st.groupBy("app_id").agg(
        F.max("stage_skew").alias("max_stage_skew"),
        F.max(F.col("written") > threshold).alias("shuffle_blowup"),
    )
    per_task = tasks.groupBy("app_id").agg(
        F.count_if(F.col("failed") & F.col("failure_text").rlike(ci(C.SIGNATURES["OOM"]))).alias("oom_tasks"),
        F.sum(F.coalesce("memory_spilled", F.lit(0)) + F.coalesce("disk_spilled", F.lit(0))).alias("spilled"),
    )
    return per_stage.join(per_task, "app_id").withColumn(
        "skewed", F.coalesce(F.col("max_stage_skew") >= skew_factor, F.lit(False))
    )


def confirm(rc: DataFrame, tasks: DataFrame, skew_factor: float = 1.5) -> DataFrame:
    """Left-join root-cause records (with an ``app_id`` column) to their
    application's run signals; ``confirmed`` says whether the metrics agree
    with the classified cause (Skew: a skewed stage; OOM/GC: OOM failures or
    spill; large-shuffle actions: a shuffle blow-up).  Unknown apps stay
    unconfirmed."""
    sig = app_signals(tasks, skew_factor)
    j = rc.join(sig, "app_id", "left")
    et = F.col("classification.error_type")
    blown = F.exists("suggested_action_types", lambda a: a.isin("optimize_join", "broadcast_or_repartition")) & F.col("shuffle_blowup")
    confirmed = (
        F.when(et == "Skew", F.col("skewed") | blown)
        .when(et.isin("OOM", "GC"), (F.col("oom_tasks") > 0) | (F.col("spilled") > 0) | blown)
        .otherwise(blown)
    )
    return j.withColumn("confirmed", F.coalesce(confirmed, F.lit(False)))
