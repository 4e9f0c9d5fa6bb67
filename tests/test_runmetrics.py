"""E: metrics over an event log written by a small skewed application."""

import os
import statistics
import subprocess
import sys
import tempfile
import textwrap

from triage.operators import runmetrics as M

APP = textwrap.dedent(
    """
    from pyspark.sql import SparkSession, functions as F
    import sys
    spark = (SparkSession.builder.master("local[2]").appName("skewed")
             .config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", sys.argv[1])
             .config("spark.sql.adaptive.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    def broken(rows):
        raise ValueError("java.lang.OutOfMemoryError: made up")
    df = spark.range(200000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), "id")
    df.repartition(4, "k").groupBy("k").agg(F.count("*")).collect()
    try:
        spark.sparkContext.parallelize(range(4), 2).mapPartitions(broken).count()
    except Exception:
        pass
    spark.stop()
    """
)


def test_run_metrics(spark):
    d = tempfile.mkdtemp(prefix="triage-evlog-")
    script = os.path.join(d, "app.py")
    with open(script, "w") as f:
        f.write(APP)
    logs = os.path.join(d, "logs")
    os.makedirs(logs)
    subprocess.run([sys.executable, script, logs], check=True, timeout=300, capture_output=True)
    tasks = M.read_run_log(spark, logs)
    assert tasks.count() > 0
    skew = M.stage_skew(tasks).where("total_read > 0").orderBy("skew_ratio", ascending=False).first()
    # shuffle bytes are compressed (the repeated hot key compresses well), so
    # compare with the fair share of one task rather than with a row ratio
    assert skew is not None and skew.skew_ratio > 1.5 / skew.tasks
    failed = M.task_failures(tasks).collect()
    assert len(failed) == 1 and failed[0].reasons == ["ExceptionFailure"] and 1 <= failed[0].failed_tasks <= 2
    assert {r.stage_id for r in M.oom_signals(tasks).collect()} == {failed[0].stage_id}
    stages = M.read_stage_log(spark, logs)
    assert M.stage_retries(tasks, stages).count() == 0
    ended = {r.stage_id: r for r in stages.collect()}
    assert "made up" in ended[failed[0].stage_id].failure and all(r.failure is None for k, r in ended.items() if k != failed[0].stage_id)
    assert {r.stage_id: r.n_tasks for r in stages.collect()}[failed[0].stage_id] == 2
    jobs = {r.result for r in M.run_jobs(M.read_run_events(spark, logs)).collect()}
    assert jobs == {"JobSucceeded", "JobFailed"}
    assert M.shuffle_blowups(tasks, threshold=1).count() > 0
    rows = tasks.select("app_id", "stage_id", "task_id", "duration_ms").collect()
    by = {}
    for r in rows:
        by.setdefault(r.stage_id, []).append(r.duration_ms)
    slow = {r.task_id for r in rows if r.duration_ms > statistics.median(by[r.stage_id]) * 1.2}
    assert {r.task_id for r in M.stragglers(tasks, 1.2).collect()} == slow

    from pyspark.sql import functions as F
    from triage.operators.rootcause import analyze

    app = tasks.select("app_id").first().app_id
    logs = spark.createDataFrame(
        [("a", "WARN: skew_ratio=0.9", app), ("b", "full gc", app), ("d", "AccessDenied", app), ("c", "skew_ratio=0.9", "other-app")],
        "log_path string, log_text string, app_id string",
    )
    got = {r.log_path: r.confirmed for r in M.confirm(analyze(logs, keep=["app_id"]), tasks).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_stage_attempts_without_tasks_count_as_retries(spark):
    tasks = spark.createDataFrame([("a", 1, 0)], "app_id string, stage_id long, stage_attempt long")
    stages = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 0)], "app_id string, stage_id long, stage_attempt long")
    assert M.stage_retries(tasks).collect() == []
    assert [tuple(r) for r in M.stage_retries(tasks, stages).collect()] == [("a", 1, 1)]


def test_exact_median_equals_percentile(spark):
    from pyspark.sql import functions as F

    million = spark.range(1_000_000).select(F.lit("big").alias("g"), F.pmod(F.xxhash64("id"), F.lit(700_000)).alias("v"))
    rows = [("tie", 5)] * 7 + [("two", 1), ("two", 4)] + [("one", 1 << 40)] + [("neg", v) for v in (-5, -1, 0, 3)] + [("null", None), ("half", 3), ("half", None), (None, 2), (None, 8)]
    rows += [("wide", v) for v in (0, 1 << 12, 1 << 24, (1 << 24) + 1, 1 << 50)]
    df = million.union(spark.createDataFrame(rows, "g string, v long"))
    got = {r.g: r.median_ms for r in M.exact_median(df, ["g"], "v").collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect() if r.m is not None}
    assert got == want and set(got) == {"big", "tie", "two", "one", "neg", "half", None, "wide"}
    assert M.exact_median(df.where("false"), ["g"], "v").collect() == []


def test_lines_that_are_no_events_are_left_out(spark, tmp_path):
    (tmp_path / "eventlog_v2_app-7").mkdir()
    lines = ['{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":3,"Stage Attempt ID":1,"Extra":[1,{"x":2}]}}', "", "no json", '{"Event":"SparkListenerStageCompleted","Stage', '{"Event":"Other","Stage Info":5}',
             '{"Event":"SparkListenerStageCompleted","Stage Info":"text"}']
    (tmp_path / "eventlog_v2_app-7" / "events_1_app-7").write_text("\n".join(lines))
    got = [(r.app_id, r.stage_id, r.stage_attempt, r.failure) for r in M.read_stage_log(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([("app-7", 3, 1, None), ("app-7", None, None, None)], key=str)
