"""The streaming triage equals the batch triage on the same files."""

import os
import tempfile

from pyspark.sql import functions as F

from triage.operators.events import EVENT_KEYS, resolve
from triage.operators.rootcause import analyze
from triage.sources.events import read_events
from triage.sources.synth import synth_failure_events, synth_logs
from triage.streaming.triage_stream import _last_epoch, process_batch, read_stream_output, triage_late_logs, triage_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="triage-stream-")
    ev_dir = os.path.join(base, "events")
    events = synth_failure_events(spark, SF).withColumn("run_id", F.concat(F.lit("r"), F.col("event_id").cast("string")))
    events = events.select(
        "source", "project", "dag_id", "task_id", "run_id", "attempt",
        F.col("timestamp").cast("timestamp").alias("timestamp"), "log_path", "job_file",
    )
    events.repartition(3).write.json(ev_dir)
    logs = synth_logs(spark, SF).select("log_path", "log_text")

    q = triage_stream(spark, ev_dir, logs, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    streamed = read_stream_output(spark, os.path.join(base, "out")).select("log_path", "root_cause", "confidence")

    batch_events = read_events(spark, ev_dir).drop("_corrupt_record", "metadata")
    found = resolve(batch_events, logs).where("ok")
    batch = analyze(found, keep=EVENT_KEYS).select("log_path", "root_cause", "confidence")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert streamed.count() > 0


def _event(n, path):
    return ("s", "p", "dag", "task", f"run{n}", 1, f"2024-01-0{n} 00:00:00", path, None)


COLUMNS = "source string, project string, dag_id string, task_id string, run_id string, attempt int, timestamp string, log_path string, job_file string"


def test_late_log_without_a_new_event_replay_and_duplicates(spark):
    base = tempfile.mkdtemp(prefix="triage-stream-")
    ev_dir, out, ckpt = (os.path.join(base, d) for d in ("events", "out", "ckpt"))

    def send(*events):
        spark.createDataFrame(list(events), COLUMNS).withColumn("timestamp", F.to_timestamp("timestamp")).write.mode(
            "append"
        ).json(ev_dir)

    def run(*paths):
        logs = spark.createDataFrame([(p, "java.lang.OutOfMemoryError: Java heap space") for p in paths], "log_path string, log_text string")
        triage_stream(spark, ev_dir, logs, out, ckpt).awaitTermination(300)
        return logs

    def runs():
        return sorted(r.run_id for r in read_stream_output(spark, out).select("run_id").collect())

    send(_event(1, "a"), _event(1, "a"), _event(2, "b"))
    run("a")
    assert runs() == ["run1"]
    both = spark.createDataFrame([("a", "OOM"), ("b", "OOM")], "log_path string, log_text string")
    for _ in range(2):  # no new event; a second pass changes nothing
        triage_late_logs(spark, both, out)
        assert runs() == ["run1", "run2"]
    send(_event(1, "a"), _event(3, "c"))
    logs = run("a", "b", "c")
    assert runs() == ["run1", "run2", "run3"]
    events = read_events(spark, ev_dir).where("run_id = 'run3'")
    last = _last_epoch(spark, os.path.join(out, "retry"))
    while spark.read.parquet(os.path.join(out, "root_causes", f"epoch={last}")).isEmpty():
        last -= 1  # epochs without rows let state expire
    process_batch(spark, events, logs, out, last)  # a replayed epoch replaces its output
    assert runs() == ["run1", "run2", "run3"]
