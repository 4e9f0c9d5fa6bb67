"""A1: files listed and read in tasks; the stream of new files; D10/D11 on two streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from triage.sources.log_source import list_logs, log_arrivals, read_tails, tail_bytes, write_logs
from triage.sources.logs import read_logs, scan_logs
from triage.streaming.triage_stream import read_stream_output, triage_arrivals

COLUMNS = "source string, project string, dag_id string, task_id string, run_id string, attempt int, timestamp string, log_path string, job_file string"


def put(root, name, text="x\njava.lang.OutOfMemoryError: heap space", at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if at is not None:
        os.utime(path, (at, at))


def test_listing_is_done_in_tasks_and_no_name_is_in_the_plan(spark, tmp_path):
    root = tmp_path / "logs"
    for name in ("top.log", "t1/a b.log", "t1/deep/c+d.log", "t2/e%20f.log", "t2/x.txt", "t1/.hidden.log"):
        put(root, name)
    put(root, "t1/empty.log", "")
    rows = list_logs(spark, str(root), depth=1)
    want = {"logs/top.log", "logs/t1/a b.log", "logs/t1/deep/c+d.log", "logs/t2/e%20f.log", "logs/t1/empty.log"}
    for depth in (0, 1, 2, 5):
        assert {r.log_path for r in list_logs(spark, str(root), depth=depth).collect()} == want
    assert rows.rdd.getNumPartitions() == 3  # the root's own files, t1, t2
    assert {r.log_path: r.length for r in rows.collect()}["logs/t1/empty.log"] == 0
    plan = read_logs(spark, str(root))._jdf.queryExecution().toString()
    assert ".log" not in plan.replace("*.log", "") and "job_logs" in plan
    with pytest.raises(Exception, match="no folder"):
        list_logs(spark, str(root / "absent")).collect()


def test_unreadable_and_vanished_files_are_empty(spark, tmp_path):
    root = tmp_path / "logs"
    for name in ("t/good.log", "t/gone.log", "t/folder.log/inner.log", "t/loop.log"):
        put(root, name)
    listing = spark.createDataFrame(list_logs(spark, str(root)).collect(), list_logs(spark, str(root)).schema)
    os.remove(root / "t" / "gone.log")
    os.remove(root / "t" / "loop.log")
    os.symlink(root / "t" / "loop.log", root / "t" / "loop.log")  # can't be opened
    got = {r.log_path: (bytes(r.raw), r.error) for r in read_tails(listing, str(root), 10).collect()}
    assert got["logs/t/gone.log"][0] == b"" and got["logs/t/gone.log"][1]
    assert got["logs/t/loop.log"][0] == b"" and got["logs/t/loop.log"][1]
    assert got["logs/t/good.log"] == (b"x\njava.lang.OutOfMemoryError: heap space", None)
    texts = {r.log_path: r.log_text for r in read_logs(spark, str(root)).collect()}
    assert texts["logs/t/good.log"].startswith("x\n") and "logs/t/folder.log/inner.log" in texts


def test_tails_equal_those_of_whole_reads(spark, tmp_path, monkeypatch):
    import io

    from triage.sources import log_source

    texts = [b"", b"one", b"one\ntwo\nthree", b"one\ntwo\nthree\n", b"a\r\nb\r\nc\r\n", b"a\rb\rc\r", b"\n\n\n\n", b"\r\n" * 30, b"x" * 40 + b"\n" + b"y\r\n" * 20, b"\r\r\n\n\r" * 5]
    for k, text in enumerate(texts):
        put(tmp_path, f"t/{k}.log", text)
    for block in (1, 2, 3, 7, 1 << 18):
        monkeypatch.setattr(log_source, "BLOCK_BYTES", block)
        for text in texts:
            for lines in (1, 2, 5, 100):
                end = tail_bytes(io.BytesIO(text), len(text), lines)
                assert text.endswith(end)
                whole, cut = (x.replace(b"\r\n", b"\n").replace(b"\r", b"\n").splitlines(True)[-lines:] for x in (text, end))
                assert whole == cut, (text, block, lines)
    for lines in (1, 2, 3000):
        scanned = {(r.log_path, r.log_text) for r in scan_logs(spark, str(tmp_path), max_lines=lines).collect()}
        assert {(r.log_path, r.log_text) for r in read_logs(spark, str(tmp_path), max_lines=lines).collect()} == scanned


def test_written_logs_are_read_back(spark, tmp_path):
    rows = [(f"logs/t{k % 3}/run {k}.log", f"text {k}\nä") for k in range(30)] + [("logs/t9/none.log", None)]
    logs = spark.createDataFrame(rows, "log_path string, log_text string").repartition(4)
    for _ in range(2):  # a second time leaves the same files
        assert write_logs(logs, str(tmp_path)) == 31
        got = {(r.log_path, r.log_text) for r in read_logs(spark, str(tmp_path / "logs")).collect()}
        assert got == {(p, t or "") for p, t in rows}


def _run(query):
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def _new_rows(query, source):
    assert any(source in s["description"] for s in query.recentProgress[-1]["sources"]), query.recentProgress[-1]["sources"]
    return [s["numInputRows"] for p in query.recentProgress for s in p["sources"] if source in s["description"]]


def test_a_batch_lists_new_files_only(spark, tmp_path):
    root = tmp_path / "logs"

    def run():
        logs = log_arrivals(spark, str(root), settle=0).writeStream.format("noop")
        return _run(logs.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())

    for n in (5, 2, 3):
        for k in range(n):
            put(root, f"t{k % 2}/{n}-{k}.log")
        time.sleep(0.05)
        assert sum(_new_rows(run(), "PythonMicroBatchStream")) == n
    assert sum(_new_rows(run(), "PythonMicroBatchStream")) == 0


class Arrivals:
    def __init__(self, spark, base, **times):
        self.spark, self.times = spark, times
        self.root, self.events, self.out, self.ckpt = (base / d for d in ("logs", "events", "out", "ckpt"))

    def send(self, *runs, day="2024-01-05"):
        rows = [("s", "p", "dag", "task", f"run{n}", 1, f"{day} 00:00:00", f"logs/t/{n}.log", None) for n in runs]
        self.spark.createDataFrame(rows, COLUMNS).withColumn("timestamp", F.to_timestamp("timestamp")).coalesce(1).write.mode("append").json(str(self.events))

    def run(self):
        time.sleep(0.05)
        return _run(triage_arrivals(self.spark, str(self.events), str(self.root), str(self.out), str(self.ckpt), settle=0, **self.times))

    def runs(self, table="root_causes"):
        return sorted(r.run_id for r in self.spark.read.parquet(str(self.out / table)).select("run_id").collect())


def test_arrivals_of_events_and_logs_in_any_order(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.send(1, 1, 2)  # run 1 twice in one batch
    put(a.root, "t/1.log")
    put(a.root, "t/9.log", "AccessDenied")  # a log before its event
    q = a.run()
    assert a.runs() == ["run1"] and sum(_new_rows(q, "PythonMicroBatchStream")) == 2
    a.send(1, 3)  # a copy in a later batch
    a.send(9, day="2001-01-01")  # a late event of a new key
    put(a.root, "t/2.log")  # a log after its event
    q = a.run()
    assert a.runs() == ["run1", "run2", "run9"] and a.runs("log_missing") == []
    assert sum(_new_rows(q, "PythonMicroBatchStream")) == 1 and sum(_new_rows(q, "FileStreamSource")) == 3
    found = {r.run_id: r.classification.error_type for r in read_stream_output(spark, str(a.out)).collect()}
    assert found == {"run1": "OOM", "run2": "OOM", "run9": "AuthError"}


def test_state_of_arrivals_expires(spark, tmp_path):
    a = Arrivals(spark, tmp_path, retention="1 second", wait="1 second", keep="1 second")
    a.send(1, 2, 3, 4)
    put(a.root, "t/1.log")
    a.run()
    for n in (11, 12):  # time passes with batches that have rows
        time.sleep(3)
        put(a.root, f"t/{n}.log")
        a.send(n)
        q = a.run()
    assert a.runs() == ["run1", "run11", "run12"] and set(a.runs("log_missing")) == {"run2", "run3", "run4"}
    state = {o["operatorName"]: o["numRowsTotal"] for o in q.recentProgress[-1]["stateOperators"]}
    assert state["dedupeWithinWatermark"] <= 2 and state["symmetricHashJoin"] <= 4, state
    a.send(1)  # its key is forgotten: counts as a new event, and waits for a log
    a.run()
    assert a.runs() == ["run1", "run11", "run12"]
