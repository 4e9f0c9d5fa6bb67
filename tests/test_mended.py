"""Cases in which rows were lost before."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from triage.operators import events as D
from triage.operators import repair as R
from triage.sources.events import EVENT_SCHEMA
from triage.sources.logs import read_logs, scan_logs
from triage.streaming.triage_stream import process_batch


def test_empty_odd_named_and_uri_logs(spark, tmp_path):
    root = tmp_path / "logs of a day"
    (root / "t1").mkdir(parents=True)
    (root / "t1" / "run 1+a.log").write_text("x\nOOM")
    (root / "t1" / "it's.log").write_text("")
    want = {("logs of a day/t1/run 1+a.log", "t1", "x\nOOM"), ("logs of a day/t1/it's.log", "t1", "")}
    for path in (str(root), f"file:{root}"):
        for read in (read_logs, scan_logs):
            assert {(r.log_path, r.task_id, r.log_text) for r in read(spark, path).collect()} == want


def test_strict_signatures(spark):
    from triage.config import SIGNATURES
    from triage.functions.text import ci

    def met(name, text):
        return spark.range(1).select(F.lit(text).rlike(ci(SIGNATURES[name], True))).first()[0]

    assert met("SchemaMismatch", "SchemaMismatchError: x") and met("AuthError", "AuthenticationException") and met("OOM", "an OOM here")
    assert not met("OOM", "ZOOMED") and not met("AuthError", "the author")


def test_hot_keys_are_all_returned(spark):
    assert R.hot_keys(spark.range(4000).select((F.col("id") % 2000).alias("k")), "k", min_share=0.0004).count() == 2000
    with pytest.raises(ValueError):
        R.hot_keys(spark.range(3), "id", min_share=0)


def test_joins_go_on_beyond_the_limits(spark):
    left, right = spark.range(50).toDF("k"), spark.range(30).toDF("k")
    assert R.broadcast_join(left, right, "k", max_bytes=10).count() == 30
    assert R.split_join(left, right, "k", right, max_hot_keys=5).count() == 30


def _event(run, path, hour, meta):
    t = datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=hour)
    values = {"dag_id": "d", "task_id": "t", "run_id": run, "attempt": 1, "timestamp": t, "log_path": path, "metadata": meta}
    return tuple(values.get(f.name) for f in EVENT_SCHEMA.fields)


def test_dedup_of_events_with_maps_and_repeated_logs(spark):
    events = spark.createDataFrame([_event("r1", "a", 1, {"x": "1"}), _event("r1", "a", 1, {"x": "0"}), _event("r2", None, 2, None)], EVENT_SCHEMA)
    got = {r.run_id: r for r in D.dedup_events(events).collect()}
    assert got["r1"].n_copies == 2 and got["r1"].metadata == {"x": "0"} and got["r2"].n_copies == 1
    logs = spark.createDataFrame([("a", "one"), ("a", "one")], "log_path string, log_text string")
    assert D.resolve(events, logs).count() == 3


def test_unreadable_retry_set_fails_the_batch(spark, tmp_path):
    events = spark.createDataFrame([_event("r1", "a", 1, None)], EVENT_SCHEMA)
    logs = spark.createDataFrame([("a", "OOM")], "log_path string, log_text string")
    bad = tmp_path / "retry" / "epoch=4"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        process_batch(spark, events, logs, str(tmp_path), 5)
    process_batch(spark, events, logs, os.path.join(str(tmp_path), "other"), 5)


def test_equal_rows_spread_over_all_salts(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.lit(2).alias("v"), "id")
    assert rows.select(R.salt_of(rows, 8, ["id"]).alias("s")).distinct().count() == 8
    got = R.salted_agg(rows, "k", [("sum", "v", "total"), ("count", "*", "n")], salts=8, salt_by=["id"]).collect()
    assert [tuple(r) for r in got] == [(1, 8000, 4000)]


def test_unigram_generation_goes_on(spark):
    from triage.operators import ngram as N

    counts = spark.createDataFrame([("", "a", 3), ("", "b", 2)], "context string, token string, n long")
    prompts = spark.createDataFrame([(1, "x y")], "prompt_id long, text string")
    row = N.generate_greedy(prompts, counts, 4, n=1).first()
    assert row["n_generated"] == 4 and row["generated"].split(N.SEP) == ["a"] * 4


def test_big_and_small_files_give_the_same_tail(spark, tmp_path):
    texts = {
        "open.log": b"one\ntwo\nthree", "ended.log": b"one\ntwo\nthree\n", "crlf.log": b"a\r\nb\r\nc\r\n", "crlf_open.log": b"a\r\nb\r\nc",
        "blank.log": b"\n\n\n", "bytes.log": b"ok\n\xff\xfe bad\nlast", "marked.log": b"\xef\xbb\xbfone\ntwo\nthree\n", "long.log": b"x" * 500 + b"\ny\n" * 40 + b"z",
    }
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        for lines in (1, 2, 30):
            small, big = ({(r.log_path, r.log_text) for r in scan_logs(spark, str(tmp_path), max_lines=lines, big_file_bytes=size).collect()} for size in (10**6, 1))
            assert {(r.log_path, r.log_text) for r in read_logs(spark, str(tmp_path), max_lines=lines).collect()} == small
            if lines == 30:  # the mark at the start is part of a whole text only
                small = {(path, text.lstrip("﻿")) for path, text in small}
            assert small == big and len(small) == len(texts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
