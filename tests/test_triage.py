"""Log triage: golden records, one literal log per analyzer branch, file reading."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from triage.operators.rootcause import analyze
from triage.operators.sinks import read_root_causes, write_root_causes
from triage.sources.logs import read_logs, scan_logs

SCHEMA_LOG = "Job failed: SchemaMismatchError: missing columns: ['amount']; extra columns: ['amt']\n"
OOM_LOG = (
    "Starting heavy operation to simulate OOM...\n"
    "ERROR: java.lang.OutOfMemoryError: Java heap space - simulated by demo\n"
    "Job failed: java.lang.OutOfMemoryError: Java heap space - simulated by demo\n"
)
SKEW_LOG = (
    "INFO: total_records=100000, hotkey_count=95063, skew_ratio=0.951\n"
    "INFO: Estimated shuffle_bytes ~ 20000000\n"
    "WARN: PerformanceAlert: extreme key skew detected on column sk, skew_ratio=0.951\n"
    "Job failed: PerformanceAlert: extreme key skew detected on column sk, skew_ratio=0.951\n"
)


def run(spark, texts):
    df = spark.createDataFrame([(f"l{i}", t) for i, t in enumerate(texts)], "log_path string, log_text string")
    rows = analyze(df).orderBy("log_path").collect()
    return [r.asDict(recursive=True) for r in rows]


def test_golden_schema_mismatch(spark):
    r = run(spark, [SCHEMA_LOG])[0]
    assert r["root_cause"] == "Schema mismatch between expected and incoming data fields."
    assert r["evidence"] == ["Detected missing columns: ['amount']", "Detected extra columns: ['amt']"]
    assert r["suggested_action_types"] == ["schema_update", "code_patch", "data_provider_alert"]
    assert r["diagnostics"]["missing_columns"] == ["amount"]
    assert r["diagnostics"]["extra_columns"] == ["amt"]
    assert r["confidence"] == 0.9
    c = r["classification"]
    assert (c["error_type"], c["matched_patterns"], c["confidence"]) == ("SchemaMismatch", ["SchemaMismatch"], 0.6)
    assert c["error_message"] == SCHEMA_LOG.strip()


def test_golden_oom(spark):
    r = run(spark, [OOM_LOG])[0]
    assert r["evidence"] == ["Detected Java/Python OutOfMemoryError in logs."]
    assert r["suggested_action_types"] == ["config_change", "increase_executor_memory", "optimize_transformations"]
    assert all(v is None for v in r["diagnostics"].values())
    assert r["confidence"] == 0.9
    assert r["classification"]["error_message"] == "ERROR: java.lang.OutOfMemoryError: Java heap space - simulated by demo"
    assert r["classification"]["confidence"] == 0.6


def test_golden_skew(spark):
    r = run(spark, [SKEW_LOG])[0]
    assert r["evidence"] == ["Detected skew_ratio=0.951", "shuffle_bytes=20000000"]
    assert r["suggested_action_types"] == ["code_patch", "salting", "repartition"]
    assert r["diagnostics"]["skew_ratio"] == 0.951
    assert r["diagnostics"]["shuffle_bytes"] == 20000000
    assert r["confidence"] == 0.9
    assert r["classification"]["error_type"] == "Skew"


@pytest.mark.parametrize(
    "text, etype, evidence, conf, extra",
    [
        # Q1: the first regex wins, comma-grouped numbers keep their first group.
        ("OutOfMemoryError\nshuffle_bytes ~ 20,000,000", "OOM", ["Detected Java/Python OutOfMemoryError in logs.", "shuffle_bytes=20"], 0.9, {}),
        # Q4: bare substring "room" is an OOM signature.
        ("the room is full", "OOM", ["No explicit exception line found"], 0.6, {}),
        # Q5: GC overhead matches OOM and GC; OOM wins with two matches.
        ("ERROR: GC overhead limit exceeded on driver", "OOM",
         ["Detected Java/Python OutOfMemoryError in logs.", "Instance hint: driver"], 0.9, {"cls": 0.7}),
        # Q6: a lone 401 is not an auth signature.
        ("HTTP 401 returned", "Other", ["No explicit exception line found"], 0.4, {}),
        # Q7: zero shuffle bytes count as absent.
        ("skew detected\nshuffle_bytes=0", "Skew", ["No explicit exception line found"], 0.5, {}),
        # hot/total fallback and a large shuffle.
        ("hotkey_count=600 total_records=1000 shuffle_bytes=2000000000", "Skew",
         ["hotkey_count=600; total_records=1000", "shuffle_bytes=2000000000"], 0.9, {"ratio": 0.6}),
        ("java.io.FileNotFoundException: /data/in/x.parquet", "MissingFile",
         ["FileNotFoundException", "Missing path: /data/in/x.parquet"], 0.85, {}),
        ("AccessDenied: permission denied for user", "AuthError", ["AccessDenied"], 0.9, {}),
        ("WARN: Full GC (Allocation Failure)", "GC", ["Garbage collection pressure detected."], 0.8, {}),
        # Q14: empty log.
        ("", "Other", ["No explicit exception line found"], 0.4, {"cls": 0.45}),
        # Other with the ±2 line context around the first exception line.
        ("a\nb\nc\nValueError: bad\nd\ne\nf", "Other", ["b\nc\nValueError: bad\nd\ne"], 0.4, {}),
        # a trailing newline does not open a line.
        ("a\nTraceback here\n", "Other", ["a\nTraceback here"], 0.4, {}),
        # Q16: the demo fallback appends amt.
        ("SchemaMismatch: bad amt", "SchemaMismatch",
         ["Found 'amt' in data; expected 'amount' (demo pattern)"], 0.9, {"extra": ["amt"]}),
        # Q3: an unbracketed list runs across lines up to the next ']'.
        ("missing columns: a, b\nnext ] end", "SchemaMismatch", ["Detected missing columns: ['a', 'b\\nnext']"], 0.9, {}),
    ],
)
def test_branches(spark, text, etype, evidence, conf, extra):
    r = run(spark, [text])[0]
    assert r["classification"]["error_type"] == etype
    assert r["evidence"] == evidence
    assert r["confidence"] == conf
    if "cls" in extra:
        assert r["classification"]["confidence"] == extra["cls"]
    if "ratio" in extra:
        assert r["diagnostics"]["skew_ratio"] == extra["ratio"]
    if "extra" in extra:
        assert r["diagnostics"]["extra_columns"] == extra["extra"]


def test_unicode_case_folding(spark):
    # Q2: the Kelvin sign folds to k under Unicode-aware matching.
    r = run(spark, ["sKew in join"])[0]
    assert r["classification"]["error_type"] == "Skew"


def test_tail_keeps_last_lines(spark):
    from triage.functions.text import tail_lines

    df = spark.createDataFrame([("\n".join(str(i) for i in range(10)) + "\n",), ("x",), ("",)], "t string")
    got = [r[0] for r in df.select(tail_lines(F.col("t"), 3)).collect()]
    assert got == ["7\n8\n9\n", "x", ""]
    again = [r[0] for r in df.select(tail_lines(tail_lines(F.col("t"), 3), 3)).collect()]
    assert again == got


def test_read_logs_whole_and_big_paths(spark):
    root = tempfile.mkdtemp(prefix="triage-logs-")
    os.makedirs(os.path.join(root, "logs", "skew"))
    os.makedirs(os.path.join(root, "logs", "oom"))
    with open(os.path.join(root, "logs", "skew", "run_1.log"), "w") as f:
        f.write(SKEW_LOG.replace("\n", "\r\n"))
    lines = [f"line {i}" for i in range(5000)] + ["java.lang.OutOfMemoryError: heap space"]
    with open(os.path.join(root, "logs", "oom", "run_2.log"), "w") as f:
        f.write("\n".join(lines) + "\n")
    small = read_logs(spark, os.path.join(root, "logs"))
    a = {r.log_path: r.log_text for r in small.collect()}
    for size in (10**9, 1000):
        assert a == {r.log_path: r.log_text for r in scan_logs(spark, os.path.join(root, "logs"), big_file_bytes=size).collect()}
    assert a["logs/skew/run_1.log"] == SKEW_LOG
    assert a["logs/oom/run_2.log"] == "\n".join(lines[-3000:]) + "\n"
    rc = {r.log_path: r for r in analyze(small).collect()}
    assert rc["logs/oom/run_2.log"].classification.error_type == "OOM"


def test_sink_round_trip(spark):
    df = spark.createDataFrame([("a", OOM_LOG), ("b", SKEW_LOG)], "log_path string, log_text string")
    rc = analyze(df)
    path = tempfile.mkdtemp(prefix="triage-rc-") + "/rc"
    write_root_causes(rc, path)
    back = read_root_causes(spark, path)
    assert back.count() == 2
    assert sorted(r.root_cause for r in back.collect()) == sorted(r.root_cause for r in rc.collect())


def test_no_python_in_plans(spark):
    import __spark_entry__ as E

    for name in ["root_causes", "recommendations", "event_outcomes", "salted_agg", "ngram_counts"]:
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan, name


def test_one_pass_finds_what_single_searches_find(spark):
    """4,000 made-up texts of pieces of the signatures, whole and broken, against Spark's search for each one."""
    import random

    from triage.config import SIGNATURES, TriageConfig
    from triage.functions.text import ci
    from triage.operators.classify import hits_pattern, match_patterns, plain_alternatives

    random.seed(11)
    parts = [a for p in SIGNATURES.values() for a in plain_alternatives(p)]
    bits = parts + [p[:-1] for p in parts] + [p.upper() for p in parts] + ["\n", " ", "x", "java", "Auth", "full g", "c", "40", "3", "ſkew", "sKew", "overhead", "\u212a", "javaXlang.OutOfMemoryError", "日本"]
    texts = ["".join(random.choice(bits) for _ in range(random.randrange(7))) for _ in range(3998)] + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, log_text string")
    custom = TriageConfig(signatures={**SIGNATURES, "Lines": r"^x.*c$", "Group": r"(a|b)c"})
    for cfg in (TriageConfig(), custom, TriageConfig(strict=True)):
        got = {r.id: r.matched_patterns for r in match_patterns(df, cfg=cfg).collect()}
        plain = df.select("id", *[F.col("log_text").rlike(ci(p, cfg.strict)).alias(n) for n, p in cfg.signatures.items()])
        assert got == {r.id: [n for n in cfg.signatures if r[n]] for r in plain.collect()}
    plan = match_patterns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "RLIKE" in plan and "log_text#" in plan
    assert plain_alternatives(r"a.*b|c") is None and plain_alternatives("(a b|c.d)") == ["a b", "c.d"]
    assert hits_pattern(["Auth", "Authentication", "403"]).count("Auth") == 1
