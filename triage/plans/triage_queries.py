"""Registered triage queries (families A and B) over the driver tables.

Each query takes ``(spark, sf_dir)`` and returns a flat DataFrame whose columns
match the DuckDB oracle in ``triage.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import line_count, tail_lines
from ..operators.classify import classify, with_excerpt, with_tail
from ..operators.rootcause import KINDS, analyze, flatten_record, shuffle_bytes
from ..sources.synth import synth_logs as _synth_logs


def synth_logs(spark, sf_dir):
    return _synth_logs(spark, sf_dir)

RCA_COLUMNS = {
    "SchemaMismatch": ["missing_columns", "extra_columns"],
    "OOM": ["instance_hint", "shuffle_bytes"],
    "Skew": ["skew_ratio", "hotkey_count", "total_records", "shuffle_bytes"],
    "MissingFile": ["missing_path"],
    "AuthError": [],
    "GC": [],
    "Other": [],
}
RCA_COMMON = ["log_path", "error_type", "root_cause", "evidence", "actions", "confidence", "remediation_hint"]


def root_causes(spark: SparkSession, sf_dir: str, fields: list[str] | None = None) -> DataFrame:
    """The root-cause table of every synthesised log (struct form)."""
    return analyze(synth_logs(spark, sf_dir), keep=["task_id", "event_id"], fields=fields)


# What the plans of family B read of a record.
ACTIONS = ["suggested_action_types"]
RENAMES = ["diagnostics.missing_columns", "diagnostics.extra_columns"]


def q_classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = with_tail(synth_logs(spark, sf_dir))
    c = classify(logs)
    return c.groupBy(
        "error_type",
        F.array_join("matched_patterns", ",").alias("matched_patterns"),
        "cls_confidence",
    ).agg(F.count(F.lit(1)).alias("n_logs"))


def q_log_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = with_excerpt(classify(with_tail(synth_logs(spark, sf_dir))))
    return logs.select(
        "log_path",
        "error_type",
        "error_message",
        F.array_join("matched_patterns", ",").alias("matched_patterns"),
        "cls_confidence",
        F.length("sample_excerpt").cast("bigint").alias("excerpt_chars"),
        line_count(F.col("log_text")).cast("bigint").alias("n_lines"),
    )


def q_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 with a 3-line window, so the cut is exercised on every multi-line log."""
    logs = synth_logs(spark, sf_dir)
    return logs.select(
        "log_path",
        tail_lines(F.col("log_text"), 3).alias("tail_text"),
        line_count(tail_lines(F.col("log_text"), 3)).cast("bigint").alias("n_lines"),
    )


def q_shuffle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 on every log, whatever its class."""
    logs = synth_logs(spark, sf_dir)
    return logs.select("log_path", shuffle_bytes(F.col("log_text")).alias("shuffle_bytes"))


def q_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir)


def _flat(spark, sf_dir, kinds=None):
    out = flatten_record(analyze(synth_logs(spark, sf_dir), kinds=kinds))
    return out.withColumn("n_evidence", F.col("n_evidence").cast("bigint"))


def _rca_query(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = _flat(spark, sf_dir, [kind])
        return flat.select(*RCA_COMMON, *RCA_COLUMNS[kind])

    q.__name__ = f"q_rca_{kind}"
    return q


def rca_key(kind: str) -> str:
    return {
        "SchemaMismatch": "rca_schema_mismatch",
        "OOM": "rca_oom",
        "Skew": "rca_skew",
        "MissingFile": "rca_missing_file",
        "AuthError": "rca_auth",
        "GC": "rca_gc",
        "Other": "rca_other",
    }[kind]


QUERIES = {
    "classify_counts": q_classify_counts,
    "log_classification": q_log_classification,
    "log_tail": q_log_tail,
    "shuffle_bytes": q_shuffle_bytes,
    "root_causes": q_root_causes,
    **{rca_key(k): _rca_query(k) for k in KINDS},
}

__all__ = ["QUERIES", "root_causes", "RCA_COLUMNS", "RCA_COMMON", "rca_key", "C"]


# ---------------------------------------------------------------------------
# Family B — repair planning over the root-cause table.
# ---------------------------------------------------------------------------

from . import fix_plans as B  # noqa: E402


def q_normalized_actions(spark, sf_dir):
    rc = root_causes(spark, sf_dir, ACTIONS)
    norm = B.normalize_actions(F.col("suggested_action_types"))
    return rc.select(
        "log_path", F.array_join(norm, ",").alias("actions"), F.size(norm).cast("bigint").alias("n_actions")
    )


def _plan_query(mode):
    def q(spark, sf_dir):
        p = B.plan_fixes(root_causes(spark, sf_dir, ACTIONS + RENAMES), mode)
        return p.select(
            "log_path",
            "broadcast",
            F.col("repartition").cast("bigint").alias("repartition"),
            "rename_old",
            "rename_new",
            F.array_join("actions", ",").alias("actions"),
        )

    return q


def q_rename_candidates(spark, sf_dir):
    return B.rename_candidates(root_causes(spark, sf_dir, RENAMES))


def q_recommendations(spark, sf_dir):
    r = B.recommend(root_causes(spark, sf_dir, [*ACTIONS, *RENAMES, "diagnostics.shuffle_bytes"]))
    return r.select(
        "log_path", "applied", F.array_join("changes", ",").alias("changes"), "n_renames", "fix_confidence"
    )


def q_rule_matches(spark, sf_dir):
    return B.match_rules(root_causes(spark, sf_dir, ACTIONS))


def q_rule_matches_table(spark, sf_dir):
    """B6 with the rules as a table (size-checked broadcast join)."""
    return B.match_rules(root_causes(spark, sf_dir, ACTIONS), B.rules_frame(spark))


def q_gated_root_causes(spark, sf_dir):
    g = B.gate(analyze(synth_logs(spark, sf_dir), fields=["confidence", "classification"]))
    return g.select("log_path", F.col("classification.error_type").alias("error_type"), "confidence")


def q_routes(spark, sf_dir):
    return B.route(root_causes(spark, sf_dir, [*ACTIONS, "confidence"])).select("log_path", "action", "next_step")


QUERIES.update(
    {
        "normalized_actions": q_normalized_actions,
        "fix_plans_review": _plan_query("review"),
        "fix_plans_local": _plan_query("local"),
        "rename_candidates": q_rename_candidates,
        "recommendations": q_recommendations,
        "rule_matches": q_rule_matches,
        "rule_matches_table": q_rule_matches_table,
        "gated_root_causes": q_gated_root_causes,
        "routes": q_routes,
    }
)
