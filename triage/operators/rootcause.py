"""A8–A16 — diagnostics extraction and the root-cause record, one projection per log.

Every analyzer's regexes sit under ``CASE WHEN error_type = …`` so a log only
pays for the branch it was classified into.  Texts and action lists are
literals from ``triage.config``; nothing is joined and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, TriageConfig
from ..functions.text import (
    ci,
    compact_array,
    extract_group,
    first_line_context,
    py_list_repr,
    split_strip,
    tail_lines,
)
from .classify import classify

KINDS = ["SchemaMismatch", "OOM", "Skew", "MissingFile", "AuthError", "GC", "Other"]

DIAGNOSTIC_FIELDS = [
    "missing_columns",
    "extra_columns",
    "instance_hint",
    "shuffle_bytes",
    "skew_ratio",
    "hotkey_count",
    "total_records",
    "missing_path",
]

RECORD_FIELDS = [
    "log_path",
    "detected_at",
    "root_cause",
    "evidence",
    "suggested_action_types",
    "diagnostics",
    "confidence",
    "remediation_hint",
    "classification",
]


def _strs(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def shuffle_bytes(text: Column, parse_commas: bool = False) -> Column:
    """First ``shuffle bytes`` number as BIGINT; 0 counts as absent (Q7)."""
    if parse_commas:
        raw = F.regexp_replace(F.regexp_extract(text, ci(r"shuffle[_ ]?bytes[^0-9]*([0-9][0-9,]*)"), 1), ",", "")
    else:
        raw = F.regexp_extract(text, ci(C.SHUFFLE_BYTES), 1)
    return F.nullif(raw.try_cast("bigint"), F.lit(0).cast("bigint"))


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    expr = None
    for k, v in values.items():
        expr = F.when(kind == k, v) if expr is None else expr.when(kind == k, v)
    return expr


def analyze(
    df: DataFrame,
    text: str = "log_text",
    cfg: TriageConfig = DEFAULT,
    keep: list[str] | None = None,
    kinds: list[str] | None = None,
    fields: list[str] | None = None,
) -> DataFrame:
    """One root-cause record per input row.

    ``df`` needs ``log_path`` and ``text``; columns in ``keep`` are carried along.
    The text column is dropped from the result, so nothing wide reaches a shuffle.
    ``kinds`` keeps the records of those error types, before the analysis;
    ``fields`` names the record fields wanted (``diagnostics.<name>`` for some of the
    diagnostics), and only what they need is extracted.
    """
    keep = [c for c in (keep or []) if c not in ("log_path", text)]
    base = df.select("log_path", *keep, tail_lines(F.col(text), cfg.max_lines).alias("_t"))
    c = classify(base, "_t", cfg)
    if kinds is not None:
        c = c.where(F.col("error_type").isin(*kinds))

    t = F.col("_t")
    kind = F.when(F.col("error_type").isin(*KINDS), F.col("error_type")).otherwise(F.lit("Other"))
    c = c.withColumn("_kind", kind)
    k = F.col("_kind")

    def on(kinds, value: Column) -> Column:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        return F.when(k.isin(*kinds), value)

    # Layer 1: raw extractions, each only for the analyzer that uses it.
    demo = (t.contains("amt") & ~t.contains("amount")) if cfg.demo_pattern else F.lit(False)
    raw = c.select(
        "*",
        on("SchemaMismatch", F.regexp_extract(t, ci(C.MISSING_COLUMNS), 1)).alias("_miss"),
        on("SchemaMismatch", F.regexp_extract(t, ci(C.EXTRA_COLUMNS), 1)).alias("_extra"),
        on("SchemaMismatch", demo).alias("_demo"),
        on("OOM", t.rlike(ci(C.OOM_PHRASE))).alias("_oom"),
        on("OOM", extract_group(t, ci(C.INSTANCE_HINT), 0)).alias("_inst"),
        on(["OOM", "Skew"], shuffle_bytes(t, cfg.parse_commas)).alias("_shuffle"),
        on("Skew", extract_group(t, ci(C.SKEW_RATIO))).alias("_ratio_s"),
        on("Skew", extract_group(t, ci(C.HOTKEY_COUNT))).alias("_hot_s"),
        on("Skew", extract_group(t, ci(C.TOTAL_RECORDS))).alias("_total_s"),
        on("MissingFile", extract_group(t, ci(C.MISSING_FILE_PHRASE), 0)).alias("_file"),
        on("MissingFile", extract_group(t, "(?U)" + C.PATH_TOKEN)).alias("_path"),
        on("AuthError", extract_group(t, ci(C.AUTH_PHRASE), 0)).alias("_auth"),
        on("GC", t.rlike(ci(C.GC_PHRASE))).alias("_gc"),
        on("Other", first_line_context(t, C.EXCEPTION_LINE)).alias("_ctx"),
    ).drop("_t")

    # Layer 2: typed diagnostics.
    miss_cols = F.when(F.col("_miss") != "", split_strip(F.col("_miss")))
    extra_found = F.when(F.col("_extra") != "", split_strip(F.col("_extra")))
    d = raw.select(
        "*",
        miss_cols.alias("_miss_cols"),
        extra_found.alias("_extra_found"),
        F.col("_ratio_s").cast("double").alias("_ratio_direct"),
        F.col("_hot_s").try_cast("bigint").alias("_hot"),
        F.col("_total_s").try_cast("bigint").alias("_total"),
    )

    extra_cols = F.when(
        F.col("_demo"), F.array_append(F.coalesce(F.col("_extra_found"), F.array().cast("array<string>")), F.lit("amt"))
    ).otherwise(F.col("_extra_found"))
    counts_used = F.col("_ratio_s").isNull() & F.col("_hot_s").isNotNull() & F.col("_total_s").isNotNull()
    ratio = F.when(F.col("_ratio_s").isNotNull(), F.col("_ratio_direct")).when(
        counts_used, F.when(F.col("_total") != 0, F.round(F.col("_hot") / F.col("_total"), 4))
    )
    d = d.select(
        "*",
        extra_cols.alias("_extra_cols"),
        ratio.alias("_ratio"),
        F.when(counts_used, F.col("_hot")).alias("_hot_used"),
        F.when(counts_used, F.col("_total")).alias("_total_used"),
    )

    shuffle = F.col("_shuffle")
    shuffle_ev = F.when(shuffle.isNotNull(), F.concat(F.lit(C.EV_SHUFFLE), shuffle.cast("string")))
    skew_high = F.coalesce(F.col("_ratio") > cfg.skew_ratio_threshold, F.lit(False))
    big_shuffle = F.coalesce(shuffle > cfg.shuffle_bytes_high, F.lit(False))

    ev_schema = compact_array(
        F.when(F.col("_miss_cols").isNotNull(), F.concat(F.lit(C.EV_MISSING_COLUMNS), py_list_repr(F.col("_miss_cols")))),
        F.when(F.col("_extra_found").isNotNull(), F.concat(F.lit(C.EV_EXTRA_COLUMNS), py_list_repr(F.col("_extra_found")))),
        F.when(F.col("_demo"), F.lit(C.EV_DEMO_AMT)),
    )
    ev_oom = compact_array(
        F.when(F.col("_oom"), F.lit(C.EV_OOM)),
        F.when(F.col("_inst").isNotNull(), F.concat(F.lit(C.EV_INSTANCE), F.col("_inst"))),
        shuffle_ev,
    )
    ev_skew = compact_array(
        F.when(F.col("_ratio_s").isNotNull(), F.concat(F.lit(C.EV_SKEW_RATIO), F.col("_ratio_direct").cast("string"))),
        F.when(
            counts_used,
            F.format_string("hotkey_count=%d; total_records=%d", F.col("_hot"), F.col("_total")),
        ),
        shuffle_ev,
    )
    ev_file = compact_array(
        F.col("_file"), F.when(F.col("_path").isNotNull(), F.concat(F.lit(C.EV_MISSING_PATH), F.col("_path")))
    )
    ev_auth = compact_array(F.col("_auth"))
    ev_gc = compact_array(F.when(F.col("_gc"), F.lit(C.EV_GC)))
    ev_other = F.array(F.coalesce(F.col("_ctx"), F.col("error_message")))

    evidence = _by_kind(
        k,
        {
            "SchemaMismatch": ev_schema,
            "OOM": ev_oom,
            "Skew": ev_skew,
            "MissingFile": ev_file,
            "AuthError": ev_auth,
            "GC": ev_gc,
            "Other": ev_other,
        },
    )

    schema_found = F.col("_miss_cols").isNotNull() | F.col("_extra_cols").isNotNull()
    confidence = _by_kind(
        k,
        {
            "SchemaMismatch": F.when(schema_found, 0.9).otherwise(0.6),
            "OOM": F.when(F.col("_oom") | F.col("_inst").isNotNull() | shuffle.isNotNull(), 0.9).otherwise(0.6),
            "Skew": F.when(skew_high, 0.9).otherwise(0.5),
            **{kk: F.lit(v) for kk, v in C.FIXED_CONFIDENCE.items()},
        },
    )
    actions = _by_kind(
        k,
        {
            "SchemaMismatch": _strs(C.ACTIONS["SchemaMismatch"]),
            "OOM": F.when(big_shuffle, _strs(C.ACTIONS["OOM_large_shuffle"])).otherwise(_strs(C.ACTIONS["OOM"])),
            "Skew": F.concat(
                F.when(skew_high, _strs(C.ACTIONS["Skew"])).otherwise(_strs(C.ACTIONS["Skew_low"])),
                F.when(big_shuffle, _strs(C.ACTIONS["Skew_large_shuffle_extra"])).otherwise(
                    F.array().cast("array<string>")
                ),
            ),
            **{kk: _strs(C.ACTIONS[kk]) for kk in ["MissingFile", "AuthError", "GC", "Other"]},
        },
    )
    hint = _by_kind(
        k,
        {
            **{kk: F.lit(C.REMEDIATION[kk]) for kk in KINDS if kk != "Skew"},
            "Skew": F.when(skew_high, F.lit(C.REMEDIATION["Skew"])).otherwise(F.lit(C.REMEDIATION["Skew_low"])),
        },
    )
    root_cause = _by_kind(k, {kk: F.lit(C.ROOT_CAUSE[kk]) for kk in KINDS})
    diagnostics = F.struct(
        F.col("_miss_cols").alias("missing_columns"),
        F.col("_extra_cols").alias("extra_columns"),
        F.col("_inst").alias("instance_hint"),
        shuffle.alias("shuffle_bytes"),
        F.col("_ratio").alias("skew_ratio"),
        F.col("_hot_used").alias("hotkey_count"),
        F.col("_total_used").alias("total_records"),
        F.col("_path").alias("missing_path"),
    )
    record = [
        F.current_timestamp().alias("detected_at"),
        root_cause.alias("root_cause"),
        F.when(F.size(evidence) == 0, F.array(F.col("error_message"))).otherwise(evidence).alias("evidence"),
        actions.alias("suggested_action_types"),
        diagnostics.alias("diagnostics"),
        confidence.cast("double").alias("confidence"),
        hint.alias("remediation_hint"),
        F.col("classification"),
    ]
    if fields is not None:
        some = [name for name in DIAGNOSTIC_FIELDS if f"diagnostics.{name}" in fields]
        if some and "diagnostics" not in fields:
            record[RECORD_FIELDS.index("diagnostics") - 1] = F.struct(*[diagnostics[name].alias(name) for name in some]).alias("diagnostics")
        wanted = {name.split(".")[0] for name in fields}
        record = [value for name, value in zip(RECORD_FIELDS[1:], record) if name in wanted]
    # The record leaves through a one-row generator: a later filter on any
    # record field (e.g. the confidence gate) stays above it instead of being
    # inlined into every analysis expression below (which multiplies both
    # plan size and regex evaluations).  The path and the carried columns stay
    # outside it, so filters on them reach the scan.
    carried = [F.col("log_path"), *[F.col(name) for name in keep]]
    return d.select(*carried, F.inline(F.array(F.struct(*record)))) if record else d.select(*carried)


def flatten_record(rc: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scalar view of a root-cause table (arrays joined, struct fields lifted)."""
    keep = keep or []
    d = F.col("diagnostics")
    cls = F.col("classification")
    return rc.select(
        "log_path",
        *keep,
        cls["error_type"].alias("error_type"),
        cls["error_message"].alias("error_message"),
        F.array_join(cls["matched_patterns"], ",").alias("matched_patterns"),
        cls["confidence"].alias("cls_confidence"),
        "root_cause",
        F.array_join("evidence", " || ").alias("evidence"),
        F.size("evidence").alias("n_evidence"),
        F.array_join("suggested_action_types", ",").alias("actions"),
        "confidence",
        "remediation_hint",
        F.array_join(d["missing_columns"], ",").alias("missing_columns"),
        F.array_join(d["extra_columns"], ",").alias("extra_columns"),
        d["instance_hint"].alias("instance_hint"),
        d["shuffle_bytes"].alias("shuffle_bytes"),
        d["skew_ratio"].alias("skew_ratio"),
        d["hotkey_count"].alias("hotkey_count"),
        d["total_records"].alias("total_records"),
        d["missing_path"].alias("missing_path"),
    )
