"""B1–B8 — from root-cause records to repair plans, recommendations and routes.

All per-record logic is a projection over array columns (no shuffle).  The rule
dimension is configuration: as literals it costs nothing; a user-supplied rule
table is joined by broadcast only after its row count is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import py_strip

RULE_LITERAL_MAX_ROWS = 1_000
RULE_BROADCAST_MAX_ROWS = 100_000


def normalize_actions(actions: Column) -> Column:
    """B1: split each on ',', strip, lower, drop empties, dedupe, sort."""
    parts = F.flatten(F.transform(actions, lambda a: F.transform(F.split(a, ",", -1), lambda x: py_strip(x))))
    kept = F.filter(parts, lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.lower(x))))


def _has(arr: Column, *values: str) -> Column:
    return F.exists(arr, lambda x: x.isin(*values))


def _nonempty(arr: Column) -> Column:
    return F.coalesce(F.size(arr) > 0, F.lit(False))


def plan_fixes(rc: DataFrame, mode: str = "review") -> DataFrame:
    """``broadcast, repartition, rename_old, rename_new, actions`` per record.

    ``review``: decisions from the normalised actions (rename needs
    schema_update/code_patch).  ``local``: broadcast when any raw action
    mentions broadcast, repartition on raw ``repartition``/``salting``, rename
    whenever both column lists are non-empty.
    """
    raw = F.coalesce(F.col("suggested_action_types"), F.array().cast("array<string>"))
    norm = normalize_actions(raw)
    missing = F.col("diagnostics.missing_columns")
    extra = F.col("diagnostics.extra_columns")
    both = _nonempty(missing) & _nonempty(extra)
    if mode == "review":
        rename = _has(norm, "schema_update", "code_patch") & both
        repart = _has(norm, "repartition", "salting")
        bcast = _has(norm, "optimize_join", "broadcast_or_repartition")
    elif mode == "local":
        rename = both
        repart = _has(raw, "repartition", "salting")
        bcast = F.exists(raw, lambda x: F.lower(x).contains("broadcast"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return rc.select(
        "*",
        bcast.alias("broadcast"),
        F.when(repart, F.lit(C.REPARTITION_N)).alias("repartition"),
        F.when(rename, F.get(extra, 0)).alias("rename_old"),
        F.when(rename, F.get(missing, 0)).alias("rename_new"),
        norm.alias("actions"),
    )


def rename_candidates_expr(missing: Column, extra: Column) -> Column:
    """Accepted (old=extra, new=missing) pairs of one record, in loop order."""
    missing = F.coalesce(missing, F.array().cast("array<string>"))
    extra = F.coalesce(extra, F.array().cast("array<string>"))

    def accept(m: Column, e: Column) -> Column:
        return F.lower(e).startswith(F.lower(F.substring(m, 1, 3))) | (F.length(e) >= 3)

    pairs = F.flatten(
        F.transform(
            missing,
            lambda m: F.transform(extra, lambda e: F.when(accept(m, e), F.struct(e.alias("old"), m.alias("new")))),
        )
    )
    return F.filter(pairs, lambda p: p.isNotNull())


def rename_candidates(rc: DataFrame) -> DataFrame:
    """B4 as rows: ``log_path, old_name, new_name``."""
    pairs = rename_candidates_expr(F.col("diagnostics.missing_columns"), F.col("diagnostics.extra_columns"))
    return rc.select("log_path", F.explode(pairs).alias("p")).select(
        "log_path", F.col("p.old").alias("old_name"), F.col("p.new").alias("new_name")
    )


def recommend(rc: DataFrame) -> DataFrame:
    """Which fixes apply and with what confidence.

    ``changes`` lists the applied fix kinds in application order; confidence is
    max(0.5, base of each applied rule), capped at 0.99; nothing applied gives
    ``applied = false`` and 0.0.  (The reference only counts a fix when the job
    source changed; here ``applied`` means "recommended".)
    """
    raw = F.coalesce(F.col("suggested_action_types"), F.array().cast("array<string>"))
    norm = normalize_actions(raw)
    pairs = rename_candidates_expr(F.col("diagnostics.missing_columns"), F.col("diagnostics.extra_columns"))
    n_renames = F.when(_has(norm, "schema_update", "code_patch"), F.size(pairs)).otherwise(0)
    shuffle = F.coalesce(F.col("diagnostics.shuffle_bytes"), F.lit(0))
    bases = {name: rule[2] for name, rule in C.FIX_RULES.items()}
    steps = [
        ("rename_column", n_renames > 0, bases["rename_column_schema"]),
        ("broadcast_join", shuffle > C.SHUFFLE_BYTES_PLAN, bases["broadcast_join"]),
        (
            "repartition_before_groupby",
            _has(norm, "salting", "repartition") | _has(raw, "salting"),
            bases["repartition_before_groupby"],
        ),
        ("config_hint_comment", _has(norm, "increase_executor_memory", "config_change"), bases["config_hint"]),
    ]
    changes = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond, _ in steps]), lambda x: x.isNotNull())
    conf = F.greatest(F.lit(0.5), *[F.when(cond, F.lit(b)).otherwise(F.lit(0.5)) for _, cond, b in steps])
    out = rc.select("*", changes.alias("changes"), n_renames.cast("bigint").alias("n_renames"), norm.alias("actions"))
    applied = F.size("changes") > 0
    return out.select(
        "*",
        applied.alias("applied"),
        F.when(applied, F.round(F.least(F.lit(0.99), conf), 2)).otherwise(F.lit(0.0)).alias("fix_confidence"),
        F.when(~applied, F.lit(C.NO_CHANGE_EXPLANATION)).alias("explanation"),
    )


def rules_frame(spark) -> DataFrame:
    """The fix-rule dimension (``rule, description, trigger_actions, confidence_base``)."""
    rows = [(name, d, list(t), float(b)) for name, (d, t, b) in C.FIX_RULES.items()]
    return spark.createDataFrame(
        rows, "rule string, description string, trigger_actions array<string>, confidence_base double"
    )


def match_rules(rc: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``log_path, rule`` for every rule one of whose triggers the record suggests.

    Without a rule table the configured rules are literals and the match is a
    projection.  A rule table of up to ``RULE_LITERAL_MAX_ROWS`` pairs becomes a
    literal map; a larger one is broadcast when its size is within
    ``RULE_BROADCAST_MAX_ROWS`` and shuffle-joined otherwise.
    """
    norm = normalize_actions(F.coalesce(F.col("suggested_action_types"), F.array().cast("array<string>")))
    if rules is None:
        hits = F.filter(
            F.array(
                *[
                    F.when(F.arrays_overlap(norm, F.array(*[F.lit(t) for t in trig])), F.lit(name))
                    for name, (_, trig, _) in C.FIX_RULES.items()
                ]
            ),
            lambda x: x.isNotNull(),
        )
        return rc.select("log_path", F.explode(hits).alias("rule"))
    pairs = rules.select("rule", F.explode("trigger_actions").alias("action")).distinct()
    n = pairs.count()
    if 0 < n <= RULE_LITERAL_MAX_ROWS:  # a literal map: no join and no shuffle
        by_action: dict[str, list[str]] = {}
        for r in pairs.orderBy("action", "rule").collect():
            by_action.setdefault(r["action"], []).append(r["rule"])
        rules_of = F.create_map(*[x for a, names in by_action.items() for x in (F.lit(a), F.array(*[F.lit(k) for k in names]))])
        hits = F.array_distinct(F.flatten(F.transform(norm, lambda a: F.coalesce(F.try_element_at(rules_of, a), F.array().cast("array<string>")))))
        return rc.select("log_path", F.explode(hits).alias("rule"))
    side = F.broadcast(pairs) if n <= RULE_BROADCAST_MAX_ROWS else pairs
    acts = rc.select("log_path", F.explode(norm).alias("action"))
    return acts.join(side, "action").select("log_path", "rule").dropDuplicates(["log_path", "rule"])


def gate(rc: DataFrame, threshold: float = C.CONFIDENCE_GATE) -> DataFrame:
    """Records confident enough for automated fixing."""
    return rc.where(F.col("confidence") >= threshold)


def route(rc: DataFrame) -> DataFrame:
    """One row per (record, routed action) with its next step."""
    routes = F.create_map(*[x for kv in C.ROUTES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    acts = rc.select("log_path", "confidence", F.explode("suggested_action_types").alias("action"))
    return acts.select("*", F.try_element_at(routes, F.col("action")).alias("next_step")).where(
        F.col("next_step").isNotNull()
    )
