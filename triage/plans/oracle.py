"""DuckDB oracle SQL for the registered queries.

Independent formulations of the same semantics, written against the driver's
pre-registered views.  Column names and types match the Spark queries.
"""

from __future__ import annotations

from .. import config as C
from ..sources.synth import JOB_CATALOG_SQL, SYNTH_FAILURE_EVENTS_SQL, SYNTH_LOGS_SQL, duck
from .triage_queries import RCA_COLUMNS, RCA_COMMON, rca_key


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


LOGS_CTE = "logs AS (" + duck(SYNTH_LOGS_SQL) + ")"
EVENTS_CTE = "fevents AS (" + duck(SYNTH_FAILURE_EVENTS_SQL) + ")"
CATALOG_CTE = "catalog AS (" + duck(JOB_CATALOG_SQL) + ")"

_SIG = C.SIGNATURES
# Classification over the (tailed) text.
CLASSIFY_CTES = f"""
tl AS (
  SELECT *, string_split(log_text, chr(10)) AS lines0 FROM logs
),
t AS (
  SELECT *, array_to_string(list_slice(lines0, greatest(1, len(lines0) - {C.MAX_LINES - 1}), len(lines0)), chr(10)) AS t
  FROM tl
),
m AS (
  SELECT *,
    regexp_matches(t, {_q(_SIG['SchemaMismatch'])}, 'i') AS s_schema,
    regexp_matches(t, {_q(_SIG['OOM'])}, 'i') AS s_oom,
    regexp_matches(t, {_q(_SIG['Skew'])}, 'i') AS s_skew,
    regexp_matches(t, {_q(_SIG['GC'])}, 'i') AS s_gc,
    regexp_matches(t, {_q(_SIG['MissingFile'])}, 'i') AS s_file,
    regexp_matches(t, {_q(_SIG['AuthError'])}, 'i') AS s_auth,
    string_split(t, chr(10)) AS lines
  FROM t
),
c AS (
  SELECT *,
    list_filter([CASE WHEN s_schema THEN 'SchemaMismatch' END, CASE WHEN s_oom THEN 'OOM' END,
                 CASE WHEN s_skew THEN 'Skew' END, CASE WHEN s_gc THEN 'GC' END,
                 CASE WHEN s_file THEN 'MissingFile' END, CASE WHEN s_auth THEN 'AuthError' END],
                lambda x: x IS NOT NULL) AS matched,
    CASE WHEN s_oom THEN 'OOM' WHEN s_schema THEN 'SchemaMismatch' WHEN s_skew THEN 'Skew'
         WHEN s_file THEN 'MissingFile' WHEN s_auth THEN 'AuthError' WHEN s_gc THEN 'GC'
         ELSE 'Other' END AS error_type,
    list_filter(range(1, len(lines) + 1),
                lambda i: regexp_matches(lines[i], {_q(C.EXCEPTION_LINE)}, 'i'))[1] AS exc_idx
  FROM m
),
cls AS (
  SELECT *,
    coalesce(trim(lines[exc_idx]), {_q(C.NO_EXCEPTION_LINE)}) AS error_message,
    array_to_string(matched, ',') AS matched_patterns,
    CASE WHEN len(matched) = 0 THEN CAST(0.45 AS DOUBLE)
         ELSE round(least(CAST(0.9 AS DOUBLE), CAST(0.6 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (len(matched) - 1)), 2)
    END AS cls_confidence
  FROM c
)"""

_NUM = "regexp_extract(t, {pat}, 1)"


def _rx(p: str) -> str:
    return _q("(?i)" + p)


RCA_CTES = (
    CLASSIFY_CTES
    + f""",
r1 AS (
  SELECT *,
    CASE WHEN error_type = 'SchemaMismatch' THEN nullif(regexp_extract(t, {_rx(C.MISSING_COLUMNS)}, 1), '') END AS miss_raw,
    CASE WHEN error_type = 'SchemaMismatch' THEN nullif(regexp_extract(t, {_rx(C.EXTRA_COLUMNS)}, 1), '') END AS extra_raw,
    CASE WHEN error_type = 'SchemaMismatch' THEN contains(t, 'amt') AND NOT contains(t, 'amount') END AS demo,
    CASE WHEN error_type = 'OOM' THEN regexp_matches(t, {_q(C.OOM_PHRASE)}, 'i') END AS oom_phrase,
    CASE WHEN error_type = 'OOM' THEN nullif(regexp_extract(t, {_rx(C.INSTANCE_HINT)}, 0), '') END AS instance_hint,
    CASE WHEN error_type IN ('OOM', 'Skew') THEN
      nullif(TRY_CAST(nullif(regexp_extract(t, {_rx(C.SHUFFLE_BYTES)}, 1), '') AS BIGINT), 0) END AS shuffle_bytes,
    CASE WHEN error_type = 'Skew' THEN nullif(regexp_extract(t, {_rx(C.SKEW_RATIO)}, 1), '') END AS ratio_s,
    CASE WHEN error_type = 'Skew' THEN nullif(regexp_extract(t, {_rx(C.HOTKEY_COUNT)}, 1), '') END AS hot_s,
    CASE WHEN error_type = 'Skew' THEN nullif(regexp_extract(t, {_rx(C.TOTAL_RECORDS)}, 1), '') END AS total_s,
    CASE WHEN error_type = 'MissingFile' THEN nullif(regexp_extract(t, {_rx(C.MISSING_FILE_PHRASE)}, 0), '') END AS file_phrase,
    CASE WHEN error_type = 'MissingFile' THEN nullif(regexp_extract(t, {_q(C.PATH_TOKEN)}, 1), '') END AS missing_path,
    CASE WHEN error_type = 'AuthError' THEN nullif(regexp_extract(t, {_rx(C.AUTH_PHRASE)}, 0), '') END AS auth_phrase,
    CASE WHEN error_type = 'GC' THEN regexp_matches(t, {_q(C.GC_PHRASE)}, 'i') END AS gc_phrase,
    CASE WHEN error_type = 'Other' AND exc_idx IS NOT NULL THEN
      array_to_string(list_slice(lines, greatest(1, exc_idx - 2), exc_idx + 2), chr(10)) END AS ctx
  FROM cls
),
r2 AS (
  SELECT *,
    list_transform(string_split(miss_raw, ','), lambda x: trim(x, {_q(C.COLUMN_STRIP_CHARS)})) AS miss_cols,
    list_transform(string_split(extra_raw, ','), lambda x: trim(x, {_q(C.COLUMN_STRIP_CHARS)})) AS extra_found,
    CAST(ratio_s AS DOUBLE) AS ratio_direct,
    TRY_CAST(hot_s AS BIGINT) AS hot,
    TRY_CAST(total_s AS BIGINT) AS total,
    (ratio_s IS NULL AND hot_s IS NOT NULL AND total_s IS NOT NULL) AS counts_used
  FROM r1
),
r3 AS (
  SELECT *,
    CASE WHEN demo THEN list_append(coalesce(extra_found, []), 'amt') ELSE extra_found END AS extra_cols,
    CASE WHEN ratio_s IS NOT NULL THEN ratio_direct
         WHEN counts_used THEN CASE WHEN total <> 0 THEN round(hot / total, 4) END END AS skew_ratio,
    CASE WHEN counts_used THEN hot END AS hotkey_count,
    CASE WHEN counts_used THEN total END AS total_records
  FROM r2
),
r4 AS (
  SELECT *,
    coalesce(skew_ratio > {C.SKEW_RATIO_THRESHOLD}, false) AS skew_high,
    coalesce(shuffle_bytes > {C.SHUFFLE_BYTES_HIGH}, false) AS big_shuffle,
    CASE WHEN shuffle_bytes IS NOT NULL THEN {_q(C.EV_SHUFFLE)} || CAST(shuffle_bytes AS VARCHAR) END AS shuffle_ev
  FROM r3
),
r5 AS (
  SELECT *,
    CASE error_type
      WHEN 'SchemaMismatch' THEN list_filter([
        CASE WHEN miss_cols IS NOT NULL THEN {_q(C.EV_MISSING_COLUMNS)} || '[' || array_to_string(list_transform(miss_cols, lambda x: '''' || x || ''''), ', ') || ']' END,
        CASE WHEN extra_found IS NOT NULL THEN {_q(C.EV_EXTRA_COLUMNS)} || '[' || array_to_string(list_transform(extra_found, lambda x: '''' || x || ''''), ', ') || ']' END,
        CASE WHEN demo THEN {_q(C.EV_DEMO_AMT)} END], lambda x: x IS NOT NULL)
      WHEN 'OOM' THEN list_filter([
        CASE WHEN oom_phrase THEN {_q(C.EV_OOM)} END,
        CASE WHEN instance_hint IS NOT NULL THEN {_q(C.EV_INSTANCE)} || instance_hint END,
        shuffle_ev], lambda x: x IS NOT NULL)
      WHEN 'Skew' THEN list_filter([
        CASE WHEN ratio_s IS NOT NULL THEN {_q(C.EV_SKEW_RATIO)} || CAST(ratio_direct AS VARCHAR) END,
        CASE WHEN counts_used THEN 'hotkey_count=' || CAST(hot AS VARCHAR) || '; total_records=' || CAST(total AS VARCHAR) END,
        shuffle_ev], lambda x: x IS NOT NULL)
      WHEN 'MissingFile' THEN list_filter([file_phrase,
        CASE WHEN missing_path IS NOT NULL THEN {_q(C.EV_MISSING_PATH)} || missing_path END], lambda x: x IS NOT NULL)
      WHEN 'AuthError' THEN list_filter([auth_phrase], lambda x: x IS NOT NULL)
      WHEN 'GC' THEN list_filter([CASE WHEN gc_phrase THEN {_q(C.EV_GC)} END], lambda x: x IS NOT NULL)
      ELSE [coalesce(ctx, error_message)]
    END AS ev0
  FROM r4
),
rc AS (
  SELECT log_path, task_id, event_id, error_type, error_message, matched_patterns, cls_confidence,
    CASE error_type {' '.join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.ROOT_CAUSE.items() if k != 'Other')}
      ELSE {_q(C.ROOT_CAUSE['Other'])} END AS root_cause,
    CASE WHEN len(ev0) = 0 THEN [error_message] ELSE ev0 END AS ev,
    CASE error_type
      WHEN 'SchemaMismatch' THEN {_list(C.ACTIONS['SchemaMismatch'])}
      WHEN 'OOM' THEN CASE WHEN big_shuffle THEN {_list(C.ACTIONS['OOM_large_shuffle'])} ELSE {_list(C.ACTIONS['OOM'])} END
      WHEN 'Skew' THEN list_concat(CASE WHEN skew_high THEN {_list(C.ACTIONS['Skew'])} ELSE {_list(C.ACTIONS['Skew_low'])} END,
                                   CASE WHEN big_shuffle THEN {_list(C.ACTIONS['Skew_large_shuffle_extra'])} ELSE [] END)
      WHEN 'MissingFile' THEN {_list(C.ACTIONS['MissingFile'])}
      WHEN 'AuthError' THEN {_list(C.ACTIONS['AuthError'])}
      WHEN 'GC' THEN {_list(C.ACTIONS['GC'])}
      ELSE {_list(C.ACTIONS['Other'])} END AS action_list,
    CAST(CASE error_type
      WHEN 'SchemaMismatch' THEN CASE WHEN miss_cols IS NOT NULL OR extra_cols IS NOT NULL THEN 0.9 ELSE 0.6 END
      WHEN 'OOM' THEN CASE WHEN oom_phrase OR instance_hint IS NOT NULL OR shuffle_bytes IS NOT NULL THEN 0.9 ELSE 0.6 END
      WHEN 'Skew' THEN CASE WHEN skew_high THEN 0.9 ELSE 0.5 END
      WHEN 'MissingFile' THEN 0.85 WHEN 'AuthError' THEN 0.9 WHEN 'GC' THEN 0.8 ELSE 0.4 END AS DOUBLE) AS confidence,
    CASE error_type
      {' '.join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.REMEDIATION.items() if k not in ('Skew', 'Skew_low', 'Other'))}
      WHEN 'Skew' THEN CASE WHEN skew_high THEN {_q(C.REMEDIATION['Skew'])} ELSE {_q(C.REMEDIATION['Skew_low'])} END
      ELSE {_q(C.REMEDIATION['Other'])} END AS remediation_hint,
    miss_cols, extra_cols, instance_hint, shuffle_bytes, skew_ratio, hotkey_count, total_records, missing_path
  FROM r5
),
flat AS (
  SELECT log_path, task_id, event_id, error_type, error_message, matched_patterns, cls_confidence, root_cause,
    array_to_string(ev, ' || ') AS evidence,
    CAST(len(ev) AS BIGINT) AS n_evidence,
    array_to_string(action_list, ',') AS actions,
    action_list,
    confidence, remediation_hint,
    array_to_string(miss_cols, ',') AS missing_columns,
    array_to_string(extra_cols, ',') AS extra_columns,
    miss_cols, extra_cols,
    instance_hint, shuffle_bytes, skew_ratio, hotkey_count, total_records, missing_path
  FROM rc
)"""
)

FLAT_COLUMNS = (
    "log_path, error_type, error_message, matched_patterns, cls_confidence, root_cause, evidence, n_evidence, "
    "actions, confidence, remediation_hint, missing_columns, extra_columns, instance_hint, shuffle_bytes, "
    "skew_ratio, hotkey_count, total_records, missing_path"
)


def with_rc(select: str) -> str:
    return f"WITH {LOGS_CTE},{RCA_CTES}\n{select}"


ORACLE: dict[str, str] = {
    "classify_counts": f"""WITH {LOGS_CTE},{CLASSIFY_CTES}
SELECT error_type, matched_patterns, cls_confidence, count(*) AS n_logs
FROM cls GROUP BY error_type, matched_patterns, cls_confidence""",
    "log_classification": f"""WITH {LOGS_CTE},{CLASSIFY_CTES}
SELECT log_path, error_type, error_message, matched_patterns, cls_confidence,
  CAST(length(substr(t, 1, {C.EXCERPT_CHARS})) AS BIGINT) AS excerpt_chars,
  CAST(len(lines) AS BIGINT) AS n_lines
FROM cls""",
    "log_tail": f"""WITH {LOGS_CTE}, s AS (SELECT log_path, string_split(log_text, chr(10)) AS l FROM logs)
SELECT log_path,
  array_to_string(list_slice(l, greatest(1, len(l) - 2), len(l)), chr(10)) AS tail_text,
  CAST(len(list_slice(l, greatest(1, len(l) - 2), len(l))) AS BIGINT) AS n_lines
FROM s""",
    "shuffle_bytes": f"""WITH {LOGS_CTE}
SELECT log_path,
  nullif(TRY_CAST(nullif(regexp_extract(log_text, {_rx(C.SHUFFLE_BYTES)}, 1), '') AS BIGINT), 0) AS shuffle_bytes
FROM logs""",
    "root_causes": with_rc(f"SELECT {FLAT_COLUMNS} FROM flat"),
}

for _kind, _cols in RCA_COLUMNS.items():
    ORACLE[rca_key(_kind)] = with_rc(
        f"SELECT {', '.join(RCA_COMMON + _cols)} FROM flat WHERE error_type = {_q(_kind)}"
    )


# ---------------------------------------------------------------------------
# Family B
# ---------------------------------------------------------------------------

_NORM = (
    "list_sort(list_distinct(list_filter(flatten(list_transform(action_list, "
    "lambda a: list_transform(string_split(a, ','), lambda x: lower(trim(x))))), lambda x: x <> '')))"
)
PLAN_CTES = f""",
nb AS (SELECT *, {_NORM} AS norm FROM rc),
pairs AS (
  SELECT mm.log_path, e AS old_name, m AS new_name
  FROM (SELECT log_path, unnest(miss_cols) AS m FROM rc) mm
  JOIN (SELECT log_path, unnest(extra_cols) AS e FROM rc) ee ON mm.log_path = ee.log_path
  WHERE starts_with(lower(e), lower(substr(m, 1, 3))) OR length(e) >= 3
),
npairs AS (SELECT log_path, count(*) AS n FROM pairs GROUP BY log_path)"""


def with_plan(select: str) -> str:
    return with_rc(PLAN_CTES + "\n" + select)


_RULES = " UNION ALL ".join(
    f"SELECT {_q(name)} AS rule, unnest({_list(trig)}) AS action" for name, (_, trig, _) in C.FIX_RULES.items()
)
_ROUTES = " UNION ALL ".join(f"SELECT {_q(a)} AS action, {_q(s)} AS next_step" for a, s in C.ROUTES.items())

ORACLE.update(
    {
        "normalized_actions": with_plan(
            "SELECT log_path, array_to_string(norm, ',') AS actions, CAST(len(norm) AS BIGINT) AS n_actions FROM nb"
        ),
        "fix_plans_review": with_plan(
            """SELECT log_path,
  list_has_any(norm, ['optimize_join', 'broadcast_or_repartition']) AS broadcast,
  CASE WHEN list_has_any(norm, ['repartition', 'salting']) THEN CAST(200 AS BIGINT) END AS repartition,
  CASE WHEN list_has_any(norm, ['schema_update', 'code_patch']) AND len(miss_cols) > 0 AND len(extra_cols) > 0
       THEN extra_cols[1] END AS rename_old,
  CASE WHEN list_has_any(norm, ['schema_update', 'code_patch']) AND len(miss_cols) > 0 AND len(extra_cols) > 0
       THEN miss_cols[1] END AS rename_new,
  array_to_string(norm, ',') AS actions
FROM nb"""
        ),
        "fix_plans_local": with_plan(
            """SELECT log_path,
  len(list_filter(action_list, lambda x: contains(lower(x), 'broadcast'))) > 0 AS broadcast,
  CASE WHEN list_has_any(action_list, ['repartition', 'salting']) THEN CAST(200 AS BIGINT) END AS repartition,
  CASE WHEN len(miss_cols) > 0 AND len(extra_cols) > 0 THEN extra_cols[1] END AS rename_old,
  CASE WHEN len(miss_cols) > 0 AND len(extra_cols) > 0 THEN miss_cols[1] END AS rename_new,
  array_to_string(norm, ',') AS actions
FROM nb"""
        ),
        "rename_candidates": with_plan("SELECT log_path, old_name, new_name FROM pairs"),
        "recommendations": with_plan(
            f"""SELECT log_path, len(ch) > 0 AS applied, array_to_string(ch, ',') AS changes, n_renames,
  CASE WHEN len(ch) > 0 THEN round(least(CAST(0.99 AS DOUBLE), greatest(CAST(0.5 AS DOUBLE),
      CASE WHEN n_renames > 0 THEN {C.FIX_RULES['rename_column_schema'][2]} ELSE 0.5 END,
      CASE WHEN big THEN {C.FIX_RULES['broadcast_join'][2]} ELSE 0.5 END,
      CASE WHEN rep THEN {C.FIX_RULES['repartition_before_groupby'][2]} ELSE 0.5 END,
      CASE WHEN cfg THEN {C.FIX_RULES['config_hint'][2]} ELSE 0.5 END)), 2)
    ELSE CAST(0.0 AS DOUBLE) END AS fix_confidence
FROM (
  SELECT *, list_filter([CASE WHEN n_renames > 0 THEN 'rename_column' END,
                         CASE WHEN big THEN 'broadcast_join' END,
                         CASE WHEN rep THEN 'repartition_before_groupby' END,
                         CASE WHEN cfg THEN 'config_hint_comment' END], lambda x: x IS NOT NULL) AS ch
  FROM (
    SELECT nb.log_path,
      CAST(CASE WHEN list_has_any(norm, ['schema_update', 'code_patch']) THEN coalesce(npairs.n, 0) ELSE 0 END AS BIGINT) AS n_renames,
      coalesce(shuffle_bytes, 0) > {C.SHUFFLE_BYTES_PLAN} AS big,
      list_has_any(norm, ['salting', 'repartition']) OR list_contains(action_list, 'salting') AS rep,
      list_has_any(norm, ['increase_executor_memory', 'config_change']) AS cfg
    FROM nb LEFT JOIN npairs ON nb.log_path = npairs.log_path
  )
)"""
        ),
        "rule_matches": with_plan(
            f"""SELECT DISTINCT a.log_path, r.rule
FROM (SELECT log_path, unnest(norm) AS action FROM nb) a JOIN ({_RULES}) r ON a.action = r.action"""
        ),
        "gated_root_causes": with_rc(
            f"SELECT log_path, error_type, confidence FROM rc WHERE confidence >= {C.CONFIDENCE_GATE}"
        ),
        "routes": with_rc(
            f"""SELECT a.log_path, a.action, r.next_step
FROM (SELECT log_path, unnest(action_list) AS action FROM rc) a JOIN ({_ROUTES}) r ON a.action = r.action"""
        ),
    }
)
ORACLE["rule_matches_table"] = ORACLE["rule_matches"]
