"""C1–C12 — the repairs as DataFrame operators.

Scale notes, operator by operator:

* Aggregates keep Spark's map-side partial aggregation: a hot key is collapsed
  inside each input partition before anything is shuffled.
* A side is broadcast only if file footers prove its rows and bytes to be under the
  limits (``sources.sizes``, no Spark job); otherwise the join is a shuffle join
  that AQE may turn into a broadcast, or whose skewed partitions it may split.
* Salts come from row content (``xxhash64``), never ``rand()``, so a re-run
  task produces the same salt for the same row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..sources.sizes import fits_broadcast

# Key types that a frequent-items summary takes.
SUMMARISED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.StringType, T.DecimalType)


# ---------------------------------------------------------------------------
# C1 / C2 — schema drift and reconciliation
# ---------------------------------------------------------------------------


def schema_drift(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Expected vs incoming column names (schema metadata only, no job)."""
    incoming = list(df.columns)
    return {
        "missing": [c for c in expected if c not in incoming],
        "extra": [c for c in incoming if c not in expected],
        "expected": list(expected),
        "incoming": incoming,
    }


def catalog_drift(expected: DataFrame, incoming: DataFrame) -> DataFrame:
    """C1 for many tables: two ``(table_name, column_name)`` catalogs →
    ``table_name, missing ARRAY, extra ARRAY`` by a full outer join."""
    e = expected.select("table_name", "column_name", F.lit(True).alias("_e"))
    i = incoming.select("table_name", "column_name", F.lit(True).alias("_i"))
    j = e.join(i, ["table_name", "column_name"], "full_outer")
    return j.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("_i").isNull(), F.col("column_name")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("_e").isNull(), F.col("column_name")))).alias("extra"),
    )


def columns_catalog(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, column_name)`` rows from DataFrame schemas."""
    rows = [(t, c) for t, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def reconcile(df: DataFrame, pairs: list[tuple[str, str]] | dict[str, str]) -> DataFrame:
    """Rename ``old → new``.  Absent sources are skipped (already applied);
    a target that already exists next to its source is refused."""
    items = list(pairs.items()) if isinstance(pairs, dict) else list(pairs)
    cols = set(df.columns)
    mapping = {}
    for old, new in items:
        if old not in cols or old == new:
            continue
        if new in cols:
            raise ValueError(f"cannot rename {old!r}: {new!r} already exists")
        mapping[old] = new
    return df.withColumnsRenamed(mapping) if mapping else df


# ---------------------------------------------------------------------------
# C4 / C5 / C10 — joins
# ---------------------------------------------------------------------------


def broadcast_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
                   max_bytes: int = C.BROADCAST_SIZE_BYTES) -> DataFrame:
    """C4: join with ``right`` broadcast; a right side that its files' footers don't show
    to be within ``max_bytes`` takes the shuffle join, so the job still runs when data
    grow, and Spark may broadcast it from its size at run time."""
    if how not in ("inner", "left", "left_semi", "left_anti", "left_outer"):
        raise ValueError(f"broadcast of the right side cannot serve a {how!r} join")
    return left.join(F.broadcast(right) if fits_broadcast(right, max_bytes) else right, on, how)


def auto_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
              max_bytes: int = C.BROADCAST_SIZE_BYTES) -> DataFrame:
    """Broadcast ``right`` when its files' footers show it to be within ``max_bytes``,
    otherwise a plain shuffle join that AQE may still turn into a broadcast from
    the shuffle's size at run time."""
    if how in ("inner", "left", "left_outer", "left_semi", "left_anti") and fits_broadcast(right, max_bytes):
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def join_count(left: DataFrame, right: DataFrame, on, by, max_bytes: int = C.BROADCAST_SIZE_BYTES) -> DataFrame:
    """``left ⋈ right`` then ``count`` per ``by`` (the demo fact–dim job)."""
    by = [by] if isinstance(by, str) else list(by)
    return auto_join(left, right, on, "inner", max_bytes).groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------------------
# C3 — skew profile
# ---------------------------------------------------------------------------


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key; partial aggregation makes a hot key cheap."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def skew_profile(df: DataFrame, key: str) -> DataFrame:
    """One row — ``total_records, n_keys, hotkey, hotkey_count, skew_ratio``.

    The hot key is the most frequent one (ties: smallest key).  The ratio uses
    the analyzer's formula ``round(hot/total, 4)``.
    """
    kc = key_counts(df, key)
    agg = kc.agg(
        F.sum("n").alias("total_records"),
        F.count(F.lit(1)).alias("n_keys"),
        F.max("n").alias("hotkey_count"),
        F.min_by(F.col(key), F.struct(F.negative(F.col("n")), F.col(key))).alias("hotkey"),
    )
    return agg.select(
        F.col("total_records").cast("bigint").alias("total_records"),
        F.col("n_keys").cast("bigint").alias("n_keys"),
        "hotkey",
        F.col("hotkey_count").cast("bigint").alias("hotkey_count"),
        F.round(F.col("hotkey_count") / F.nullif(F.col("total_records"), F.lit(0)), 4).alias("skew_ratio"),
    )


def top_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent keys with their share (a top-k report)."""
    kc = key_counts(df, key)
    total = kc.agg(F.sum("n")).scalar()
    top = kc.orderBy(F.col("n").desc(), F.col(key).asc()).limit(k)
    # The window runs over the k rows that survive the limit.
    w = Window.orderBy(F.col("n").desc(), F.col(key).asc())
    return top.select(
        F.row_number().over(w).cast("bigint").alias("rank"),
        F.col(key),
        F.col("n").cast("bigint").alias("n"),
        F.round(F.col("n") / total, 4).alias("share"),
    )


MOST_TRACKED = 1_000_000  # items a frequent-items summary can hold


def frequent_candidates(df: DataFrame, key: str, min_share: float) -> DataFrame:
    """At most ``2 / min_share`` keys, among them every key with that share of the rows.

    One pass with a frequent-items summary: a bounded number of counters in each task,
    which drop the rarest keys, and whose errors add up to less than 3.5 / (number of
    counters) of the rows.  Only the summaries are shuffled, a buffer a task.  NULL is
    not among the candidates.
    """
    tracked = math.ceil(8 / min_share)
    if tracked > MOST_TRACKED:
        raise ValueError(f"min_share must be at least {8 / MOST_TRACKED} for a summary")
    top = F.expr(f"approx_top_k(__key, {math.ceil(2 / min_share) + 1}, {tracked})")
    summary = df.select(F.col(key).alias("__key")).where("__key IS NOT NULL").agg(top.alias("top"))
    return summary.select(F.explode("top").alias("one")).select(F.col("one.item").alias(key)).where(F.col(key).isNotNull())


def hot_keys(df: DataFrame, key: str, min_share: float = 0.01) -> DataFrame:
    """All keys holding at least ``min_share`` of the rows; at most ``1/min_share``
    keys can qualify, so the result is bounded by construction.

    A summary names the candidates (:func:`frequent_candidates`), whose rows are then
    counted exactly; other keys are neither shuffled nor counted.  Very small shares
    and key types that a summary doesn't take count all keys.
    """
    if not min_share > 0:
        raise ValueError("min_share must be above 0")
    kind = df.select(key).schema[0].dataType
    if 8 / min_share > MOST_TRACKED or not isinstance(kind, SUMMARISED):
        kc = key_counts(df, key)
    else:
        few = frequent_candidates(df, key, min_share).withColumnRenamed(key, "__hot")
        counted = df.select(key).join(F.broadcast(few), F.col(key) == F.col("__hot"), "left_semi")
        kc = key_counts(counted, key).union(df.where(F.col(key).isNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        kc.where(F.col("n") >= total * F.lit(min_share))
        .orderBy(F.col("n").desc(), F.col(key))
        .select(key)
    )


# ---------------------------------------------------------------------------
# C6 / C7 — aggregation
# ---------------------------------------------------------------------------


def agg_repartitioned(df: DataFrame, keys, aggs: list[Column], n: int = C.REPARTITION_N,
                      mode: str = "combine") -> DataFrame:
    """Aggregate with an explicit partitioning.

    ``combine`` (default): plain ``groupBy`` — partial aggregation before the one
    exchange, whose number of partitions Spark chooses.  ``by_key``: ``repartition(n, keys)``
    first, so one hash exchange serves the aggregate *and* any later join or
    window on the same keys (raw rows cross the network; use when keys are
    nearly unique).  ``round_robin``: the literal keyless ``repartition(n)``
    (two exchanges; kept for comparison only).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if mode == "combine":
        return df.groupBy(*keys).agg(*aggs)
    if mode == "by_key":
        return df.repartition(n, *keys).groupBy(*keys).agg(*aggs)
    if mode == "round_robin":
        return df.repartition(n).groupBy(*keys).agg(*aggs)
    raise ValueError(f"unknown mode {mode!r}")


def salt_of(df: DataFrame, salts: int, by: list[str] | None = None) -> Column:
    """Deterministic salt in ``[0, salts)`` from columns that are unique together,
    or from the whole row, where identical rows share a salt."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in by or df.columns]), F.lit(salts))


_PARTIAL = {
    "count": (lambda c: F.count(c), lambda c: F.sum(c)),
    "sum": (lambda c: F.sum(c), lambda c: F.sum(c)),
    "min": (lambda c: F.min(c), lambda c: F.min(c)),
    "max": (lambda c: F.max(c), lambda c: F.max(c)),
}


def salted_agg(df: DataFrame, key, aggs: list[tuple[str, str, str]], salts: int = 16, salt_by: list[str] | None = None) -> DataFrame:
    """Two-phase aggregate for hot keys.

    ``aggs`` are ``(function, column, alias)`` with function in count, sum, min,
    max, avg (carried as sum and count) and count_distinct (exact, of one column,
    which then is the salt: the aggregate that map-side combining helps least).  Phase 1 groups by
    ``(key, salt)``, phase 2 by ``key``; a hot key's rows are spread over
    ``salts`` reducers in phase 1.  Only the columns used are read; ``salt_by``
    names columns that are unique together, so that equal rows part as well.
    """
    keys = [key] if isinstance(key, str) else list(key)
    used = dict.fromkeys([*keys, *(c for _, c, _ in aggs if c != "*"), *(salt_by or [])])
    distinct = {c for fn, c, _ in aggs if fn == "count_distinct"}
    if len(distinct) > 1:
        raise ValueError(f"one column can be counted distinct, not {sorted(distinct)}")
    # Equal values share a salt, so the distinct counts of a key's salts add up.
    s = df.select(*used).withColumn("_salt", salt_of(df.select(*used), salts, list(distinct) or salt_by))
    phase1, phase2 = [], []
    for fn, col, alias in aggs:
        if fn == "avg":
            phase1 += [F.sum(col).alias(f"_{alias}_s"), F.count(col).alias(f"_{alias}_c")]
            phase2.append((F.sum(f"_{alias}_s") / F.sum(f"_{alias}_c")).alias(alias))
        elif fn == "count_distinct":
            phase1.append(F.count_distinct(F.col(col)).alias(f"_{alias}"))
            phase2.append(F.sum(f"_{alias}").alias(alias))
        elif fn in _PARTIAL:
            p, f = _PARTIAL[fn]
            c = F.lit(1) if col == "*" else F.col(col)
            phase1.append(p(c).alias(f"_{alias}"))
            phase2.append(f(F.col(f"_{alias}")).alias(alias))
        else:
            raise ValueError(f"{fn!r} is not decomposable")
    return s.groupBy(*keys, "_salt").agg(*phase1).groupBy(*keys).agg(*phase2)


# ---------------------------------------------------------------------------
# C8 / C9 — skew-resistant joins
# ---------------------------------------------------------------------------


def salted_join(left: DataFrame, right: DataFrame, on, salts: int = 8, how: str = "inner", salt_by: list[str] | None = None) -> DataFrame:
    """The left side gets a salt (of ``salt_by``, or of its content), the right side is replicated once
    per salt, and the pair joins on ``(keys, salt)`` by a shuffle.  A hot key's left rows are
    spread over ``salts`` partitions.  Right/full outer joins are refused
    (unmatched right rows would repeat once per salt)."""
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted join cannot produce a {how!r} join")
    keys = [on] if isinstance(on, str) else list(on)
    l = left.withColumn("_salt", salt_of(left, salts, salt_by))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return l.join(r.hint("merge"), keys + ["_salt"], how).drop("_salt")


def split_join(left: DataFrame, right: DataFrame, on: str, hot, how: str = "inner", salts: int = 16,
               salt_by: list[str] | None = None, max_hot_keys: int = 10_000) -> DataFrame:
    """One shuffle join in which the rows of hot keys alone are salted.

    ``hot`` is a list of keys or a one-column DataFrame such as :func:`hot_keys`.  A
    left row of a hot key gets one of ``salts`` salts (of ``salt_by``, or of its
    content), all others salt 0; a right row of a hot key is there once per salt.  So
    each side is read once, a hot key is spread over ``salts`` partitions, and only
    the right rows of hot keys are repeated.  Rows with a NULL key match nothing and are spread as well.

    Keys beyond the first ``max_hot_keys`` (which bounds the broadcast of the keys) are
    joined unsalted: that is slower for them, the result is the same.  ``hot`` is read
    for each side and has to give the same keys both times.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"split join cannot produce a {how!r} join")
    if isinstance(hot, DataFrame):
        few = hot.select(F.col(hot.columns[0]).alias("_hot")).where(F.col("_hot").isNotNull()).distinct().orderBy("_hot").limit(max_hot_keys)

        def marked(df: DataFrame) -> DataFrame:
            return df.join(F.broadcast(few), F.col(on) == F.col("_hot"), "left").withColumn("_hot", F.col("_hot").isNotNull())
    else:
        keys = sorted({k for k in hot if k is not None})[:max_hot_keys]

        def marked(df: DataFrame) -> DataFrame:
            return df.withColumn("_hot", F.coalesce(F.col(on).isin(keys), F.lit(False)) if keys else F.lit(False))

    own = salt_of(left, salts, salt_by)
    l = marked(left).withColumn("_salt", F.when(F.col("_hot") | F.col(on).isNull(), own).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    r = marked(right).withColumn("_salt", F.explode(every)).drop("_hot")
    return l.join(r.hint("merge"), [on, "_salt"], how).drop("_salt")


# ---------------------------------------------------------------------------
# C11 / C12 — job runner and plan application
# ---------------------------------------------------------------------------


def run_fact_dim_job(spark, fact_path: str, dim_path: str, out_path: str, on: str, by: str, dim_on: str | None = None) -> None:
    """C11: read two parquet inputs, join, count per ``by``, overwrite parquet.
    ``dim_on`` is the key's name in the dimension where it is another one."""
    fact = spark.read.parquet(fact_path)
    dim = reconcile(spark.read.parquet(dim_path), [(dim_on, on)] if dim_on else [])
    join_count(fact, dim, on, by).write.mode("overwrite").parquet(out_path)


def apply_plan(fact: DataFrame, dim: DataFrame, on: str, plan: dict, by=None) -> DataFrame:
    """Run a fix plan (B2/B3 row as a dict) on a fact–dim pair.

    The rename comes first, then the join.  With ``by`` the joined rows are counted
    per ``by``; that aggregate takes the plan's repartition, not the join's input.
    """
    if plan.get("rename_old") and plan.get("rename_new"):
        fact = reconcile(fact, [(plan["rename_old"], plan["rename_new"])])
    joined = auto_join(fact, dim, on) if plan.get("broadcast") else fact.join(dim, on)
    if by is None:
        return joined
    n = plan.get("repartition")
    return agg_repartitioned(joined, by, [F.count(F.lit(1)).alias("count")], n, "by_key" if n else "combine")
