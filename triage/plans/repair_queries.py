"""Registered data-repair queries (family C) over the TPC-H-style tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import repair as R
from ..sources.tables import read_table

# Fixture: a lineitem key with one key holding most rows (lines 1-4 of every
# order map to supplier 0).  Same expression in the oracle.
HOT_KEY_SQL = "CASE WHEN l_linenumber <= 4 THEN 0 ELSE l_suppkey END"


def hot_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        F.expr(HOT_KEY_SQL).alias("sk"),
    )


def q_skew_profile_suppkey(spark, sf_dir):
    return R.skew_profile(read_table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey")


def q_skew_profile_hot(spark, sf_dir):
    return R.skew_profile(hot_lineitem(spark, sf_dir).select("sk"), "sk")


def q_top_keys_hot(spark, sf_dir):
    return R.top_keys(hot_lineitem(spark, sf_dir).select("sk"), "sk", 10)


def q_broadcast_join(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    su = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"
    )
    return R.broadcast_join(li, su, "l_suppkey")


def q_auto_join(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_nationkey")
    return R.auto_join(o, c, "custkey")


def q_join_count(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    return R.join_count(o, c, "custkey", "c_nationkey")


def q_agg_repartitioned(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return R.agg_repartitioned(
        li,
        "l_orderkey",
        [F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n_lines")],
        n=8,
    )


def q_salted_agg(spark, sf_dir):
    out = R.salted_agg(
        hot_lineitem(spark, sf_dir),
        "sk",
        [
            ("count", "*", "n"),
            ("sum", "l_quantity", "sum_qty"),
            ("sum", "l_extendedprice", "sum_price"),
            ("min", "l_extendedprice", "min_price"),
            ("max", "l_extendedprice", "max_price"),
            ("avg", "l_discount", "avg_disc"),
        ],
        salts=16,
        salt_by=["l_orderkey", "l_linenumber"],
    )
    return out.select(
        "sk", "n", "sum_qty", F.round("sum_price", 2).alias("sum_price"), "min_price", "max_price",
        F.round("avg_disc", 6).alias("avg_disc"),
    )


def q_salted_distinct(spark, sf_dir):
    """C7 for the aggregate that needs it: exact distinct counts under a hot key."""
    aggs = [("count", "*", "n"), ("count_distinct", "l_orderkey", "n_orders"), ("max", "l_quantity", "max_qty")]
    return R.salted_agg(hot_lineitem(spark, sf_dir), "sk", aggs)


def _supplier_dim(spark, sf_dir):
    return read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"), "s_nationkey")


def q_salted_join(spark, sf_dir):
    li = hot_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "sk")
    return R.salted_join(li, _supplier_dim(spark, sf_dir), "sk", salts=8, salt_by=["l_orderkey", "l_linenumber"])


def q_split_join(spark, sf_dir):
    li = hot_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "sk")
    hot = R.hot_keys(li, "sk", min_share=0.01)
    return R.split_join(li, _supplier_dim(spark, sf_dir), "sk", hot, salt_by=["l_orderkey", "l_linenumber"])


def q_reconcile(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.reconcile(o, [("o_totalprice", "amount"), ("o_custkey", "user_id"), ("absent", "x")])


QUERIES = {
    "skew_profile_suppkey": q_skew_profile_suppkey,
    "skew_profile_hot": q_skew_profile_hot,
    "top_keys_hot": q_top_keys_hot,
    "broadcast_join": q_broadcast_join,
    "auto_join": q_auto_join,
    "join_count": q_join_count,
    "agg_repartitioned": q_agg_repartitioned,
    "salted_agg": q_salted_agg,
    "salted_distinct": q_salted_distinct,
    "salted_join": q_salted_join,
    "split_join": q_split_join,
    "reconcile": q_reconcile,
}

_PROFILE = """SELECT CAST(sum(n) AS BIGINT) AS total_records, CAST(count(*) AS BIGINT) AS n_keys,
  arg_min(k, (-n, k)) AS hotkey, CAST(max(n) AS BIGINT) AS hotkey_count,
  round(max(n) / sum(n), 4) AS skew_ratio
FROM (SELECT {key} AS k, count(*) AS n FROM ({src}) GROUP BY 1)"""
_HOT = f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, {HOT_KEY_SQL} AS sk FROM lineitem"

ORACLE = {
    "skew_profile_suppkey": _PROFILE.format(key="l_suppkey", src="SELECT l_suppkey FROM lineitem").replace(
        "AS hotkey", "AS hotkey"
    ),
    "skew_profile_hot": _PROFILE.format(key="sk", src=_HOT),
    "top_keys_hot": f"""SELECT CAST(row_number() OVER (ORDER BY n DESC, sk) AS BIGINT) AS rank, sk, n,
  round(n / (SELECT count(*) FROM lineitem), 4) AS share
FROM (SELECT sk, CAST(count(*) AS BIGINT) AS n FROM ({_HOT}) GROUP BY sk) ORDER BY n DESC, sk LIMIT 10""",
    "broadcast_join": """SELECT l_suppkey, l_orderkey, l_linenumber, s_name, s_nationkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "auto_join": """SELECT o_custkey AS custkey, o_orderkey, c_name, c_nationkey
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "join_count": """SELECT c_nationkey, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_nationkey""",
    "agg_repartitioned": """SELECT l_orderkey, sum(l_quantity) AS sum_qty, count(*) AS n_lines FROM lineitem
GROUP BY l_orderkey""",
    "salted_agg": f"""SELECT sk, count(*) AS n, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
  min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, round(avg(l_discount), 6) AS avg_disc
FROM ({_HOT}) GROUP BY sk""",
    "salted_distinct": f"""SELECT sk, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, max(l_quantity) AS max_qty
FROM ({_HOT}) GROUP BY sk""",
    "salted_join": f"""SELECT h.sk, l_orderkey, l_linenumber, s_nationkey
FROM ({_HOT}) h JOIN supplier ON h.sk = s_suppkey""",
    "split_join": f"""SELECT h.sk, l_orderkey, l_linenumber, s_nationkey
FROM ({_HOT}) h JOIN supplier ON h.sk = s_suppkey""",
    "reconcile": "SELECT o_orderkey, o_custkey AS user_id, o_totalprice AS amount FROM orders",
}
