"""Gapless numbers within keys of any size, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_within(df: DataFrame, key: str, ties: list[str], rows: int, name: str, bucket_rows: int = 200, along: str | None = None) -> DataFrame:
    """Add ``name``: 0, 1, ... within each value of ``key``.

    Rows are dealt by a hash of ``ties`` into buckets of a key, numbered in
    their bucket, and moved up by the rows of the key's earlier buckets.  Of a
    key with a share s of the ``rows``, a bucket holds about s times
    ``bucket_rows`` rows (more where there are over a million buckets a key).
    ``df`` must give the same rows whenever it is read, as a table does.  With ``along``,
    a column of numbers from 0 on, the buckets are ranges of it and the numbers run along
    it; rows with one number in it are in one bucket.
    """
    buckets = max(1, min(rows // bucket_rows, 1_000_000))
    bucket = F.pmod(F.xxhash64(*ties), F.lit(buckets))
    if along is not None:
        width = ((df.agg(F.max(along)).first()[0] or 0) + 1 + buckets - 1) // buckets
        bucket, ties = F.expr(f"`{along}` div {width}"), [along, *ties]
    dealt = df.withColumn("__bucket", bucket)
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
        .select(F.col(key).alias("__key"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(key, "__bucket").orderBy(*ties)
    numbered = dealt.withColumn("__row", F.row_number().over(inside) - 1)
    return (
        numbered.join(before, (F.col(key) == F.col("__key")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(name, F.col("__row") + F.col("__before"))
        .drop("__bucket", "__key", "__b", "__before", "__row")
    )
