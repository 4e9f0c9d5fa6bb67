"""Connected components of a distributed link list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


class Forest:
    """Union-find over ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``links(a, b)``: the smallest node that links reach.

    Each step takes the smallest label among a node and its neighbours, then
    the label of that label, so long chains close in a logarithmic number of
    steps.  Each step is a table; a node with very many links is combined
    before the shuffle and split by the adaptive joins.
    """
    spark = links.sparkSession
    both = scratch.saved(links.select("a", "b").union(links.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), "links")
    path = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        old = spark.read.schema("node long, label long").parquet(path)
        near = both.join(old, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = old.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = old.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = low.join(jump, F.col("low") == F.col("to")).select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("old")).alias("moved"))
        next_path = scratch.save(new, "labels")
        moved = spark.read.parquet(next_path)
        done = moved.where("moved").isEmpty()
        scratch.remove(spark, path)
        path = next_path
        if done:
            return moved.select("node", "label")
