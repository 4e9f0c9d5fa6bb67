"""Sizes that are known without running a job.

A frame whose plan only reads files and never adds rows to what it reads has at most
the rows of those files.  Parquet footers hold their number and the bytes of the
columns; the optimizer's statistics add what the plan makes of them.  Anything else
has no proven size: such a side is joined by a shuffle, and Spark decides at run
time from the sizes it has measured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

MAX_ROWS = 10_000_000
MAX_FILES = 1_000  # footers read on the driver
# Plan nodes that give at most a row for each row they read.
KEEPS = {"Project", "Filter", "Aggregate", "Distinct", "Deduplicate", "Union", "SubqueryAlias", "View", "Sort", "GlobalLimit", "LocalLimit",
         "Repartition", "RepartitionByExpression", "RebalancePartitions", "Window", "ResolvedHint"}


@dataclass(frozen=True)
class Size:
    """At most so many rows and bytes."""

    rows: int
    bytes: int


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _footers(spark, relation) -> Size | None:
    """Rows and uncompressed bytes of a scan's parquet files."""
    files = list(relation.inputFiles())
    if len(files) > MAX_FILES:
        return None
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = size = 0
    for name in files:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            for block in reader.getFooter().getBlocks():
                rows, size = rows + block.getRowCount(), size + block.getTotalByteSize()
        finally:
            reader.close()
    return Size(rows, size)


def _leaf(spark, node, limit: int) -> Size | None:
    name = node.getClass().getSimpleName()
    if name == "LocalRelation":
        return Size(node.data().size(), int(node.stats().sizeInBytes()))
    if name == "Range":
        n = int(str(node.numElements()))
        return Size(n, 8 * n)
    if name != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    relation = node.relation()
    if relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat" or relation.location().sizeInBytes() > limit:
        return None  # what is larger compressed is not read at all
    return _footers(spark, relation)


def _bound(spark, node, limit: int) -> Size | None:
    children = _items(node.children())
    if not children:
        return _leaf(spark, node, limit)
    if node.getClass().getSimpleName() == "Join" and node.joinType().toString() in ("LeftSemi", "LeftAnti"):
        children = children[:1]
    elif node.getClass().getSimpleName() not in KEEPS:
        return None
    parts = [_bound(spark, child, limit) for child in children]
    if any(p is None for p in parts):
        return None
    return Size(sum(p.rows for p in parts), sum(p.bytes for p in parts))


def proven_size(df: DataFrame, limit: int) -> Size | None:
    """The most rows and bytes ``df`` can have, or None if that is not known to be
    within ``limit`` bytes.  Starts no job."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = _bound(df.sparkSession, plan, limit)
    if size is None:
        return None
    wide = sum(field.dataType().defaultSize() for field in _items(df._jdf.schema()))
    return Size(size.rows, max(size.bytes, size.rows * wide))


def fits_broadcast(df: DataFrame, max_bytes: int, max_rows: int = MAX_ROWS) -> bool:
    size = proven_size(df, max_bytes)
    return size is not None and size.rows <= max_rows and size.bytes <= max_bytes


def input_bytes(df: DataFrame) -> int:
    """Bytes of what ``df`` reads, by the optimizer's statistics; 0 where they don't tell."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = sum(int(str(leaf.stats().sizeInBytes())) for leaf in _items(plan.collectLeaves()))
    return size if size < 1 << 50 else 0
