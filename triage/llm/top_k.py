"""Exact top-k inner products by distributed histogram selection.

Every component x becomes the integer floor(256 x), so scores are integers.
Queries and candidates are packed into blocks; a task meets a group of queries
with a part of the candidates and scores all pairs.

1. Each query starts with the range of scores that its norm and the longest
   candidate allow (Cauchy-Schwarz).  A pass counts its scores in 512 equal bins of
   the range; the counts of all tasks are added up, and the bin in which the k-th
   highest score lies is the next range.  Passes go on until that bin has one value
   (two passes for unit vectors, whatever their number).
2. A last pass keeps the scores above the k-th value, and of those equal to it
   the smallest ids: a task gives at most as many of them as are still needed.

A task reports only bins at or above the one with its own k-th score: the k-th
score of all candidates can't be lower.  So a pass sends at most k counts a query
and task, and no scores.  A repeated pass over the same blocks gives the same rows.

Edge cases: vectors that are null, empty or hold null or non-finite components,
or whose integers' squares add up to 2^62 or more (their scores need not fit a
long), take no part, nor do rows with null ``vec_id``.  Rows that repeat a
``vec_id`` are candidates each for itself, but none for a query of that id;
repeated rows of a query are one query, different vectors of one id are ranked
each for itself.  Vectors of different lengths are not compared.  Fewer than k
candidates are all ranked; without candidates, or with an empty table, there are
no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

SCALE, BINS = 256, 512
GROUP_QUERIES, PART_BYTES, LEAST_ROWS, BLOCK_ROWS, AT_ONCE = 8_192, 1 << 26, 2_048, 512, 1 << 20
BLOCKS = "dims int, rows long, longest double, ids binary, data binary"


def integers(vector: pa.Scalar, scale: int) -> np.ndarray | None:
    """floor(scale x) of a vector's components; None if it takes no part."""
    if not vector.is_valid or not len(vector.values) or vector.values.null_count:
        return None
    x = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return x.astype(np.int64) if np.isfinite(x).all() and float(x @ x) < 2.0**61.999 else None


def _integers(scale: int):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [integers(v, scale) for v in batch["embedding"]]
            keep = np.array([x is not None for x in found], bool) & np.asarray(batch["vec_id"].is_valid())
            kept = [found[k] for k in np.flatnonzero(keep)]
            norms = pa.array([float(np.sqrt((x.astype(np.float64) ** 2).sum())) for x in kept], pa.float64())
            dims, data = pa.array([len(x) for x in kept], pa.int32()), pa.array([x.tobytes() for x in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(keep)), dims, norms, data], names=["vec_id", "dims", "norm", "data"])

    return convert


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: ids and integers side by side."""
    for batch in batches:
        dims = batch["dims"].to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for low in range(0, len(at), BLOCK_ROWS):
                some = batch.take(pa.array(at[low : low + BLOCK_ROWS]))
                data = np.frombuffer(b"".join(some["data"].to_pylist()), np.int64).reshape(-1, d)
                longest = max(some["norm"].to_pylist())
                small = data.astype(np.int16) if np.abs(data).max() < 1 << 15 else data
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(data)], pa.int64()), pa.array([longest]), pa.array([some["vec_id"].to_numpy().tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary())],
                                                 names=["dims", "rows", "longest", "ids", "data"])


def matrix(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * rows * dims else np.int64).reshape(rows, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a bᵀ, exact: in doubles where every sum fits them, else in 64-bit integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Group:
    """Some queries with their ranges, and what a task has counted or kept for them."""

    def __init__(self, rows: list[dict], dims: int, k: int):
        self.k, self.qno = k, np.array([r["qno"] for r in rows])
        self.ids = np.array([r["vec_id"] for r in rows])
        self.low, self.span, self.above = (np.array([r[c] for r in rows], np.int64) for c in ("low", "span", "above"))
        self.width = np.maximum(-(-self.span // BINS), 1)
        self.vectors = np.stack([np.frombuffer(r["data"], np.int64) for r in rows])
        self.counts = np.zeros((len(rows), BINS), np.int64)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def pairs(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Scores of some queries with a block, and which of them are other rows than the query's."""
        step = max(1, AT_ONCE // len(ids))
        for a in range(0, len(self.qno), step):
            b = min(a + step, len(self.qno))
            yield a, b, products(self.vectors[a:b], vectors), ids[None, :] != self.ids[a:b, None]

    def count(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a, b, scores, other in self.pairs(ids, vectors):
            beyond = scores - self.low[a:b, None]
            row, col = np.nonzero(other & (beyond >= 0) & (beyond < self.span[a:b, None]))
            bins = beyond[row, col] // self.width[a:b][row]
            self.counts[a:b] += np.bincount(row * BINS + bins, minlength=(b - a) * BINS).reshape(b - a, BINS)

    def keep(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a, b, scores, other in self.pairs(ids, vectors):
            row, col = np.nonzero(other & (scores >= self.low[a:b, None]))
            self.kept.append((row + a, ids[col], scores[row, col]))
            self.held += len(row)
        if self.held > AT_ONCE:
            self.reduce()

    def reduce(self) -> None:
        """Of a query's kept scores the k highest, ties to the smaller id: no other can be among those of all tasks."""
        if not self.kept:
            return
        q, ids, scores = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.kept, self.held = [(q[best], ids[best], scores[best])], int(best.sum())

    def counted(self) -> pa.RecordBatch:
        """Bins from the highest down to that of the task's own k-th score, empty ones left out."""
        higher = np.cumsum(self.counts[:, ::-1], axis=1)[:, ::-1] - self.counts
        q, at = np.nonzero((self.counts > 0) & (higher + self.above[:, None] < self.k))
        return pa.RecordBatch.from_arrays([pa.array(self.qno[q]), pa.array(at.astype(np.int32)), pa.array(self.counts[q, at])], names=["c_qno", "bin", "n"])

    def found(self) -> pa.RecordBatch:
        self.reduce()
        q, ids, scores = self.kept[0] if self.kept else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(self.qno[q]), pa.array(self.ids[q]), pa.array(ids), pa.array(scores)], names=["f_qno", "query_id", "vec_id", "score"])


def _meet(k: int, last: bool):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, group = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["dims"], row["grp"], row["part"])
                if now != key:
                    if group is not None:
                        yield group.found() if last else group.counted()
                    key, queries, group = now, [], None
                if row["kind"] == 0:
                    queries.append(row)
                    continue
                if group is None:
                    if not queries:
                        continue
                    group = Group(queries, row["dims"], k)
                ids, vectors = np.frombuffer(row["ids"], np.int64), matrix(row["data"], row["rows"], row["dims"])
                (group.keep if last else group.count)(ids, vectors)
        if group is not None:
            yield group.found() if last else group.counted()

    return meet


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, group_queries: int = GROUP_QUERIES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each of ``queries`` with ``vectors``.

    Both have ``vec_id`` and ``embedding``; a query's own ``vec_id`` is no candidate.
    """

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    convert = _integers(scale)
    blocks = scratch.saved(rows(vectors).mapInArrow(lambda batches: _packed(convert(batches)), BLOCKS), "topk-blocks").withColumn("block", F.monotonically_increasing_id())
    asked = rows(queries).mapInArrow(convert, "vec_id long, dims int, norm double, data binary").distinct()
    asked = scratch.saved(asked.withColumn("qno", F.monotonically_increasing_id()), "topk-queries")
    n_rows, n_bytes, n_blocks = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.length("data")), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-asked.count() // group_queries))
    parts = max(1, min(n_blocks, max(-(-n_bytes // part_bytes), min(64, n_rows // LEAST_ROWS))))
    none = F.lit(None).cast("long")
    candidates = blocks.select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"),
        none.alias("vec_id"), "rows", "ids", "data", F.col("block").alias("qno"), none.alias("low"), none.alias("span"), none.alias("above"))

    def meeting(state: DataFrame, last: bool, schema: str) -> DataFrame:
        """Every open query against every candidate, a task for each group and part."""
        now = asked.join(state.withColumnRenamed("qno", "s_qno"), F.col("qno") == F.col("s_qno"))
        grouped = now.select(
            "dims", F.pmod(F.xxhash64("qno"), F.lit(groups)).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"),
            "vec_id", F.lit(1).cast("long").alias("rows"), F.lit(None).cast("binary").alias("ids"), "data", "qno", "low", "span", "above")
        both = grouped.union(candidates).repartition(2 * groups * parts, "dims", "grp", "part").sortWithinPartitions("dims", "grp", "part", "kind", "qno")
        return both.mapInArrow(_meet(k, last), schema)

    longest = blocks.groupBy(F.col("dims").alias("l_dims")).agg(F.max("longest").alias("longest"))
    reach = F.least(F.ceil(F.col("norm") * F.col("longest") * 1.000001 + 1), F.lit((1 << 62) - BINS)).cast("long")
    first = asked.join(longest, F.col("dims") == F.col("l_dims")).select("qno", reach.alias("reach"))
    state = first.select("qno", (-F.col("reach")).alias("low"), (2 * F.col("reach") + 1).alias("span"), F.lit(0).cast("long").alias("above"))
    state, settled = scratch.saved(state, "topk-state"), []
    width = F.expr(f"(span + {BINS - 1}) div {BINS}")
    downward = Window.partitionBy("c_qno").orderBy(F.col("bin").desc())
    while not state.isEmpty():
        counts = meeting(state, False, "c_qno long, bin int, n long").groupBy("c_qno", "bin").agg(F.sum("n").alias("n"))
        reached = counts.withColumn("upto", F.sum("n").over(downward)).join(state, F.col("c_qno") == F.col("qno"))
        kth = reached.where(F.col("above") + F.col("upto") >= k).groupBy("c_qno").agg(F.max("bin").alias("bin"), F.max_by(F.col("upto") - F.col("n"), "bin").alias("higher"))
        at = F.col("low") + F.coalesce("bin", F.lit(0)) * width
        found = state.join(kth, F.col("qno") == F.col("c_qno"), "left").select(
            "qno", at.alias("low"), F.when(F.col("bin").isNotNull() & (width > 1), F.least(width, F.col("low") + F.col("span") - at)).otherwise(0).alias("span"),
            (F.col("above") + F.coalesce("higher", F.lit(0))).alias("above"))
        found = scratch.saved(found, "topk-state")
        settled.append(found.where("span = 0"))  # the k-th score, or the lowest possible one if there are fewer
        state = found.where("span > 0")
    if not settled:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kept = meeting(reduce(DataFrame.union, settled), True, "f_qno long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("f_qno").orderBy(F.col("score").desc(), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
