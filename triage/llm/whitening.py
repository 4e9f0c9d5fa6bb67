"""Whitened leading components of embeddings, by spectrum slicing.

Entries become integers x = floor(scale c) + shift.

1. One pass gives the number of vectors n and the sums S, a second one, of vectors
   centred at the rounded mean a, the integer sums of z zᵀ (z = x - a).  With
   r = S - n a the covariance is (sum z zᵀ - r rᵀ / n) / n.  Integer sums don't depend
   on the order in which tasks report, so the model is the same on every run.
2. The number of positive pivots of the LDLᵀ factors of V - sI is the number of
   eigenvalues above s.  Halving an interval by these counts isolates each leading
   eigenvalue, or shows it to be one of several that are equal to rounding.
3. Rayleigh quotient iteration, started by inverse iteration in the interval and
   kept orthogonal to the components before it, converges cubically.  A result is
   taken when counts right above and right below it certify its number; otherwise
   the interval is halved on and the iteration begins anew.
4. A third pass projects the centred vectors.  The error of the identity is measured
   on the whitened values themselves.

The passes are sums over partitions; the fit of a (dimension x dimension) matrix is
one task, and the model (dimension x components) is all that goes back to the tasks.

Edge cases: vectors that are null, empty or hold null or non-finite entries, or
entries whose x doesn't fit 52 bits, are dropped; where vectors of several lengths
remain, those of the most frequent length (of several: the shortest) are the table
and the others are dropped.  Rows that repeat a ``vec_id`` count each for itself and
a null ``vec_id`` stays.  Components without variance (an eigenvalue below 1e-12 of
the largest) can't be whitened and have no rows, so equal vectors, a single vector
and an empty table give none.  ``deviation`` is null where it doesn't fit a long.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
NO_VARIANCE = 1e-12
BATCH_CELLS = 1 << 20


def inertia(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of LDLᵀ with symmetric (Bunch-Kaufman) pivoting."""
    m, k, above = a - shift * np.eye(len(a)), 0, 0
    n, alpha = len(m), (1 + 17**0.5) / 8
    floor = np.finfo(float).eps * max(np.abs(m).max(initial=0), np.finfo(float).tiny)

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < n:
        below = np.abs(m[k + 1 :, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        most = below.max(initial=0.0)
        width = 1
        if most > 0 and abs(m[k, k]) < alpha * most:
            others = np.abs(m[r, k:].copy())
            others[r - k] = 0
            if abs(m[k, k]) * others.max() < alpha * most**2:
                if abs(m[r, r]) >= alpha * others.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    width = 2
        if width == 1:
            pivot = m[k, k] if abs(m[k, k]) > floor else -floor
            above += pivot > 0
            column = m[k + 1 :, k] / pivot
            m[k + 1 :, k + 1 :] -= np.outer(column, m[k, k + 1 :])
        else:
            block = m[k : k + 2, k : k + 2]
            above += 1  # a pivot of two by two that pivoting chooses has one eigenvalue of each sign
            rest = m[k + 2 :, k : k + 2]
            m[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        k += width
    return above


def leading(v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and unit eigenvectors as rows; those without variance are left out."""
    d = len(v)
    bound = float(np.abs(v).sum(axis=1).max(initial=0))  # no eigenvalue is larger
    if not bound > 0:
        return np.zeros(0), np.zeros((0, d))
    tiny = 8 * d * np.finfo(float).eps * bound
    counts: dict[float, int] = {bound + tiny: 0, -bound - tiny: d}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(v, shift)
        return counts[shift]

    def interval(j: int) -> tuple[float, float]:
        """The narrowest known interval with the j-th eigenvalue."""
        return max(s for s, c in counts.items() if c >= j), min(s for s, c in counts.items() if c < j)

    values, vectors = [], np.zeros((0, d))
    start = np.random.default_rng(0).normal(size=(components, d))

    def free(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - vectors.T @ (vectors @ x)
        return x / np.linalg.norm(x)

    def solved(shift: float, x: np.ndarray) -> np.ndarray:
        m = v - shift * np.eye(d)
        try:
            y = np.linalg.solve(m, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(m + tiny * np.eye(d), x)
        return free(y) if np.isfinite(y).all() and np.linalg.norm(y) > 0 else x

    for j in range(1, min(components, d) + 1):
        low, high = interval(j)
        while True:
            while high - low > tiny and (count(high) != j - 1 or count(low) != j or high - low > 0.25 * max(abs(high), abs(low))):
                middle = (low + high) / 2
                low, high = (middle, high) if count(middle) >= j else (low, middle)
            x = free(start[j - 1])
            for _ in range(2):
                x = solved((low + high) / 2, x)
            for _ in range(12):
                value = float(x @ v @ x)
                residual = float(np.linalg.norm(v @ x - value * x))
                if residual <= tiny / 8 or not low - tiny <= value <= high + tiny:
                    break
                x = solved(value, x)
            value = float(x @ v @ x)
            near = max(tiny, 2 * float(np.linalg.norm(v @ x - value * x)))
            if high - low <= tiny or (low - near <= value <= high + near and near <= 64 * tiny and count(value + near) < j <= count(value - near)):
                break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= j else (low, middle)
        values.append(value)
        vectors = np.concatenate([vectors, x[None, :]])
    order = np.argsort(-np.array(values), kind="stable")
    e, vectors = np.array(values)[order], vectors[order]
    kept = e > NO_VARIANCE * e[0]
    return e[kept], vectors[kept]


def _entries(scale: int, shift: int):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``x`` as bytes of 64-bit integers, of the vectors that remain."""
        for batch in batches:
            found = []
            for v in batch["embedding"]:
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale) + shift
                    x = x.astype(np.int64) if np.isfinite(x).all() and np.abs(x).max() < 1 << 52 else None
                found.append(x)
            keep = pa.array([x is not None for x in found], pa.bool_())
            kept = [x for x in found if x is not None]
            yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(keep), pa.array([len(x) for x in kept], pa.int32()), pa.array([x.tobytes() for x in kept], pa.binary())], names=["vec_id", "dims", "x"])

    return convert


def _rows(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BATCH_CELLS // dims)
    for low in range(0, batch.num_rows, step):
        some = batch.slice(low, step)
        yield some, np.frombuffer(b"".join(some["x"].to_pylist()), np.int64).reshape(-1, dims)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums, in Python integers where 64 bits could be too few."""
    wide = float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62
    return (x.astype(object) if wide else x).sum(axis=0)


def exact_product(z: np.ndarray) -> np.ndarray:
    """zᵀ z in integers: in doubles as long as they hold every sum."""
    most = float(np.abs(z).max(initial=0))
    if most * most * len(z) < 2.0**53:
        y = z.astype(np.float64)
        return (y.T @ y).astype(np.int64)
    return z.astype(object).T @ z.astype(object)


def _summed(dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            for _, x in _rows(batch, dims):
                n, total = n + len(x), total + exact_sum(x)
        if n:
            yield _parts(np.zeros(dims, np.int32), np.arange(dims, dtype=np.int32), total.tolist(), n)

    return add


def _parts(row: np.ndarray, column: np.ndarray, values: list[int], n: int) -> pa.RecordBatch:
    """Integers as high 2^32 + low, so that sums of both parts fit longs."""
    high, low = pa.array([int(v) >> 32 for v in values], pa.int64()), pa.array([int(v) & 0xFFFF_FFFF for v in values], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), high, low, pa.array(np.full(len(values), n, np.int64))], names=["row", "col", "high", "low", "n"])


PARTS = "row int, col int, high long, low long, n long"


def _products(dims: int, a: list[int]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, centre = 0, np.zeros((dims, dims), object), np.array(a, np.int64)
        part, parted = np.zeros((dims, dims), np.int64), 0.0
        for batch in batches:
            for _, x in _rows(batch, dims):
                more = exact_product(x - centre)
                most = float(np.abs(more).max(initial=0))
                if more.dtype == object or parted + most >= 2.0**62:
                    total, part, parted = total + part + more, np.zeros((dims, dims), np.int64), 0.0
                else:
                    part, parted = part + more, parted + most
                n += len(x)
        if n:
            total = total + part
            for i in range(dims):
                yield _parts(np.full(dims - i, i, np.int32), np.arange(i, dims, dtype=np.int32), total[i, i:].tolist(), n)

    return add


def _added(parts: DataFrame) -> DataFrame:
    value = (F.sum("high").cast("decimal(38,0)") * F.lit(1 << 32) + F.sum("low")).cast("string")
    return parts.groupBy("row", "col").agg(value.alias("value"), F.sum("n").alias("n"))


MODEL = "component int, value double, explained double, vector binary"


def _fitted(dims: int, n: int, rest: list[int], components: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros((dims, dims))
        empty = True
        for batch in batches:
            for row in batch.to_pylist():
                empty, i, j = False, row["row"], row["col"]
                v[i, j] = v[j, i] = float(Fraction(int(row["value"]) * n - rest[i] * rest[j], n * n))
        if empty:
            return
        e, vectors = leading(v, components)
        if len(e):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(1, len(e) + 1, dtype=np.int32)), pa.array(e), pa.array(e / np.trace(v)), pa.array([x.tobytes() for x in vectors], pa.binary())], names=["component", "value", "explained", "vector"])

    return fit


def _projected(dims: int, n: int, a: list[int], rest: list[int], values: list[float], vectors: np.ndarray):
    centre, off = np.array(a, np.int64), np.array([float(Fraction(r, n)) for r in rest])
    weights = vectors.T / np.sqrt(np.array(values))
    most = max(map(abs, rest), default=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _rows(batch, dims):
                z = x - centre
                reach = float(np.abs(z).max(initial=0)) * n + most
                apart = z * n - np.array(rest, np.int64) if reach < 2.0**62 else z.astype(object) * n - np.array(rest, object)
                square = (apart if reach * reach * dims < 2.0**62 else apart.astype(object)) ** 2
                deviation = [int(y) if y < 1 << 63 else None for y in square.sum(axis=1).tolist()]
                white = (z - off) @ weights
                yield pa.RecordBatch.from_arrays([some["vec_id"], pa.array(deviation, pa.int64())] + [pa.array(white[:, k]) for k in range(white.shape[1])], names=["vec_id", "deviation", *[f"w{k}" for k in range(white.shape[1])]])

    return project


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector and leading component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    entries = scratch.saved(rows.mapInArrow(_entries(scale, shift), "vec_id long, dims int, x binary"), "whitening-entries")
    common = entries.groupBy("dims").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "dims")).alias("most")).first().most
    if common is None:
        return spark.createDataFrame([], RESULT)
    dims, n = common.dims, -common.n
    entries = entries.where(F.col("dims") == dims)
    total = [int(r.value) for r in _added(entries.select("x").mapInArrow(_summed(dims), PARTS)).orderBy("col").collect()]  # a number a dimension
    a = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, a)]
    sums = _added(entries.select("x").mapInArrow(_products(dims, a), PARTS))
    model = scratch.saved(sums.coalesce(1).mapInArrow(_fitted(dims, n, rest, components), MODEL), "whitening-model").orderBy("component").collect()
    if not model:
        return spark.createDataFrame([], RESULT)
    axes = np.stack([np.frombuffer(r.vector, np.float64) for r in model])
    names = [f"w{k}" for k in range(len(model))]
    white = scratch.saved(entries.select("vec_id", "x").mapInArrow(_projected(dims, n, a, rest, [r.value for r in model], axes), "vec_id long, deviation long, " + ", ".join(f"{c} double" for c in names)), "whitening-rows")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    errors = white.agg(*[F.abs(F.covar_pop(names[i], names[j]) - float(i == j)).alias(f"e{i}_{j}") for i, j in pairs]).first()
    each = F.explode(F.array(*[F.struct(F.lit(r.component).alias("component"), F.col(c).alias("whitened"), F.lit(r.explained).alias("explained")) for r, c in zip(model, names)])).alias("one")
    return white.select("vec_id", "deviation", each).select("vec_id", "one.component", F.lit(n).cast("long").alias("n"), "deviation", "one.whitened", "one.explained", F.lit(float(max(errors))).alias("identity_error"))
