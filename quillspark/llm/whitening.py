"""Whitening of embeddings: exact distributed scatter, eigenvectors by cyclic Jacobi rotations on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, only

#: An entry c becomes floor(SCALE * c) + OFFSET. Entries of this size or more can't be summed exactly and are an error.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**33
#: Sweeps of rotations at most (ten is already more than quadratic convergence leaves to do); rows of a product at a time.
SWEEPS, ROWS = 60, 4096


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix.

    A sweep takes each off-diagonal entry to zero once, by a rotation. Rounds of a tournament order them, so that the
    rotations of a round touch different rows and are done at once. Sweeps go on until every off-diagonal entry is
    negligible beside the geometric mean of its two diagonal ones, which is what keeps small eigenvalues accurate.
    """
    d = len(a)
    a, v = np.array(a, np.float64), np.eye(d)
    if d < 2:
        return np.diag(a).copy(), v
    order = list(range(d + d % 2))  # an odd one sits out each round
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(order) - 1):
            p, q = (np.array(x) for x in zip(*[(min(x, y), max(x, y)) for x, y in zip(order[: len(order) // 2], order[::-1]) if max(x, y) < d], strict=True))
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            need = np.abs(apq) > np.finfo(float).eps * np.sqrt(np.abs(app * aqq))
            if need.any():
                turned = True
                p, q, app, aqq, apq = p[need], q[need], app[need], aqq[need], apq[need]
                tau = (aqq - app) / (2 * apq)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau))
                c = 1 / np.sqrt(1 + t * t)
                s = t * c
                for m in (a, v):
                    mp, mq = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
                ap, aq = a[p].copy(), a[q].copy()
                a[p], a[q] = c[:, None] * ap - s[:, None] * aq, s[:, None] * ap + c[:, None] * aq
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            order = [order[0], order[-1], *order[1:-1]]
        if not turned:
            break
    else:
        raise ArithmeticError("the rotations don't settle")
    e = np.diag(a)
    first = np.argsort(-e, kind="stable")
    return e[first], v[:, first]


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """A batch of vectors as rows of x."""
    return (np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + OFFSET).astype(np.int64).reshape(-1, d)


def _exact(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: by doubles as long as no sum can pass 2**53, by Python's integers where one entry can."""
    most = int(np.abs(y).max(initial=0))
    if most >= 1 << 26:
        return y.astype(object).T @ y.astype(object)
    out, rows = 0, max(1, min(ROWS, (1 << 53) // max(1, most * most)))
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def scatter(rows: DataFrame, d: int, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of y = x - ``centre`` and of y'y, as whole numbers. A task sends d + d (d + 1) / 2 sums."""
    at = np.concatenate([np.full(d, -1), np.repeat(np.arange(d), np.arange(d, 0, -1))])
    beside = np.concatenate([np.arange(d), *[np.arange(k, d) for k in range(d)]])
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = products = None
        for batch in batches:
            y = integers(batch.column(0), d) - centre
            if len(y):
                own = _exact(y)
                sums, products = (y.sum(0).astype(object), own) if sums is None else (sums + y.sum(0), products + own)
        if sums is not None:
            values = [Decimal(int(v)) for v in np.concatenate([sums, products[upper]])]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(beside, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"])

    got = rows.select("v").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for r in got:
        if r["i"] < 0:
            sums[r["j"]] = int(r["v"])
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["v"])
    return sums, products


def whitened(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows of ``vectors`` along the first principal components of x = floor(1024 * c) + 100000, scaled to variance 1.

    Two scans sum x, then the products of x less its rounded mean, in whole numbers, so the covariance is exact but for
    one rounding and does not depend on how rows are dealt. The driver holds only d x d numbers (d, the length of a
    vector). The rotated axes, sorted by eigenvalue and divided by its root, go to the tasks with the mean.

    Returns for each row and component: vec_id, component (from 1), n, deviation (a decimal: the sum over dimensions of
    (n * x - S)^2, exact), whitened, explained, identity_error (over all rows: the largest absolute entry of the written
    values' covariance less the identity). Rows whose vector is null or holds a null, NaN or infinity are left out; so
    are vectors of another length than the most frequent (ties: the longest). Null ids stay, repeated rows count each.
    A component without variance (one row, equal rows, dependent dimensions) has null for ``whitened`` and no share in
    ``identity_error``, which is null if none has any. Fewer dimensions than ``components`` give one for each dimension.
    A table without such rows gives none. An entry of 2**33 or more in absolute value is an error.
    """
    spark = vectors.sparkSession
    rows = only(vectors, id=id_col, v=vector_col).filter("v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.select("id", F.col("v").cast("array<double>").alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if size is None or not size["d"]:
        return spark.createDataFrame([], schema)
    if size["most"] >= LARGEST:
        raise ArithmeticError(f"an entry of {LARGEST:g} or more can't be whitened exactly")
    d, n = size["d"], size["n"]
    rows = rows.filter(F.size("v") == d)
    sums = _sums(rows, d)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest, products = scatter(rows, d, centre)  # rest = S - n * centre
    covariance = np.array([[float(Decimal(n * products[i, j] - rest[i] * rest[j]) / Decimal(n * n)) for j in range(d)] for i in range(d)])
    values, axes = jacobi(covariance)
    k = min(components, d)
    trace = float(Decimal(sum(n * products[i, i] - rest[i] * rest[i] for i in range(d))) / Decimal(n * n))
    real = values[:k] > d * np.finfo(float).eps * max(values[0], 0.0)
    scaled = np.where(real, axes[:, :k] / np.sqrt(np.where(real, values[:k], 1.0)), 0.0)
    shares = values[:k] / trace if trace > 0 else np.zeros(k)
    mean, constant = np.array([r / n for r in rest]), sum(r * r for r in rest)
    shared = spark.sparkContext.broadcast((centre, mean, [int(r) for r in rest], scaled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, mean, rest, scaled = shared.value
        for batch in batches:
            y = integers(batch.column(1), d) - centre
            fits = int(np.abs(y).max(initial=0)) * max(int(np.abs(y).max(initial=0)), *map(abs, rest), 1) * d < 1 << 63
            y_, rest_ = (y, np.array(rest, np.int64)) if fits else (y.astype(object), np.array(rest, object))
            squares, cross = (y_ * y_).sum(1), y_ @ rest_
            deviation = [Decimal(n * n * int(a) - 2 * n * int(b) + constant) for a, b in zip(squares, cross, strict=True)]
            out = pa.FixedSizeListArray.from_arrays(pa.array(((y - mean) @ scaled).ravel()), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.decimal128(38, 0)), out.cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    done = materialize(rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>"), "whitened")
    use = np.flatnonzero(real)
    error = _identity_error(done, k, use) if len(use) else None
    facts = F.array(*[F.struct(F.lit(float(s)).alias("explained"), F.lit(bool(r)).alias("real")) for s, r in zip(shares, real, strict=True)])
    each = done.withColumn("f", facts).select("vec_id", "deviation", F.posexplode(F.arrays_zip("w", "f")).alias("k", "z"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("z.f.real"), F.col("z.w")).alias("whitened"),
        F.col("z.f.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def _sums(rows: DataFrame, d: int) -> np.ndarray:
    """S, the sums of x by dimension."""
    got = rows.select(F.posexplode("v").alias("j", "c")).groupBy("j").agg(F.sum((F.floor(F.lit(SCALE) * F.col("c")) + OFFSET).cast("decimal(28,0)")).alias("s")).collect()
    sums = np.zeros(d, object)
    for r in got:
        sums[r["j"]] = int(r["s"])
    return sums


def _identity_error(done: DataFrame, k: int, use: np.ndarray) -> float:
    """How far the covariance of the written values is from the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = np.column_stack([np.ones(batch.num_rows), batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)])
            total += w.T @ w
        at, beside = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at.ravel(), pa.int32()), pa.array(beside.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((k + 1, k + 1))
    for r in done.select("w").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[0, 1:] / total[0, 0]
    return float(np.abs(total[1:, 1:] / total[0, 0] - np.outer(mean, mean) - np.eye(k))[np.ix_(use, use)].max())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`whitened` of all embeddings. ``deviation`` is a long where it fits one; where it does not (from some
    millions of vectors on) it is null, and ``deviation_exact`` has the digits."""
    t = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return t.withColumns({"deviation": F.expr("try_cast(deviation as bigint)"), "deviation_exact": F.col("deviation").cast("string")})
