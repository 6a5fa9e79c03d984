"""Whitening of embeddings: pivoted Cholesky, then one-sided Jacobi.

A component c becomes the integer x = floor(SCALE * c) + OFFSET. Their number n and sums S
are exact, so n * x - S, which is n times the centred value, is exact too. Tasks sum the
products of centred values of their rows; a width x width table of such sums is all that
reaches the driver, and the width is checked.

There the centred scatter V is factored as P L L' P' by Cholesky with the largest rest
first, which ends where nothing above rounding is left. One-sided Jacobi rotates pairs of
columns of P L until all are orthogonal: their squared norms are the eigenvalues and the
normalised columns the components, without the loss of squaring a factor again. The pairs
of a step are disjoint and rotated together.

The covariance of what comes out is measured on the rows, not assumed.

*Defined cases.* Vectors that are null, or hold null or non-finite entries, are dropped.
Shorter vectors count as filled up with 0. Components without variance (fewer distinct
rows than components, constant or dependent entries) can't be whitened and are left out,
so equal vectors only, one vector or no vector give no rows. Rows with equal or null ids
stay rows of their own. Integers that pass 64 bits, in x or in a deviation, raise an error.
Further columns aren't read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .topk import matrix

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Widest vectors: the driver holds a table of this many columns and rows.
MAX_WIDTH = 4_096
#: Rows whose products are summed at once.
ROWS = 4_096
#: Largest size of x; beyond, an error names the row.
LARGEST = 1 << 52
#: Sweeps of rotations; columns are orthogonal after far fewer.
SWEEPS = 60


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    scaled = lambda c: F.lit(float(SCALE)) * c.cast("double")
    whole = lambda c: F.when(F.abs(scaled(c)) < LARGEST, F.floor(scaled(c)).cast("long") + OFFSET).otherwise(
        F.raise_error(F.concat(F.lit("a component is too large in vector "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast("long"))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.transform(v, whole).alias("x"))


def filled(rows: DataFrame, width: int) -> DataFrame:
    """All vectors with ``width`` integers."""
    return rows.select("id", F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("x"))).alias("x"))


def sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """n and S."""
    n = rows.count()
    found = (rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect())  # a row per dimension
    out = np.zeros(len(found), dtype=object)
    for r in found:
        out[r["i"]] = int(r["s"])
    return n, out


def _wide(x: np.ndarray, n: int, total: np.ndarray, limit: int) -> np.ndarray:
    """n * x - S: 64-bit integers where their size stays below ``limit``, else Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, total.tolist()), default=0) < limit:
        return x * np.int64(n) - total.astype(np.int64)
    return x.astype(object) * n - total


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once."""
    return np.array(_wide(x, n, total, 1 << 53) / n, float)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int]:
    """The exact sum of squares of n * x - S of each row."""
    limit = math.isqrt((1 << 63) // max(1, x.shape[1])) - 1
    wide = _wide(x, n, total, limit)
    return (wide * wide).sum(1).tolist()


def scatter(rows: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """Sum of the products of centred values over n, by position."""
    width = len(total)

    def run(batches):
        held = np.zeros((width, width))
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = _centred(matrix(b.column(0).slice(at, ROWS), width), n, total)
                held += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(held))], ["i", "row"])

    parts = rows.select("x").mapInArrow(run, "i long, row array<double>")
    found = (parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect())  # width x width
    out = np.zeros((width, width))
    for r in found:
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): a[order][:, order] = factor @ factor.T, the factor lower triangular
    with as many columns as ``a`` has rank; the largest rest comes first."""
    a = a.copy()
    size = len(a)
    order, left = np.arange(size), np.zeros((size, size))
    tiny = size * np.finfo(float).eps * max(a.diagonal().max(initial=0), 0)
    for k in range(size):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= tiny:
            return left[:, :k], order
        for m in (a, left):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        left[k, k] = np.sqrt(a[k, k])
        left[k + 1:, k] = a[k + 1:, k] / left[k, k]
        a[k + 1:, k + 1:] -= np.outer(left[k + 1:, k], left[k + 1:, k])
    return left, order


def _pairs(size: int):
    """Steps of disjoint pairs that together are all pairs, as in a round-robin."""
    ring = list(range(size + size % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        step = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], reversed(ring[half:])) if max(a, b) < size]
        yield np.array(step, int).T
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` rotated until all are orthogonal, longest first."""
    g, size = factor.copy(), factor.shape[1]
    steps = list(_pairs(size)) if size > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in steps:
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            angle = np.abs(ab) / np.sqrt(np.maximum(aa * bb, np.finfo(float).tiny))
            worst = max(worst, angle.max())
            turn = angle > np.finfo(float).eps
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            g[:, i], g[:, j] = c * (a - t * b), c * (b + t * a)
        if worst <= 4 * np.finfo(float).eps * np.sqrt(size):
            break
    return g[:, np.argsort(-(g * g).sum(0), kind="stable")]


def principal(v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns), largest first, of those that aren't 0."""
    factor, order = pivoted_cholesky(v)
    turned = np.zeros_like(factor)
    turned[order] = one_sided_jacobi(factor)
    values = (turned * turned).sum(0)
    keep = min(components, int((values > len(v) * np.finfo(float).eps * values.max(initial=0)).sum()))
    return values[:keep], turned[:, :keep] / np.sqrt(values[:keep])


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector that takes part and component: id, component, n, deviation,
    whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(vectors, id_col, vector_col)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if width > MAX_WIDTH:
        raise ValueError(f"vectors have at most {MAX_WIDTH} components, not {width}")
    rows = cut(filled(rows, width))
    n, total = sums(rows)
    v = scatter(rows, n, total)
    values, axes = principal(v, components)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    explained, scaled = values / np.trace(v), axes / np.sqrt(values)

    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = matrix(b.column(1).slice(at, ROWS), width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, ROWS), pa.array(deviations(x, n, total), pa.int64()), pa.array(list(_centred(x, n, total) @ scaled))],
                                                 ["id", "deviation", "w"])

    done = cut(rows.mapInArrow(project, f"id {dict(rows.dtypes)['id']}, deviation long, w array<double>"))
    size = len(values)
    errors = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - (1.0 if i == j else 0.0)) for i in range(size) for j in range(i, size)]
    error = done.agg(reduce(F.greatest, errors) if len(errors) > 1 else errors[0]).first()[0]
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return (done.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
            .select(F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    shares[F.col("k")].alias("explained"), F.lit(float(error)).alias("identity_error")))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
