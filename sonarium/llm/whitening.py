"""Whitening of embeddings: blockwise QR on Spark, then a bidiagonal qd solver for the small factor."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm.topk_search import scaled, usable
from sonarium.session import materialize

SCALE = 256
COMPONENTS = 4
#: Rows that enter one QR step, and factors that meet in one task.
BLOCK_ROWS = 4096
FAN_IN = 256

_EPS = np.finfo(np.float64).eps
_OUT_SCHEMA = "key bigint, component int, n bigint, deviation bigint, whitened double, explained double"


# ------------------------------------------------------------------------------------ the small factor


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of ``B = U' R V`` by Householder reflections, and ``V``."""
    a = r.astype(np.float64).copy()
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """A unit vector whose reflection sends ``x`` to a multiple of the first axis."""
        top = np.abs(x).max(initial=0.0)
        if len(x) < 2 or top == 0:
            return None
        h = x / top
        h[0] += math.copysign(math.sqrt(float(h @ h)), h[0])
        return h / math.sqrt(float(h @ h))

    for k in range(n):
        h = reflector(a[k:, k])
        if h is not None:
            a[k:, k:] -= 2.0 * np.outer(h, h @ a[k:, k:])
        h = reflector(a[k, k + 1 :])
        if h is not None:
            a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _qd_sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float]:
    """One dqds transform; the smallest and the last of its ``d``. A negative minimum means the shift was too large."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = least = q[0] - shift
    for i in range(n - 1):
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        if not d >= least:
            least = d
    new_q[-1] = d
    return new_q, new_e, least, d


def singular_squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by differential qd with shifts.

    Every transform adds and multiplies positive numbers only, so small values come out as accurately as large ones.
    """
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while work:
        q, e, sigma = work.pop()
        guess = 0.0
        while q:
            n = len(q)
            # The last value stands alone, or the matrix falls apart in the middle.
            if n == 1 or e[-1] <= _EPS * _EPS * (sigma + q[-1]):
                found.append(sigma + q.pop())
                if e:
                    e.pop()
                guess = 0.0
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= _EPS * _EPS * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                guess = 0.0
                continue
            shift = guess
            while True:
                new_q, new_e, least, last = _qd_sweep(q, e, shift)
                if least >= 0 or shift == 0.0:
                    break
                shift = shift * 0.25 if shift > _EPS * (sigma + q[-1]) else 0.0
            if least < 0 or not all(map(math.isfinite, new_q)):
                new_q = [max(0.0, x) if math.isfinite(x) else 0.0 for x in new_q]
            sigma += shift
            # The smallest value of what is left lies below the least d; most of it is taken off next time.
            guess = max(0.0, least) * (0.98 if least == last else 0.5)
            q, e = new_q, new_e
            if n > 1 and q[0] < q[-1] / 4:  # graded the wrong way round: turn the matrix over
                q, e = _turned(q, e)
    return np.sort(np.array(found))[::-1]


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the same matrix read from its other end."""
    return q[::-1], e[::-1]


def _twisted(q: np.ndarray, e: np.ndarray, off: np.ndarray, value: float, tiny: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both factorisations of ``B'B - value``: multipliers from the top, from the bottom, and the twists."""
    n = len(q)
    down, up = np.zeros(n), np.zeros(n)
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + q[i]
        d = d if abs(d) > tiny else math.copysign(tiny, d)
        down[i] = off[i] / d
        s[i + 1] = e[i] * s[i] / d - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        d = e[i] + p[i + 1]
        d = d if abs(d) > tiny else math.copysign(tiny, d)
        up[i] = off[i] / d
        # Without a link to what follows the matrix begins anew here.
        p[i] = (p[i + 1] * q[i] / d if e[i] else q[i]) - value
    return down, up, s + p + value


def _residual(diagonal: np.ndarray, upper: np.ndarray, z: np.ndarray, value: float) -> float:
    """The size of ``B'B z - value z``."""
    y = diagonal * z
    y[:-1] += upper * z[1:]
    back = diagonal * y - value * z
    back[1:] += upper * y[:-1]
    return float(np.abs(back).max())


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of ``B'B`` as rows, one per value, from twisted factorisations.

    A vector starts at the twist of least size. Vectors of values that are nearly equal are made orthogonal; where one
    lies in those before it or does not solve the equation, the next twist is tried.
    """
    q, e, off = diagonal**2, upper**2, diagonal[:-1] * upper
    n, scale = len(q), float(values[0]) if len(values) else 0.0
    tiny = max(scale * _EPS * 1e-3, np.finfo(np.float64).tiny)
    out = np.zeros((len(values), n))
    for j, value in enumerate(values):
        down, up, twist = _twisted(q, e, off, float(value), tiny)
        near = [i for i in range(j) if values[i] - value <= 1e-3 * scale]
        for r in np.argsort(np.abs(twist), kind="stable"):
            z = np.zeros(n)
            z[r] = 1.0
            for i in range(r - 1, -1, -1):
                z[i] = -down[i] * z[i + 1]
            for i in range(r, n - 1):
                z[i + 1] = -up[i] * z[i]
            z /= math.sqrt(float(z @ z))
            for _ in range(2):
                for i in near:
                    z -= (out[i] @ z) * out[i]
            size = math.sqrt(float(z @ z))
            if size > 0.1 and _residual(diagonal, upper, z / size, float(value)) <= 1e-9 * scale:
                out[j] = z / size
                break
        else:
            raise ArithmeticError(f"no vector found for the value {value}")
    return out


# ------------------------------------------------------------------------------------ fitting


@dataclass(frozen=True)
class Whitening:
    """What a fit list has: its size, sums, falling variances above zero, unit directions as rows, and total variance."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    directions: np.ndarray
    total: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows along every direction, each over its standard deviation."""
        return _centred(x, self.n, self.sums) @ self.directions.T / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int]:
        """``sum((n * x - sums) ** 2)`` of every row, exact."""
        sums = np.array(self.sums, np.int64)
        bound = (float(self.n) * np.abs(x).max(initial=0) + max(map(abs, self.sums), default=0)) ** 2 * max(1, x.shape[1])
        if bound < 2.0**62:
            return ((self.n * x - sums) ** 2).sum(1).tolist()
        return [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]


def _centred(x: np.ndarray, n: int, sums) -> np.ndarray:
    """``x - sums / n``, from exact integers while they fit."""
    sums = np.array(sums, np.int64)
    if float(n) * np.abs(x).max(initial=0) < 2.0**62 and np.abs(sums).max(initial=0) < 2**62:
        return (n * x - sums) / float(n)
    return x - sums / float(n)


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _factor(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def triangular_factor(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the QR factorisation of all centred rows: by blocks in a task, then by groups of tasks."""
    dims = len(sums)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                r = _factor(np.vstack([r, _centred(_rows(batch.column("x").slice(at, BLOCK_ROWS)), n, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def of_factors(table: pa.Table) -> pa.Table:
        r = np.zeros((0, dims))
        # In the order of their parts, so that reruns agree to the last bit.
        for blob in table.sort_by("part").column("r"):
            r = _factor(np.vstack([r, np.frombuffer(blob.as_buffer(), np.float64).reshape(-1, dims)]))
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors = fit.select("x").mapInArrow(of_rows, "part bigint, r binary")
    for _ in range(2):
        factors = factors.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(of_factors, "part bigint, r binary")
    r = np.zeros((0, dims))
    for row in factors.orderBy("part").toLocalIterator():  # one factor for every FAN_IN ** 2 tasks
        r = _factor(np.vstack([r, np.frombuffer(row.r, np.float64).reshape(-1, dims)]))
    return np.vstack([r, np.zeros((max(0, dims - len(r)), dims))])


def fit_list(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``x``: every distinct scaled vector once. Copies are dropped before the shuffle."""
    return vectors.where(usable(F.col(vector))).select(scaled(F.col(vector), scale).alias("x")).distinct()


def fit(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of a written fit list; sums, sizes and one small factor reach the driver.

    Directions of no variance are left out, so a fit list of few or of dependent vectors has fewer than ``components``.
    Vectors of different lengths raise.
    """
    least, most, n = fit.select(F.min(F.size("x")), F.max(F.size("x")), F.count(F.lit(1))).first()
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components; whitening needs one length")
    sums = tuple(r.s for r in fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).orderBy("i").collect())
    diagonal, upper, v = bidiagonal(triangular_factor(fit, n, sums))
    squares = singular_squares(diagonal, upper)
    total = float(math.fsum(squares))
    kept = squares[:components]
    kept = kept[kept > squares[0] * (most * _EPS) ** 2 * n] if total else kept[:0]
    directions = right_vectors(diagonal, upper, kept) @ v.T
    sign = np.sign(directions[np.arange(len(kept)), np.abs(directions).argmax(1)]) if len(kept) else np.ones(0)
    return Whitening(n, sums, kept / n, directions * sign[:, None], total / n)


def whiten(vectors: DataFrame, fitted: Whitening, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``key, component, n, deviation, whitened, explained``: every usable vector along every fitted direction.

    Null vectors and those with null or non-finite components are left out; repeated rows and rows without a key give
    rows of their own. No shuffle; other columns are not carried. A vector of another length than the fit list raises.
    """
    count = len(fitted.variances)
    explained = fitted.variances / fitted.total if count else np.zeros(0)
    schema = pa.schema([("key", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x, rows = _rows(batch.column("x")), np.repeat(np.arange(batch.num_rows), count)
            yield pa.RecordBatch.from_arrays([
                batch.column("key").take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), fitted.n)), pa.array(fitted.deviations(x), pa.int64()).take(pa.array(rows)),
                pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(explained, len(x))),
            ], schema=schema)

    rows = vectors.where(usable(F.col(vector))).select(F.col(key).cast("bigint").alias("key"), scaled(F.col(vector), scale).alias("x"))
    return rows.mapInArrow(run, _OUT_SCHEMA)


def identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity (0 without directions)."""
    count = len(fitted.variances)
    if not count:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = fitted.whitened(_rows(batch.column("x")))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, i])) for i in range(count)], names=[f"w{i}" for i in range(count)])

    rows = fit.select("x").mapInArrow(run, ", ".join(f"w{i} double" for i in range(count)))
    pairs = [(i, j) for i in range(count) for j in range(i, count)]

    def off(i: int, j: int) -> Column:
        return F.covar_pop(f"w{i}", f"w{j}") - F.lit(float(i == j))

    return max(map(abs, rows.agg(*[off(i, j) for i, j in pairs]).first()))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the four main directions of all distinct vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    distinct = materialize(fit_list(vectors), "fit")
    fitted = fit(distinct)
    rows = whiten(vectors, fitted).withColumnRenamed("key", "vec_id")
    return rows.withColumn("identity_error", F.lit(identity_error(distinct, fitted)))
