"""Embedding whitening by a one-sided Jacobi SVD.

The centred rows are never multiplied with each other: each Arrow batch is reduced to the R of its QR factorisation, R factors are
stacked and reduced again (first within a task, then in rounds of tasks), until one R of dims x dims has the singular values of
all rows. Plane rotations make R's columns orthogonal; the rotations, accumulated, are the components, and the lengths of the columns the
standard deviations times the root of n, small ones as accurate as large ones. A scan projects all rows; one before it gives the covariance
of what comes out, from sums of centred products merged pair by pair.

Sums are whole numbers of any size, so the mean is exact: x minus its whole part is a whole number, and only the fraction is rounded. The
driver holds one R and the matrices of its size; no task or batch holds more than its own rows.

Defined results. Vectors that are null or hold a null, NaN or an infinity are left out; where lengths differ, those of the most frequent
length are the table (of equally frequent ones the longest) and others are left out, as they have no common covariance. Null ids and
repeated rows stay as they are. A component without spread (its deviation below 10^-12 of the largest, as a constant dimension or
fewer rows than dimensions give) can't be scaled to one and is left out, so equal vectors give no rows. ``deviation`` is null where
it exceeds a long. Equal eigenvalues have no one basis: the rotations' order decides. An empty table gives an empty result. Other
columns, whatever their names, are ignored. Entries that are no long after scaling are an error.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table
from tidemark.llm.vectors import finite, folded, lists, matrix, whole

#: Deviations below this share of the largest are rounding errors.
LEAST = 1e-12


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a matrix, falling, and its right singular vectors as columns.

    A sweep turns every pair of columns once, in rounds of disjoint pairs; it ends when no pair is further from orthogonal than rounding.
    """
    dims = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(dims)
    seats = np.arange(dims + dims % 2)
    half = len(seats) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(1, len(seats) - 1)):
            p, q = seats[:half], seats[::-1][:half]
            real = (p < dims) & (q < dims) & (p != q)
            p, q = p[real], q[real]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            if not len(p):
                continue
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(off.max()))
            turn = off > 1e-16
            if not turn.any():
                continue
            p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if worst < 1e-15:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


@dataclass
class Whitening:
    """What the fit leaves: n, the exact sums, components as columns with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def split(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole part of the mean, what is left of the sum, and the fraction."""
        base = [s // self.n for s in self.sums]
        rest = [s - self.n * b for s, b in zip(self.sums, base, strict=True)]
        return np.array(base, np.int64), np.array(rest, np.int64), np.array([r / self.n for r in rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        base, _, fraction = self.split()
        return (x - base).astype(np.float64) - fraction

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> np.ma.MaskedArray:
        """The exact sum of (n x - sum)^2 over the dimensions, masked where no long holds it."""
        base, rest, _ = self.split()
        away = x - base
        about = ((away.astype(np.float64) * self.n - rest) ** 2).sum(1)
        fits, close = about < 0.99 * 2.0**63, (about >= 0.99 * 2.0**63) & (about < 1.01 * 2.0**63)
        out = np.zeros(len(x), np.int64)
        out[fits] = ((away[fits] * self.n - rest) ** 2).sum(1)
        for k in np.flatnonzero(close):
            exact = sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(away[k], rest, strict=True))
            fits[k] = exact < 1 << 63
            out[k] = exact if fits[k] else 0
        return np.ma.MaskedArray(out, ~fits)


def whole_vectors(df: DataFrame, scale: int = 64, plus: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that are kept, and their length; 0 where there are none."""
    kept = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(finite("vector") & (F.size("vector") > 0))
    lengths = kept.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    dims = lengths[0]["length"] if lengths else 0
    rows = kept.where(F.size("vector") == dims).select("vec_id", whole("vector", scale, plus).alias("x"))
    checked = F.when(F.exists("x", lambda e: e.isNull()), F.raise_error(F.lit("a scaled vector has an entry that is no long")).cast("array<bigint>")).otherwise(F.col("x"))
    return rows.select("vec_id", checked.alias("x")), dims


def fit(rows: DataFrame, dims: int, most: int = 32) -> Whitening | None:
    """Mean, components and eigenvalues of all rows (x); None without rows or without spread."""

    def added(a: bytes, b: bytes) -> bytes:
        (n, s), (m, t) = pickle.loads(a), pickle.loads(b)
        return pickle.dumps((n + m, [x + y for x, y in zip(s, t, strict=True)]))

    def counted(batch: pa.RecordBatch) -> bytes:
        x = matrix(batch.column(0), dims)
        safe = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
        return pickle.dumps((len(x), [int(s) for s in (x if safe else x.astype(object)).sum(0)]))

    x = rows.select("x")
    state = folded(x, counted, added) if dims else None
    if state is None:
        return None
    n, sums = pickle.loads(state)
    model = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)

    def reduced(batch: pa.RecordBatch) -> bytes:
        return np.linalg.qr(model.centred(matrix(batch.column(0), dims)), mode="r").tobytes()

    def stacked(a: bytes, b: bytes) -> bytes:
        return np.linalg.qr(np.concatenate([np.frombuffer(r).reshape(-1, dims) for r in (a, b)]), mode="r").tobytes()

    sigma, v = jacobi(np.frombuffer(folded(x, reduced, stacked)).reshape(-1, dims))
    used = min(most, int((sigma > LEAST * sigma[0]).sum()))
    if not used:
        return None
    return Whitening(n, sums, v[:, :used], sigma[:used] ** 2 / n, float((sigma**2).sum() / n))


def identity_error(rows: DataFrame, dims: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""

    def moments(batch: pa.RecordBatch) -> bytes:
        z = model.whitened(matrix(batch.column(0), dims))
        mean = z.mean(0)
        return pickle.dumps((len(z), mean, (z - mean).T @ (z - mean)))

    def joined(a: bytes, b: bytes) -> bytes:
        (n, s, p), (m, t, q) = pickle.loads(a), pickle.loads(b)
        d, share = t - s, m / (n + m)
        return pickle.dumps((n + m, s + d * share, p + q + np.outer(d, d) * (n * share)))

    n, _, products = pickle.loads(folded(rows.select("x"), moments, joined))
    return float(np.abs(products / n - np.eye(len(products))).max())


def whiten(df: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each kept row of (vec_id, embedding) and component."""
    rows, dims = whole_vectors(df)
    kind = df.schema["vec_id"].dataType.simpleString()
    model = fit(rows, dims, most)
    if model is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(rows, dims, model)

    def make():  # noqa: ANN202
        def each(batch: pa.RecordBatch):  # noqa: ANN202
            x = matrix(batch.column(1), dims)
            far = model.deviations(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(far.data, mask=np.ma.getmaskarray(far)), lists(model.whitened(x), pa.float64())], ["vec_id", "deviation", "z"],
            )

        return each

    done = map_batches(rows, make, f"vec_id {kind}, deviation long, z array<double>")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    long = done.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
