"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers x = floor(256 c); the components are those of the distinct x vectors. Right
vectors v of the dimension's length are held on the driver. Left vectors u have an entry per distinct vector of
the table and are never held: each is a linear function of the rows, u = X w with the centred rows X, and a pass
computes its entries again. A step is one pass, in which every task multiplies its rows by v (X v), subtracts the former u, and
multiplies the result back (X^T u); sums, not rows, leave the task. Both sides are fully reorthogonalised: u against all
former u by the products that the same pass returns (twice if they are not tiny), v against all former v. The small
bidiagonal matrix's singular values give the deviations, its right vectors the components. Steps go on until the residuals of
the first components are at rounding, and until what is left of the trace can't hide a larger component; at the
latest all dimensions are reached. Where a vector vanishes, a new direction orthogonal to all former ones is taken, so equal deviations are all found.

What a pass returns is summed in Spark; the driver gets a few vectors of the dimension's length.

Defined cases: rows with a null vector, or one with null, NaN or infinite entries (or any of 2**54 and more, whose x no long holds), are left out; vectors shorter than
the longest are padded with zeros (a zero-length one is all zeros); repeated rows are returned each, equal vectors count once in the fit; components without deviation can't be
whitened and are left out, so one distinct vector or an empty table gives no rows; a component's sign makes its
largest entry positive; deviation is null where it passes 64 bits; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

COMPONENTS = 4
#: Residuals and deviations below this share of the largest deviation are rounding.
ROUNDING, VANISHES = 1e-14, 1e-9
#: Rows that a task multiplies at a time, as entries.
BLOCK = 1 << 20


class Fit(NamedTuple):
    """n, per-dimension sums, components (rows), their eigenvalues, the trace and the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def integers(vector: Column) -> Column:
    """floor(256 c) of each entry as a long; null for a vector that is null or has an entry that is null, not finite or too large for one."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**54))
    return F.when(fine, F.transform(wide, lambda c: F.floor(c * 256).cast("long")))


def matrix(column, d: int) -> np.ndarray:
    """A column of lists of longs as rows of ``d`` integers, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def blocks(batches, d: int):
    for b in batches:
        step = max(1, BLOCK // max(1, d))
        for lo in range(0, len(b), step):
            yield b.slice(lo, step)


def summed(fit: DataFrame, d: int, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of(block of rows)``, ``size`` doubles."""

    def partial(batches):
        total = np.zeros(size)
        for b in blocks(batches, d):
            total += of(matrix(b.column("x"), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "v"])

    got = fit.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def most(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from integers where they fit."""
    if n * most(x) + most(sums) < 1 << 62:
        return (n * x - sums) / n
    return x - (sums / n).astype(float)


class Bidiagonal:
    """Golub-Kahan-Lanczos steps over the centred rows of ``fit``, orthogonal to the rows of ``locked``."""

    def __init__(self, fit: DataFrame, n: int, sums: np.ndarray, locked: np.ndarray, seed: int):
        self.fit, self.n, self.sums, self.d = fit, n, sums, len(sums)
        self.locked, self.rng = locked, np.random.default_rng(seed)
        self.v: list[np.ndarray] = []  # right vectors
        self.w: list[np.ndarray] = []  # u = X w
        self.back: list[np.ndarray] = []  # X^T u
        self.diagonal: list[float] = []
        self.above: list[float] = []
        self.next, self.beta, self.largest = self.fresh(), 0.0, 0.0

    def outside(self, x: np.ndarray) -> np.ndarray:
        """``x`` without its parts along all former right vectors; twice is enough."""
        for _ in range(2):
            for basis in (self.locked, np.array(self.v).reshape(-1, self.d)):
                x = x - basis.T @ (basis @ x)
        return x

    def fresh(self) -> np.ndarray | None:
        """A unit vector orthogonal to all former ones; None when they fill the space."""
        if len(self.v) + len(self.locked) >= self.d:
            return None
        x = self.outside(self.rng.standard_normal(self.d))
        return x / np.linalg.norm(x)

    def passed(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """X^T p, all u^T p and p^T p of p = X w."""
        n, sums, d, former = self.n, self.sums, self.d, np.array(self.w).reshape(-1, self.d).T

        def of(x: np.ndarray) -> np.ndarray:
            rows = centred(x, n, sums)
            p = rows @ w
            return np.concatenate([rows.T @ p, (rows @ former).T @ p, [p @ p]])

        got = summed(self.fit, d, d + len(self.w) + 1, of)
        return got[:d], got[d:-1], float(got[-1])

    def step(self) -> None:
        """One more u and v."""
        v = self.next
        w = v - self.beta * self.w[-1] if self.beta else v
        back, along, square = self.passed(w)
        if len(along) and np.abs(along).max() > 1e-10 * np.sqrt(max(square, 1e-300)):  # the correction is no mere rounding: once more, on what it leaves
            w = w - np.array(self.w).T @ along
            back, along, square = self.passed(w)
        for c, u, b in zip(along, self.w, self.back):
            w, back = w - c * u, back - c * b
        alpha = float(np.sqrt(max(0.0, square - along @ along)))
        self.largest = max(self.largest, alpha, self.beta)
        self.v.append(v)
        if self.above or len(self.v) > 1:
            self.above.append(self.beta)
        if alpha <= VANISHES * self.largest or alpha == 0:  # X v adds no direction
            self.diagonal.append(0.0)
            self.w.append(np.zeros(self.d))
            self.back.append(np.zeros(self.d))
            self.next, self.beta = self.fresh(), 0.0
            return
        self.diagonal.append(alpha)
        self.w.append(w / alpha)
        self.back.append(back / alpha)
        rest = self.outside(self.back[-1] - alpha * v)
        beta = float(np.linalg.norm(rest))
        if len(self.v) + len(self.locked) >= self.d:
            self.next, self.beta = None, 0.0
        elif beta <= 1e-13 * self.largest:
            self.next, self.beta = self.fresh(), 0.0
        else:
            self.next, self.beta = rest / beta, beta
            self.largest = max(self.largest, beta)

    def ritz(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors as rows, and residuals, from the small bidiagonal matrix."""
        b = np.diag(self.diagonal) + np.diag(self.above, 1)
        left, s, right = np.linalg.svd(b)
        return s, right @ np.array(self.v), self.beta * np.abs(left[-1])


def leading(fit: DataFrame, n: int, sums: np.ndarray, k: int, total: float, locked: np.ndarray, seed: int, rounding: float = ROUNDING) -> tuple[np.ndarray, np.ndarray, bool]:
    """The ``k`` largest singular values and right vectors, and whether the rest of ``total`` (all squares) proves that none is missed."""
    g = Bidiagonal(fit, n, sums, locked, seed)
    while True:
        g.step()
        s, v, residual = g.ritz()
        done = g.next is None
        proven = done or len(s) >= k and total - (s**2).sum() <= s[k - 1] ** 2
        if done or len(s) >= k and (residual[:k] <= rounding * s[0]).all():
            return s[:k], v[:k], proven


def fitted(fit: DataFrame, k: int = COMPONENTS, seed: int = 11) -> Fit | None:
    """Components of the distinct vectors ``fit`` (x: array of longs); None if it has no rows or no deviation."""
    head = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not head.n or not head.d:
        return None
    n, d = head.n, head.d
    at = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("s")).collect()  # a row per dimension
    sums = np.array([int(s) for _, s in sorted(at)], object)
    sums = sums.astype(np.int64) if most(sums) < 1 << 62 else sums
    total = float(summed(fit, d, 1, lambda x: np.array([np.square(centred(x, n, sums)).sum()]))[0])
    if total == 0:
        return None
    s, v, proven = leading(fit, n, sums, min(k, d), total, np.zeros((0, d)), seed)
    while not proven:  # look for a larger one in what is orthogonal to those found
        more, w, _ = leading(fit, n, sums, 1, total - (s**2).sum(), v, seed := seed + 1, 1e-8)
        if more[0] <= s[-1] * (1 + 1e-7):
            break
        more, w, _ = leading(fit, n, sums, 1, total - (s**2).sum(), v, seed)
        s, v = np.append(s[:-1], more), np.vstack([v[:-1], w])
        order = np.argsort(-s, kind="stable")
        s, v = s[order], v[order]
    keep = s > VANISHES * s[0]
    s, v = s[keep], v[keep]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    values, m = s**2 / n, len(s)

    def white(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ v.T / np.sqrt(values)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    got = summed(fit, d, m * m + m, white)
    mean = got[m * m :] / n
    error = float(np.abs(got[: m * m].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())
    return Fit(n, sums, v, values, total / n, error)


def exact_squares(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """The sum over dimensions of (n x - S)^2 of each row, exact; None where it passes 64 bits."""
    bound = n * most(x) + most(sums)
    if bound * bound * len(sums) < 1 << 63:
        y = n * x - sums
        return np.einsum("ij,ij->i", y, y).tolist()
    found = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return [f if f < 1 << 63 else None for f in found]


def whitened(rows: DataFrame, fit: Fit, key: str = "vec_id") -> DataFrame:
    """A row per row and component of (key, x): key, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[key].dataType.simpleString()
    n, sums, v, values, trace, error = fit
    d, m = len(sums), len(values)

    def of(batches):
        for b in blocks(batches, d):
            x = matrix(b.column("x"), d)
            z = centred(x, n, sums) @ v.T / np.sqrt(values)
            rep = np.repeat(np.arange(len(b)), m)
            one = lambda y: np.tile(y, len(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(rep)), pa.array(one(np.arange(1, m + 1, dtype=np.int32))), pa.array(np.full(len(rep), n)), pa.array(exact_squares(x, n, sums), pa.int64()).take(pa.array(rep)), pa.array(z.ravel()), pa.array(one(values / trace)), pa.array(np.full(len(rep), error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, "x").mapInArrow(of, f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all usable rows of (key, column) along the ``k`` first components."""
    rows = vectors.select(F.col(key).alias(key), integers(F.col(column)).alias("x")).where("x IS NOT NULL")
    longest = rows.agg(F.max(F.size("x")).alias("d")).first().d or 0
    padded = rows.select(key, F.when(F.size("x") == longest, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), longest - F.size("x")))).alias("x"))
    found = fitted(stored(padded.select("x").distinct()), k)
    if found is None:
        kind = rows.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(padded, found, key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
