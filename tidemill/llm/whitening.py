"""Embedding whitening by shifted CholeskyQR.

The centred rows are never gathered: each pass adds up the d x d Gram matrix of the rows divided by the triangular
factors found so far, its Cholesky factor is the next one, and the composed factor R has the singular values and right
singular vectors of all rows. Only d x d matrices leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Passes that add a factor, at most; three Gram matrices do unless the rows are very ill-conditioned.
PASSES = 8
#: An eigenvalue of a Gram matrix of orthogonalised rows is 1 up to CLOSE times the width, or has VANISHED.
CLOSE, VANISHED = 1e-14, 1e-6
#: Singular values below this share of the first are rounding errors.
NOISE = 1e-11


def _usable(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without null or non-finite entries, their widths, and floor(scale * entry) of their entries one after the other."""
    column = column.cast(pa.large_list(pa.float64()))
    widths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    value = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), np.maximum(widths, 0))
    good = widths >= 0
    good[row[~np.isfinite(value)]] = False
    x = np.floor(scale * value[good[row]])
    if x.size and np.abs(x).max() >= 2.0 ** 53:
        raise OverflowError("an entry is too large to be scaled to a whole number exactly")
    return np.flatnonzero(good), widths[good], x.astype(np.int64)


def integral(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """(x, width) of each usable row: its entries scaled and rounded down, as longs."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, widths, x = _usable(batch["x"], scale)
            bounds = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)), pa.array(widths)], ["x", "width"])
    return vectors.select(F.col(vector).alias("x")).mapInArrow(convert, "x array<bigint>, width bigint")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)


def _summed(rows: DataFrame, d: int, of_batch, kind: str = "double") -> np.ndarray:
    """The sum of ``of_batch`` (an array of fixed shape for an (m, d) matrix of rows) over all batches: in tasks, then by entry."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of_batch(_matrix(batch["x"], d))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "value"])

    parts = rows.select("x").mapInArrow(add, f"at int, value {kind}")
    sums = parts.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow()  # As many rows as one matrix has entries.
    return sums["value"].to_numpy()


class Fit:
    """What whitening needs of the fit list: n, exact sums, components as columns, their eigenvalues, the trace of the covariance."""

    def __init__(self, n: int, sums: list[int], columns: np.ndarray, values: np.ndarray, trace: float, passes: int):
        self.n, self.sums, self.columns, self.values, self.trace, self.passes, self.error = n, sums, columns, values, trace, passes, 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.columns / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact; raises where a long cannot hold it."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        small = most ** 2 * x.shape[1] < 2 ** 63
        off = self.n * (x if small else x.astype(object)) - np.array(self.sums, np.int64 if small else object)
        return (off * off).sum(1).astype(np.int64)


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper triangular R with R'R = gram + s I: s is 0 if that is positive definite, or else grows from ``shift``."""
    s = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + s * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            s = max(shift, 100 * s, np.finfo(float).tiny)


def fit(rows: DataFrame, d: int, n: int, components: int) -> Fit:
    """The first ``components`` components of the ``n`` distinct ``rows`` (x) of width ``d``; directions without variance give none.

    A pass solves the centred rows against the factors found so far, adds up their Gram matrix, and takes its Cholesky
    factor, shifted where the matrix is not positive definite. Passes end once the Gram matrix is the identity on all
    directions with variance. Rows' = Q R holds at any pass, so R times the root of the last Gram matrix (all but the
    identity) has the singular values and right singular vectors of the centred rows, to double precision.
    """
    low = (1 << 26) - 1
    halves = _summed(rows, d, lambda x: np.stack([(x >> 26).sum(0), (x & low).sum(0)]), "bigint").reshape(2, d)
    sums = [(int(high) << 26) + int(rest) for high, rest in halves.T]
    mean, factors = np.array([s / n for s in sums]), []
    while True:
        def gram_of(x: np.ndarray) -> np.ndarray:
            q = (x - mean).T
            for r in factors:
                q = np.linalg.solve(r.T, q)
            return q @ q.T

        gram = _summed(rows, d, gram_of).reshape(d, d)
        gram = (gram + gram.T) / 2
        trace = float(np.trace(gram)) / n if not factors else trace
        values, vectors = np.linalg.eigh(gram)
        if len(factors) >= PASSES or len(factors) > 1 and np.all((values < VANISHED) | (np.abs(values - 1) < CLOSE * d)):
            break
        factors.append(_factor(gram, 11 * d * (n + d + 1) * np.finfo(float).eps * float(np.trace(gram))))
    composed = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for r in reversed(factors):
        composed = composed @ r
    _, singular, right = np.linalg.svd(composed)
    kept = [i for i in range(min(components, d)) if singular[i] > NOISE * singular[0]]
    found = Fit(n, sums, right[kept].T, singular[kept] ** 2 / n, trace, len(factors))
    if kept:
        def moments(x: np.ndarray) -> np.ndarray:
            w = np.hstack([found.whiten(x), np.ones((len(x), 1))])
            return w.T @ w

        moment = _summed(rows, d, moments).reshape(len(kept) + 1, len(kept) + 1) / n
        mean_of = moment[-1, :-1]
        found.error = float(np.abs(moment[:-1, :-1] - np.outer(mean_of, mean_of) - np.eye(len(kept))).max())
    return found


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """One row per usable row of ``vectors`` and component: key, ``component``, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * entry). The fit list holds each distinct x vector once: n of them, with sums S, and
    their covariance V of divisor n. ``whitened`` is x - S / n along a unit eigenvector of V over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``deviation`` the exact sum of (n x - S)^2 over dimensions (an error if a long
    cannot hold it), ``identity_error`` the largest absolute entry of the covariance of ``whitened`` over the fit list minus the identity.

    Rows whose vector is null or holds a null, infinite or NaN entry are dropped, and so are those of another width than most
    distinct vectors have (of two such widths the larger counts). Entries of 2^53 and more after scaling raise an error. Repeated
    rows give repeated results and count once in the fit; null keys are kept. Directions without variance are no components, so
    an empty table, a single vector or vectors of width 0 give no rows. Other columns are not read. Distinct vectors meet in one
    shuffle that combines before it; a task and the driver hold some matrices of width x width and a batch of rows.
    """
    kind = vectors.schema[key].dataType.simpleString()
    names = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = stored(integral(vectors, vector, scale).distinct(), "fit-list")
    widest = rows.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    found = None
    if widest and widest["width"]:
        d, n = widest["width"], widest["n"]
        found = fit(rows.where(F.col("width") == d), d, n, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, widths, x = _usable(batch["x"], scale)
            right, k = widths == d, len(found.values)
            x = x[np.repeat(right, widths)].reshape(-1, d)
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                batch["key"].take(pa.array(np.repeat(row[right], k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)),
                pa.array(np.repeat(found.deviations(x), k)), pa.array(found.whiten(x).ravel()), pa.array(np.tile(found.values / found.trace, m)), pa.array(np.full(m * k, found.error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], names).withColumnRenamed("key", key)
    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("x")).mapInArrow(project, names).withColumnRenamed("key", key)
