"""Whitening of embeddings with the covariance of their distinct vectors.

Entries become whole numbers, floor(SCALE * entry), so that equal vectors are equal and sums
are exact. The fit list holds every distinct vector once. Its n vectors and their sums S
centre all rows exactly: n * x - S is a whole number, and only its quotient by n is rounded.
A RowMatrix of the centred rows gives the Gramian matrix on executors, which divided by n
is the covariance; its eigenvectors are found on the driver (d by d numbers), sent to all
tasks and applied to batches of rows. The identity error is measured, not derived: the
whitened fit list's own covariance less the identity, with Spark's aggregates.

Components are numbered from 1 by falling eigenvalue; of either sign that one is taken by
which the entry of largest size (the first of equals) is positive. A component whose eigenvalue is no
more than rounding beside the largest (fewer distinct vectors than dimensions) cannot be
whitened: its values are null.

Defined cases: vectors that are null or hold null or non-finite entries are left out;
vectors of less than the most entries found get zeros at their end; entries beyond 64
bits are held to their range; a squared deviation of more than 64 bits is null in `deviation` and whole in
`deviation_exact`; repeated rows and ties keep a row each, a null vec_id stays; an empty
table, or one without a vector left, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove_table

SCALE, COMPONENTS = 256, 4
LONG = 1 << 63


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the vectors that can be used as whole numbers, all of one length."""
    entry = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    most, least = float(LONG - 1024), float(-LONG)
    x = F.transform(entry, lambda c: F.floor(F.greatest(F.lit(least), F.least(F.lit(most), c * SCALE))))
    return vectors.filter(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long"), x.alias("x"))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix, with zeros at the end of short ones."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()[ends[0] : ends[-1]]
    n = np.diff(ends)
    if len(values) == len(n) * dims and (n == dims).all():
        return values.reshape(len(n), dims)
    out = np.zeros((len(n), dims), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], n)] = values
    return out


def fits(x: np.ndarray, times: int) -> bool:
    """Whether sums of so many such numbers stay within 62 bits."""
    return not x.size or max(abs(int(x.max())), abs(int(x.min()))) * times < 1 << 62


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number of rows, exact sum of each dimension): d rows come to the driver."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for b in it:
            x = rows_of(b.column("x"), dims)
            part = x.sum(axis=0) if fits(x, len(x)) else x.astype(object).sum(axis=0)
            n, sums = n + len(x), [s + int(p) for s, p in zip(sums, part)]
        if n:  # in halves, so that Spark's sums are of whole numbers below 64 bits
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(n), *map(str, sums)])], names=["dim", "sum"])

    rows = fit.mapInArrow(batches, "dim int, sum string").groupBy("dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    found = {r["dim"]: int(r["sum"]) for r in rows}
    return found.get(-1, 0), [found.get(k, 0) for k in range(dims)]


class Centre:
    """n * x - S, exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.top = max(map(abs, sums), default=0)

    def of(self, x: np.ndarray) -> np.ndarray:
        small = x.size and max(abs(int(x.max())), abs(int(x.min()))) * self.n + self.top < 1 << 62
        if small:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def squares(self, m: np.ndarray) -> list[int]:
        if m.dtype != object and m.size and int(np.abs(m).max()) ** 2 * m.shape[1] < LONG:
            return (m * m).sum(axis=1).tolist()
        return (m.astype(object) ** 2).sum(axis=1).tolist()

    def quotients(self, m: np.ndarray) -> np.ndarray:
        """m / n as doubles, each rounded once where m has at most 53 bits."""
        return (m / self.n).astype(np.float64)


def covariance(fit: DataFrame, centre: Centre, dims: int) -> np.ndarray:
    """Gramian matrix of the centred rows over their number."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            c = centre.quotients(centre.of(rows_of(b.column("x"), dims)))
            ends = pa.array(np.arange(0, c.size + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(c.reshape(-1)))], names=["row"])

    rows = fit.mapInArrow(batches, "row array<double>").select(array_to_vector("row").alias("row"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), centre.n, dims).computeGramianMatrix().toArray()
    return (gram + gram.T) / 2 / centre.n


def axes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) by falling eigenvalue, the entry of largest size positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    top = np.abs(u)
    first = (top >= top.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
    return e, u * np.where(u[first, np.arange(u.shape[1])] < 0, -1.0, 1.0)


SCHEMA = "vec_id long, n long, deviation long, deviation_exact string, whitened array<double>"


def applied(rows: DataFrame, centre: Centre, axis: np.ndarray, spread: np.ndarray, dims: int) -> DataFrame:
    """Rows with their squared deviation and whitened components, in batches."""
    sent = rows.sparkSession.sparkContext.broadcast((centre, axis, spread))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, axis, spread = sent.value
        for df in it:
            x = np.zeros((len(df), dims), np.int64)
            for k, v in enumerate(df["x"]):
                x[k, : len(v)] = v
            m = centre.of(x)
            squares = centre.squares(m)
            z = centre.quotients(m) @ axis
            z = np.divide(z, spread, out=np.full_like(z, np.nan), where=spread > 0)
            listed = [[None if np.isnan(c) else c for c in row] for row in z.tolist()]
            whole = pd.Series([q if q < LONG else None for q in squares], dtype="Int64")
            yield pd.DataFrame({"vec_id": df["vec_id"].astype("Int64"), "n": centre.n, "deviation": whole, "deviation_exact": [str(q) for q in squares], "whitened": listed})

    return rows.mapInPandas(batches, SCHEMA)


def identity_error(fit: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, of components that can be whitened."""
    z = [F.get("whitened", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    if not pairs:
        return None
    row = fit.agg(*[F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    errors = [abs(c - (i == j)) for (i, j), c in zip(pairs, row) if c is not None]
    return max(errors, default=None)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, deviation_exact, whitened, explained, identity_error: one row for each vector, with arrays by component."""
    rows = whole(vectors)
    fit = materialise(rows.select("x").distinct(), "fit")
    sizes = fit.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    dims = sizes[0] or 0
    if sizes[0] != sizes[1]:
        padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))).alias("x")
        before, fit = fit, materialise(fit.select(padded).distinct(), "fit")
        remove_table(before)
    n, sums = totals(fit, dims)
    centre = Centre(max(n, 1), sums)
    e, u = axes(covariance(fit, centre, dims)) if n and dims else (np.empty(0), np.empty((0, 0)))
    k = min(components, dims)
    total = float(np.sum(e))
    flat = max(dims, 1) * np.finfo(float).eps * (float(e[0]) if dims and n else 0.0)
    spread = np.where(e[:k] > flat, np.sqrt(np.maximum(e[:k], 0)), 0.0)
    axis = np.ascontiguousarray(u[:, :k])
    error = identity_error(applied(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), centre, axis, spread, dims), k)
    explained = F.array(*[F.lit(float(x / total) if total > 0 else None).cast("double") for x in e[:k]]).cast("array<double>")
    out = applied(rows, centre, axis, spread, dims)
    return out.withColumns({"explained": explained, "identity_error": F.lit(error).cast("double")})
