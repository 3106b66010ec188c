"""Embedding whitening by shifted CholeskyQR.

Vectors are quantised to whole numbers x = floor(256 c); the fit list holds each
distinct x vector once and is written as a table. Its size n and its sums S are
exact whole numbers, so the centred rows (n x - S) / n carry one rounding each.

The centred rows A (n by d) are orthogonalised without ever being collected: a
pass over the fit table adds up the Gram matrix of Q = A R^-1, where every row
goes through triangular solves with the factors found so far, and the Cholesky
factor of that Gram matrix becomes the next factor. The first pass has none
yet, and its Gram matrix is shifted by a multiple of the rounding error, so that
the factorisation succeeds for rows of any condition; two more passes remove what
the shift did. The product R of the three factors satisfies R'R = A'A to rounding,
relative to each direction instead of the largest one, and the driver takes the
singular values and right singular vectors of this d by d matrix.

What reaches the driver is d by d, whatever the number of rows. A task holds a
batch and a d by d sum; the sums of the tasks meet row by row of the matrix.

Defined results: a vector that is null, or holds null or non-finite entries, is
dropped; shorter vectors are filled with zeros to the longest length; entries
beyond a long's range become its limits, a deviation of more than 38 digits (in the
query: beyond a long's range) is null; rows with equal or null ids are rows of
their own, and so are equal vectors, which count once in the fit. Components without
variance (fewer distinct vectors than dimensions, constant entries) have explained
0, whitened null, and no part in identity_error (0 if there is no other). An empty
table, or one whose vectors are all empty, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.tables import discard, materialize

STEPS = 256                 # whole numbers a unit of an entry
COMPONENTS = 4
PASSES = 3                  # one shifted, two plain
SOLVE_COLUMNS = 32
NO_VARIANCE = 1e-24         # share of the whole variance that rounding of the centred rows may leave in a direction
LONG = 2**63


def usable(vec: str) -> Column:
    v = F.col(f"`{vec}`")
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))


def quantised(lists: pa.Array, d: int) -> np.ndarray:
    """x of a list column without nulls, rows filled with zeros to length ``d``."""
    size = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEPS)
    top = flat >= LONG
    x = np.where(top, 0, np.maximum(flat, -float(LONG))).astype(np.int64)
    x[top] = LONG - 1
    if (size == d).all():
        return x.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x
    return out


@dataclass
class Fit:
    """Exact statistics of the fit list and, once found, its components."""

    n: int
    sums: list[int]
    largest: int                         # |x| at most
    basis: np.ndarray | None = None      # d by k: unit eigenvectors, divided by sqrt(eigenvalue)
    explained: np.ndarray | None = None
    rank: int = 0
    identity_error: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: longs, or whole numbers of any size where longs could overflow."""
        room = 2 * self.n * (self.largest + 1) < 2**62
        return x * self.n - np.array(self.sums, np.int64) if room else x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        s = self.scaled(x)
        if s.dtype == object or len(self.sums) * (2 * self.n * (self.largest + 1)) ** 2 >= 2**62:
            s = s.astype(object)
        return (s * s).sum(1).tolist()


def rows_of(packed: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<i8").reshape(-1, d)


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q of Q r = a for an upper triangular r, by forward substitution in column blocks."""
    q = np.empty_like(a)
    for j in range(0, len(r), SOLVE_COLUMNS):
        end = min(len(r), j + SOLVE_COLUMNS)
        q[:, j:end] = a[:, j:end] - q[:, :j] @ r[:j, j:end]
        for c in range(j, end):
            q[:, c] = (q[:, c] - q[:, j:c] @ r[j:c, c]) / r[c, c]
    return q


def summed(fit_rows: DataFrame, fn, rows: int, columns: int) -> np.ndarray:
    """Sum over the fit table of ``fn(x batch)``, a rows by columns matrix: a sum in each task, then one group a matrix row."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            if batch.num_rows:
                total += fn(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, columns)
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([v.sum(0)], pa.list_(pa.float64()))})

    out = np.zeros((rows, columns))
    got = fit_rows.mapInArrow(partial, "i long, v array<double>").groupBy("i").applyInArrow(add, "i long, v array<double>")
    for i, v in got.collect():
        out[i] = v
    return out


def exact_sums(fit_rows: DataFrame, d: int) -> tuple[int, list[int], int]:
    """(n, per-dimension sums, largest |x|) as whole numbers of any size."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, top = 0, np.zeros(d, object), np.zeros(d, object), 0
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0), d)
                n += len(x)
                high += (x >> 32).sum(0).astype(object)       # halves of a long: no overflow in a batch
                low += (x & 0xFFFFFFFF).sum(0).astype(object)
                top = max(top, int(x.max()), -int(x.min()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 2)), pa.array([*(str(h * 2**32 + v) for h, v in zip(high, low)), str(n), str(top)])], ["i", "v"])

    parts = fit_rows.mapInArrow(partial, "i long, v string").select("i", F.col("v").cast("decimal(38,0)").alias("v"))
    got = dict(parts.groupBy("i").agg(F.when(F.col("i") == d + 1, F.max("v")).otherwise(F.sum("v")).alias("v")).collect())
    return int(got[d]), [int(got[i]) for i in range(d)], int(got[d + 1])


def cholesky(gram: np.ndarray, rows: int, shift: bool) -> np.ndarray:
    """Upper factor; with a shift of the size of the rounding errors where asked for or where it needs one."""
    d = len(gram)
    s = 11 * (rows * d + d * (d + 1)) * np.finfo(np.float64).eps / 2 * max(np.linalg.norm(gram, 2), np.finfo(np.float64).tiny)
    s = min(s, 1e-6 * np.linalg.norm(gram, 2)) or 1.0
    if not shift:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass                                              # directions without variance
    return np.linalg.cholesky(gram + s * np.eye(d)).T


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Components of the distinct quantised vectors; None if there is nothing to fit."""
    good = vectors.where(usable(vec_col)).select(F.col(f"`{vec_col}`").alias("v"))
    d = good.agg(F.max(F.size("v"))).first()[0] or 0
    if d == 0:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(quantised(batch.column(0), d), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    rows = materialize(good.mapInArrow(pack, "x binary").distinct(), "whitening-fit")
    f = Fit(*exact_sums(rows, d))
    factors: list[np.ndarray] = []

    def orthogonal(packed: pa.Array) -> np.ndarray:
        q = f.centred(rows_of(packed, d))
        for r in factors:
            q = solved(q, r)
        return q

    drift = np.zeros(d)
    for k in range(PASSES):
        def gram(packed: pa.Array) -> np.ndarray:
            q = orthogonal(packed)
            return np.vstack([q.T @ q, q.sum(0)])

        got = summed(rows, gram, d + 1, d)
        if k == 0:
            drift = got[d] / f.n                              # what rounding left of the mean
        factors.append(cholesky(got[:d], f.n, k == 0))
    r = np.linalg.multi_dot(factors[::-1])
    _, sigma, vt = np.linalg.svd(r)
    e = sigma**2 / f.n
    k = min(components, d)
    f.rank = int((e[:k] > e.sum() * NO_VARIANCE).sum()) if f.n > 1 else 0      # the shift alone is no variance
    f.explained = np.where(np.arange(k) < f.rank, e[:k] / e.sum(), 0.0) if f.rank else np.zeros(k)
    f.basis = np.zeros((d, k))
    f.basis[:, :f.rank] = vt[:f.rank].T / np.sqrt(e[:f.rank])
    if f.rank:
        basis, middle = f.basis[:, :f.rank], drift @ f.basis[:, :f.rank]

        def products(packed: pa.Array) -> np.ndarray:
            w = f.centred(rows_of(packed, d)) @ basis - middle
            return w.T @ w

        f.identity_error = float(np.abs(summed(rows, products, f.rank, f.rank) / f.n - np.eye(f.rank)).max())
    discard(rows)
    return f


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation decimal(38,0) or null beyond it, whitened, explained, identity_error): a row for each usable vector and component."""
    spark = vectors.sparkSession
    f = fit(vectors, vec_col, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    typed = [F.col("deviation").try_cast("decimal(38,0)").alias("deviation") if c == "deviation" else F.col(f"`{c}`")
             for c in (id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")]
    if f is None:
        return spark.createDataFrame([], schema).select(*typed)
    d, k = f.basis.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = quantised(batch.column(1), d)
            w = f.centred(x) @ f.basis
            at = np.repeat(np.arange(m), k)
            blank = np.tile(np.arange(k) >= f.rank, m)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, f.n)), pa.array([str(v) for v in f.deviations(x)]).take(pa.array(at)),
                pa.array(w.reshape(-1), mask=blank), pa.array(np.tile(f.explained, m)), pa.array(np.full(m * k, f.identity_error)),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.where(usable(vec_col)).select(F.col(f"`{id_col}`"), F.col(f"`{vec_col}`")).mapInArrow(project, schema).select(*typed)
