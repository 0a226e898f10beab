"""Embedding whitening: leading eigenvectors of the covariance by matrix-free block Lanczos, and whitened rows.

Entries become whole numbers (SCALE times the entry, floored, plus OFFSET), so that counts, sums and deviations
are exact. The covariance matrix is never formed: each step is one distributed pass that gives
V Q = (1/n) X'(X Q) of the centred rows X for a block of directions Q, of which the driver gets a table of
dimensions x block. The new block is orthogonalised against all blocks before it, twice (full
reorthogonalisation). Where directions of a block vanish, the Krylov space is exhausted in them: random directions
that are orthogonal to everything so far take their place (restart on breakdown), until the wanted
pairs' residuals are below TOLERANCE of the largest eigenvalue or the basis is complete. The trace, and so each component's explained
share, comes from the exact deviations of all rows.

The driver holds the basis: dimensions x directions doubles, whatever the number of rows.

Defined results: rows whose vector is null, empty, or holds null, non-finite entries or ones too large for a
whole number of 64 bits are dropped, and so are vectors of another length than the most frequent one (of equally
frequent ones the longest); repeated rows each count and each get their rows; null ids pass through;
directions without variance (at most RANK of the trace) are no components; an empty table has no rows. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, written

SCALE, OFFSET = 64, 1_000_000
#: Components, directions of a block, residual (share of the largest eigenvalue) that counts as none, share of the trace below which a direction has no variance.
COMPONENTS, BLOCK, TOLERANCE, RANK = 32, 16, 1e-13, 1e-14
#: Bytes of centred rows that a step holds at once.
STEP_BYTES = 32 * 2**20
_SUMS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])
_TOTALS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.LongType()), T.StructField("n", T.LongType())])
_DEVIATION = T.StructType([T.StructField("total", T.DecimalType(38, 0))])
_OUT = T.StructType([T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


@dataclass(frozen=True)
class Whitening:
    """What was fitted: count and sums of the x-vectors, eigenvalues (falling), unit eigenvectors (columns), trace, passes over the rows and the largest residual."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residual: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def whole_vectors(df: DataFrame, vector_col: str, name: str = "x") -> DataFrame:
    """Written table of df with the x-vectors as `name`; rows without a usable vector are dropped."""
    (raw,) = fresh(df, "_raw")
    entry = lambda c: F.floor(c.cast("double") * SCALE)
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < float(2**62))
    usable = F.col(raw).isNotNull() & (F.size(raw) > 0) & F.forall(raw, fits)
    rows = df.withColumn(raw, F.col(vector_col)).where(usable)
    lengths = rows.groupBy(F.size(raw).alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()
    kept = rows.where(F.size(raw) == (lengths["d"] or 0)).withColumn(name, F.transform(raw, lambda c: (entry(c) + OFFSET).cast("long")))
    return written(kept.drop(raw), "whitening-vectors")


def _matrices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """First row and x-matrix of the batch's rows, a bounded number of bytes at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    if not len(column):
        return
    d = len(column[0])
    step = max(1, STEP_BYTES // (8 * d))
    for row in range(0, len(column), step):
        own = column.slice(row, step)
        yield row, own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n * x - S) / n: exact whole numbers until the last step."""
    if n < 2**62 // max(1, int(np.abs(x).max(initial=0))):
        return (n * x - sums) / n
    return ((n * x.astype(object) - sums.astype(object)) / n).astype(float)


def _totals(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    sums, n = None, 0
    for batch in batches:
        for _, x in _matrices(batch, name):
            sums = x.sum(0) if sums is None else sums + x.sum(0)
            n += len(x)
    if sums is not None:
        yield pa.record_batch([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums), pa.array(np.full(len(sums), n))], names=["i", "s", "n"])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 of each row, exact."""
    most = float(np.abs(x.astype(float) * n - sums).max(initial=0.0))
    if n * max(1.0, float(np.abs(x).max(initial=0))) < 2**62 and most * most * x.shape[1] < 2**62:
        gap = n * x - sums
        return (gap * gap).sum(1).tolist()
    gap = n * x.astype(object) - sums.astype(object)
    return [int(v) for v in (gap * gap).sum(1)]


def _total_deviation(batches: Iterator[pa.RecordBatch], name: str, n: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for _, x in _matrices(batch, name):
            total += sum(deviations(x, n, sums))
    from decimal import Decimal

    yield pa.record_batch([pa.array([Decimal(total)], pa.decimal128(38, 0))], names=["total"])


def _products(batches: Iterator[pa.RecordBatch], name: str, n: int, sums: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """X'(X Q) of a task's rows, by cell."""
    out = np.zeros(q.shape)
    for batch in batches:
        for _, x in _matrices(batch, name):
            c = _centred(x, n, sums)
            out += c.T @ (c @ q)
    yield pa.record_batch([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], names=["i", "v"])


def _cells(rows: DataFrame, function, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of what `function` gives for each cell."""
    found = rows.mapInArrow(function, _SUMS).groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # a row for each cell
    out = np.zeros(int(np.prod(shape)))
    out[found["i"].to_numpy(int)] = found["v"].to_numpy(float)
    return out.reshape(shape)


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, width: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """width directions orthogonal to the basis, and R with block = directions @ R up to the basis.

    Directions of the block that vanish, up to `floor`, are replaced by random ones, for which R has no entry; at
    most as many as there is room for.
    """
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, vt = np.linalg.svd(block, full_matrices=False)
    alive = s > floor
    q, r = u[:, alive], s[alive, None] * vt[alive]
    width = min(width, basis.shape[0] - basis.shape[1])
    q, r = q[:, :width], r[:width]
    while q.shape[1] < width:
        more, known = rng.standard_normal((basis.shape[0], width - q.shape[1])), np.hstack([basis, q])
        for _ in range(2):
            more = more - known @ (known.T @ more)
        q = np.hstack([q, np.linalg.qr(more)[0]])
    for _ in range(2):  # against the rounding that small directions of the block have magnified
        q, u = np.linalg.qr(q - basis @ (basis.T @ q))
        q = q * np.where(np.diag(u) < 0, -1.0, 1.0)
    return q, np.vstack([r, np.zeros((width - len(r), block.shape[1]))])


def block_lanczos(apply, d: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 17) -> tuple[np.ndarray, np.ndarray, int, float]:
    """The leading eigenvalues and eigenvectors of the symmetric operator, the number of its applications, the largest residual.

    apply: a d x b block to a d x b block. The projection on the basis is block tridiagonal: A on its diagonal,
    what orthogonalising the next block leaves (B) beside it; B also gives the residuals.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    basis = np.linalg.qr(rng.standard_normal((d, min(block, d))))[0]
    widths, t, passes = [basis.shape[1]], np.zeros((0, 0)), 0
    beside = None
    while True:
        q = basis[:, -widths[-1] :]
        w = apply(q)
        passes += 1
        a, m, b = q.T @ w, t.shape[0], widths[-1]
        grown = np.zeros((m + b, m + b))
        grown[:m, :m], grown[m:, m:] = t, (a + a.T) / 2
        if beside is not None:
            grown[m:, m - widths[-2] : m], grown[m - widths[-2] : m, m:] = beside, beside.T
        t = grown
        values, s = np.linalg.eigh(t)
        values, s = values[::-1][:wanted], s[:, ::-1][:, :wanted]
        scale = max(float(values[0]), np.finfo(float).tiny)
        following, beside = orthonormal(w, basis, rng, block, floor=scale * 1e-14)
        left = np.linalg.norm(beside @ s[-b:], axis=0) if len(beside) else np.zeros(len(values))
        residual = float(left.max(initial=0.0))
        # an exhausted space says nothing of what is orthogonal to it, so a block without a link is no end of its own
        linked = len(beside) == 0 or bool(np.abs(beside).max(initial=0.0) > 0)
        if basis.shape[1] == d or (linked and len(values) == wanted and residual <= tolerance * scale):
            return values, basis @ s, passes, residual / scale
        widths.append(following.shape[1])
        basis = np.hstack([basis, following])


def fit(rows: DataFrame, components: int = COMPONENTS, name: str = "x", block: int = BLOCK, seed: int = 17) -> Whitening | None:
    """The whitening of the x-vectors in column `name`; None without rows."""
    only = rows.select(name)
    found = only.mapInArrow(partial(_totals, name=name), _TOTALS).groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").toPandas()  # a row for each dimension
    if not len(found):
        return None
    n, sums = int(found["n"].iloc[0]), found["s"].to_numpy(np.int64)
    total = only.mapInArrow(partial(_total_deviation, name=name, n=n, sums=sums), _DEVIATION).agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).first()["t"]
    trace = int(total or 0) / n**3
    d = len(sums)
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 2, 0.0)
    apply = lambda q: _cells(only, partial(_products, name=name, n=n, sums=sums, q=q), q.shape) / n
    values, vectors, passes, residual = block_lanczos(apply, d, components, block, seed=seed)
    real = values > RANK * trace
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, vectors, trace, passes + 2, residual)


def _whitened(batches: Iterator[pa.RecordBatch], name: str, model, kept: list[str]) -> Iterator[pa.RecordBatch]:
    n, sums, scaled = model.value
    for batch in batches:
        for row, x in _matrices(batch, name):
            own = batch.slice(row, len(x))
            z = _centred(x, n, sums) @ scaled
            wide = [v if -(2**63) <= v < 2**63 else None for v in deviations(x, n, sums)]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            columns = [own.column(own.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(wide, pa.int64()), listed], names=[*kept, *_OUT.names])


def _moments(batches: Iterator[pa.RecordBatch], name: str, model, mean: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened rows, or, given their mean, of their centred products."""
    n, sums, scaled = model.value
    k = scaled.shape[1]
    out = np.zeros(k if mean is None else (k, k))
    for batch in batches:
        for _, x in _matrices(batch, name):
            z = _centred(x, n, sums) @ scaled
            out += z.sum(0) if mean is None else (z - mean).T @ (z - mean)
    yield pa.record_batch([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], names=["i", "v"])


def identity_error(rows: DataFrame, model, n: int, k: int, name: str = "x") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    only = rows.select(name)
    mean = _cells(only, partial(_moments, name=name, model=model, mean=None), (k,)) / n
    return float(np.abs(_cells(only, partial(_moments, name=name, model=model, mean=mean), (k, k)) / n - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, Whitening | None, float | None]:
    """df's rows that have a usable vector with `deviation` and `whitened` (array<double>), what was fitted, and the identity error."""
    had = [c for c in df.columns if c.lower() not in _OUT.names]
    (x,) = fresh(df, "_x")
    rows = whole_vectors(df, vector_col, x)
    found = fit(rows, components, x, block, seed)
    schema = T.StructType([*[f for f in df.schema if f.name in had], *_OUT])
    if found is None or not len(found.values):
        empty = rows.select(*[F.col(f"`{c}`") for c in had], F.lit(None).cast("long").alias("deviation"), F.expr("cast(array() as array<double>)").alias("whitened"))
        return empty.withColumn("deviation", F.lit(0).cast("long")), found, None
    model = df.sparkSession.sparkContext.broadcast((found.n, found.sums, found.vectors / np.sqrt(found.values)))
    error = identity_error(rows, model, found.n, len(found.values), x)
    return rows.mapInArrow(partial(_whitened, name=x, model=model, kept=had), schema), found, error


def components(whitened: DataFrame, found: Whitening | None, error: float | None, id_col: str = "vec_id") -> DataFrame:
    """One row id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    shares = F.array(*[F.lit(float(v)) for v in (found.explained if found else [])]).cast("array<double>")
    each = whitened.select(F.col(id_col), "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        id_col, (F.col("i") + 1).cast("int").alias("component"), F.lit(found.n if found else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
