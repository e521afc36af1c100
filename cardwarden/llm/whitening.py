"""Whitening of embeddings by shifted CholeskyQR.

The centred vectors are the rows of a tall matrix. A pass over the table adds up the Gram matrix of
its rows in every task, the partial sums are added on executors, and the driver factors the small
result. The rows of the next pass are the same vectors after a triangular solve with the factors so
far. The first factors carry a shift, so a Gram matrix that is singular in floating point has one
too; passes repeat until the rows are orthonormal to working precision. The product of the factors
is the R of the whole table, and its singular values and vectors are those of the centred vectors.

The driver holds a few matrices of the vectors' dimension, never a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: x = floor(SCALE * c) + OFFSET
SCALE, OFFSET = 1024, 100_000
#: Entries beyond this have no 64-bit x and make a vector unusable, as infinities do.
LARGEST = 2.0**50
MAX_PASSES = 8
#: Partial sums that one executor task adds up at most, before the last sum.
FAN_IN = 64
#: Rows taken into floating point at a time.
BLOCK = 4096
PARTIAL = "n long, total binary"


def usable(vectors: Column, dims: int) -> Column:
    fits = F.forall(vectors, lambda c: c.isNotNull() & (F.abs(c) <= F.lit(LARGEST)))
    return vectors.isNotNull() & (F.size(vectors) == dims) & fits


def common_dimension(vectors: DataFrame) -> int:
    """The most frequent length among the vectors (ties: the greater), 0 if there is none."""
    sizes = vectors.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def blocks(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, x) of each block of a column of clean vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    c = flat.reshape(-1, dims)
    for at in range(0, len(c), BLOCK):
        yield at, np.floor(SCALE * c[at : at + BLOCK]).astype(np.int64) + OFFSET


class Centre:
    """The sums of the fit list; gives vectors minus their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.mean = np.array([s // n for s in sums], np.int64)  # whole part; the rest is below one
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exactly; null where it passes 64 bits."""
        whole = x - self.mean
        rough = (((np.abs(whole).astype(float) + 1) * self.n) ** 2).sum(1)
        if len(rough) and rough.max() < 2.0**62:
            return ((whole * self.n - self.rest) ** 2).sum(1).tolist()
        exact = ((whole.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(1).tolist()
        return [e if e < 1 << 63 else None for e in exact]


def _added(partials: DataFrame, kind: type, n_tasks: int) -> tuple[int, np.ndarray | None]:
    """Add up (n, total) rows: on executors a few at a time, so no task or driver holds them all."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            for m, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(part.as_py(), kind)
                n, total = n + m, values.copy() if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    while n_tasks > 1:
        n_tasks = -(-n_tasks // FAN_IN)
        partials = partials.repartition(n_tasks).mapInArrow(run, PARTIAL)
    rows = partials.collect()  # one row
    return (rows[0]["n"], np.frombuffer(rows[0]["total"], kind)) if rows else (0, None)


class _Table:
    """The clean vectors of a table, and passes over them."""

    def __init__(self, df: DataFrame, dims: int):
        self.df, self.dims = df, dims
        # Every task gives one partial sum at most.
        self.n_tasks = max(2, df.select("v").rdd.getNumPartitions())

    def totals(self, of_block: Callable[[np.ndarray], np.ndarray], kind: type) -> tuple[int, np.ndarray | None]:
        """The number of vectors and the sum of ``of_block`` over blocks of their x."""
        dims = self.dims

        def run(batches):
            n, total = 0, None
            for batch in batches:
                for _, x in blocks(batch.column(0), dims):
                    part = of_block(x).ravel()
                    n, total = n + len(x), part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.astype(kind).tobytes()], pa.binary())], ["n", "total"])

        return _added(self.df.select("v").mapInArrow(run, PARTIAL), kind, self.n_tasks)

    def centre(self) -> Centre | None:
        """Sums as 32-bit halves, so that no number of rows overflows them on the way."""

        def halves(x: np.ndarray) -> np.ndarray:
            return np.stack([x >> 32, x & 0xFFFFFFFF]).sum(1)

        n, total = self.totals(halves, np.int64)
        if not n:
            return None
        high, low = total.reshape(2, -1).tolist()
        return Centre(n, [(h << 32) + w for h, w in zip(high, low)])

    def gram(self, centre: Centre, factors: list[np.ndarray]) -> np.ndarray:
        """The Gram matrix of the centred rows after a solve with each triangular factor."""
        solve = [np.linalg.inv(r) for r in factors]

        def of_block(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            for inverse in solve:
                rows = rows @ inverse
            return rows.T @ rows

        _, total = self.totals(of_block, np.float64)
        return total.reshape(self.dims, self.dims)


def shifted_cholesky(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper factor of ``gram``, shifted at first or where it is singular in floating point."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    # The bound above is for the worst rounding; a smaller shift is enough, and is tried first.
    shift = min(shift, 1e-10 * np.trace(gram)) if shifted else 0.0
    for _ in range(60):
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, d * np.finfo(float).eps * np.trace(gram))
    raise ArithmeticError("the Gram matrix has no Cholesky factor")


def qr_factor(table: _Table, centre: Centre) -> tuple[np.ndarray, int]:
    """R of the centred vectors, and the Gram passes it took."""
    d = table.dims
    factors: list[np.ndarray] = []
    r = np.eye(d)
    for k in range(MAX_PASSES):
        gram = table.gram(centre, factors)
        gram = (gram + gram.T) / 2
        if not np.trace(gram) > 0:
            return np.zeros((d, d)), k + 1
        if k > 1 and np.abs(gram - np.eye(d)).max() < 1e-13 * d:
            return r, k + 1
        factor = shifted_cholesky(gram, centre.n, k == 0)
        factors.append(factor)
        r = factor @ r
        # A clean third factor leaves rows that are orthonormal to working precision.
        if k > 1 and np.abs(gram - np.eye(d)).max() < 1e-6:
            return r, k + 1
    return r, MAX_PASSES


def components_of(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and its unit eigenvectors as columns.

    Of each vector the entry of largest size is positive. Eigenvalues that rounding alone can bring
    about are 0.
    """
    _, s, vt = np.linalg.svd(r)
    s = np.where(s > len(s) * np.finfo(float).eps * s[0] * 8, s, 0.0)
    v = vt.T
    top = v[np.abs(v).argmax(0), np.arange(v.shape[1])]
    return s**2 / n, v * np.where(top < 0, -1.0, 1.0)


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double, gram_passes int"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """Per usable row and component: id, component (from 1), n, deviation, whitened, explained,
    identity_error, gram_passes.

    Rows are left out if the vector is null, holds null, NaN, infinite or entries beyond 2^50, or
    is not of the most frequent length (ties: the greater; empty vectors have no coordinates). Null
    ids and repeated rows are rows like any other. With fewer dimensions than ``components`` there
    is one component a dimension. A component without variance has explained 0 and a null whitened
    value and no part in identity_error, which is null if there is no other. ``deviation`` is null
    where it passes 64 bits. An empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(df[id_col].alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))
    if str(df.schema[vector_col].dataType.elementType) == "FloatType()":
        rows = df.select(df[id_col].alias("vec_id"), df[vector_col].alias("v"))
    out = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), *T.StructType.fromDDL(RESULT).fields])
    dims = common_dimension(rows)
    clean = rows.where(usable(F.col("v"), dims))
    table = _Table(clean, dims)
    centre = table.centre() if dims else None
    if centre is None:
        return df.sparkSession.createDataFrame([], out)
    r, passes = qr_factor(table, centre)
    values, vectors = components_of(r, centre.n)
    k = min(components, dims)
    live = values[:k] > 0
    share = values[:k] / values.sum() if values.sum() > 0 else np.zeros(k)
    scale = vectors[:, :k] / np.sqrt(np.where(live, values[:k], 1.0))
    error = _identity_error(table, centre, scale[:, live])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for at, x in blocks(batch.column(1), dims):
                m = len(x)
                white = (centre.centred(x) @ scale).ravel()
                null = np.tile(~live, m)
                every = np.repeat(np.arange(at, at + m), k)
                columns = [
                    batch.column(0).take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n)),
                    pa.array(centre.deviations(x), pa.int64()).take(pa.array(every - at)),
                    pa.array(white, mask=null),
                    pa.array(np.tile(share, m)),
                    pa.array([error] * (m * k), pa.float64()),
                    pa.array(np.full(m * k, passes, np.int32)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return clean.mapInArrow(run, out)


def _identity_error(table: _Table, centre: Centre, scale: np.ndarray) -> float | None:
    """The largest entry of the whitened rows' covariance minus the identity, by one more pass."""
    k = scale.shape[1]
    if not k:
        return None

    def of_block(x: np.ndarray) -> np.ndarray:
        white = centre.centred(x) @ scale
        return np.concatenate([white.sum(0), (white.T @ white).ravel()])

    n, total = table.totals(of_block, np.float64)
    mean, square = total[:k] / n, total[k:].reshape(k, k) / n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
