"""PCA whitening of embeddings by matrix-free block subspace iteration.

A vector of finite entries c becomes the integers ``floor(64 * c) + 1000000``; each distinct integer vector is fitted once.
Each Spark pass multiplies the centred rows X of the fit list with a block Q in tasks and adds up Xᵀ(XQ), so no covariance
matrix is ever made. The driver holds blocks of d by ``block`` numbers only: it orthonormalises the product against what it
has (QR), takes Ritz pairs over the blocks since the last restart and goes on until every wanted pair's residual is below
``tolerance`` of the largest eigenvalue. A restart keeps the best Ritz vectors.

Integers are centred as ``x - floor(S / n)`` before any product, so that the large offset costs no digits; sums per
dimension and deviations are exact integers.

Defined cases: rows with a null vector, a null or non-finite entry, or an entry whose integer is beyond 2**52, are left out;
so are rows whose vector has another length than most rows have (of equally many: the greater length); components whose
eigenvalue is not above 1e-12 of the trace have no direction and are left out, hence one distinct vector gives no rows; a
null vec_id and repeated ids are rows like others; a deviation beyond a long raises an error; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import written

OFFSET, SCALE, WIDEST = 1_000_000, 64, 1 << 52
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """vec_id and x, the integer vector, of every usable row."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE) + OFFSET)
    fine = F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < WIDEST))
    found = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sizes = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("x") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


class Centre:
    """The mean of integer vectors as its floor and what is left of n times it."""

    def __init__(self, sums: list[int], n: int):
        self.n = n
        self.low = np.array([s // n for s in sums], np.int64)
        self.left = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low).astype(np.float64) - self.left / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sums of (n * x - S)**2: in longs where they surely fit, else in Python's integers."""
        off = x - self.low
        if (float(np.abs(off).max(initial=0)) + 1) * self.n * np.sqrt(x.shape[1]) < 2.0**31:
            return ((off * self.n - self.left) ** 2).sum(axis=1)
        found = [sum((int(o) * self.n - int(r)) ** 2 for o, r in zip(row, self.left, strict=True)) for row in off]
        if max(found) >= 1 << 63:
            raise OverflowError("the deviation of a vector does not fit into a long")
        return np.array(found, np.int64)


class FitList:
    """The distinct integer vectors, written once; each method is one pass over them."""

    def __init__(self, vectors: DataFrame):
        self.rows = written(vectors.select("x").distinct(), "whitening-fit")
        self.n, self.dim = self.rows.count(), len((self.rows.first() or [[]])[0])
        sums = {r["i"]: r["s"] for r in self.rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v") - OFFSET).alias("s")).collect()}
        self.centred = Centre([sums[i] + OFFSET * self.n for i in range(self.dim)], self.n)

    def summed(self, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of a matrix that ``of`` makes of a batch's centred rows: added up in tasks, then by matrix row on Spark."""
        centred = self.centred

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + of(centred(_matrix(batch.column(0))))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(np.ascontiguousarray(c), pa.float64()) for c in total.T)], names)

        names = ["i", *(f"c{k}" for k in range(width))]
        parts = self.rows.mapInArrow(each, ", ".join(["i int", *(f"{c} double" for c in names[1:])]))
        found = sorted(parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names[1:])).collect())
        return np.array([r[1:] for r in found], np.float64)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q."""
        return self.summed(q.shape[1], lambda x: x.T @ (x @ q)) / self.n

    def trace(self) -> float:
        return float(self.summed(1, lambda x: np.array([[np.einsum("ij,ij->", x, x)]]))[0, 0]) / self.n


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis; directions that add nothing go."""
    if not block.shape[1]:
        return block
    block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(3):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10]
    for _ in range(2):
        u = np.linalg.qr(u - basis @ (basis.T @ u))[0] if u.shape[1] else u
    return u


def leading(fit: FitList, trace: float, k: int, spare: int = 8, blocks: int = 5, tolerance: float = 1e-13, most_passes: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the k leading components."""
    k = min(k, fit.dim)
    width = min(fit.dim, k + spare)
    rng = np.random.default_rng(12)
    basis, products = np.zeros((fit.dim, 0)), np.zeros((fit.dim, 0))
    block = _orthonormal(rng.standard_normal((fit.dim, width)), basis)
    for _ in range(most_passes):
        product = fit.times(block)
        basis, products = np.hstack([basis, block]), np.hstack([products, product])
        small = basis.T @ products
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        vectors, images = basis @ w, products @ w
        residual = images - vectors * e
        if np.linalg.norm(residual[:, :k], axis=0).max() <= tolerance * max(e[0], 1e-300) or basis.shape[1] >= fit.dim or e[0] <= 1e-12 * trace:
            return e[:k], vectors[:, :k]
        block = _orthonormal(residual[:, :width], basis)
        if not block.shape[1]:
            block = _orthonormal(rng.standard_normal((fit.dim, width)), basis)
        if basis.shape[1] + width > blocks * width:
            basis, products = vectors[:, : 2 * width], images[:, : 2 * width]
            block = _orthonormal(block, basis)
        block = block[:, : fit.dim - basis.shape[1]]
    raise RuntimeError("subspace iteration did not settle")


def whiten(rows: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows)
    if vectors.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    fit = FitList(vectors)
    trace = fit.trace()
    e, v = leading(fit, trace, components) if trace > 0 else (np.zeros(0), np.zeros((fit.dim, 0)))
    kept = e > 1e-12 * trace
    e, v = e[kept], v[:, kept]
    if not len(e):
        return spark.createDataFrame([], SCHEMA)
    scaled = v / np.sqrt(e)
    moments = fit.summed(len(e) + 1, lambda x: np.vstack([(w := np.hstack([x @ scaled, np.ones((len(x), 1))])).T @ w])) / fit.n
    mean = moments[-1, :-1]
    error = float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(len(e))).max())
    n, k, centred, explained = fit.n, len(e), fit.centred, e / trace

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _matrix(part.column(1))
                deviation = centred.deviation(x)
                m = len(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(np.repeat(deviation, k), pa.int64()),
                        pa.array((centred(x) @ scaled).ravel(), pa.float64()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(each, SCHEMA)
