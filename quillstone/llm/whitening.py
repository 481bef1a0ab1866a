"""Embedding whitening by matrix-free block Lanczos.

The covariance is never formed. A pass over the vectors multiplies it with a
block of directions: every task centres its rows, adds X'(X v) up and gives
out one small block, and the blocks are added by Spark. The new directions
are made orthogonal to all earlier ones, twice (full reorthogonalisation).
Directions that vanish (the space is exhausted, or vectors repeat) are
replaced by random ones orthogonal to the rest: a restart on breakdown. Ritz
pairs are taken from the products already made, with residuals; passes end
when the residuals of all wanted components are at rounding error. A basis that
has grown to its limit is restarted from its best Ritz vectors. The trace is
the sum of the rows' deviations, so shares need no other eigenvalue.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared

COMPONENTS = 8
BLOCK = 8  # directions multiplied in a pass
BASIS = 512  # directions kept before a restart
TOLERANCE = 1e-13  # of residuals, as a share of the largest eigenvalue
PASSES = 400
SCALE, SHIFT = 1024, 100_000
_ROWS = 4096  # rows of a batch multiplied at once


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>, length) of vectors without null or non-finite entries: floor(1024 c) + 100000 of each entry c as double."""
    wide = vectors.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = wide.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return finite.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x"), F.size("v").alias("length"))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def sums(rows: DataFrame, length: int) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension."""
    total = rows.agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(length))).alias("s")).first()
    return total["n"], [int(s) for s in total["s"]] if total["n"] else []


def covariance_times(rows: DataFrame, length: int, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The rows' covariance times a block of directions, in one pass. What comes to the driver is a block."""
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, width))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                centred = _matrix(batch.column(0).slice(at, _ROWS), length) - mean
                total += centred.T @ (centred @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "value"])

    parts = rows.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(length * width)
    for at, value in map(tuple, parts.collect()):
        out[at] = value
    return out.reshape(length, width) / n


def _orthogonal(new: np.ndarray, basis: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """At most `most` orthonormal directions: those of `new` that aren't in the basis, random ones in place of those that vanish."""
    kept: list[np.ndarray] = []
    room = min(most, basis.shape[0] - basis.shape[1])
    for candidate in new.T:
        if len(kept) == room:
            break
        norm = np.linalg.norm(candidate)
        for attempt in range(3):
            if attempt or not norm > 0:
                candidate = rng.standard_normal(basis.shape[0])
            v = candidate / np.linalg.norm(candidate)
            size = 1.0
            for _ in range(3):
                for have in (basis, np.array(kept).T if kept else basis[:, :0]):
                    v = v - have @ (have.T @ v)
                size *= (left := np.linalg.norm(v))
                if left < 1e-300:
                    break
                v = v / left
            if size > 1e-10:
                kept.append(v)
                break
    return np.array(kept).T.reshape(basis.shape[0], len(kept))


def components(multiply, length: int, wanted: int = COMPONENTS, block: int = BLOCK, most_basis: int = BASIS, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, of the symmetric matrix that `multiply` applies to a block.

    A space of fewer dimensions has fewer. Equal eigenvalues have any
    orthonormal vectors of their space. Raises if residuals don't get down
    to the tolerance (or to rounding error of the whole space) in time.
    """
    wanted = min(wanted, length)
    most_basis = min(length, max(most_basis, 2 * (wanted + block)))
    rng = np.random.default_rng(seed)
    basis, product = np.zeros((length, 0)), np.zeros((length, 0))
    new = rng.standard_normal((length, min(block, length)))
    for _ in range(passes):
        fresh = _orthogonal(new, basis, rng, block)
        basis, product = np.hstack([basis, fresh]), np.hstack([product, multiply(fresh)])
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        k = min(wanted, len(values))
        vectors = basis @ turn[:, :k]
        residual = product @ turn[:, :k] - vectors * values[:k]
        if basis.shape[1] == length or (k == wanted and np.linalg.norm(residual, axis=0).max() <= tolerance * max(values[0], 0)):
            return np.maximum(values[:k], 0), vectors / np.linalg.norm(vectors, axis=0)
        new = product[:, -fresh.shape[1] :] - basis @ (basis.T @ product[:, -fresh.shape[1] :])
        if basis.shape[1] + block > most_basis and most_basis < length:
            kept = min(most_basis - block, max(2 * wanted, most_basis // 2))
            basis, product = basis @ turn[:, :kept], product @ turn[:, :kept]
            new = np.hstack([residual, rng.standard_normal((length, max(0, block - k)))])[:, :block]
    raise ArithmeticError(f"components haven't converged in {passes} passes")


def _exact_deviation(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2 in whole numbers; an error where these need more than 63 bits."""
    span = max(abs(int(x.max()) * n), abs(int(x.min()) * n), 1) + int(np.abs(total).max())
    if span < 1 << 63:
        apart = n * x - total
        largest = int(np.abs(apart).max())
        if largest * largest * x.shape[1] < 1 << 63:
            return (apart * apart).sum(1)
    rows = [sum((n * a - int(s)) ** 2 for a, s in zip(row, total.tolist(), strict=True)) for row in x.tolist()]
    if max(rows) >= 1 << 63:
        raise OverflowError("a deviation needs more than 63 bits; scale the vectors down")
    return np.array(rows, np.int64)


def _whitened(rows: DataFrame, length: int, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray, kind: str) -> DataFrame:
    """(vec_id, deviation, w): each row's deviation and its whitened components as an array."""
    whole = np.array(total, object)
    small = all(abs(s) < 1 << 62 for s in total)
    mean, by = np.array([s / n for s in total]), vectors / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = _matrix(part.column(1), length)
                deviation = _exact_deviation(x, n, whole.astype(np.int64) if small else whole)
                w = (x - mean) @ by
                offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))], ["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation bigint, w array<double>")


def _of_length(rows: DataFrame, length: int, wanted: int, options: dict, kind: str) -> DataFrame | None:
    rows = rows.where(F.col("length") == length)
    n, total = sums(rows, length)
    mean = np.array([s / n for s in total])
    values, vectors = components(lambda block: covariance_times(rows, length, mean, n, block), length, wanted, **options)
    # A direction in which nothing varies can't be brought to unit variance.
    real = values > 1e-12 * max(values[0], 1e-300) if len(values) else np.zeros(0, bool)
    if not real.any():
        return None
    values, vectors = values[real], vectors[:, real]
    out = _shared.settle(_whitened(rows, length, n, total, values, vectors, kind), "whitened")
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    stats = out.agg(F.sum(F.col("deviation").cast("double")).alias("trace"), *(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    trace = stats["trace"] / n / n / n
    error = max(abs(stats[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.lit([float(v / trace) for v in values])
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, key: str = "vec_id", column: str = "embedding", **options) -> DataFrame:
    """Project vectors on their leading principal components, each scaled to unit variance.

    Returns vec_id, component int (from 1), n long, deviation long, whitened,
    explained and identity_error double; a row for each vector and component.
    Vectors that are null or hold null or non-finite entries drop out; those
    of another length are fitted among their own (n is then their number);
    empty vectors and vectors that are all equal have no component and give
    no rows. Fewer dimensions, or fewer directions in which anything varies,
    give fewer components. Repeated rows and null keys are kept and count as
    often as they occur. Extra columns don't pass; an empty table gives no
    rows. A deviation beyond 63 bits is an error, not a wrong number. Options go to components().
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = _shared.settle(quantised(vectors, key, column), "quantised")
    lengths = sorted(r.length for r in rows.select("length").distinct().collect() if r.length)
    found = [x for x in (_of_length(rows, length, wanted, options, kind) for length in lengths) if x is not None]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(_shared.table(spark, sf_dir, "embeddings"))
