"""Whitening of embeddings by principal components.

Spark gathers exact sums, then products of centred rows: each task adds up a
matrix of its own and sends it row by row, so every row of the covariance is a
sum of its own.  The matrix of dimensions by dimensions is small whatever the
table's size, and the driver takes it apart: Householder reflections make it
tridiagonal, counts of sign changes (Sturm sequences) bisect its leading
eigenvalues, inverse iteration finds their vectors, and vectors whose
eigenvalues lie close together are made orthogonal to each other again.  The
components are broadcast, and a last pass projects every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3
#: A component with less than this share of the largest eigenvalue, times the dimensions, is rounding noise.
NOISE = 1e-12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix, reduced by Householder's method."""
    a, n, reflections = matrix.astype(float).copy(), len(matrix), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if not np.any(v[1:]):
            reflections.append(np.zeros(len(v)))
            continue
        head = -length if v[0] > 0 else length
        v[0] -= head
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = head
        reflections.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``: the negative terms of its Sturm sequence."""
    tiny = np.finfo(float).tiny / EPS
    count, q = np.zeros(len(at), int), None
    for d, e in zip(diagonal, np.append(0.0, off)):
        q = d - at - (0.0 if q is None else e * e / q)
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a term of 0 counts as negative, and the next one follows from that
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, largest first, each bisected until its bounds are neighbours."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    norm = float(np.max(np.abs(diagonal) + reach))
    low = np.full(k, float(np.min(diagonal - reach)) - 2 * n * EPS * norm)
    high = np.full(k, float(np.max(diagonal + reach)) + 2 * n * EPS * norm)
    rank = n - 1 - np.arange(k)  # eigenvalues below the one that is sought
    while np.any(high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)) + EPS * EPS * norm):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = count_below(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low + (high - low) / 2


def _factors(diagonal: np.ndarray, off: np.ndarray, value: float, tiny: float) -> list[tuple[bool, float, float, float, float]]:
    """Gaussian elimination of the shifted matrix with row exchanges: (exchanged, multiplier, three entries of U) per row."""
    n, out = len(diagonal), []
    a, b, c = float(diagonal[0] - value), float(off[0]) if n > 1 else 0.0, 0.0
    for i in range(n - 1):
        low, mid, right = float(off[i]), float(diagonal[i + 1] - value), float(off[i + 1]) if i + 2 < n else 0.0
        if abs(a) >= abs(low):
            a = a or tiny
            m = low / a
            out.append((False, m, a, b, c))
            a, b, c = mid - m * b, right - m * c, 0.0
        else:
            m = a / low
            out.append((True, m, low, mid, right))
            a, b, c = b - m * mid, c - m * right, 0.0
    out.append((False, 0.0, a if abs(a) > tiny else tiny, 0.0, 0.0))
    return out


def _solve(factors: list[tuple[bool, float, float, float, float]], right: np.ndarray) -> np.ndarray:
    x, n = right.tolist(), len(right)
    for i in range(n - 1):
        swap, m, *_ = factors[i]
        if swap:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= m * x[i]
    for i in range(n - 1, -1, -1):
        _, _, a, b, c = factors[i]
        x[i] = (x[i] - (b * x[i + 1] if i + 1 < n else 0.0) - (c * x[i + 2] if i + 2 < n else 0.0)) / a
        if abs(x[i]) > 1e200:  # only the direction counts
            x = [y * 1e-200 for y in x]
    return np.array(x)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 4) -> np.ndarray:
    """Unit eigenvectors as columns, by inverse iteration; inside a cluster each is kept orthogonal to its predecessors."""
    n = len(diagonal)
    norm = float(np.max(np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off)))) or 1.0
    out, draw = np.zeros((n, len(values))), np.random.default_rng(n)
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # Equal eigenvalues are told apart a little, so that their systems differ.
        shift = min(float(value), shift - 10 * EPS * norm) if j > first else float(value)
        factors = _factors(diagonal, off, shift, EPS * norm)
        x = draw.uniform(-1, 1, n)
        for _ in range(steps):
            x = _solve(factors, x / np.max(np.abs(x)))
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
                x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, largest first, and their unit vectors as columns.

    A vector's entry of largest size is positive.
    """
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale or not k:
        return np.zeros(min(k, len(matrix))), np.eye(len(matrix))[:, :k]
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, min(k, len(matrix)))
    vectors = tridiagonal_vectors(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    largest = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])]
    return values * scale, vectors * np.where(largest < 0, -1.0, 1.0)


@dataclass
class Fit:
    """What whitening knows of a table: rows, sums, leading eigenvalues and components of its covariance, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    scale: float
    offset: int


def _usable(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, c`` of the vectors that are whole and finite, and small enough for whole numbers of 64 bits."""
    c = F.col("embedding").cast("array<double>")
    limit = float(1 << 62) / scale
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= limit)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & ~F.exists("c", bad))


def _whole(column: pa.Array, width: int, scale: float, offset: int) -> np.ndarray:
    """Lists of entries as rows of whole numbers; shorter ones are filled up with entries 0."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64) + offset
    out = np.full((len(size), width), offset, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = entries
    return out


def _from_sums(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` exactly: 64-bit numbers where they suffice, else Python's."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _exact_squares(far: np.ndarray) -> list[int | None]:
    """Sums of squares of each row; null where a long does not hold them."""
    most = int(np.abs(far).max()) if far.size else 0
    if far.dtype != object and most * most * max(1, far.shape[1]) < 1 << 62:
        return (far * far).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in far.tolist())]


def _added(rows: DataFrame, width: int, make: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``make(batch)``, matrices of ``width`` columns, over all batches; each of its rows is added up in a group of its own."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
        if total is not None:
            lines = [line.tobytes() for line in np.ascontiguousarray(total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.binary())], ["i", "line"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, i = np.zeros(width), 0
        for batch in batches:
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = total + np.frombuffer(line)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "line"])

    found = rows.mapInArrow(work, "i int, line binary").groupBy("i").applyInArrow(add, "i int, line binary").collect()
    return np.array([np.frombuffer(line) for _, line in sorted(found)])


def _exact_sums(rows: DataFrame, scale: float, offset: int) -> tuple[int, list[int]]:
    """Number of vectors, and their sum in each dimension."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in batches:
            width = pc.max(pc.list_value_length(batch.column(1))).as_py() or 0
            x = _whole(batch.column(1), width, scale, 0)
            n += len(x)
            sums += [0] * (width - len(sums))
            for d in range(width):
                small = int(np.abs(x[:, d]).max(initial=0)) * max(1, len(x)) < 1 << 62
                sums[d] += int(x[:, d].sum()) if small else sum(x[:, d].tolist())
        if n:
            # The entry -1 carries the number of vectors.
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([str(v) for v in [n, *sums]])], ["d", "sum"])

    found = rows.mapInArrow(work, "d int, sum string").groupBy("d").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    sums = {d: int(v) for d, v in found}
    n = sums.pop(-1, 0)
    return n, [sums[d] + n * offset for d in range(len(sums))]


def fit(vectors: DataFrame, k: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> Fit:
    """Sums, covariance (divisor n, rows centred before they are multiplied) and leading components of a table.

    Entries c count as ``floor(scale * c) + offset``.  A table of equal
    vectors, or none, has no components.
    """
    rows = _usable(vectors, scale)
    n, sums = _exact_sums(rows, scale, offset)
    width = len(sums)
    if not n or not width:
        return Fit(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0, scale, offset)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        far = (_from_sums(_whole(batch.column(1), width, scale, offset), n, sums) / n).astype(float)
        return far.T @ far

    covariance = _added(rows, width, products) / n
    covariance = (covariance + covariance.T) / 2
    values, components = leading_components(covariance, min(k, width))
    kept = values > NOISE * width * max(values[0], 0.0)
    return Fit(n, sums, values[kept], components[:, kept], float(np.trace(covariance)), scale, offset)


def whiten(vectors: DataFrame, k: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each vector and component.

    Vectors that are null or hold null or non-finite entries are dropped, as
    are those with entries of 2**62 / ``scale`` or more, which are no 64-bit
    whole numbers.  Shorter vectors are filled up with entries 0.  The fit list
    is all other rows, repeated ones as often as they occur, also those without
    an id.  There are fewer components than ``k`` where vectors have fewer
    dimensions or lie in a flat subspace; equal vectors only, or an empty table,
    give no rows.  ``deviation`` is null where a long does not hold it.  Other
    columns are not read.

    The covariance of the whitened rows is gathered in passes of its own:
    ``identity_error`` is its largest distance from the identity, one value for
    all rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    found = fit(vectors, k, scale, offset)
    if not len(found.values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((found.n, found.sums, found.components / np.sqrt(found.values)))
    rows, kept = _usable(vectors, scale), len(found.values)

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n, sums, basis = shared.value
        far = _from_sums(_whole(batch.column(1), len(sums), scale, offset), n, sums)
        return far, (far / n).astype(float) @ basis

    mean = _added(rows, kept, lambda batch: projected(batch)[1].sum(axis=0, keepdims=True))[0] / found.n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        near = projected(batch)[1] - mean
        return near.T @ near

    error = float(np.abs(_added(rows, kept, products) / found.n - np.eye(kept)).max())
    explained = found.values / found.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                far, white = projected(batch)
                m = batch.num_rows
                row = np.repeat(np.arange(m), kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, found_n)),
                        pa.array(_exact_squares(far), pa.int64()).take(pa.array(row)), pa.array(white.ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    found_n = found.n
    return rows.mapInArrow(work, schema)
