"""Whitening of embeddings along the leading axes of their covariance.

Vectors become integers first, so that counts, sums, equal vectors and deviations are
exact; the covariance is summed from integers that were centred before, and rounded once.
Its leading eigenvalues are found by spectrum slicing: the signs of the pivots of an LDL'
factorisation of the shifted matrix count the eigenvalues above the shift, halving an
interval by such counts isolates one eigenvalue, Rayleigh quotient iteration started there
converges cubically, and two more counts certify which eigenvalue it is. The matrix has
the size of one vector squared; everything that grows with the rows stays in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundswell.llm.common import checkpointed, give_back

SCALE = 256
LARGEST = float(2**62)  # entries beyond this, scaled, do not fit a long
EXACT = 2**53  # integers below this are exact as doubles
EPS = np.finfo(float).eps
COMPONENTS = 4
ROWS = 4096  # vectors handled at a time


# --- integer vectors -------------------------------------------------------------------


def integer_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (row numbers, integer matrix)} of the usable vectors of a list column."""
    column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    lengths, starts = np.diff(offsets), offsets[:-1]
    valid = np.asarray(column.is_valid())
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * SCALE)
        good = np.abs(values) < LARGEST  # false for NaN, too
    found = {}
    for length in np.unique(lengths[valid & (lengths > 0)]).tolist():
        rows = np.flatnonzero(valid & (lengths == length))
        cells = starts[rows][:, None] + np.arange(length)
        usable = good[cells].all(axis=1)
        if usable.any():
            found[length] = rows[usable], values[cells[usable]].astype(np.int64)
    return found


def pack_vector(vector: np.ndarray) -> bytes:
    """Bytes of an integer vector at the least width; equal vectors have equal bytes."""
    low, high = int(vector.min()), int(vector.max())
    for code in ("i1", "<i2", "<i4", "<i8"):
        limits = np.iinfo(code)
        if limits.min <= low and high <= limits.max:
            return bytes([limits.bits]) + vector.astype(code).tobytes()
    raise AssertionError


def unpack_vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0] // 8}", offset=1).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for length, (rows, matrix) in integer_vectors(batch.column(0)).items():
            data = {pack_vector(row) for row in matrix}
            columns = [pa.array([length] * len(data), pa.int32()), pa.array(list(data), pa.binary())]
            yield pa.record_batch(columns, names=["length", "vector"])
    give_back()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, integer matrix) from packed vectors, a bounded number of rows each."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            lengths = part.column(0).to_numpy()
            vectors = part.column(1).to_pylist()
            for length in np.unique(lengths).tolist():
                yield length, np.stack([unpack_vector(vectors[i]) for i in np.flatnonzero(lengths == length)])


def exact_sums(matrix: np.ndarray) -> list[int]:
    """Column sums of integers, without overflow."""
    if len(matrix) * (int(np.abs(matrix).max(initial=0)) + 1) < 2**62:
        return matrix.sum(axis=0).tolist()
    return matrix.astype(object).sum(axis=0).tolist()


def exact_products(matrix: np.ndarray) -> np.ndarray:
    """matrix' * matrix of integers as Python integers, by floating point where that is exact."""
    largest = int(np.abs(matrix).max(initial=0)) if matrix.dtype != object else EXACT
    if largest * largest * len(matrix) < EXACT:
        real = matrix.astype(float)
        return (real.T @ real).astype(np.int64).astype(object)
    matrix = matrix.astype(object)
    return matrix.T @ matrix


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, i, j, value): the number of vectors at i = -1, column sums at i."""
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for length, matrix in _matrices(batches):
        counts[length] = counts.get(length, 0) + len(matrix)
        sums[length] = [a + b for a, b in zip(sums.get(length, [0] * length), exact_sums(matrix))]
    rows = [(length, -1, -1, n) for length, n in counts.items()]
    rows += [(length, i, -1, value) for length, found in sums.items() for i, value in enumerate(found)]
    if rows:
        yield _cells(rows)
    give_back()


def _products(centres: dict[int, list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, i, j, value): sums of products of the centred columns i <= j."""
    sums: dict[int, np.ndarray] = {}
    for length, matrix in _matrices(batches):
        found = exact_products(shifted(matrix, centres[length]))
        sums[length] = sums[length] + found if length in sums else found
    for length, found in sums.items():
        for i in range(length):
            yield _cells([(length, i, j, found[i, j]) for j in range(i, length)])
    give_back()


CELLS = "length int, i int, j int, limb int, value long"
LIMB = 40  # bits; the tasks' limbs add up within a long


def _cells(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """Whole numbers of any size as signed limbs, a row each."""
    parts = []
    for length, i, j, value in rows:
        sign, value, limb = (-1 if value < 0 else 1), abs(int(value)), 0
        while value or not limb:
            parts.append((length, i, j, limb, sign * (value & ((1 << LIMB) - 1))))
            value, limb = value >> LIMB, limb + 1
    columns = [pa.array(x, pa.int32()) for x in list(zip(*parts))[:4]]
    columns.append(pa.array([part[4] for part in parts], pa.int64()))
    return pa.record_batch(columns, names=["length", "i", "j", "limb", "value"])


def _total(cells: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Exact sums of the tasks' cells; as many as a vector has entries, squared at most."""
    found: dict[int, dict[tuple[int, int], int]] = {}
    for row in cells.groupBy("length", "i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        of = found.setdefault(row["length"], {})
        of[row["i"], row["j"]] = of.get((row["i"], row["j"]), 0) + (row["value"] << (LIMB * row["limb"]))
    return found


def shifted(matrix: np.ndarray, centre: list[int]) -> np.ndarray:
    """Integer rows minus an integer centre; Python integers where long ones do not hold it."""
    largest = max(int(np.abs(matrix).max(initial=0)), max(map(abs, centre), default=0))
    if largest < 2**61:
        return matrix - np.array(centre, np.int64)
    return matrix.astype(object) - np.array(centre, object)


# --- eigenvalues -----------------------------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of LDL' of the shifted one.

    Pivots are single entries or blocks of two, chosen by the largest entry of what is left,
    so that the factors stay bounded; a block of two has one positive and one negative root.
    """
    left = matrix - shift * np.eye(len(matrix))
    above, alpha = 0, (1 + np.sqrt(17)) / 8
    while (n := len(left)) > 0:
        diagonal = np.abs(np.diagonal(left))
        p = int(diagonal.argmax())
        if n > 1:
            off = np.abs(left)
            np.fill_diagonal(off, -1)
            r, s = divmod(int(off.argmax()), n)
        if n == 1 or diagonal[p] >= alpha * off[r, s]:
            pivot = left[p, p]
            above += pivot > 0
            rest = np.delete(np.arange(n), p)
            column = left[rest, p]
            left = left[np.ix_(rest, rest)]
            if pivot != 0:
                left = left - np.outer(column, column) / pivot
        else:
            above += 1
            pair, rest = [r, s], np.delete(np.arange(n), [r, s])
            columns = left[np.ix_(rest, pair)]
            left = left[np.ix_(rest, rest)] - columns @ np.linalg.solve(left[np.ix_(pair, pair)], columns.T)
        left = (left + left.T) / 2
    return int(above)


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray, scale: float) -> np.ndarray:
    for step in (0.0, EPS, 8 * EPS):
        try:
            found = np.linalg.solve(matrix - (shift + step * scale) * np.eye(len(matrix)), vector)
        except np.linalg.LinAlgError:
            continue
        size = np.linalg.norm(found)
        if np.isfinite(size) and size > 0:
            return found / size
    return vector


def _clean(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (other @ vector) * other
    size = np.linalg.norm(vector)
    return vector / size if size > 0 else vector


def _quotient(matrix: np.ndarray, low: float, high: float, others: list[np.ndarray], scale: float):
    """Rayleigh quotient iteration from inside an interval; (eigenvalue, vector, residual)."""
    rng = np.random.default_rng(len(others))
    value = (low + high) / 2
    vector = _clean(rng.normal(size=len(matrix)), others)
    for _ in range(3):  # inverse iteration: into the interval's own direction
        vector = _clean(_solve(matrix, value, vector, scale), others)
    best = np.inf, value, vector
    for _ in range(12):
        value = vector @ matrix @ vector
        residual = np.linalg.norm(matrix @ vector - value * vector)
        if residual >= best[0] / 2 and best[0] <= 64 * EPS * scale:
            break
        if residual < best[0]:
            best = residual, value, vector
        vector = _clean(_solve(matrix, value, vector, scale), others)
    return best[1], best[2], best[0]


def leading_pairs(matrix: np.ndarray, wanted: int) -> list[tuple[float, np.ndarray]]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, with unit vectors.

    An interval is halved until it holds one eigenvalue, and further until the iteration
    stays inside. Eigenvalues that double precision cannot tell apart share an interval; their
    vectors are any orthogonal ones of their common space. A vector's largest entry is
    positive.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max())
    if scale == 0:
        return [(0.0, row) for row in np.eye(n)[: min(wanted, n)]]
    least = 4 * n * EPS * scale
    counts = {-scale - least: n, scale + least: 0}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    found: list[tuple[float, np.ndarray]] = []
    for number in range(1, min(wanted, n) + 1):
        low = max(s for s, c in counts.items() if c >= number)
        high = min(s for s, c in counts.items() if c < number and s > low)
        while True:
            alone = above(low) == number and above(high) == number - 1
            if alone or high - low <= least:
                value, vector, residual = _quotient(matrix, low, high, [v for _, v in found], scale)
                edge = max(residual, least)
                inside = low - edge <= value <= high + edge
                if inside and above(value - edge) >= number and above(value + edge) < number:
                    break
                if high - low <= least:  # cannot be told apart any further
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        vector = vector * np.sign(vector[np.abs(vector).argmax()])
        found.append((float(value), vector))
    return found


# --- fit and apply -----------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit learns for vectors of one length."""

    n: int  # distinct vectors
    sums: list[int]  # per dimension
    values: list[float]  # eigenvalues, falling
    axes: np.ndarray  # a unit vector per row
    explained: list[float | None]
    error: float | None = None

    @property
    def centre(self) -> list[int]:
        return [s // self.n for s in self.sums]

    def centred(self, matrix: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once at the end."""
        rest = np.array([s % self.n for s in self.sums], object) / self.n
        return shifted(matrix, self.centre).astype(float) - rest.astype(float)

    def deviations(self, matrix: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 over the dimensions, exact; null beyond a long."""
        rest = [s % self.n for s in self.sums]
        moved = shifted(matrix, self.centre)
        largest = int(np.abs(moved).max(initial=0)) + 1 if moved.dtype != object else 2**62
        if (largest * self.n) ** 2 * matrix.shape[1] < 2**62:
            return ((moved * self.n - np.array(rest)) ** 2).sum(axis=1).tolist()
        exact = ((moved.astype(object) * self.n - np.array(rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def whitened(self, matrix: np.ndarray) -> np.ndarray:
        """A column per component; NaN where the component has no variance."""
        roots = np.sqrt([v if v > 0 else np.nan for v in self.values])
        return self.centred(matrix) @ self.axes.T / roots


def _squares(fits: dict[int, Whitening], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, i, j, value): sums of whitened components (j = -1) and of their products."""
    sums: dict[int, np.ndarray] = {}
    for length, matrix in _matrices(batches):
        white = np.nan_to_num(fits[length].whitened(matrix))
        found = np.column_stack([white.T @ white, white.sum(axis=0)])
        sums[length] = sums.get(length, 0) + found
    for length, found in sums.items():
        k = len(found)
        rows = [(length, i, j if j < k else -1, float(found[i, j])) for i in range(k) for j in range(k + 1)]
        lengths, i, j, values = zip(*rows)
        columns = [pa.array(x, pa.int32()) for x in (lengths, i, j)]
        yield pa.record_batch([*columns, pa.array(values, pa.float64())], names=["length", "i", "j", "value"])
    give_back()


def fit_whitening(embeddings: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A fit per vector length, on each distinct usable vector once."""
    column = embeddings.select(F.col("embedding").alias("embedding"))
    vectors = checkpointed(column.mapInArrow(_packed, "length int, vector binary").distinct())
    fits = {}
    first = _total(vectors.mapInArrow(_sums, CELLS))
    centres, rests = {}, {}
    for length, cells in first.items():
        n = cells[-1, -1]
        sums = [cells[i, -1] for i in range(length)]
        centres[length] = [s // n for s in sums]
        rests[length] = n, sums, [s % n for s in sums]
    second = _total(vectors.mapInArrow(partial(_products, centres), CELLS))
    for length, cells in second.items():
        n, sums, rest = rests[length]
        cov = np.empty((length, length))
        for (i, j), value in cells.items():  # whole numbers until this one division
            cov[i, j] = cov[j, i] = (n * value - rest[i] * rest[j]) / (n * n)
        trace = sum(n * cells[i, i] - rest[i] * rest[i] for i in range(length)) / (n * n)
        pairs = leading_pairs(cov, components)
        none = 8 * length * EPS * trace
        values = [value if value > none else 0.0 for value, _ in pairs]
        fits[length] = Whitening(
            n, sums, values, np.array([axis for _, axis in pairs]), [v / trace if trace else None for v in values]
        )
    if fits:
        squares = vectors.mapInArrow(partial(_squares, fits), "length int, i int, j int, value double")
        found: dict[int, dict[tuple[int, int], float]] = {}
        for row in squares.groupBy("length", "i", "j").agg(F.sum("value").alias("value")).collect():
            found.setdefault(row["length"], {})[row["i"], row["j"]] = row["value"]
        for length, cells in found.items():
            fit = fits[length]
            used = [i for i, value in enumerate(fit.values) if value > 0]
            mean = {i: cells[i, -1] / fit.n for i in used}
            errors = [abs(cells[i, j] / fit.n - mean[i] * mean[j] - (i == j)) for i in used for j in used]
            fit.error = max(errors, default=None)
    return fits


def _apply(fits: dict[int, Whitening], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            for length, (rows, matrix) in integer_vectors(part.column(1)).items():
                fit = fits[length]
                k = len(fit.values)
                white = fit.whitened(matrix).ravel()
                ids = part.column(0).take(pa.array(np.repeat(rows, k)))
                deviations = pa.array(fit.deviations(matrix), pa.int64())
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                    pa.array(np.full(len(ids), fit.n), pa.int64()),
                    deviations.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(white, pa.float64(), mask=np.isnan(white)),
                    pa.array(fit.explained * len(rows), pa.float64()),
                    pa.array([fit.error] * len(ids), pa.float64()),
                ]
                yield pa.record_batch(columns, names=NAMES)
    give_back()


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of every usable vector of ``embeddings`` (vec_id, embedding, ...).

    An entry c becomes x = floor(SCALE * c). The fit takes each distinct x vector once: n
    vectors with sums S. Returns per row and component (vec_id, component, n, deviation,
    whitened, explained, identity_error): deviation is the sum of (n * x - S)^2, whitened
    the projection of x - S/n on the component's axis over the root of its eigenvalue,
    explained the eigenvalue's share of the trace, identity_error the largest difference
    between the covariance of the whitened fit vectors and the identity.

    Rows whose vector is null, empty, holds null or non-finite entries, or entries of 2^62 /
    SCALE and more are left out. Vectors of another length are fitted among themselves.
    Repeated rows and null ids stay. A component without variance (its eigenvalue is 0 in
    double precision) has no whitened value (null) and takes no part in identity_error; a
    vector has as many components as entries if that is less. A deviation beyond a long is null.
    """
    chosen = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    return chosen.mapInArrow(partial(_apply, fit_whitening(embeddings, components)), SCHEMA)
