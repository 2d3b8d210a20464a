"""Embedding columns in Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimension: (row numbers, float64 matrix)} of the usable vectors of a list column.

    Unusable: null, empty, all zero, or with a null or non-finite component.
    """
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.diff(column.offsets.to_numpy())
    valid = np.asarray(column.is_valid())
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = column.offsets.to_numpy()[:-1]
    found = {}
    for dim in np.unique(lengths[valid & (lengths > 0)]).tolist():
        rows = np.flatnonzero(valid & (lengths == dim))
        matrix = values[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if good.any():
            found[dim] = rows[good], matrix[good]
    return found


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, against overflow."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
