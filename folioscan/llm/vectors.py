"""Arrow lists of numbers as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) for each length of the lists; null and empty lists and those that hold null, NaN or infinity are left out."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        matrix = flat[(offsets[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            out.append((rows[good], matrix[good]))
    return out
