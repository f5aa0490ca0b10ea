"""Shared parts of the vector operators: clean rows and pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: which rows are not null and hold only finite numbers, every
    row's offset, and all values as doubles (nulls as NaN)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False) if len(column) else np.empty(0)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ok = ~np.asarray(column.is_null()) & (wrong[ends[1:]] == wrong[ends[:-1]])
    return ok, ends, values


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k spread rows of x (fewer if x has fewer distinct ones)."""
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        i = int(far.argmax())
        if far[i] <= 0:
            break
        chosen.append(i)
        far = np.minimum(far, ((x - x[i]) ** 2).sum(1))
    return x[chosen]


def pad(a: np.ndarray, n: int) -> np.ndarray:
    return a if a.shape[1] == n else np.pad(a, ((0, 0), (0, n - a.shape[1])))
