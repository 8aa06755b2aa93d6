"""Reading a column of vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def by_dimension(ids: pa.Array, vectors: pa.Array, zero: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of doubles) for each vector length of the batch.

    Rows with a null id, null vectors, empty ones and those with null or
    non-finite components are left out; all-zero ones too if ``zero`` is false.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    known = np.asarray(ids.is_valid())
    flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    names = np.asarray(ids.cast(pa.int64()).fill_null(0), np.int64)
    out = []
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero((lengths == d) & known)
        matrix = flat[starts[at][:, None] + np.arange(d)]
        fine = np.isfinite(matrix).all(1)
        if not zero:
            fine &= (matrix != 0).any(1)
        if fine.any():
            out.append((names[at[fine]], matrix[fine]))
    return out


def fewest_of_equal(ids: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows with the smallest ids among each set of equal vectors: ``k`` of an id and 2 * ``k`` in all.

    When ties go to smaller ids, no more than ``k`` equal vectors can be among
    the first ``k`` answers to a query, and no more than ``k`` of those kept are
    of the query's own id, so the others need not travel.
    """
    _, group = np.unique(np.ascontiguousarray(matrix).view(f"V{matrix.dtype.itemsize * matrix.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    order = order[places(group[order], ids[order]) < k]
    return order[places(group[order]) < 2 * k]


def places(*keys: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal keys, from 0."""
    count = len(keys[0])
    new = np.ones(count, bool)
    new[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    return np.arange(count) - np.maximum.accumulate(np.where(new, np.arange(count), 0))
