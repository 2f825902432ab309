"""Small dense algebra over a batch of systems (first axis: systems)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

# Rows of an Arrow batch that a function takes and returns at once.
PIECE_ROWS = 1_000
# Doubles that the largest table of one slice of a batch may take, about 4 MB; some ten such tables are held.
SLICE_VALUES = 500_000


def pieces(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[tuple[pd.Series, ...]]:
    """The rows of all batches in order, ``PIECE_ROWS`` at most at a time.

    A worker then holds the results of a piece, not those of a batch of 10,000 series.
    """
    for batch in batches:
        for i in range(0, len(batch[0]), PIECE_ROWS):
            yield tuple(column.iloc[i : i + PIECE_ROWS] for column in batch)


def slices(members: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """Parts of a batch whose tables, of ``each`` values a member, stay within ``SLICE_VALUES``; one member at least."""
    step = max(1, SLICE_VALUES // max(1, int(each)))
    for i in range(0, len(members), step):
        yield members[i : i + step]


# A column is aliased when less than this share of its squared length is its own.
ALIAS_TOLERANCE = 1e-10


def sweep(gram: np.ndarray, order) -> tuple[np.ndarray, np.ndarray]:
    """Solve by sweeping the listed columns of symmetric matrices with the target last.

    Returns the swept matrices (inverse, coefficients and error sum of squares in
    place) and a mask of the columns that were independent. Aliased columns are
    skipped, so their weight stays on the earlier ones.
    """
    a = gram.copy()
    size = np.diagonal(gram, axis1=1, axis2=2)
    kept = np.zeros(size.shape, dtype=bool)
    for j in order:
        pivot = a[:, j, j]
        ok = (size[:, j] > 0) & (pivot > ALIAS_TOLERANCE * size[:, j])
        kept[:, j] = ok
        if not ok.any():
            continue
        safe = np.where(ok, pivot, 1.0)
        row = a[:, j, :] / safe[:, None]
        col = a[:, :, j].copy()
        new = a - col[:, :, None] * row[:, None, :]
        new[:, j, :] = row
        new[:, :, j] = -col / safe[:, None]
        new[:, j, j] = 1.0 / safe
        a = np.where(ok[:, None, None], new, a)
    return a, kept


def unpack(flat: np.ndarray, size: int) -> np.ndarray:
    """Upper triangles, row by row, to symmetric matrices."""
    i, j = np.triu_indices(size)
    out = np.zeros((len(flat), size, size))
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


# Shares of a column's length that are its own, below which the orthogonal solver calls it aliased.
ORTHOGONAL_TOLERANCE = 1e-12
EXACT_TOLERANCE = 1e-14


def triangles(scatter: np.ndarray, exact_last: float = 1e-14) -> np.ndarray:
    """Upper triangles ``f`` with ``f' f = scatter``, columns in order; rows of dependent columns are 0."""
    a, d = scatter.copy(), scatter.shape[1]
    out = np.zeros_like(a)
    size = np.diagonal(scatter, axis1=1, axis2=2)
    for j in range(d):
        pivot = a[:, j, j]
        share = exact_last if j == d - 1 else ALIAS_TOLERANCE
        ok = pivot > share * np.maximum(size[:, j], 0)
        root = np.sqrt(np.where(ok, pivot, 1.0))
        row = np.where(ok[:, None], a[:, j, :] / root[:, None], 0.0)
        row[:, :j] = 0.0
        out[:, j, :] = row
        a -= row[:, :, None] * row[:, None, :]
    return out


def orthogonal(stacked: np.ndarray, order) -> dict[str, np.ndarray]:
    """Least squares of the last column on the others without forming their products.

    Columns are made orthogonal in ``order``, each twice against those before, which keeps the digits
    that a common level of the columns takes from a matrix of products. Dependent
    columns are skipped: their coefficient is NaN, their rows of the inverse are 0.
    """
    batch, _, width = stacked.shape
    p = width - 1
    a = stacked.copy()
    length = np.sqrt((stacked**2).sum(axis=1))
    upper = np.zeros((batch, p, width))
    kept = np.zeros((batch, p), dtype=bool)
    done: list[int] = []
    for j in [*order, p]:
        v = a[:, :, j]
        for _ in range(2):
            for i in done:
                part = np.einsum("br,br->b", a[:, :, i], v)
                upper[:, i, j] += part
                v = v - part[:, None] * a[:, :, i]
        norm = np.sqrt((v**2).sum(axis=1))
        if j == p:
            sse = np.where(norm <= EXACT_TOLERANCE * length[:, p], 0.0, norm**2)
            break
        ok = (length[:, j] > 0) & (norm > ORTHOGONAL_TOLERANCE * length[:, j])
        kept[:, j] = ok
        # a skipped column is 0 and 1 on the diagonal, so that it takes part in nothing
        a[:, :, j] = np.where(ok[:, None], v / np.where(ok, norm, 1.0)[:, None], 0.0)
        upper[:, j, j] = np.where(ok, norm, 1.0)
        upper[:, done, j] = np.where(ok[:, None], upper[:, done, j], 0.0)
        done.append(j)
    turn = list(order)
    triangle = upper[:, turn][:, :, turn]
    beta, root = np.empty((batch, p)), np.zeros((batch, p, p))
    if p:
        beta[:, turn] = np.linalg.solve(triangle, upper[:, turn, p][:, :, None])[:, :, 0]
        root[:, turn] = np.linalg.inv(triangle)
    both = kept[:, :, None] & kept[:, None, :]
    return {
        "beta": np.where(kept, beta, np.nan),
        "inverse": np.where(both, root @ root.transpose(0, 2, 1), 0.0),
        "sse": sse,
        "kept": kept,
    }
