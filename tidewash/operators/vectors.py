"""Vectors as rows of a matrix, and what connects them."""

from __future__ import annotations

import numpy as np
import pandas as pd


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one; a zero vector stays zero."""
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def forest(match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect rows and columns as the whole match matrix does."""
    rows, columns = match.shape
    row_free, column_free = np.ones(rows, bool), np.ones(columns, bool)
    found: list[tuple[int, int]] = []
    for start in range(rows):
        if not row_free[start]:
            continue
        row_free[start] = False
        open_rows, open_columns = [start], []
        while open_rows or open_columns:
            if open_rows:
                i = open_rows.pop()
                new = np.flatnonzero(match[i] & column_free)
                column_free[new] = False
                found += [(i, j) for j in new]
                open_columns.extend(new)
            else:
                j = open_columns.pop()
                new = np.flatnonzero(match[:, j] & row_free)
                row_free[new] = False
                found += [(i, j) for i in new]
                open_rows.extend(new)
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def thinned(
    i: np.ndarray, j: np.ndarray, rows: int, columns: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows and columns, only as many as connect the same ones."""
    parent = list(range(rows + columns))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for place, (x, y) in enumerate(zip(i.tolist(), (j + rows).tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            kept.append(place)
    return i[kept], j[kept]
