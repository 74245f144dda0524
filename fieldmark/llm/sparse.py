"""Bounded labelled samples as sparse matrices in numpy, in batches that sum by row or by column without a loop."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Batch:
    """Rows of a sparse matrix. By row: idx, val, start. By column: the same entries sorted by idx."""

    y: np.ndarray
    weight: np.ndarray
    row: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    start: np.ndarray
    order: np.ndarray
    cols: np.ndarray
    col_start: np.ndarray

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """Sums of x (a row for each entry) by row; every row has an entry."""
        return np.add.reduceat(x, self.start, axis=0)

    def by_col(self, x: np.ndarray) -> np.ndarray:
        """Sums of x by column, for the columns in cols."""
        return np.add.reduceat(x[self.order], self.col_start, axis=0)


def batches(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, size: int, seed: int) -> list[Batch]:
    """rows: (indices, values) of each row, none empty. The list is emptied on the way."""
    deal = np.random.default_rng(seed).permutation(len(rows))
    out = []
    for at in range(0, len(deal), size):
        part = deal[at : at + size]
        lengths = np.array([len(rows[i][0]) for i in part])
        idx = np.concatenate([rows[i][0] for i in part]).astype(np.int32)
        val = np.concatenate([rows[i][1] for i in part]).astype(np.float32)
        for i in part:  # each row is held once: here or there
            rows[i] = None
        order = np.argsort(idx, kind="stable").astype(np.int32)
        cols, col_start = np.unique(idx[order], return_index=True)
        start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        out.append(Batch(y[part], weight[part], np.repeat(np.arange(len(part), dtype=np.int32), lengths), idx, val, start, order, cols, col_start.astype(np.int32)))
    return out


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample the shares of the classes among all labelled rows, with mean 1."""
    total = sum(counts.values())
    w = np.array([counts[int(v)] / total / max((y == v).mean(), 1e-9) for v in y])
    return w / w.mean() if len(w) else w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
