"""Rows with few of very many columns: batches with the columns they have, and sums by row and by column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Batch:
    """rows: which ones; entry e lies in row at[e] of the batch and in column columns[of[e]], with values[e]."""

    rows: np.ndarray
    at: np.ndarray
    columns: np.ndarray
    of: np.ndarray
    values: np.ndarray | None

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """For each row the sum over its entries of their columns' x (one number for each of columns)."""
        own = x[self.of] if self.values is None else x[self.of] * self.values
        return np.bincount(self.at, own, len(self.rows))

    def by_column(self, x: np.ndarray) -> np.ndarray:
        """For each of columns the sum over its entries of their rows' x."""
        own = x[self.at] if self.values is None else x[self.at] * self.values
        return np.bincount(self.of, own, len(self.columns))


    def only(self, kept: np.ndarray) -> Batch:
        """The entries whose column is kept (a flag for every column there is)."""
        own = kept[self.columns]
        e = np.flatnonzero(own[self.of])
        return Batch(self.rows, self.at[e], self.columns[own], (np.cumsum(own) - 1).astype(np.int32)[self.of[e]], None if self.values is None else self.values[e])


def batches(columns: np.ndarray, ends: np.ndarray, order: np.ndarray, size: int, values: np.ndarray | None = None) -> list[Batch]:
    """Row i has the columns [ends[i], ends[i + 1]); the rows in order, size in a batch."""
    found = []
    for lo in range(0, len(order), size):
        rows = order[lo : lo + size]
        n = ends[rows + 1] - ends[rows]
        entries = np.repeat(ends[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own, of = np.unique(columns[entries], return_inverse=True)
        found.append(Batch(rows, np.repeat(np.arange(len(rows), dtype=np.int32), n), own, of.astype(np.int32), None if values is None else values[entries]))
    return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def evidence(z: np.ndarray, least: float = 3.0) -> np.ndarray:
    """How fast a column may learn, 0 to 1: the square of what its |z| is to the largest.

    All columns learn; those that tell labels apart by themselves learn first. Where not one reaches `least`, all are slow.
    """
    top = float(np.max(z, initial=0.0))
    return (z / top) ** 2 * (1.0 if top > least else 0.1) if top > 0 else np.zeros(len(z))
