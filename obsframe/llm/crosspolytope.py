"""Cross-polytope hashes of unit vectors: fast pseudo-rotations, nearest signed axes and probe orders."""

from __future__ import annotations

from itertools import product

import numpy as np


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def signs(seed: int, tables: int, hashes: int, dim: int) -> np.ndarray:
    """(tables, hashes, 3, dim) random signs from a fixed seed."""
    bits = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (tables, hashes, 3, dim))
    return (2.0 * bits - 1.0).astype(np.float64)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, dim = x.shape
    h = 1
    while h < dim:
        x = x.reshape(n, dim // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, dim) / np.sqrt(dim)


def rotate(unit: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; ``unit`` is padded with zeros to the width of ``s``."""
    x = np.zeros((len(unit), s.shape[-1]))
    x[:, : unit.shape[1]] = unit
    for i in range(3):
        x = hadamard(x * s[i])
    return x


def nearest_axis(y: np.ndarray) -> np.ndarray:
    """Index of the nearest signed axis: coordinate, plus the width if it is negative."""
    at = np.abs(y).argmax(axis=1)
    return at + y.shape[1] * (y[np.arange(len(y)), at] < 0)


def _code(axes: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros(len(axes[0]), dtype=np.int64)
    for a in axes:
        out = out * (2 * width) + a
    return out


def codes(unit: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(rows, tables) bucket of each row in each table."""
    return np.stack([_code([nearest_axis(rotate(unit, h)) for h in table], s.shape[-1]) for table in s], axis=1)


def probes(unit: np.ndarray, s: np.ndarray, count: int) -> np.ndarray:
    """(rows, tables, count) buckets to look into, the most likely first: signed axes by how far they lie behind the nearest.

    Fewer than ``count`` where there are no more buckets.
    """
    width, k = s.shape[-1], s.shape[1]
    each = min(2 * width, count if k == 1 else max(2, int(np.ceil(np.sqrt(count))) * 2))
    count = min(count, each**k)
    out = np.empty((len(unit), len(s), count), dtype=np.int64)
    combos = np.array(list(product(range(each), repeat=k)))
    combos = combos[np.argsort(combos.sum(axis=1), kind="stable")][: 8 * count]
    for t, table in enumerate(s):
        loss = np.zeros((len(unit), len(combos)))
        code = np.zeros((len(unit), len(combos)), dtype=np.int64)
        for i, h in enumerate(table):
            y = rotate(unit, h)
            both = np.concatenate([y, -y], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :each]
            gap = both[np.arange(len(y)), order[:, 0]][:, None] - np.take_along_axis(both, order, axis=1)
            loss += (gap**2)[:, combos[:, i]]
            code = code * (2 * width) + order[:, combos[:, i]]
        best = np.argsort(loss, axis=1, kind="stable")[:, :count]
        out[:, t] = np.take_along_axis(code, best, axis=1)
    return out
