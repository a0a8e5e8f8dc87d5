"""Bit-sliced vectors: integer inner products by bitmap arithmetic and top rows from the highest slice downward."""

from __future__ import annotations

import numpy as np


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis to 64-bit words, row i in bit i % 64 of word i // 64."""
    pad = -bits.shape[-1] % 64
    bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), dtype=bool)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def slices(values: np.ndarray, low: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """(rows, attributes) integers to bitmaps: those of attribute 0 from its lowest bit upward, then attribute 1, ..."""
    lifted = (values - low).astype(np.int64)
    bits = [((lifted[:, j] >> b) & 1).astype(bool) for j in range(values.shape[1]) for b in range(int(widths[j]))]
    return bitmap(np.array(bits).reshape(len(bits), len(values)))


def add(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps, columns[w] those of weight 2**w, as bitmaps of the sum's bits: full adders on thirds of a weight."""
    out, carried = [], []
    w = 0
    while w < len(columns) or carried:
        parts = (columns[w] if w < len(columns) else []) + carried
        carried = []
        if not parts:
            out.append(None)
            w += 1
            continue
        x = np.concatenate(parts)
        while len(x) > 1:
            if len(x) == 2:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
                continue
            t = len(x) // 3
            a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
            half = a ^ b
            carried.append((a & b) | (half & c))
            x = np.concatenate([half ^ c, x[3 * t :]])
        out.append(x[0])
        w += 1
    return out


def inner_products(index: np.ndarray, widths: np.ndarray, low: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps of a sum that is, for each row, its inner product with ``query`` less the returned constant.

    A negative factor takes the complement of the attribute's bits: -x = (2**width - 1 - x) - (2**width - 1).
    """
    starts = np.concatenate([[0], np.cumsum(widths)]).astype(int)
    plain: dict[int, list[int]] = {}
    turned: dict[int, list[int]] = {}
    constant = 0
    for j, q in enumerate(query.tolist()):
        constant += q * int(low[j])
        into = plain if q > 0 else turned
        if q < 0:
            constant += q * ((1 << int(widths[j])) - 1)
        size = abs(q)
        for a in range(size.bit_length()):
            if size >> a & 1:
                for b in range(int(widths[j])):
                    into.setdefault(a + b, []).append(starts[j] + b)
    columns = []
    for w in range(max([*plain, *turned], default=-1) + 1):
        parts = []
        if w in plain:
            parts.append(index[plain[w]])
        if w in turned:
            parts.append(~index[turned[w]])
        columns.append(parts)
    return add(columns), constant


def count(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def rows_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def top(sums: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest sums among ``valid``; of rows equal at the boundary those that come first."""
    sure, open_ = np.zeros_like(valid), valid
    for bits in reversed(sums):
        if bits is None:
            continue
        ones = open_ & bits
        with_ones = sure | ones
        n = count(with_ones)
        if n > k:
            open_ = ones
        else:
            sure, open_ = with_ones, open_ & ~bits
            if n == k:
                return rows_of(sure)
    more = rows_of(open_)[: k - count(sure)]
    return np.concatenate([rows_of(sure), more])


def values_at(sums: list[np.ndarray], rows: np.ndarray) -> list[int]:
    total = [0] * len(rows)
    for w, bits in enumerate(sums):
        if bits is not None:
            hit = (bits[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
            for i in np.flatnonzero(hit):
                total[i] += 1 << w
    return total
