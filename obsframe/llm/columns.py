"""Column-wise sorting of a collection of strings that share a column grid.

The step of Bauer, Cox and Rosone (TCS 2013), with the common prefixes of Cox et al. (2016): each round inserts one symbol
of every string, from the last column to the first.  The suffixes of a column, sorted, follow from those of the next
column by a stable partition on the inserted symbols, which, read in that order, are the column's piece of the collection's
Burrows-Wheeler transform; the common prefix of two neighbours is one more than the least between them before.  The
strings here are aligned, so equal substrings lie in equal columns and the suffixes of other columns need not be kept.
"""

from __future__ import annotations

import numpy as np

_NONE = 256  # symbol of a string that has no byte in a column


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], both included, for each pair."""
    span = high - low + 1
    level = np.frexp(span)[1] - 1
    out, table, width = np.empty(len(low), values.dtype), values, 1
    for k in range(int(level.max()) + 1):
        pick = np.flatnonzero(level == k)
        if len(pick):
            out[pick] = np.minimum(table[low[pick]], table[high[pick] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def repeated_starts(texts: list[bytes], starts: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string the columns where a substring of ``length`` begins that another of its group has in the same column.

    String i occupies columns starts[i] and on; the strings of a group stand together.
    """
    m = len(texts)
    ends = starts + np.fromiter(map(len, texts), np.int64, m)
    first, last = int(starts.min()), int(ends.max())
    grid = np.full((m, last - first), _NONE, np.int16)
    for i, text in enumerate(texts):
        at = int(starts[i]) - first
        grid[i, at : at + len(text)] = np.frombuffer(text, np.uint8)
    grid = np.ascontiguousarray(grid.T)
    fresh = np.ones(m, bool)  # positions where a group begins; groups keep their places
    fresh[1:] = groups[1:] != groups[:-1]
    place = (np.cumsum(fresh) - 1) * 512
    order, common = np.arange(m), np.zeros(m, np.int32)
    found_strings, found_columns = [], []
    for column in range(len(grid) - 1, -1, -1):
        symbols = grid[column][order]
        same = np.zeros(m, bool)
        same[1:] = (symbols[1:] == symbols[:-1]) & ~fresh[1:]
        if (same | fresh).all():
            common = np.where(same & (symbols != _NONE), common + 1, 0)
        else:
            by = np.argsort(place + symbols, kind="stable")
            symbols = symbols[by]
            same[1:] = (symbols[1:] == symbols[:-1]) & ~fresh[1:] & (symbols[1:] != _NONE)
            longer, at = np.zeros(m, np.int32), np.flatnonzero(same)
            near = by[at] == by[at - 1] + 1
            longer[at[near]] = common[by[at[near]]] + 1
            far = at[~near]
            if len(far):
                longer[far] = _range_min(common, by[far - 1] + 1, by[far]) + 1
            order, common = order[by], longer
        long = common >= length
        if long.any():
            long[:-1] |= long[1:]
            which = order[long]
            found_strings.append(which)
            found_columns.append(np.full(len(which), first + column))
    if not found_strings:
        return [np.empty(0, np.int64)] * m
    strings, columns = np.concatenate(found_strings), np.concatenate(found_columns)
    by = np.lexsort((columns, strings))
    return np.split(columns[by], np.searchsorted(strings[by], np.arange(1, m)))
