"""Gradient-boosted trees over a table of counted feature cells, and their score as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    bound: int  # at most: left
    left: Split | Leaf
    right: Split | Leaf


def _tree(x, n, slope, bend, depth: int, rate: float):
    """One regression tree by second-order gain; slope and bend are sums over the rows of each cell."""
    leaf = Leaf(float(rate * slope.sum() / (bend.sum() + 1.0)))
    if not depth:
        return leaf
    best, at = 1e-6, None
    whole = slope.sum() ** 2 / (bend.sum() + 1.0)
    for j in range(x.shape[1]):
        for bound in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= bound
            if min(n[left].sum(), n[~left].sum()) < 2:
                continue
            gain = slope[left].sum() ** 2 / (bend[left].sum() + 1.0) + slope[~left].sum() ** 2 / (bend[~left].sum() + 1.0) - whole
            if gain > best:
                best, at = gain, (j, int(bound), left)
    if at is None:
        return leaf
    j, bound, left = at
    side = lambda m: _tree(x[m], n[m], slope[m], bend[m], depth - 1, rate)
    return Split(j, bound, side(left), side(~left))


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.bound, tree_values(tree.left, x), tree_values(tree.right, x))


def boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray, trees: int, depth: int, rate: float) -> tuple[float, list]:
    """Base score and trees for the log loss; cell i stands for n[i] rows, positive[i] of them of label 1."""
    share = (positive.sum() + 0.5) / (n.sum() + 1)
    base, out = float(np.log(share / (1 - share))), []
    score = np.full(len(x), base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        out.append(_tree(x, n, positive - n * q, n * q * (1 - q), depth, rate))
        score += tree_values(out[-1], x)
    return base, out


def calibrated(score: np.ndarray, n: np.ndarray, positive: np.ndarray) -> list[tuple[float, float, float]]:
    """Isotonic regression of the share of positives on the score, from the highest block down: lowest score of the block, its
    probability, share of positives from there upwards.  Cells without a labelled row take no part.
    """
    pools: list[list[float]] = []
    for low in np.unique(score[n > 0]):
        at = (score == low) & (n > 0)
        pools.append([float(low), float(positive[at].sum()), float(n[at].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, more, count = pools.pop()
            pools[-1][1] += more
            pools[-1][2] += count
    out, above, count = [], 0.0, 0.0
    for low, own, rows in reversed(pools):
        above, count = above + own, count + rows
        out.append((low, own / rows, above / count))
    return out


def score_column(base: float, trees: list, features: list[Column]) -> Column:
    def of(tree) -> Column:
        if isinstance(tree, Leaf):
            return F.lit(tree.value)
        return F.when(features[tree.feature] <= tree.bound, of(tree.left)).otherwise(of(tree.right))

    total = F.lit(base)
    for tree in trees:
        total = total + of(tree)
    return total
