"""Gradient-boosted trees over binary features, fitted on counts of feature patterns.

With F binary features all rows of a corpus fall into at most 2**F patterns, so the counts of positives
and of all rows by pattern are complete statistics of the whole corpus with a fixed size bound. The trees
are fitted on that table in the driver and returned as a SQL expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations


@dataclass(frozen=True)
class Tree:
    """Depth two over the bits f and g: leaf 2 * bit(f) + bit(g)."""

    f: int
    g: int
    leaves: tuple[float, float, float, float]

    def at(self, mask: int) -> float:
        return self.leaves[2 * (mask >> self.f & 1) + (mask >> self.g & 1)]

    def sql(self, mask: str) -> str:
        f, g = (f"({mask} & {1 << i}) <> 0" for i in (self.f, self.g))
        a, b, c, d = (repr(x) + "D" for x in self.leaves)
        return f"if({f}, if({g}, {d}, {c}), if({g}, {b}, {a}))"


def fit(patterns: list[tuple[int, int, int]], n_features: int, rounds: int = 16, rate: float = 0.5, ridge: float = 4.0) -> list[Tree]:
    """patterns: (mask, rows, positives). Newton boosting on the logistic loss."""
    score = {m: 0.0 for m, _, _ in patterns}
    trees: list[Tree] = []
    for _ in range(rounds if patterns else 0):
        grad = []
        for m, n, pos in patterns:
            p = 1 / (1 + math.exp(-score[m]))
            grad.append((m, pos - n * p, n * p * (1 - p)))
        best: tuple[float, Tree] | None = None
        for f, g in combinations(range(n_features), 2):
            sums = [[0.0, 0.0] for _ in range(4)]
            for m, d, h in grad:
                s = sums[2 * (m >> f & 1) + (m >> g & 1)]
                s[0] += d
                s[1] += h
            gain = sum(d * d / (h + ridge) for d, h in sums)
            if best is None or gain > best[0] + 1e-9:
                best = gain, Tree(f, g, tuple(round(rate * d / (h + ridge), 6) for d, h in sums))
        trees.append(best[1])
        for m in score:
            score[m] += trees[-1].at(m)
    return trees


def score(trees: list[Tree], mask: int) -> float:
    return sum(t.at(mask) for t in trees)


def score_sql(trees: list[Tree], mask: str) -> str:
    return " + ".join(f"({t.sql(mask)})" for t in trees) or "0D"


def calibrate(trees: list[Tree], held_out: list[tuple[int, int, int]], precision: float) -> float:
    """The lowest score from which on the held-out rows are positive in at least that share; inf if none is. Leaves have
    six decimals; the half of the last one is taken off, so that an equal score is reached however it is summed."""
    best, n, pos = math.inf, 0, 0
    by: dict[float, list[int]] = {}
    for m, k, p in held_out:
        x = by.setdefault(round(score(trees, m), 6), [0, 0])
        x[0] += k
        x[1] += p
    for s in sorted(by, reverse=True):
        n, pos = n + by[s][0], pos + by[s][1]
        if n and pos / n >= precision:
            best = s - 5e-7
    return best
