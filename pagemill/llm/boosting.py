"""Gradient boosted trees fitted on the driver from a bounded table, and scored as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    low: Leaf | Split  # rows with feature <= threshold
    high: Leaf | Split


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> Leaf | Split:
    """A tree for gradients g and curvatures h, by exact greedy splits at midpoints."""
    total_g, total_h = g.sum(), h.sum()
    best, gain = None, 1e-6
    if depth and len(g) >= 2 * least:
        base = total_g**2 / (total_h + ridge)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            (at,) = np.nonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
            if len(at):
                score = cg[at] ** 2 / (ch[at] + ridge) + (total_g - cg[at]) ** 2 / (total_h - ch[at] + ridge) - base
                k = score.argmax()
                if score[k] > gain:
                    gain, best = score[k], (f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best is None:
        return Leaf(float(-total_g / (total_h + ridge)))
    low = x[:, best[0]] <= best[1]
    return Split(*best, _grow(x[low], g[low], h[low], depth - 1, least, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, least, ridge))


def _apply(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.threshold, _apply(tree.low, x), _apply(tree.high, x))


@dataclass(frozen=True)
class Model:
    """Trees whose values add up to a log odds, and the scale and shift that calibrate it."""

    trees: tuple[Leaf | Split, ...]
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))

    def sql(self, names: list[str]) -> str:
        """The calibrated log odds as a SQL expression of feature expressions."""

        def case(tree: Leaf | Split) -> str:
            if isinstance(tree, Leaf):
                return f"{tree.value!r}D"
            return f"CASE WHEN {names[tree.feature]} <= {tree.threshold!r}D THEN {case(tree.low)} ELSE {case(tree.high)} END"

        return f"({self.scale!r}D * ({' + '.join(f'({case(t)})' for t in self.trees)}) + {self.shift!r}D)"


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0) -> Model:
    trees: list[Leaf | Split] = []
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, p - y, p * (1 - p), depth, least, ridge)
        tree = _scaled(tree, rate)
        margin += _apply(tree, x)
        trees.append(tree)
    return Model(tuple(trees))


def _scaled(tree: Leaf | Split, rate: float) -> Leaf | Split:
    if isinstance(tree, Leaf):
        return Leaf(tree.value * rate)
    return Split(tree.feature, tree.threshold, _scaled(tree.low, rate), _scaled(tree.high, rate))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Model:
    """Platt scaling on rows that the trees have not seen, with smoothed targets."""
    m = model.margin(x)
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * m).sum(), (p - target).sum()]) + 1e-3 * np.array([a - 1, b])
        hess = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(hess, grad)
        a, b = a - da, b - db
    return Model(model.trees, float(a), float(b))


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest probability above which the precision holds; 1.01 if there is none."""
    order = np.argsort(-probability, kind="stable")
    p, hits = probability[order], np.cumsum(y[order])
    last = np.append(p[1:] < p[:-1], True)  # ties are taken together
    good = last & (hits >= precision * np.arange(1, len(p) + 1))
    return float(p[good].min()) if good.any() else 1.01
