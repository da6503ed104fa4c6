"""Markov logic on the driver, over groundings that are bounded, and calibrators.

A ground rule is (body fact indexes, head fact index); rule k has weight ``weights[k]`` and, in
``rules``, the number of each grounding's rule.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def satisfied(worlds: np.ndarray, ground: list[tuple[list[int], int]]) -> np.ndarray:
    """(worlds, groundings): whether not all of the body holds, or the head does."""
    out = np.empty((len(worlds), len(ground)), bool)
    for k, (body, head) in enumerate(ground):
        out[:, k] = ~worlds[:, body].all(axis=1) | worlds[:, head]
    return out


def exact_log_partition(weights: list[float], ground: list[tuple[list[int], int]], facts: int) -> float:
    """ln of the sum over all truth assignments of exp(weight of what is satisfied); one weight a grounding."""
    if facts > 20:
        raise ValueError("exact enumeration is for 20 facts at most")
    worlds = np.array(list(itertools.product([False, True], repeat=facts)), bool).reshape(-1, facts)
    energy = satisfied(worlds, ground) @ np.asarray(weights, float) if ground else np.zeros(len(worlds))
    return float(energy.max() + np.log(np.exp(energy - energy.max()).sum()))


def log_partition(weights: list[float], ground: list[tuple[list[int], int]], facts: int) -> float:
    """The same for facts that fall apart into parts which share no grounding, each of 20 facts at most."""
    parent = list(range(facts))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for body, head in ground:
        for b in body:
            parent[root(b)] = root(head)
    parts: dict[int, list[int]] = {}
    for k, (_, head) in enumerate(ground):
        parts.setdefault(root(head), []).append(k)
    total = 0.0
    for r in {root(f) for f in range(facts)}:
        own = {f: i for i, f in enumerate(f for f in range(facts) if root(f) == r)}
        held = parts.get(r, [])
        total += exact_log_partition([weights[k] for k in held], [([own[b] for b in ground[k][0]], own[ground[k][1]]) for k in held], len(own))
    return total


def sampled_log_partition(weights: np.ndarray, ground: list, facts: int, samples: int = 1000, seed: int = 42) -> float:
    worlds = np.random.default_rng(seed).random((samples, facts)) < 0.5
    energy = satisfied(worlds, ground) @ weights
    return float(energy.max() + np.log(np.exp(energy - energy.max()).mean()) + facts * np.log(2))


def gibbs(weights: np.ndarray, ground: list, known: np.ndarray, steps: int = 100, seed: int = 42) -> np.ndarray:
    """A world after so many sweeps over the facts that aren't known."""
    rng = np.random.default_rng(seed)
    world = known | (rng.random(len(known)) < 0.5)
    for _ in range(steps):
        for i in np.flatnonzero(~known):
            both = np.repeat(world[None, :], 2, axis=0)
            both[:, i] = [False, True]
            energy = satisfied(both, ground) @ weights
            world[i] = rng.random() < 1 / (1 + np.exp(np.clip(energy[0] - energy[1], -40, 40)))
    return world


class Ground:
    """Groundings as arrays: bodies padded by a fact that is certain (the last, of number ``facts``), heads, and rules."""

    def __init__(self, rules: list[int], ground: list[tuple[list[int], int]], facts: int):
        width = max([len(b) for b, _ in ground], default=0)
        self.body = np.array([[*b, *[facts] * (width - len(b))] for b, _ in ground], np.int64).reshape(len(ground), width)
        self.head, self.rules, self.facts = np.array([h for _, h in ground], np.int64), np.asarray(rules, np.int64), facts

    def parts(self, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The probability of each body, and for each of its places that of the others with a head that fails."""
        p = np.append(q, 1.0)[self.body]
        fails = 1 - q[self.head]
        return p.prod(axis=1), [np.delete(p, j, axis=1).prod(axis=1) * fails for j in range(p.shape[1])]

    def log_odds(self, weights: np.ndarray, q: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.zeros(len(q))
        w = weights[self.rules]
        whole, others = self.parts(q)
        out = np.bincount(self.head, w * whole, self.facts + 1)
        for j, o in enumerate(others):
            out -= np.bincount(self.body[:, j], w * o, self.facts + 1)
        return np.clip(out[:-1], -40, 40)

    def gradient(self, gap: np.ndarray, q: np.ndarray, n_rules: int) -> np.ndarray:
        """By weight, of the pseudo-likelihood, whose log-odds miss ``q`` by ``gap``."""
        if not len(self.head):
            return np.zeros(n_rules)
        whole, others = self.parts(q)
        each, gap = gap[self.head] * whole, np.append(gap, 0.0)
        for j, o in enumerate(others):
            each = each - gap[self.body[:, j]] * o
        return np.bincount(self.rules, each, n_rules)

    def expected(self, q: np.ndarray, n_rules: int) -> np.ndarray:
        """How many groundings of each rule are expected to hold, facts being independent."""
        if not len(self.head):
            return np.zeros(n_rules)
        return np.bincount(self.rules, 1 - self.parts(q)[0] * (1 - q[self.head]), n_rules)


def log_odds(weights: np.ndarray, rules: list[int], ground: list, q: np.ndarray) -> np.ndarray:
    """Of each fact, given the probabilities of the others: support as a head, less what it would break in bodies."""
    return Ground(rules, ground, len(q)).log_odds(np.asarray(weights, float), np.asarray(q, float))


def log_probability(weights: np.ndarray, rules: list[int], ground: list, world: np.ndarray, log_partition: float | None = None) -> float:
    """ln of the probability of a truth assignment; the partition is enumerated unless it is given."""
    w = np.asarray(weights, float)[np.asarray(rules, int)] if len(rules) else np.zeros(0)
    if log_partition is None:
        log_partition = exact_log_partition(list(w), ground, len(world))
    return float(satisfied(np.asarray(world, bool)[None, :], ground)[0] @ w - log_partition)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def elbo(weights: np.ndarray, rules: list[int], ground: list, q: np.ndarray, unknown: np.ndarray) -> float:
    """Expected weight of satisfied groundings, less the partition's bound, plus the entropy of what is unknown."""
    joint = sum(weights[k] * (1 - np.prod(q[body]) * (1 - q[head])) for k, (body, head) in zip(rules, ground, strict=True))
    bound = sampled_log_partition(weights[rules] if len(rules) else np.zeros(0), ground, len(q)) if ground else 0.0
    p = np.clip(q[unknown], 1e-12, 1 - 1e-12)
    return float(joint - bound - (p * np.log(p) + (1 - p) * np.log(1 - p)).sum())


@dataclass
class Fit:
    weights: np.ndarray
    q: np.ndarray
    history: list[float] = field(default_factory=list)
    converged: bool = False


def fit(rules: list[int], ground: list[tuple[list[int], int]], known: np.ndarray, n_rules: int, epochs: int = 12, m_iterations: int = 100, rate: float = 5e-4, l2: float = 0.01, clip: float = 1.0, tolerance: float = 1e-4, patience: int = 3, e_iterations: int = 1, after=None) -> Fit:
    """Variational E-M: posteriors by their Markov blankets, weights by pseudo-likelihood with Adam.

    It has converged once neither bound nor weights have moved by more than ``tolerance`` for
    ``patience`` rounds in a row. ``after`` is called with each round's number, bound and weights.
    """
    weights, q, unknown = np.full(n_rules, 0.5), np.where(known, 1.0, 0.5), ~known
    held, out, calm = Ground(rules, ground, len(known)), Fit(weights, q), 0
    for epoch in range(epochs):
        for _ in range(e_iterations):
            was = q.copy()
            q[unknown] = _sigmoid(held.log_odds(weights, q))[unknown]
            if np.abs(q - was).max(initial=0) < tolerance:
                break
        before, m, v = weights.copy(), np.zeros(n_rules), np.zeros(n_rules)
        for step in range(1, m_iterations + 1):
            gradient = held.gradient(q - _sigmoid(held.log_odds(weights, q)), q, n_rules) - l2 * weights
            gradient *= min(1.0, clip / max(np.linalg.norm(gradient), 1e-12))
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        value = elbo(weights, rules, ground, q, unknown)
        moved = abs(value - out.history[-1]) / max(1.0, abs(out.history[-1])) if out.history else np.inf
        out.history.append(value)
        if after is not None:
            after(epoch, value, weights)
        calm = calm + 1 if moved < tolerance and np.linalg.norm(weights - before) < tolerance else 0
        if calm >= patience:
            out.converged = True
            break
    out.weights, out.q = weights, q
    return out


def isotonic(rows: DataFrame) -> DataFrame:
    """probability, calibrated of (probability, label)."""
    model = IsotonicRegression(featuresCol="probability", labelCol="label").fit(rows)
    return model.transform(rows).groupBy("probability").agg(F.avg("prediction").alias("calibrated"))


def calibrate_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """log T such that logits / softplus(log T) have the best likelihood; by golden section."""
    def loss(t: float) -> float:
        x = logits / np.log1p(np.exp(t))
        return float(np.mean(np.logaddexp(0, x) - labels * x))

    low, high, g = -6.0, 6.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return (low + high) / 2


def calibrate_platt(logits: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b such that sigmoid(a * logit + b) has the best likelihood; by Newton steps, with a slight pull to zero."""
    x, theta = np.column_stack([logits, np.ones(len(logits))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        gradient = x.T @ (p - labels) + 1e-3 * theta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        theta = theta - move / max(1.0, np.abs(move).max() / 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def platt(rows: DataFrame) -> DataFrame:
    """probability, calibrated of (probability, label), by a logistic curve over the log-odds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    p = F.greatest(F.least("probability", F.lit(1 - 1e-6)), F.lit(1e-6))
    put = VectorAssembler(inputCols=["logit"], outputCol="features")
    ready = put.transform(rows.withColumn("logit", F.ln(p / (1 - p))))
    model = LogisticRegression(featuresCol="features", labelCol="label", probabilityCol="given").fit(ready)
    return model.transform(ready).groupBy("probability").agg(F.avg(vector_to_array("given")[1]).alias("calibrated"))
