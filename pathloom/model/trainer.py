"""Training of the plausibility model: hold-out, rules, the bilinear scorer with early stop, Markov-logic weights, calibration.

What comes to the driver is bounded by parameters: ``scorer.MOST_FACTS`` facts, ``MOST_RULES`` rules,
``max_groundings`` ground rules of each, ``MOST_VALID`` facts to validate by.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..operators import rules as R
from ..sources.shared import written
from . import mln
from .scorer import Scorer, train

log = logging.getLogger(__name__)
#: Mined rules that are grounded, those of most support first.
MOST_RULES = 64
#: Held-out facts that validate, chosen by hash, and entities that each is ranked against on each side.
MOST_VALID, AGAINST = 1000, 50
#: Facts of a relation from which on it gets a temperature of its own.
OWN_TEMPERATURE = 20


@dataclass
class Trained:
    """A model and how it came about."""

    scorer: Scorer
    rules: list[dict] = field(default_factory=list)
    #: a row for each epoch of the scorer and of the rules
    history: list[dict] = field(default_factory=list)
    temperatures: dict[str, float] = field(default_factory=dict)
    platt: tuple[float, float] = (1.0, 0.0)
    best_mrr: float = 0.0
    converged: bool = True

    def to_document(self) -> dict:
        return {"scorer": self.scorer.to_document(), "rules": self.rules, "history": self.history, "temperatures": self.temperatures, "platt": list(self.platt), "best_mrr": self.best_mrr, "converged": self.converged}

    @classmethod
    def from_document(cls, d: dict) -> Trained:
        return cls(Scorer.from_document(d["scorer"]), d["rules"], d["history"], d["temperatures"], tuple(d["platt"]), d["best_mrr"], d["converged"])

    def rule_confidences(self) -> list[dict]:
        """Each rule with the confidence that its weight stands for."""
        return [r | {"learned": float(1 / (1 + np.exp(-r["weight"])))} for r in self.rules]


class Validation:
    """Ranks of held-out facts against drawn heads and tails that aren't known."""

    def __init__(self, facts: list[tuple], entities: list[str], known: set[tuple], seed: int, against: int = AGAINST):
        rng, self.facts, self.rows, self.owner, self.side = np.random.default_rng(seed), facts, [], [], []
        for k, (s, r, d) in enumerate(facts):
            for side in (0, 1):
                for e in {entities[i] for i in rng.integers(0, max(1, len(entities)), against)} if entities else ():
                    row = (e, r, d) if side == 0 else (s, r, e)
                    if row not in known and row[0] != row[2]:
                        self.rows.append(row)
                        self.owner.append(k)
                        self.side.append(side)

    def mrr(self, scorer: Scorer) -> float:
        """Mean reciprocal rank over both sides; ties share the best rank."""
        if not self.facts:
            return 0.0
        own = scorer.probabilities(*zip(*self.facts, strict=True))
        other = scorer.probabilities(*zip(*self.rows, strict=True)) if self.rows else np.zeros(0)
        owner, side = np.array(self.owner, int), np.array(self.side, int)
        better = np.bincount(2 * owner + side, other > own[owner], 2 * len(own)) if len(other) else np.zeros(2 * len(own))
        return float(np.mean(1 / (1 + better)))


def ground_all(known: DataFrame, mined: list[dict], config: ModelConfig, seed: int) -> tuple[list[int], list[tuple[list[int], int]], np.ndarray]:
    """Rule numbers and ground rules over numbered facts, and which of these are known."""
    numbers: dict[tuple, int] = {}
    certain: list[bool] = []
    rules, ground = [], []

    def fact(f: tuple, holds: bool) -> int:
        if f not in numbers:
            numbers[f] = len(numbers)
            certain.append(holds)
        certain[numbers[f]] = certain[numbers[f]] or holds
        return numbers[f]

    for k, rule in enumerate(mined):
        if rule["kind"] == "prior":
            continue
        body, head = R.parse_rule(rule["text"])
        rows = R.ground_rule(known, body, head, config.max_groundings, seed).collect()  # bounded by max_groundings
        for row in sorted(rows, key=str):
            atoms = [fact(tuple(b), row["body_holds"]) for b in row["body"]]
            rules.append(k)
            ground.append((atoms, fact(tuple(row["head"]), row["head_holds"])))
    return rules, ground, np.array(certain, bool)


def calibrated(scorer: Scorer, validation: Validation) -> tuple[dict[str, float], tuple[float, float]]:
    """A temperature for each relation that has enough facts (and "" for all), and a logistic curve, by what was held out."""
    rows, n = validation.facts + validation.rows, len(validation.facts)
    if not n or len(rows) == n:
        return {"": 0.0}, (1.0, 0.0)
    logits, _ = scorer.forward(*scorer.indexes(*zip(*rows, strict=True)))
    labels, rel = np.r_[np.ones(n), np.zeros(len(rows) - n)], np.array([r for _, r, _ in rows])
    out = {"": mln.calibrate_temperature(logits, labels)}
    for name in sorted(set(rel[:n])):
        at = rel == name
        if at[:n].sum() >= OWN_TEMPERATURE:
            out[str(name)] = mln.calibrate_temperature(logits[at], labels[at])
    return out, mln.calibrate_platt(logits, labels)


def train_model(triples: DataFrame, config: ModelConfig = ModelConfig(), seed: int = 42, after=None) -> Trained:
    """Hold out, mine rules, fit the scorer until validation stops it, fit the rules' weights, calibrate.

    ``after`` is called with each row of the history, for checkpoints and logs.
    """
    every = written(R.hold_out(R.facts(triples), config.holdout, seed))
    known, hidden = every.filter("is_known").drop("is_known"), every.filter("NOT is_known").drop("is_known")
    out = Trained(None)

    def told(row: dict) -> None:
        out.history.append(row)
        if after is not None:
            after(row)

    chosen = [tuple(r) for r in hidden.orderBy(F.xxhash64("src", "rel", "dst", F.lit(seed)), "src", "rel", "dst").limit(MOST_VALID).collect()]  # bounded
    state: dict = {}

    def validate(epoch: int, scorer: Scorer) -> bool:
        """Whether to go on."""
        if "v" not in state:
            state["v"] = Validation(chosen, scorer.entities[1:], set(chosen), seed)
        mrr = state["v"].mrr(scorer)
        told({"part": "scorer", "epoch": epoch, "mrr": mrr})
        if mrr > out.best_mrr:
            out.best_mrr, state["best"], state["calm"] = mrr, {n: x.copy() for n, x in scorer.tensors.items()}, 0
        else:
            state["calm"] = state.get("calm", 0) + 1
        return not chosen or state["calm"] < config.patience

    scorer = train(known, config, seed, after=validate)
    if "best" in state:
        scorer.tensors = state["best"]
    out.scorer = scorer
    found = R.smart_rules(known, cap=config.max_groundings).withColumn("text", R.rule_text(F.col("kind"), F.col("r1"), F.col("r2"), F.col("r3")))
    rows = found.filter("kind <> 'prior'").orderBy(F.col("support").desc(), "text").limit(MOST_RULES).collect()  # bounded
    mined = [r.asDict() for r in rows]
    rules, ground, certain = ground_all(known, mined, config, seed)
    fit = mln.fit(rules, ground, certain, len(mined), config.em_epochs, config.m_iterations, config.m_learning_rate, config.m_l2, config.grad_clip, config.convergence, config.patience, config.em_iterations, after=lambda epoch, bound, w: told({"part": "rules", "epoch": epoch, "elbo": bound, "weights": float(np.linalg.norm(w))}))
    out.converged = fit.converged or not mined
    if not out.converged:
        log.warning("rule weights had not converged after %d rounds", config.em_epochs)
    expected = mln.Ground(rules, ground, len(certain)).expected(fit.q, len(mined))
    out.rules = [r | {"weight": float(w), "expected": float(e)} for r, w, e in zip(mined, fit.weights, expected, strict=True)]
    out.temperatures, out.platt = calibrated(scorer, state["v"]) if "v" in state else ({"": 0.0}, (1.0, 0.0))
    return out


def predict_unknown(scorer: Scorer, candidates: DataFrame, known: DataFrame, k: int = 10) -> DataFrame:
    """src, rel, dst, confidence of the ``k`` candidates of largest confidence that aren't known."""
    new = candidates.select("src", "rel", "dst").join(known.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti")
    return scorer.score(new).orderBy(F.round("confidence", 12).desc(), "src", "rel", "dst").limit(k)
