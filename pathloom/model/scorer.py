"""A bilinear scorer of edges: u' relu((h+r)' W (t+r) + V [h+r; t+r] + b), trained in numpy, applied by Arrow batches.

Training takes a bounded sample of facts (``MOST_FACTS``, chosen by hash); what it learns of entities
is kept only for those. Others share one vector, which is learned from known entities that are masked
at random (``MASKED``), in facts as in corrupted ones, so it stands for an entity of its relation. Scoring
runs on all rows, in executors.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CorruptArtifactError, ModelConfig
from ..operators.rules import facts, negative_samples
from ..sources.shared import cut

MOST_FACTS = 200_000
MASKED = 0.1
#: Scores that a task remembers.
MOST_HELD = 100_000
OTHER = "\u0000other"


class Scorer:
    def __init__(self, entities: list[str], relations: list[str], tensors: dict[str, np.ndarray]):
        self.entities, self.relations, self.tensors = entities, relations, tensors
        self.entity_index = {e: k for k, e in enumerate(entities)}
        self.relation_index = {r: k for k, r in enumerate(relations)}

    @classmethod
    def fresh(cls, entities: list[str], relations: list[str], config: ModelConfig, seed: int) -> Scorer:
        rng, d, k = np.random.default_rng(seed), config.embedding_dim, config.hidden
        shape = {"E": (len(entities) + 1, d), "R": (len(relations) + 1, d), "W": (k, d, d), "V": (k, 2 * d), "b": (k,), "u": (k,)}
        scale = {"E": 0.5, "R": 0.5, "W": 1 / d, "V": 1 / np.sqrt(2 * d), "b": 0.0, "u": 1 / np.sqrt(k)}
        return cls([OTHER, *entities], [OTHER, *relations], {n: rng.normal(0, 1, s) * scale[n] for n, s in shape.items()})

    def indexes(self, src: Iterable[str], rel: Iterable[str], dst: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, r = self.entity_index, self.relation_index
        return np.array([e.get(x, 0) for x in src], int), np.array([r.get(x, 0) for x in rel], int), np.array([e.get(x, 0) for x in dst], int)

    def forward(self, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.tensors
        a, c = x["E"][h] + x["R"][r], x["E"][t] + x["R"][r]
        aw = np.einsum("bd,kde->bke", a, x["W"], optimize=True)
        z = np.einsum("bke,be->bk", aw, c, optimize=True) + np.concatenate([a, c], 1) @ x["V"].T + x["b"]
        return np.maximum(z, 0) @ x["u"], (a, c, aw, z)

    def gradients(self, h, r, t, error: np.ndarray, held: tuple) -> dict[str, np.ndarray]:
        """Of the summed loss, from d loss / d logit."""
        x, (a, c, aw, z) = self.tensors, held
        d = a.shape[1]
        dz = error[:, None] * x["u"] * (z > 0)
        both = np.concatenate([a, c], 1)
        dv = dz @ x["V"]
        da = np.einsum("bk,kde,be->bd", dz, x["W"], c, optimize=True) + dv[:, :d]
        dc = np.einsum("bk,bke->be", dz, aw, optimize=True) + dv[:, d:]
        out = {"u": error @ np.maximum(z, 0), "b": dz.sum(0), "V": dz.T @ both, "W": np.einsum("bk,bd,be->kde", dz, a, c, optimize=True), "E": np.zeros_like(x["E"]), "R": np.zeros_like(x["R"])}
        np.add.at(out["E"], h, da)
        np.add.at(out["E"], t, dc)
        np.add.at(out["R"], r, da + dc)
        return out

    def probabilities(self, src, rel, dst) -> np.ndarray:
        return self.at(*self.indexes(src, rel, dst))

    def at(self, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        logits, _ = self.forward(h, r, t)
        p = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
        return np.where(np.isfinite(p), np.maximum(p, 1e-6), 1e-6)

    def score(self, edges: DataFrame, distinct: bool = True) -> DataFrame:
        """src, rel, dst, confidence of each distinct triple; rows that are so already need no ``distinct``.

        Most entities share one vector, so a batch has few different triples of vectors: each is scored once.
        """
        shared = edges.sparkSession.sparkContext.broadcast(self)  # bounded by MOST_FACTS

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = shared.value
            entities, relations = pa.array(scorer.entities, pa.string()), pa.array(scorer.relations, pa.string())
            n_e, n_r = len(scorer.entities), len(scorer.relations)
            of = lambda column, names: pc.fill_null(pc.index_in(column.cast(pa.string()), names), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known: dict[int, float] = {}
            for b in batches:
                key = (of(b.column(0), entities) * n_r + of(b.column(1), relations)) * n_e + of(b.column(2), entities)
                keys, place = np.unique(key, return_inverse=True)
                new = np.array([k for k in keys.tolist() if k not in known], np.int64)
                if len(new):
                    if len(known) > MOST_HELD:
                        known.clear()
                        new = keys
                    p = scorer.at(new // n_e // n_r, new // n_e % n_r, new % n_e)
                    known.update(zip(new.tolist(), p.tolist(), strict=True))
                p = np.array([known[k] for k in keys.tolist()], float)[place]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=["src", "rel", "dst", "confidence"])

        rows = edges.select("src", "rel", "dst")
        return (rows.distinct() if distinct else rows).mapInArrow(run, "src string, rel string, dst string, confidence double")

    def to_document(self) -> dict:
        held = io.BytesIO()
        np.savez(held, **self.tensors)
        blob = base64.b64encode(held.getvalue()).decode()
        return {"entities": self.entities, "relations": self.relations, "tensors": blob, "checksum": hashlib.sha256(blob.encode()).hexdigest()}

    @classmethod
    def from_document(cls, document: dict) -> Scorer:
        try:
            blob = document["tensors"]
            if hashlib.sha256(blob.encode()).hexdigest() != document["checksum"]:
                raise CorruptArtifactError("the model's tensors don't match their checksum")
            with np.load(io.BytesIO(base64.b64decode(blob)), allow_pickle=False) as z:
                return cls(document["entities"], document["relations"], {n: z[n] for n in z.files})
        except (KeyError, ValueError, AttributeError, OSError) as e:
            raise CorruptArtifactError("the model's document isn't valid") from e


def train(known: DataFrame, config: ModelConfig = ModelConfig(), seed: int = 42, most: int = MOST_FACTS, after=None, entities: DataFrame | None = None) -> Scorer:
    """A scorer of facts against corrupted ones by weighted logistic loss, with Adam.

    ``after`` is called with each epoch's number and the scorer, and says whether to go on. ``entities``: the ids of ``known``,
    if they are at hand; its facts must be there once each then.
    """
    if entities is None:
        known = facts(known)
    positives = cut(known.orderBy(F.xxhash64("src", "rel", "dst", F.lit(seed)), "src", "rel", "dst").limit(most))
    good = [tuple(r) for r in positives.collect()]  # bounded
    bad = [tuple(r) for r in negative_samples(known, positives, config.negatives_per_side, seed, entities).select("src", "rel", "dst").orderBy("src", "rel", "dst").collect()]
    scorer = Scorer.fresh(sorted({x for s, _, d in good for x in (s, d)}), sorted({r for _, r, _ in good}), config, seed)
    rows = good + bad
    if not good:
        return scorer
    h, r, t = scorer.indexes(*zip(*rows, strict=True))
    y = np.r_[np.ones(len(good)), np.zeros(len(bad))]
    weight = np.where(y == 1, max(1.0, len(bad) / len(good)), 1.0)
    m = {n: np.zeros_like(x) for n, x in scorer.tensors.items()}
    v = {n: np.zeros_like(x) for n, x in scorer.tensors.items()}
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(config.epochs):
        order = rng.permutation(len(rows))
        head, tail = (np.where(rng.random(len(rows)) < MASKED, 0, x) for x in (h, t))
        for at in range(0, len(rows), config.batch_size):
            k, step = order[at : at + config.batch_size], step + 1
            logits, held = scorer.forward(head[k], r[k], tail[k])
            error = weight[k] * (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y[k]) / len(k)
            for n, g in scorer.gradients(head[k], r[k], tail[k], error, held).items():
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.999 * v[n] + 0.001 * g * g
                scorer.tensors[n] -= config.learning_rate * 3 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
        if after is not None and not after(epoch, scorer):
            break
    return scorer
