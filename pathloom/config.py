"""Settings: how input columns map to the graph, and the parameters of retrieval and scoring."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field, fields, replace


class ConfigurationError(ValueError):
    """A mapping or parameter is missing or out of range."""


class CapabilityError(RuntimeError):
    """The graph lacks a table that the operation needs."""


class ModelStoreError(RuntimeError):
    """An artifact can't be read or written."""


class CorruptArtifactError(ModelStoreError):
    """An artifact is there but isn't valid."""


class NewerArtifactError(ModelStoreError):
    """An artifact was written by a later version."""


class RevisionConflictError(ModelStoreError):
    """Another writer saved first."""


@dataclass(frozen=True)
class GraphConfig:
    """Column names of the input tables. None: not mapped, so never interpreted."""

    node_id: str = "id"
    node_type: str | None = "type"
    node_label: str | None = "label"
    source: str = "src"
    target: str = "dst"
    relation: str = "rel"
    edge_id: str | None = "edge_id"
    weight: str | None = "weight"
    created_at: str | None = "created_at"
    valid_from: str | None = None
    valid_to: str | None = None
    status: str | None = None
    raw_confidence: str | None = None
    model_posterior: str | None = None
    calibration: str | None = None
    inline_sources: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("node_id", "source", "target", "relation"):
            if not str(getattr(self, name) or "").strip():
                raise ConfigurationError(f"{name} must name a column")


@dataclass(frozen=True)
class EdgeFilter:
    """Predicates of a neighbour scan; empty means unrestricted."""

    community: str | None = None
    community_mode: str = "none"  # none, property, mapping
    community_property: str = "community"
    algorithm: str | None = None
    allowed_relations: tuple[str, ...] = ()
    denied_relations: tuple[str, ...] = ()
    neighbor_types: tuple[str, ...] = ()
    time_window: tuple[str, str] | None = None
    as_of: str | None = None
    current_only: bool = False
    statuses: tuple[str, ...] = ()

    def __post_init__(self):
        if self.community_mode not in ("none", "property", "mapping"):
            raise ConfigurationError(f"unknown community mode {self.community_mode!r}")
        if self.community_mode != "none" and self.community is None:
            raise ConfigurationError("a community mode needs a community")
        if self.current_only and self.as_of is None:
            raise ConfigurationError("current_only needs as_of")


@dataclass(frozen=True)
class BeamParams:
    hop_limit: int = 3
    beam_width: int = 64
    max_paths: int = 200
    # weights of the logarithms of node rank, relation prior, confidence and recency
    lambdas: tuple[float, float, float, float] = (0.6, 0.2, 0.15, 0.05)
    allowed_relations: tuple[str, ...] = ()
    max_out_degree: int | None = None


@dataclass(frozen=True)
class ScoreConfig:
    tau_days: float = 30.0
    recency_clamp: tuple[float, float] = (0.5, 1.0)
    rho: float = 0.5
    bridge_boost: float = 1.5
    affinity_boost: float = 1.5


@dataclass(frozen=True)
class InsightConfig:
    evidence: float = 0.5
    community: float = 0.2
    explanation: float = 0.2
    impact: float = 0.1


@dataclass(frozen=True)
class RetrievalParams:
    alpha: float = 0.15
    eps: float = 1e-4
    walk_length: int = 40
    push_rounds: int = 20
    topn: int = 200
    beam: BeamParams = field(default_factory=BeamParams)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    insight: InsightConfig = field(default_factory=InsightConfig)
    top_k_paths: int = 5
    dynamic_scale: bool = True
    min_paths_for_confidence: int = 8

    def scaled(self) -> RetrievalParams:
        """Larger bounds for the one retry that thin results get."""
        b = self.beam
        return replace(self, beam=replace(b, hop_limit=min(4, b.hop_limit + 1), beam_width=min(256, 2 * b.beam_width), max_paths=min(400, 2 * b.max_paths)))


@dataclass(frozen=True)
class ModelConfig:
    """Hyper-parameters of the plausibility model."""

    embedding_dim: int = 32
    hidden: int = 64
    learning_rate: float = 0.003
    epochs: int = 60
    batch_size: int = 128
    negatives_per_side: int = 4
    em_epochs: int = 12
    em_iterations: int = 20
    m_iterations: int = 100
    m_learning_rate: float = 5e-4
    m_l2: float = 0.01
    grad_clip: float = 1.0
    convergence: float = 1e-4
    patience: int = 3
    max_groundings: int = 1000
    min_support: int = 2
    min_confidence: float = 0.2
    holdout: float = 0.1


PROFILES = {"default": ModelConfig(), "small": ModelConfig(embedding_dim=8, hidden=8, epochs=30, em_epochs=4), "large": ModelConfig(embedding_dim=64, hidden=128)}


def get_profile(name: str) -> ModelConfig:
    if name not in PROFILES:
        raise ConfigurationError(f"unknown profile {name!r}")
    return copy.deepcopy(PROFILES[name])


def model_config_from_json(text: str) -> ModelConfig:
    """Integers where floats are meant are repaired; unknown names are refused."""
    data, known = json.loads(text), {f.name: f for f in fields(ModelConfig)}
    if extra := set(data) - set(known):
        raise ConfigurationError(f"unknown settings {sorted(extra)}")
    return ModelConfig(**{k: float(v) if known[k].type == "float" else v for k, v in data.items()})
