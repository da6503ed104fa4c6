"""The engine: retrieval of ranked evidence paths with aggregates and a triage score; edge plausibility."""

from __future__ import annotations

import logging
from collections import OrderedDict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CapabilityError, EdgeFilter, GraphConfig, ModelConfig, RetrievalParams, RevisionConflictError
from .functions.scalars import fused_confidence, half_life_of_window
from .operators import aggregates, linking, paths, ranking, rules, scoring
from .operators import graph as G
from .sources.derived import Graph
from .sources.shared import written
from .sources.sinks import ArtifactStore, MetricsLog

log = logging.getLogger(__name__)
MODEL_KEY = "edge-plausibility"


@dataclass
class RetrievalResult:
    """DataFrames of one retrieval; ``to_dict`` gathers them (paths are bounded by their maximum)."""

    paths: DataFrame
    edges: DataFrame
    ranks: DataFrame
    insight: DataFrame
    triage: DataFrame
    motifs: DataFrame
    relation_shares: DataFrame
    snippet_anchors: DataFrame
    decomposition: DataFrame
    baseline: DataFrame | None = None
    params: RetrievalParams | None = None
    usage: Usage | None = None

    def to_dict(self) -> dict:
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        best = self.paths.orderBy(F.col("path_score").desc(), "path_id")
        out = {"paths": rows(best), "topk_ppr": rows(self.ranks), "insight": rows(self.insight)[0], "triage": rows(self.triage)[0], "motifs": rows(self.motifs)}
        out |= {"relation_shares": rows(self.relation_shares), "snippet_anchors": rows(self.snippet_anchors), "decomposition": rows(self.decomposition)[0]}
        if self.baseline is not None:
            out["baseline"] = rows(self.baseline)
        return out


@dataclass(frozen=True)
class Usage:
    """What a retrieval used, beside its bounds, and whether a bound was met."""

    nodes: int
    edges: int
    paths: int
    most_nodes: int
    most_paths: int
    hit_budget: bool

    @classmethod
    def of(cls, r: RetrievalResult) -> Usage:
        nodes, edges, found = r.ranks.count(), r.edges.count(), r.paths.count()
        most = r.params.beam.max_paths
        return cls(nodes, edges, found, r.params.topn, most, nodes >= r.params.topn or found >= most)


class ResultCache:
    """Ranks by everything that they depend on; the oldest go first."""

    def __init__(self, size: int = 256):
        self.size, self.held = size, {}

    def get(self, key: tuple) -> DataFrame | None:
        return self.held.get(key)

    def put(self, key: tuple, value: DataFrame) -> None:
        self.held[key] = value
        while len(self.held) > self.size:
            del self.held[next(iter(self.held))]

    def clear(self) -> None:
        self.held.clear()


class NeighborCache:
    """Neighbours of nodes on the driver, the least recently asked for going first.

    A node of over ``most`` neighbours isn't held, as its rows may be many: ``get_neighbors`` gives a DataFrame.
    """

    def __init__(self, engine: GraphEngine, size: int = 5000, most: int = 10_000):
        self.engine, self.size, self.most = engine, size, most
        self.held: OrderedDict[str, list] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, node: str) -> list:
        """The neighbours (rows) of a node, both ways."""
        if node in self.held:
            self.hits += 1
            self.held.move_to_end(node)
            return self.held[node]
        self.misses += 1
        return self._put(node, self.engine.get_neighbors(node).limit(self.most + 1).collect())

    def _put(self, node: str, rows: list) -> list:
        if len(rows) > self.most:
            raise CapabilityError(f"{node!r} has over {self.most} neighbours; get_neighbors gives them as a DataFrame")
        self.held[node] = rows
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return rows

    def warm(self, nodes: list[str]) -> int:
        """Read the neighbours of many nodes in one job; how many nodes are held of them."""
        found = G.both_neighbors(self.engine.edges(), self.engine._ids(nodes), self.engine.graph.nodes)
        few = found.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") <= self.most).select("src")
        by: dict[str, list] = {n: [] for n in nodes[: self.size]}
        for row in found.filter(F.col("src").isin(list(by))).join(few, "src", "left_semi").toLocalIterator():
            by[row["src"]].append(row)
        hubs = {r["src"] for r in found.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > self.most).select("src").collect()}  # of the nodes asked for
        for node, rows in by.items():
            if node not in hubs:
                self._put(node, rows)
        return len(by.keys() - hubs)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self.held), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}

    def clear(self) -> None:
        self.held.clear()
        self.hits = self.misses = 0


class GraphEngine:
    """Over a :class:`Graph`; ``rule`` filters every scan. ``as_of`` is now; no clock is read.

    ``priors`` (rel, prior) weigh the edges of walks, the beam's steps and the paths' scores; ``half_life``
    (days) lets weights decay; ``fuse`` takes an edge's confidence from the graph's ``confidences``, with the
    model's in the place of the posterior if there is one.
    """

    def __init__(self, spark: SparkSession, graph: Graph, params: RetrievalParams = RetrievalParams(), rule: EdgeFilter = EdgeFilter(), as_of: str | None = None, store: ArtifactStore | None = None, model: ModelConfig = ModelConfig(), require_model: bool = False, metrics: MetricsLog | None = None, confidence: float = 0.8, priors: DataFrame | None = None, half_life: float | None = None, fuse: bool = False, cache_size: int = 5000):
        self.spark, self.graph, self.params, self.rule, self.as_of = spark, graph, params, rule, as_of
        self.store, self.model_config, self.metrics, self.constant = store, model, metrics, confidence
        self.priors, self.half_life, self.fuse = priors, half_life, fuse
        if fuse and graph.confidences is None:
            raise CapabilityError("fusion needs the graph's confidences")
        self.trained = self.scorer = None
        self.neighbors = NeighborCache(self, cache_size)
        self.results = ResultCache()
        self._adjacent: dict = {}
        if require_model:
            if store is None:
                raise CapabilityError("require_model needs a store")
            self.ensure_model()

    @classmethod
    def from_tables(cls, spark: SparkSession, nodes: DataFrame, edges: DataFrame, config: GraphConfig = GraphConfig(), **settings) -> GraphEngine:
        return cls(spark, Graph(G.canonical_nodes(nodes, config), G.canonical_edges(edges, config)), **settings)

    # -- access

    def edges(self, rule: EdgeFilter | None = None) -> DataFrame:
        return G.filter_edges(self.graph.edges, rule or self.rule, self.graph.nodes, self.graph.membership)

    def get_neighbors(self, node: str) -> DataFrame:
        return G.both_neighbors(self.edges(), self._ids([node]), self.graph.nodes)

    def find_anchors(self, seeds: list[str], topn: int = 20) -> DataFrame:
        start = ranking.personalization(self._ids(seeds))
        return ranking.top(ranking.push_ppr(start, self.edges(), self.params.alpha, self.params.eps, self.params.push_rounds), topn)

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _weighed(self, edges: DataFrame) -> DataFrame:
        """``edges`` with confidence, and with their effective weight as weight."""
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        edges = self._confident(edges)
        if self.fuse:
            given = self.graph.confidences.select("src", "rel", "dst", F.col("raw").alias("raw_confidence"), "posterior", F.col("calib").alias("calibration"))
            edges = edges.join(given, ["src", "rel", "dst"], "left")
            posterior = F.col("posterior") if self.scorer is None else F.coalesce("confidence", "posterior")
            edges = edges.withColumn("model_posterior", posterior).withColumn("confidence", F.coalesce(fused_confidence(F.col("raw_confidence"), F.col("model_posterior"), F.col("calibration")), F.col("confidence")))
        if self.priors is None and self.half_life is None and not self.fuse:
            return edges
        as_of = self.as_of if self.half_life is not None else None
        return G.effective_weight(edges, self.priors, as_of, self.half_life or 30.0, self.fuse).withColumn("weight", F.col("effective_weight"))

    def _ranks(self, seeds: list[str], params: RetrievalParams, rule: EdgeFilter, prior: DataFrame | None, extra: DataFrame | None, edges: DataFrame) -> DataFrame:
        """Ranks of nodes. Those of seeds without a prior or soft edges are kept for when they are asked for again."""
        key = (tuple(sorted(seeds)), params.alpha, params.eps, params.push_rounds, params.walk_length, params.topn, rule)
        if prior is None and extra is None and (held := self.results.get(key)) is not None:
            return held
        start = ranking.personalization(self._ids(seeds), prior, self.graph.nodes)
        if extra is None:
            if rule not in self._adjacent:
                self._adjacent[rule] = written(ranking.adjacency(edges)), written(ranking.adjacency(edges, weighted=True))
            plain, weighted = self._adjacent[rule]
        else:
            plain, weighted = written(ranking.adjacency(edges)), written(ranking.adjacency(edges, weighted=True))
        push = ranking.push_ppr(start, edges, params.alpha, params.eps, params.push_rounds, plain)
        walks = ranking.expected_walks(start, weighted, params.alpha, params.walk_length)
        ranks = ranking.cut(ranking.mix(push, walks, params.topn))
        if prior is None and extra is None:
            self.results.put(key, ranks)
        return ranks

    def refresh(self) -> None:
        """Forget what was kept of the graph, after it changed."""
        self.neighbors.clear()
        self.results.clear()
        self._adjacent.clear()

    # -- retrieval

    def retrieve(self, seeds: list[str], max_paths: int | None = None, hop_limit: int | None = None, beam_width: int | None = None, include_baseline: bool = False, prior: DataFrame | None = None, extra: DataFrame | None = None) -> RetrievalResult:
        """Paths from ``seeds``. Between 2 and ``min_paths_for_confidence`` paths, one larger try; the better one counts."""
        beam = self.params.beam
        beam = replace(beam, max_paths=max_paths or beam.max_paths, hop_limit=hop_limit or beam.hop_limit, beam_width=beam_width or beam.beam_width)
        params = replace(self.params, beam=beam)
        first = self._once(seeds, params, self.rule, prior, extra)
        n = first.paths.count()
        if params.dynamic_scale and 2 <= n < params.min_paths_for_confidence:
            second = self._once(seeds, params.scaled(), self.rule, prior, extra)
            value = lambda r: (r.insight.first()["insight_score"], r.paths.count())
            first = max(first, second, key=value)
        if include_baseline:
            first = self._with_baseline(first, seeds, params)
        first = replace(first, usage=Usage.of(first))
        if self.metrics:
            self.metrics.log(**first.usage.__dict__, seeds=[str(redact_text(s)) for s in seeds], tries=1 + int(params.dynamic_scale and 2 <= n < params.min_paths_for_confidence), hop_limit=params.beam.hop_limit)
        return first

    def _confident(self, edges: DataFrame) -> DataFrame:
        if self.scorer is None:
            return paths.default_confidence(edges, self.constant)
        return edges.join(self.scorer.score(edges), ["src", "rel", "dst"])

    def _once(self, seeds: list[str], params: RetrievalParams, rule: EdgeFilter, prior=None, extra=None) -> RetrievalResult:
        g = self.graph
        edges = self.edges(rule)
        if extra is not None:
            edges = edges.unionByName(extra, allowMissingColumns=True)
        edges = self._weighed(edges)
        ranks = self._ranks(seeds, params, rule, prior, extra, edges)
        found = paths.beam_search(edges, self._ids(seeds), ranks, params.beam, self.priors, as_of=self.as_of)
        scored = ranking.cut(scoring.score_paths(ranking.cut(paths.numbered(found)), ranks, g.bridges, g.membership, g.affinities, self.priors, self.as_of, params.score))
        rows = self._rows(scored)
        now = self.as_of or "1970-01-01"
        half_life = self._half_life(rule)
        return RetrievalResult(
            scored, rows, ranks, scoring.insight(scored, ranks, params.insight, params.top_k_paths), aggregates.triage(rows, now, self._priors(), half_life=half_life), aggregates.motifs(rows, now), aggregates.relation_shares(rows),
            aggregates.snippet_anchors(rows), aggregates.insight_decomposition(paths.path_edges(scored), scored), None, params,
        )

    def _half_life(self, rule: EdgeFilter) -> float:
        if not rule.time_window:
            return 30.0
        low, high = (F.to_timestamp(F.lit(t)) for t in rule.time_window)
        return self.spark.range(1).select(half_life_of_window(low, high).alias("h")).first()["h"]

    def _rows(self, scored: DataFrame) -> DataFrame:
        """The edges of paths with labels of their ends and a document."""
        e = paths.path_edges(scored).withColumnRenamed("rel", "relation")
        label = self.graph.nodes.select("id", "label")
        for end in ("src", "dst"):
            e = e.join(label.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
        if self.graph.provenance is None:
            return ranking.cut(e.withColumn("document_id", F.lit(None).cast("string")))
        first = self.graph.provenance.groupBy("src").agg(F.min("dst").alias("document_id"))
        return ranking.cut(e.join(first, "src", "left"))

    def _priors(self) -> DataFrame:
        counted = self.graph.edges.groupBy(F.col("rel").alias("relation")).agg(F.count("*").alias("n"))
        return counted.join(F.broadcast(counted.agg(F.sum("n").alias("all")))).select("relation", (F.col("n") / F.col("all")).alias("prior"))

    def _with_baseline(self, result: RetrievalResult, seeds: list[str], params: RetrievalParams) -> RetrievalResult:
        """Against the window of equal length before; on filtered edges, so the engine stays as it is."""
        if not self.rule.time_window:
            raise CapabilityError("a baseline needs a time window")
        row = self.spark.sql("SELECT CAST(to_timestamp(:a) - (to_timestamp(:b) - to_timestamp(:a)) AS STRING) AS low", {"a": self.rule.time_window[0], "b": self.rule.time_window[1]}).first()
        before = replace(self.rule, time_window=(row["low"], self.rule.time_window[0]))
        small = replace(params, beam=replace(params.beam, max_paths=max(20, params.beam.max_paths // 10), beam_width=max(16, params.beam.beam_width // 2)))
        base = self._once(seeds, small, before)
        now = self.as_of or "1970-01-01"
        return replace(result, baseline=aggregates.baseline_comparison(result.relation_shares, base.relation_shares), triage=aggregates.triage(result.edges, now, None, base.edges, self._half_life(self.rule)))

    def score_candidates(self, candidates: DataFrame, seeds: list[str]) -> DataFrame:
        """id, score of candidate nodes (id) by bidirectional ranking from the seeds."""
        return ranking.bippr(ranking.personalization(self._ids(seeds)), candidates, self.edges(), self.params.alpha)

    def link_and_retrieve(self, mentions: DataFrame, writer=None, **settings) -> tuple[DataFrame, RetrievalResult]:
        """Mentions are linked, joined to the graph by soft edges, and the first three entities are the seeds."""
        linked = ranking.cut(linking.link(mentions))
        soft = linked.join(mentions.select("mention_id", "surface"), "mention_id").select(F.concat_ws("/", F.lit("overlay"), F.sha2(F.concat_ws("|", "surface", "entity"), 256)).alias("edge_id"), F.col("surface").alias("src"), F.lit("mentions").alias("rel"), F.col("entity").alias("dst"), F.col("confidence").alias("weight"))
        seeds = [r["id"] for r in linking.linked_seeds(linked).collect()]  # three at most
        if writer is not None:
            writer.write_links(linked.select(F.col("entity").alias("src"), F.lit("linked_from_text").alias("rel"), F.col("entity").alias("dst"), "confidence"))
        return linked, self.retrieve(seeds, extra=soft, **settings)

    # -- plausibility

    @property
    def has_model(self) -> bool:
        return self.scorer is not None

    def score_edge(self, src: str, rel: str, dst: str) -> float:
        return self.constant if self.scorer is None else float(self.scorer.probabilities([src], [rel], [dst])[0])

    def score_edges(self, edges: DataFrame) -> DataFrame:
        return self._confident(edges)

    def ensure_model(self, force: bool = False) -> bool:
        """Load a model of the present data and settings, or train and save one; true if it was trained.

        If another driver saved one meanwhile, that one serves.
        """
        from .model.trainer import Trained, train_model

        snapshot = G.training_snapshot(self.graph.edges, self.graph.nodes)
        stamp = {"snapshot": G.snapshot_hash(snapshot).first()["snapshot"], "config": repr(self.model_config)}
        held = self.store.load(MODEL_KEY) if self.store else None
        fits = lambda h: h is not None and {k: h[0].get(k) for k in stamp} == stamp
        if fits(held) and not force:
            self._serve(Trained.from_document(held[0]["model"]))
            return False
        fresh = train_model(snapshot, self.model_config, seed=int(stamp["snapshot"][:16], 16) % (1 << 63), after=(lambda row: self.metrics.log(**row)) if self.metrics else None)
        if not fresh.converged:
            log.warning("the rules' weights of this model had not converged; it serves as it is")
        if self.store:
            try:
                self.store.save(MODEL_KEY, {**stamp, "model": fresh.to_document()}, held[1] if held else None)
            except RevisionConflictError:
                winner = self.store.load(MODEL_KEY)
                if not fits(winner):
                    raise
                fresh = Trained.from_document(winner[0]["model"])
        self._serve(fresh)  # only now: a failure leaves what served before
        return True

    def _serve(self, trained) -> None:
        self.trained, self.scorer = trained, trained.scorer
        self.refresh()

    def rule_confidences(self) -> list[dict]:
        """The rules of the model with their weights."""
        return [] if self.trained is None else self.trained.rule_confidences()

    def predict_unknown(self, candidates: DataFrame, k: int = 10) -> DataFrame:
        """The most plausible of ``candidates`` (src, rel, dst) that the graph doesn't have."""
        from .model.trainer import predict_unknown

        if self.scorer is None:
            raise CapabilityError("predictions need a model")
        return predict_unknown(self.scorer, candidates, self.graph.edges, k)

    def retrain_model(self) -> bool:
        return self.ensure_model(force=True)

    def mined_rules(self, cap: int | None = 1000) -> DataFrame:
        return rules.smart_rules(rules.facts(G.training_snapshot(self.graph.edges, self.graph.nodes)), cap)

    def get_status(self) -> dict:
        g = self.graph
        return {"has_model": self.has_model, "converged": None if self.trained is None else self.trained.converged, "validation_mrr": None if self.trained is None else self.trained.best_mrr, "neighbors": self.neighbors.stats(), "community": self.rule.community, "community_mode": self.rule.community_mode, **{n: getattr(g, n) is not None for n in ("membership", "bridges", "affinities", "provenance")}}


def redact_text(text: str) -> str:
    """Mail addresses and telephone numbers of one text on the driver, replaced by a mark."""
    import re

    from .functions.scalars import EMAIL, PHONE

    return re.sub(PHONE, "[PHONE_REDACTED]", re.sub(EMAIL, "[EMAIL_REDACTED]", text))


