"""Path scores and the insight score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import InsightConfig, ScoreConfig
from ..functions.scalars import TINY, affinity_factor, bridge_factor, clamp, insight_score, past_days, power_mean, product, recency_factor


def node_signals(paths: DataFrame, ranks: DataFrame, bridges: DataFrame | None, config: ScoreConfig) -> DataFrame:
    """path_id, ranks and bridge factors of its nodes in order."""
    at = paths.select("path_id", F.posexplode("nodes").alias("position", "id")).join(ranks.select("id", F.col("score").alias("rank")), "id", "left")
    if bridges is not None:
        strongest = bridges.groupBy(F.col("entity").alias("id")).agg(F.max("strength").alias("strength"))
        at = at.join(strongest, "id", "left").withColumn("factor", bridge_factor(F.coalesce("strength", F.lit(0.0)), config.bridge_boost))
    else:
        at = at.withColumn("factor", F.lit(1.0))
    held = at.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce("rank", F.lit(TINY)).alias("rank"), "factor"))).alias("x"))
    return held.select("path_id", F.transform("x", lambda s: s["rank"]).alias("ranks"), F.transform("x", lambda s: s["factor"]).alias("bridges"))


def symmetric_affinity(pairs: DataFrame, affinities: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``affinity`` of the unordered pair, 0 by default."""
    known = affinities.groupBy(F.least("from_c", "to_c").alias("low"), F.greatest("from_c", "to_c").alias("high")).agg(F.max("score").alias("affinity"))
    keyed = pairs.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))
    return keyed.join(known, ["low", "high"], "left").withColumn("affinity", F.coalesce("affinity", F.lit(0.0))).drop("low", "high")


def edge_signals(paths: DataFrame, membership: DataFrame | None, affinities: DataFrame | None, priors: DataFrame | None, as_of: str | None, config: ScoreConfig) -> DataFrame:
    """path_id, confidences, affinity factors, priors and ages of its edges in order."""
    at = paths.select("path_id", F.posexplode("edges").alias("position", "edge")).select("path_id", "position", "edge.*")
    if membership is not None and affinities is not None:
        of = membership.select("entity", "community").dropDuplicates(["entity"])
        at = at.join(of.select(F.col("entity").alias("src"), F.col("community").alias("a")), "src", "left").join(of.select(F.col("entity").alias("dst"), F.col("community").alias("b")), "dst", "left")
        at = symmetric_affinity(at, affinities)
        at = at.withColumn("affinity", F.when(F.coalesce(F.col("a") != F.col("b"), F.lit(False)), affinity_factor(F.col("affinity"), config.affinity_boost)).otherwise(1.0))
    else:
        at = at.withColumn("affinity", F.lit(1.0))
    if priors is not None:
        at = at.join(F.broadcast(priors.select("rel", "prior")), "rel", "left")
    else:
        at = at.withColumn("prior", F.lit(1.0))
    age = past_days(F.col("created_at"), as_of) if as_of else F.lit(None).cast("double")
    row = F.struct("position", F.greatest(F.least("confidence", F.lit(1.0)), F.lit(TINY)).alias("confidence"), "affinity", F.greatest(F.coalesce("prior", F.lit(1.0)), F.lit(1e-6)).alias("prior"), age.alias("age"))
    held = at.groupBy("path_id").agg(F.sort_array(F.collect_list(row)).alias("x"))
    pick = lambda n: F.transform("x", lambda s: s[n])
    return held.select("path_id", pick("confidence").alias("confidences"), pick("affinity").alias("affinities"), pick("prior").alias("priors"), F.filter(pick("age"), lambda a: a.isNotNull()).alias("ages"))


def score_paths(paths: DataFrame, ranks: DataFrame, bridges=None, membership=None, affinities=None, priors=None, as_of=None, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """``paths`` with ``path_score`` and its parts ``decomp``. A path without edges scores 0."""
    signals = node_signals(paths, ranks, bridges, config).join(edge_signals(paths, membership, affinities, priors, as_of, config), "path_id")
    recency = recency_factor(F.col("ages"), config.tau_days, *config.recency_clamp) if as_of else F.lit(1.0)
    score = product(F.col("confidences")) * power_mean(F.col("ranks"), config.rho) * power_mean(F.col("bridges"), config.rho) * product(F.col("affinities")) * product(F.col("priors")) * recency
    scored = signals.select("path_id", score.alias("s"), F.struct("confidences", "ranks", "bridges", "affinities", "priors", "ages").alias("decomp"))
    return paths.join(scored, "path_id", "left").withColumn("path_score", F.coalesce("s", F.lit(0.0))).drop("s")


def evidence_strength(scored: DataFrame, top_k: int = 5) -> DataFrame:
    """One row: noisy-or of the best paths."""
    best = scored.select(F.col("path_score").alias("s")).orderBy(F.col("s").desc()).limit(top_k)
    return best.agg((1 - F.coalesce(F.product(F.greatest(F.lit(0.0), 1 - F.col("s"))), F.lit(1.0))).alias("evidence_strength"))


def community_relevance(paths: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: the rank mass of all nodes on paths, each once."""
    ids = paths.select(F.explode("nodes").alias("id")).distinct()
    return ids.join(ranks, "id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("community_relevance"))


def insight(scored: DataFrame, ranks: DataFrame, config: InsightConfig = InsightConfig(), top_k: int = 5) -> DataFrame:
    both = evidence_strength(scored, top_k).join(F.broadcast(community_relevance(scored, ranks)))  # one row each
    half = F.lit(0.5)
    value = insight_score(F.col("evidence_strength"), F.col("community_relevance"), half, half, (config.evidence, config.community, config.explanation, config.impact))
    return both.withColumn("insight_score", clamp(value, 0.0, 1.0))
