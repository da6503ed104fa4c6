"""Bounded beam search over simple paths, and what paths hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import BeamParams
from ..functions.scalars import age_days, safe_ln
from ..sources.shared import checked_broadcast, cut


def default_confidence(edges: DataFrame, value: float = 0.8) -> DataFrame:
    return edges.withColumn("confidence", F.lit(min(max(value, 1e-6), 1.0)))


def beam_search(edges: DataFrame, seeds: DataFrame, scores: DataFrame, params: BeamParams = BeamParams(), priors: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """hop, score, nodes, edges: the kept paths of every hop, best first.

    ``edges`` carry ``confidence``. A hop joins the frontier, at most ``beam_width`` rows and cut off
    from its lineage, with edges. Frontier, seeds and scores are broadcast if they are counted to be
    few. Scores are rounded so that ties are the same everywhere, and ties go by nodes and edge ids.
    """
    by_rank, by_prior, by_confidence, by_recency = params.lambdas
    if params.allowed_relations:
        edges = edges.filter(F.col("rel").isin(*params.allowed_relations))
    if params.max_out_degree is not None:
        place = W.partitionBy("src").orderBy("edge_id")
        edges = edges.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= params.max_out_degree).drop("place")
    step = F.lit(0.0)
    if priors is not None:
        edges = edges.join(F.broadcast(priors.select("rel", "prior")), "rel", "left")
        step = step + by_prior * safe_ln(F.coalesce("prior", F.lit(1.0)))
    step = step + by_confidence * safe_ln(F.col("confidence"))
    if as_of is not None:
        step = step + by_recency * F.coalesce(-F.greatest(age_days(F.col("created_at"), as_of), F.lit(0.0)) / 90.0, F.lit(0.0))
    moves = edges.select("src", F.col("dst").alias("next"), F.struct("edge_id", "src", "rel", "dst", "confidence", "created_at").alias("edge"), step.alias("step"))
    ranks = checked_broadcast(cut(scores.select(F.col("id").alias("next"), "score")))
    frontier = seeds.select("id").distinct().select(F.lit(0.0).alias("total"), F.array("id").alias("nodes"), F.array().cast(f"array<{moves.schema['edge'].dataType.simpleString()}>").alias("edges"))
    frontier, out = cut(frontier), None
    for hop in range(1, params.hop_limit + 1):
        tail = checked_broadcast(frontier.withColumn("src", F.element_at("nodes", -1)))
        grown = moves.join(tail, "src").filter(~F.array_contains("nodes", F.col("next")))
        ranked = grown.join(ranks, "next", "left").withColumn("total", F.round(F.col("total") + by_rank * safe_ln(F.coalesce("score", F.lit(0.0))) + F.col("step"), 9))
        extended = ranked.select("total", F.concat("nodes", F.array("next")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"))
        frontier = cut(extended.orderBy(F.col("total").desc(), "nodes", F.transform("edges", lambda e: e["edge_id"])).limit(params.beam_width))
        kept = frontier.withColumn("hop", F.lit(hop))
        out = kept if out is None else out.unionByName(kept)
    return out.orderBy(F.col("total").desc(), "nodes", F.transform("edges", lambda e: e["edge_id"])).limit(params.max_paths).select("hop", F.col("total").alias("score"), "nodes", "edges")


def numbered(paths: DataFrame) -> DataFrame:
    """path_id from 1 by score, nodes and edges. At most ``max_paths`` rows, so one window is short."""
    order = W.orderBy(F.col("score").desc(), "nodes", F.transform("edges", lambda e: e["edge_id"]))
    return paths.withColumn("path_id", F.row_number().over(order))


def path_edges(paths: DataFrame) -> DataFrame:
    """path_id, position and the fields of each edge."""
    return paths.select("path_id", F.posexplode("edges").alias("position", "edge")).select("path_id", "position", "edge.*")


def normalized_edges(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One name for the relation (rel, relation, relationship), an id for each edge, labels where missing."""
    have = set(edges.columns)
    rel = F.coalesce(*[F.col(c) for c in ("rel", "relation", "relationship") if c in have])
    key = F.coalesce(*[F.col(c) for c in ("edge_id", "id") if c in have], F.concat_ws("|", F.col("src"), rel, F.col("dst")))
    out = edges.withColumn("relation", rel).withColumn("edge_id", key)
    if labels is not None:
        for end in ("src", "dst"):
            known = labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_known"))
            given = F.col(f"{end}_label") if f"{end}_label" in have else F.lit(None).cast("string")
            out = out.join(known, end, "left").withColumn(f"{end}_label", F.coalesce(given, F.col(f"{end}_known"))).drop(f"{end}_known")
    return out
