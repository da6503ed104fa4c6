"""Aggregates over the edges of ranked paths, and the triage score.

Edges come as rows: path_id, position, relation, src_label, dst_label, confidence, created_at,
document_id. ``as_of`` stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp, geometric_mean, past_days
from ..sources.shared import written
from .graph import keep_relation
from .numbering import coded
from .rules import chains_by_kind, closed_chains


def kept_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(keep_relation(F.col("relation"), F.col("src_label"), F.col("dst_label")))


def motifs(edges: DataFrame, as_of: str) -> DataFrame:
    """pattern, edge_count, path_count, mean_confidence, median_age_days; a pattern is a path's kept relations in order."""
    kept = kept_edges(edges)
    pattern = kept.groupBy("path_id").agg(F.concat_ws("->", F.transform(F.sort_array(F.collect_list(F.struct("position", "relation"))), lambda x: x["relation"])).alias("pattern"))
    grouped = kept.join(pattern, "path_id").groupBy("pattern")
    return grouped.agg(
        F.count("*").alias("edge_count"),
        F.count_distinct("path_id").alias("path_count"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.median(past_days(F.col("created_at"), as_of)).alias("median_age_days"),
    )


def relation_shares(edges: DataFrame) -> DataFrame:
    """relation, count, share among kept edges."""
    counted = kept_edges(edges).groupBy("relation").agg(F.count("*").alias("count"))
    return counted.withColumn("share", F.round(F.col("count") / F.sum("count").over(W.partitionBy()), 4))  # a row for each relation


def coverage(edges: DataFrame, as_of: str, half_life: float = 30.0) -> DataFrame:
    """One row: provenance and label coverage, recency, counts."""
    age = past_days(F.col("created_at"), as_of)
    labelled = F.col("src_label").isNotNull().cast("int") + F.col("dst_label").isNotNull().cast("int")
    kept = keep_relation(F.col("relation"), F.col("src_label"), F.col("dst_label"))
    return edges.agg(
        F.count("*").alias("edges"),
        F.coalesce(F.sum(kept.cast("int")), F.lit(0)).alias("kept_edges"),
        F.coalesce(F.avg(F.col("document_id").isNotNull().cast("int")), F.lit(0.0)).alias("provenance_coverage"),
        F.coalesce(F.sum(labelled) / (2 * F.count("*")), F.lit(0.0)).alias("label_coverage"),
        F.coalesce(F.avg(F.exp(-age / half_life)), F.lit(0.0)).alias("recency"),
    )


def motif_density(found: DataFrame, top_k: int = 2) -> DataFrame:
    """One row: the share of edges in the largest motifs."""
    place = F.row_number().over(W.orderBy(F.col("edge_count").desc(), F.col("path_count").desc(), "pattern"))
    ranked = found.withColumn("place", place)
    return ranked.agg(F.coalesce(F.sum(F.when(F.col("place") <= top_k, F.col("edge_count"))) / F.sum("edge_count"), F.lit(0.0)).alias("motif_density"))


def snippet_anchors(edges: DataFrame, paths: int = 10, per_path: int = 2, total: int = 16) -> DataFrame:
    """path_id, position, document_id: of the first paths, so many edges with a document each. Documents may repeat."""
    rows = edges.filter((F.col("path_id") <= paths) & F.col("document_id").isNotNull())
    place = F.row_number().over(W.partitionBy("path_id").orderBy("position"))
    return rows.withColumn("place", place).filter(F.col("place") <= per_path).orderBy("path_id", "position").limit(total).select("path_id", "position", "document_id")


def dominant_relation(shares: DataFrame) -> DataFrame:
    """One row: the relation of the largest share; of equal ones the first by name."""
    return shares.orderBy(F.col("share").desc(), "relation").limit(1).select("relation", "share")


def surprise(shares: DataFrame, priors: DataFrame) -> DataFrame:
    """relation, surprise: how far a share is from its prior (0 if it has none)."""
    return shares.join(priors.select("relation", "prior"), "relation", "left").select("relation", F.round(F.abs(F.col("share") - F.coalesce("prior", F.lit(0.0))), 4).alias("surprise"))


def baseline_comparison(current: DataFrame, base: DataFrame, min_edges: int = 10) -> DataFrame:
    """relation, shares now and before, their difference in points and relative, and whether support is low."""
    a = current.select("relation", F.col("share").alias("share"), F.col("count").alias("count"))
    b = base.select("relation", F.col("share").alias("base_share"), F.col("count").alias("base_count"))
    both = a.join(b, "relation", "full_outer").na.fill(0.0, ["share", "base_share"]).na.fill(0, ["count", "base_count"])
    change = F.round(F.col("share") - F.col("base_share"), 4)
    return both.select("relation", "share", "base_share", change.alias("delta_share"), F.round(100 * change, 2).alias("pp_change"), F.when(F.col("base_share") > 0, F.round(change / F.col("base_share"), 4)).alias("relative_change"), (F.col("base_count") < min_edges).alias("low_support"))


def insight_decomposition(edges: DataFrame, path_scores: DataFrame) -> DataFrame:
    """One row: mean strength (geometric mean of confidences) and rank of paths, a label and a gate."""
    strength = edges.groupBy("path_id").agg(geometric_mean(F.sort_array(F.collect_list("confidence"))).alias("strength"), F.avg("confidence").alias("confidence"))
    one = strength.join(path_scores.select("path_id", F.col("path_score").alias("rank")), "path_id").agg(F.coalesce(F.avg("strength"), F.lit(0.0)).alias("mean_strength"), F.coalesce(F.avg("rank"), F.lit(0.0)).alias("mean_rank"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
    label = F.when(F.col("mean_strength") >= 0.7, "High").when(F.col("mean_strength") >= 0.4, "Medium").otherwise("Low")
    return one.withColumn("label", label).withColumn("passes", F.col("mean_strength") >= 0.4)


def triage_score(provenance: Column, recency: Column, surprise_value: Column, density: Column, control: Column, label_coverage: Column, low_support: Column) -> Column:
    """0 to 100, rounded half to even. Too few labels cap the motif part and cost 15; low support costs two fifths first."""
    poor = label_coverage < 0.8
    m = F.when(poor, F.least(density, F.lit(0.3))).otherwise(density)
    base = 25 * clamp(provenance, 0, 1) + 25 * clamp(recency, 0, 1) + 25 * clamp(surprise_value, 0, 1) + 15 * clamp(m, 0, 1) + 10 * clamp(control, 0, 1)
    base = F.when(low_support, 0.6 * base).otherwise(base) - F.when(poor, 15.0).otherwise(0.0)
    return F.bround(clamp(base, 0.0, 100.0), 0)


def summary(edges: DataFrame, as_of: str, half_life: float = 30.0) -> DataFrame:
    """One row: coverage, motif density and the dominant relation; values rounded to 4 places."""
    one = coverage(edges, as_of, half_life).join(F.broadcast(motif_density(motifs(edges, as_of))))
    lead = dominant_relation(relation_shares(edges)).select(F.col("relation").alias("dominant_relation"), F.col("share").alias("dominant_share"))
    one = one.join(F.broadcast(lead), F.lit(True), "left")  # one row each
    return one.select("edges", "kept_edges", *[F.round(c, 4).alias(c) for c in ("provenance_coverage", "label_coverage", "recency", "motif_density")], "dominant_relation", F.coalesce("dominant_share", F.lit(0.0)).alias("dominant_share"))


def triage(edges: DataFrame, as_of: str, priors: DataFrame | None = None, baseline: DataFrame | None = None, half_life: float = 30.0, control: float = 1.0, min_edges: int = 20) -> DataFrame:
    """``summary`` with surprise of the dominant relation (against priors, else a baseline) and the triage score."""
    one = summary(edges, as_of, half_life)
    if priors is not None:
        other = priors.select(F.col("relation").alias("dominant_relation"), F.col("prior").alias("was"))
    elif baseline is not None:
        other = relation_shares(baseline).select(F.col("relation").alias("dominant_relation"), F.col("share").alias("was"))
    else:
        other = None
    if other is None:
        one = one.withColumn("surprise", F.lit(0.0))
    else:
        one = one.join(other, "dominant_relation", "left").withColumn("surprise", F.round(F.abs(F.col("dominant_share") - F.coalesce("was", F.lit(0.0))), 4)).drop("was")
    score = triage_score(F.col("provenance_coverage"), F.col("recency"), F.col("surprise"), F.col("motif_density"), F.lit(control), F.col("label_coverage"), F.col("kept_edges") < min_edges)
    return one.withColumn("triage", score)


def wedges_and_triads(edges: DataFrame, relations: tuple[str, ...] = (), coding=None) -> DataFrame:
    """One row: paths of two steps over distinct nodes, how many are closed, and the rate. ``coding``: ``edges`` in numbers (known, rels, kind), if it is at hand."""
    if coding is not None:
        known, rels = coding.known, coding.rels
        if relations:
            known = known.join(F.broadcast(rels.filter(F.col("rel").isin(*relations))), "r", "left_semi")
    else:
        known, rels = coded((edges.filter(F.col("rel").isin(*relations)) if relations else edges).filter("src <> dst"))
    pairs = written(known.filter("s <> d").select("s", F.lit(0).cast("long").alias("r"), "d").distinct())
    # a wedge is an edge in and one out of its middle, less those that go back; none is made
    ins, outs = pairs.groupBy(F.col("d").alias("v")).agg(F.count("*").alias("n_in")), pairs.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("n_out"))
    through = ins.join(outs, "v").agg(F.coalesce(F.sum(F.col("n_in") * F.col("n_out")), F.lit(0)).alias("through"))
    turned = pairs.groupBy(F.least("s", "d").alias("u"), F.greatest("s", "d").alias("v")).agg(F.count("*").alias("n"))
    back = turned.agg(F.coalesce(F.sum(F.when(F.col("n") == 2, 2).otherwise(0)), F.lit(0)).alias("back"))
    found = None if coding is None else chains_by_kind(pairs, coding.kind)
    closed = (closed_chains(pairs) if found is None else found).agg(F.coalesce(F.sum("support"), F.lit(0)).alias("triads"))
    one = through.join(F.broadcast(back)).join(F.broadcast(closed)).select((F.col("through") - F.col("back")).alias("wedges"), "triads")  # one row each
    return one.withColumn("closure", F.when(F.col("wedges") > 0, F.col("triads") / F.col("wedges")).otherwise(0.0))
