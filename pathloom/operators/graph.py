"""Graph access: canonical tables, filtered and weighted neighbourhoods, degrees, provenance, overlays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EdgeFilter, GraphConfig
from ..functions.scalars import decay, edge_hash, fused_confidence
from ..sources.shared import MOST_IDS, checked_broadcast, cut, written


def canonical_edges(df: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """edge_id, src, rel, dst, the mapped signals, inline_sources, and the whole row as ``assertion``."""

    def mapped(name: str, kind: str) -> Column:
        column = getattr(config, name)
        return (F.col(column).cast(kind) if column else F.lit(None).cast(kind)).alias(name)

    src, rel, dst = (F.col(getattr(config, n)).cast("string") for n in ("source", "relation", "target"))
    key = F.col(config.edge_id).cast("string") if config.edge_id else edge_hash(src, rel, dst)
    sources = F.array_compact(F.array(*[F.col(c).cast("string") for c in config.inline_sources])) if config.inline_sources else F.array().cast("array<string>")
    signals = [mapped(n, k) for n, k in (("created_at", "timestamp"), ("valid_from", "timestamp"), ("valid_to", "timestamp"), ("status", "string"), ("raw_confidence", "double"), ("model_posterior", "double"), ("calibration", "double"))]
    weight = F.coalesce(F.expr(f"try_cast(`{config.weight}` AS DOUBLE)"), F.lit(1.0)) if config.weight else F.lit(1.0)
    return df.select(key.alias("edge_id"), src.alias("src"), rel.alias("rel"), dst.alias("dst"), weight.alias("weight"), *signals, sources.alias("inline_sources"), F.struct(*df.columns).alias("assertion"))


def canonical_nodes(df: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    optional = [(F.col(c).cast("string") if c else F.lit(None).cast("string")).alias(n) for n, c in (("type", config.node_type), ("label", config.node_label))]
    return df.select(F.col(config.node_id).cast("string").alias("id"), *optional, F.struct(*df.columns).alias("doc"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def filter_edges(edges: DataFrame, rule: EdgeFilter, nodes: DataFrame | None = None, membership: DataFrame | None = None) -> DataFrame:
    """Edges that pass; predicates on edge columns reach the scan, those on neighbours are semi-joins, by broadcast where ids are few."""
    few = lambda ids: checked_broadcast(ids.distinct(), MOST_IDS)
    if rule.allowed_relations:
        edges = edges.filter(F.col("rel").isin(*rule.allowed_relations))
    if rule.denied_relations:
        edges = edges.filter(F.coalesce(~F.col("rel").isin(*rule.denied_relations), F.lit(True)))
    if rule.time_window:
        edges = edges.filter(F.col("created_at").between(*[F.to_timestamp(F.lit(t)) for t in rule.time_window]))
    if rule.current_only:
        at = F.to_timestamp(F.lit(rule.as_of))
        edges = edges.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))
    if rule.statuses:
        edges = edges.filter(F.col("status").isin(*rule.statuses))
    if rule.neighbor_types:
        edges = edges.join(few(nodes.filter(F.col("type").isin(*rule.neighbor_types)).select(F.col("id").alias("dst"))), "dst", "left_semi")
    if rule.community_mode == "property":
        edges = edges.join(few(nodes.filter(F.col(rule.community_property) == rule.community).select(F.col("id").alias("dst"))), "dst", "left_semi")
    elif rule.community_mode == "mapping":
        edges = edges.join(few(members(membership, rule.community, rule.algorithm).select(F.col("entity").alias("dst"))), "dst", "left_semi")
    return edges


def members(membership: DataFrame, community: str, algorithm: str | None = None) -> DataFrame:
    out = membership.filter(F.col("community") == community)
    return out if algorithm is None else out.filter(F.col("algorithm") == algorithm)


def effective_weight(edges: DataFrame, priors: DataFrame | None = None, as_of: str | None = None, half_life: float = 30.0, fuse: bool = False) -> DataFrame:
    """``edges`` with weight * relation prior * decay * fused confidence, as far as each is asked for."""
    weight = F.coalesce(F.col("weight"), F.lit(1.0))
    if priors is not None:
        edges = edges.join(F.broadcast(priors.select("rel", "prior")), "rel", "left")  # a row for each relation
        weight = weight * F.coalesce(F.col("prior"), F.lit(1.0))
    if as_of is not None:
        weight = weight * decay(F.col("created_at"), as_of, half_life)
    if fuse:
        weight = weight * fused_confidence(F.col("raw_confidence"), F.col("model_posterior"), F.col("calibration"))
    out = edges.withColumn("effective_weight", weight)
    return out.drop("prior") if priors is not None else out


def neighbors(edges: DataFrame, frontier: DataFrame, nodes: DataFrame, direction: str = "out") -> DataFrame:
    """Edges from (or to) the nodes of ``frontier`` (id) whose other end exists; parallel edges all stay."""
    if direction == "in":
        edges = reverse(edges)
    found = edges.join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return found.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").withColumn("direction", F.lit(direction))


def both_neighbors(edges: DataFrame, frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    return neighbors(edges, frontier, nodes, "out").unionByName(neighbors(edges, frontier, nodes, "in"))


def degrees(edges: DataFrame, direction: str = "out") -> DataFrame:
    return edges.groupBy(F.col("src" if direction == "out" else "dst").alias("id")).agg(F.count("*").alias("degree"))


def reachable(seeds: DataFrame, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The edges of all nodes that ``seeds`` (id) lead to. ``edges_of``: those that leave the nodes given; each node is asked for once."""
    new = cut(seeds.select("id").distinct())
    seen, out = new, None
    while True:
        found = written(edges_of(checked_broadcast(new)))
        out = found if out is None else out.unionByName(found)
        new = cut(found.select(F.col("dst").alias("id")).na.drop().distinct().join(checked_broadcast(seen), "id", "left_anti"))
        if new.isEmpty():
            return out
        seen = cut(seen.unionByName(new))


def edge_provenance(edges: DataFrame, provenance: DataFrame, collections: tuple[str, ...] = ()) -> DataFrame:
    """edge_id, sources: the inline ones and those of either end, each once. Ends are exploded: no join on OR."""
    if collections:
        provenance = provenance.filter(F.split("dst", "/")[0].isin(*collections))
    ends = edges.select("edge_id", "inline_sources", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"))
    found = ends.join(provenance.select(F.col("src").alias("end"), F.col("dst").alias("document")), "end", "left")
    grouped = found.groupBy("edge_id").agg(F.first("inline_sources").alias("inline"), F.collect_set("document").alias("via"))
    return grouped.select("edge_id", F.array_sort(F.array_union("inline", "via")).alias("sources"))


def overlay(edges: DataFrame, soft: DataFrame, community: str) -> DataFrame:
    """``edges`` and the soft edges (src, rel, dst, weight, position), which get ids of their own."""
    key = F.concat(F.lit("overlay/"), F.sha2(F.concat(F.lit(f'["{community}", "'), F.col("src"), F.lit('", '), F.col("position").cast("string"), F.lit("]")), 256))
    return edges.select("edge_id", "src", "rel", "dst", "weight").unionByName(soft.select(key.alias("edge_id"), "src", "rel", "dst", "weight"))


def training_snapshot(edges: DataFrame, nodes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """src, rel, dst of edges whose ends both exist, and a has_type triple for each typed node; a bag.

    ``ends`` (id): what ``edges`` name, if it is at hand; then only names without a node are set against edges, which are few as a rule.
    """
    ids, known = nodes.select("id"), edges.select("src", "rel", "dst")
    if ends is None:
        known = known.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    else:
        missing = checked_broadcast(cut(ends.join(ids, "id", "left_anti")), MOST_IDS)
        known = known.na.drop(subset=["src", "dst"]).join(missing.withColumnRenamed("id", "src"), "src", "left_anti").join(missing.withColumnRenamed("id", "dst"), "dst", "left_anti")
    known = known.select("src", "rel", "dst")
    return known.unionByName(nodes.filter(F.col("type").isNotNull()).select(F.col("id").alias("src"), F.lit("has_type").alias("rel"), F.col("type").alias("dst")))


def snapshot_hash(triples: DataFrame, parts: int = 256) -> DataFrame:
    """One row: the hash of the sorted triples. Buckets are hashed first, so no task holds them all."""
    row = F.concat_ws("\u001f", "src", "rel", "dst")
    counted = triples.groupBy(row.alias("row")).agg(F.count("*").alias("n"))
    bucket = counted.groupBy(F.pmod(F.xxhash64("row"), F.lit(parts)).alias("bucket")).agg(F.sha2(F.concat_ws("\u001e", F.sort_array(F.collect_list(F.concat_ws("\u001f", "row", "n")))), 256).alias("part"))
    return bucket.agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("bucket", "part"))), lambda x: x["part"])), 256).alias("snapshot"))


# Relations that say nothing, relations kept only between things, and labels of schema.
BANNED = (
    "is", "object", "value", "from", "to", "object type", "object value", "object ID", "relationship", "related to", "page", "table", "id", "chunkid", "imagemetadata",
)
CONDITIONAL = ("contains", "includes")
SCHEMA_LABELS = ("page", "table", "imagemetadata", "id", "chunkid", "object")


def keep_relation(rel: Column, src_label: Column, dst_label: Column) -> Column:
    """Whether a relation counts for motifs. "object ID" never matches a lower-case name, as in what this must agree with."""
    name = F.lower(F.trim(rel))
    structural = F.coalesce(F.lower(src_label).isin(*SCHEMA_LABELS), F.lit(False)) | F.coalesce(F.lower(dst_label).isin(*SCHEMA_LABELS), F.lit(False))
    return F.coalesce((rel != "") & ~name.isin(*BANNED) & ~(name.isin(*CONDITIONAL) & structural), F.lit(False))
