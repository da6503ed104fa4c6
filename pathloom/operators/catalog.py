"""Discovery, search and hydration of entities and documents; schema introspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_by_degree(edges: DataFrame, n: int, window: tuple[str, str] | None = None) -> DataFrame:
    if window:
        edges = edges.filter(F.col("created_at").between(*[F.to_timestamp(F.lit(t)) for t in window]))
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "id").limit(n)


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("count"))


def relation_counts(edges: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    if window:
        edges = edges.filter(F.col("created_at").between(*[F.to_timestamp(F.lit(t)) for t in window]))
    return edges.filter(F.col("rel").isNotNull()).groupBy("rel").agg(F.count("*").alias("count"))


def community_summaries(communities: DataFrame, n: int, skip: int = 0, require_summary: bool | None = None) -> DataFrame:
    has = F.coalesce(F.trim("summary") != "", F.lit(False))
    if require_summary is not None:
        communities = communities.filter(has if require_summary else ~has)
    return communities.orderBy("community_id").offset(skip).limit(n)


def top_in_community(edges: DataFrame, inside: DataFrame, n: int) -> DataFrame:
    """``inside``: entity."""
    return top_by_degree(edges.join(inside.select(F.col("entity").alias("src")), "src", "left_semi"), n)


def recent_entities(nodes: DataFrame, since: str, n: int | None = None) -> DataFrame:
    at = F.to_timestamp(F.lit(since))
    out = nodes.filter((F.col("created_at") >= at) | (F.col("updated_at") >= at)).withColumn("seen_at", F.coalesce("created_at", "updated_at"))
    return out if n is None else out.orderBy(F.col("seen_at").desc(), "id").limit(n)


def matched_fields(fields: list[str], query: str) -> Column:
    """Names of the fields that hold the text, whatever its case; % and _ are wildcards."""
    pattern = "%" + query.lower().replace("\\", "\\\\") + "%"
    return F.array_compact(F.array(*[F.when(F.lower(F.col(f).cast("string")).like(pattern), F.lit(f)) for f in fields]))


def search(rows: DataFrame, fields: list[str], query: str, key: str = "id") -> DataFrame:
    return rows.withColumn("matched", matched_fields(fields, query)).filter(F.size("matched") > 0).select(key, "matched")


def search_content(tables: dict[str, tuple[DataFrame, str, list[str]]], query: str) -> DataFrame:
    """source_type, id, matched over several tables: name to (rows, key, fields)."""
    out = None
    for name, (rows, key, fields) in tables.items():
        found = search(rows, fields, query, key).select(F.lit(name).alias("source_type"), F.col(key).cast("string").alias("id"), "matched")
        out = found if out is None else out.unionByName(found)
    return out


def document_content(tables: dict[str, tuple[DataFrame, str, str]], doc_id: str) -> DataFrame | None:
    """id, content of ``collection/key``; None for an unknown collection. Tables: name to (rows, key, text)."""
    name, _, key = doc_id.partition("/")
    if name not in tables:
        return None
    rows, id_column, text = tables[name]
    return rows.filter(F.col(id_column).cast("string") == key).select(F.lit(doc_id).alias("id"), F.col(text).alias("content"))


def entity_sources(provenance: DataFrame, documents: DataFrame, entity: str) -> DataFrame:
    """document ids of an entity that exist. ``documents``: id."""
    return provenance.filter(F.col("src") == entity).join(documents.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id")).distinct()


def edge_collections(edges: DataFrame) -> DataFrame:
    """Kinds of ends of each relation."""
    return edges.select("rel", F.split("src", "/")[0].alias("from_kind"), F.split("dst", "/")[0].alias("to_kind")).distinct()


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes
