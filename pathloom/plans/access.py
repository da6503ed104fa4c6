"""Queries of graph access, filters and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EdgeFilter
from ..functions import scalars as S
from ..operators import aggregates, catalog, paths, ranking
from ..operators import graph as G
from ..sources import derived as D
from ..sources.shared import checked_broadcast
from .registry import query

SEEDS = ("Customer/1", "Customer/2")
FRONTIER = ("Customer/1", "Customer/2", "Order/1", "Order/2", "Nation/3")
ROW = ["edge_id", "src", "rel", "dst", "weight"]


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def plain(name, tables, body, f):
    query(name, tables, body)(f)


IN_FRONTIER = "('Customer/1', 'Customer/2', 'Order/1', 'Order/2', 'Nation/3')"

plain("nodes_all", "nodes", "SELECT id FROM nodes", lambda s, d: D.nodes(s, d).select("id"))
plain("nodes_by_property", "nodes", "SELECT id FROM nodes WHERE type = 'Supplier'", lambda s, d: D.nodes(s, d).filter(F.col("type") == "Supplier").select("id"))
plain("nodes_by_membership", "membership", "SELECT entity FROM membership WHERE community = 'EUROPE' AND algorithm = 'region'", lambda s, d: G.members(D.membership(s, d), "EUROPE", "region").select("entity"))
plain("neighbors_out", "edges nodes", f"SELECT edge_id, src, rel, dst, weight, 'out' AS direction FROM edges WHERE src IN {IN_FRONTIER} AND dst IN (SELECT id FROM nodes)", lambda s, d: G.neighbors(D.edges(s, d), ids(s, FRONTIER), D.nodes(s, d), "out").select(*ROW, "direction"))
plain("neighbors_in", "edges nodes", f"SELECT edge_id, dst AS src, rel, src AS dst, weight, 'in' AS direction FROM edges WHERE dst IN {IN_FRONTIER} AND src IN (SELECT id FROM nodes)", lambda s, d: G.neighbors(D.edges(s, d), ids(s, FRONTIER), D.nodes(s, d), "in").select(*ROW, "direction"))
plain("get_neighbors", "edges nodes", f"SELECT edge_id, src, rel, dst, weight, 'out' AS direction FROM edges WHERE src = 'Nation/3' AND dst IN (SELECT id FROM nodes) UNION ALL SELECT edge_id, dst, rel, src, weight, 'in' FROM edges WHERE dst = 'Nation/3' AND src IN (SELECT id FROM nodes)", lambda s, d: G.both_neighbors(D.edges(s, d), ids(s, ["Nation/3"]), D.nodes(s, d)).select(*ROW, "direction"))
plain("get_node", "nodes", "SELECT id, label FROM nodes WHERE id = 'Supplier/1'", lambda s, d: D.nodes(s, d).filter(F.col("id") == "Supplier/1").select("id", "label"))
plain("kg_accessor_out", "edges membership", "SELECT DISTINCT src, rel, dst, 1.0::DOUBLE AS weight FROM edges WHERE dst IN (SELECT entity FROM membership WHERE community = 'ASIA')", lambda s, d: D.facts(s, d).join(G.members(D.membership(s, d), "ASIA").select(F.col("entity").alias("dst")), "dst", "left_semi").select("src", "rel", "dst", F.lit(1.0).alias("weight")))
plain("edge_ids", "edges", """SELECT src, rel, dst, 'kg/' || sha256('["' || src || '", "' || rel || '", "' || dst || '"]') AS id FROM edges WHERE rel IN ('part_of', 'neighbors')""", lambda s, d: D.edges(s, d).filter(F.col("rel").isin("part_of", "neighbors")).select("src", "rel", "dst", S.edge_hash(F.col("src"), F.col("rel"), F.col("dst")).alias("id")))
plain("weight_default", "edges", "SELECT edge_id, coalesce(CASE WHEN rel = 'contains' THEN NULL ELSE weight END, 1.0) AS weight FROM edges", lambda s, d: D.edges(s, d).select("edge_id", F.coalesce(F.when(F.col("rel") != "contains", F.col("weight")), F.lit(1.0)).alias("weight")))
plain("training_snapshot", "edges nodes", "SELECT src, rel, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) UNION ALL SELECT id, 'has_type', type FROM nodes WHERE type IS NOT NULL", lambda s, d: G.training_snapshot(D.edges(s, d), D.nodes(s, d), D.entities(s, d)))
plain("schema_edge_collections", "edges", "SELECT DISTINCT rel, split_part(src, '/', 1) AS from_kind, split_part(dst, '/', 1) AS to_kind FROM edges", lambda s, d: catalog.edge_collections(D.edges(s, d)))
plain("kg_roundtrip", "edges", "SELECT DISTINCT src, rel, dst FROM edges", lambda s, d: D.edges(s, d).select(F.to_json(F.struct("src", "rel", "dst")).alias("j")).distinct().select(F.from_json("j", "src string, rel string, dst string").alias("t")).select("t.*"))
plain("top_entities_by_degree", "edges", "SELECT src AS id, count(*) AS degree FROM edges WHERE created_at BETWEEN '1998-01-01' AND '1998-12-31' GROUP BY src ORDER BY degree DESC, id LIMIT 25", lambda s, d: catalog.top_by_degree(D.edges(s, d), 25, D.WINDOW))
plain("entity_type_counts", "nodes", "SELECT type, count(*) AS count FROM nodes GROUP BY type", lambda s, d: catalog.type_counts(D.nodes(s, d)))
plain("relationship_type_counts", "edges", "SELECT rel, count(*) AS count FROM edges WHERE rel IS NOT NULL GROUP BY rel", lambda s, d: catalog.relation_counts(D.edges(s, d)))
plain("community_summaries", "communities", "SELECT * FROM communities WHERE coalesce(trim(summary), '') <> '' ORDER BY community_id LIMIT 2 OFFSET 1", lambda s, d: catalog.community_summaries(D.communities(s, d), 2, 1, True))
plain("unique_headers", None, "SELECT DISTINCT role || ',' || (turn % 3) AS headers FROM conversations", lambda s, d: D.read(s, d, "conversations").select(F.array("role", (F.col("turn") % 3).cast("string")).alias("headers")).distinct().select(F.concat_ws(",", "headers").alias("headers")))
plain("top_entities_in_community", "edges membership", "SELECT src AS id, count(*) AS degree FROM edges WHERE src IN (SELECT entity FROM membership WHERE community = 'EUROPE') GROUP BY src ORDER BY degree DESC, id LIMIT 20", lambda s, d: catalog.top_in_community(D.edges(s, d), G.members(D.membership(s, d), "EUROPE"), 20))
plain("recent_entities", "nodes", "SELECT id, epoch_us(coalesce(created_at, updated_at)) AS seen_at FROM nodes WHERE created_at >= '2001-06-01' OR updated_at >= '2001-06-01'", lambda s, d: catalog.recent_entities(D.nodes(s, d), "2001-06-01").select("id", F.unix_micros("seen_at").alias("seen_at")))
plain("search_entities", "nodes", "SELECT id, CASE WHEN lower(label) LIKE '%000_1%' AND lower(type) LIKE '%000_1%' THEN 'label,type' WHEN lower(label) LIKE '%000_1%' THEN 'label' ELSE 'type' END AS matched FROM nodes WHERE lower(label) LIKE '%000_1%' OR lower(type) LIKE '%000_1%'", lambda s, d: catalog.search(D.nodes(s, d), ["label", "type"], "000_1").select("id", F.concat_ws(",", "matched").alias("matched")))


def _content(s, d):
    return {"documents": (D.read(s, d, "documents"), "doc_id", ["text"]), "pages": (D.read(s, d, "pages"), "page_id", ["html", "url"]), "conversations": (D.read(s, d, "conversations"), "conv_id", ["text"])}


plain(
    "search_content", None,
    """SELECT 'documents' AS source_type, CAST(doc_id AS VARCHAR) AS id, 'text' AS matched FROM documents WHERE lower(text) LIKE '%the%in%'
       UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), concat_ws(',', CASE WHEN lower(html) LIKE '%the%in%' THEN 'html' END, CASE WHEN lower(url) LIKE '%the%in%' THEN 'url' END) FROM pages WHERE lower(html) LIKE '%the%in%' OR lower(url) LIKE '%the%in%'
       UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR), 'text' FROM conversations WHERE lower(text) LIKE '%the%in%'""",
    lambda s, d: catalog.search_content(_content(s, d), "The%in").select("source_type", "id", F.concat_ws(",", "matched").alias("matched")),
)
plain("get_document_content", None, "SELECT 'documents/7' AS id, text AS content FROM documents WHERE doc_id = 7", lambda s, d: catalog.document_content({"documents": (D.read(s, d, "documents"), "doc_id", "text")}, "documents/7"))
plain("entity_sources", "provenance", "SELECT DISTINCT dst AS id FROM provenance WHERE src = 'Order/5' AND dst IN (SELECT 'Document/' || doc_id FROM documents)", lambda s, d: catalog.entity_sources(D.provenance(s, d), D.read(s, d, "documents").select(F.concat(F.lit("Document/"), F.col("doc_id").cast("string")).alias("id")), "Order/5"))


def _inlined(s, d):
    return D.edges(s, d).filter(F.col("rel").isin("placed", "fulfilled_by")).withColumn("inline_sources", F.when(F.col("rel") == "placed", F.array(F.concat(F.lit("Ledger/"), F.col("dst")))).otherwise(F.array().cast("array<string>")))


plain(
    "edge_provenance", "edges provenance",
    """WITH e AS (SELECT edge_id, src, dst, CASE WHEN rel = 'placed' THEN 'Ledger/' || dst END AS inline FROM edges WHERE rel IN ('placed', 'fulfilled_by')),
       a AS (SELECT edge_id, inline AS source FROM e UNION SELECT edge_id, p.dst FROM e JOIN provenance p ON p.src = e.src UNION SELECT edge_id, p.dst FROM e JOIN provenance p ON p.src = e.dst)
       SELECT edge_id, string_agg(source, ',' ORDER BY source) AS sources FROM a WHERE source IS NOT NULL GROUP BY edge_id""",
    lambda s, d: G.edge_provenance(_inlined(s, d), D.provenance(s, d)).filter(F.size("sources") > 0).select("edge_id", F.concat_ws(",", "sources").alias("sources")),
)


def _overlay(s, d):
    soft = D.edges(s, d).filter(F.col("rel") == "neighbors").select("src", F.lit("soft").alias("rel"), "dst", F.lit(0.25).alias("weight"), F.lit(0).alias("position"))
    return G.overlay(D.edges(s, d).filter(F.col("rel") == "part_of"), soft, "global").select("edge_id", "src", "rel", "dst", "weight")


plain("overlay_union", "edges", """SELECT edge_id, src, rel, dst, weight FROM edges WHERE rel = 'part_of' UNION ALL SELECT 'overlay/' || sha256('["global", "' || src || '", 0]'), src, 'soft', dst, 0.25 FROM edges WHERE rel = 'neighbors'""", _overlay)
plain("out_degree", "edges", "SELECT src AS id, count(*) AS degree FROM edges GROUP BY src", lambda s, d: G.degrees(D.edges(s, d)))
plain("in_degree", "edges", "SELECT dst AS id, count(*) AS degree FROM edges GROUP BY dst", lambda s, d: G.degrees(D.edges(s, d), "in"))


# -- filters


def _filtered(name, where, rule, validity=False):
    def run(s, d):
        e = D.edges(s, d)
        if validity:
            e = e.withColumns({"valid_from": F.col("created_at"), "valid_to": F.when(F.col("status") == "F", F.col("created_at") + F.expr("INTERVAL 90 DAYS"))})
        nodes = D.nodes(s, d) if rule.neighbor_types or rule.community_mode == "property" else None
        membership = D.membership(s, d) if rule.community_mode == "mapping" else None
        return G.filter_edges(e, rule, nodes, membership).select("edge_id", "src", "rel", "dst")

    query(name, "edges nodes membership", f"SELECT edge_id, src, rel, dst FROM edges WHERE {where}")(run)


_filtered("filter_community_property", "dst IN (SELECT id FROM nodes WHERE type = 'Supplier')", EdgeFilter(community="Supplier", community_mode="property", community_property="type"))
_filtered("filter_community_membership", "dst IN (SELECT entity FROM membership WHERE community = 'ASIA' AND algorithm = 'region')", EdgeFilter(community="ASIA", community_mode="mapping", algorithm="region"))
_filtered("filter_allowed_rel", "rel IN ('placed', 'part_of')", EdgeFilter(allowed_relations=("placed", "part_of")))
_filtered("filter_denied_rel", "coalesce(rel NOT IN ('contains', 'placed'), TRUE)", EdgeFilter(denied_relations=("contains", "placed")))
_filtered("filter_neighbor_type", "dst IN (SELECT id FROM nodes WHERE type IN ('Nation', 'Region'))", EdgeFilter(neighbor_types=("Nation", "Region")))
_filtered("filter_time_window", "created_at BETWEEN '1998-01-01' AND '1998-12-31'", EdgeFilter(time_window=D.WINDOW))
_filtered("filter_as_of", "(created_at IS NULL OR created_at <= '1999-01-01') AND (status IS DISTINCT FROM 'F' OR created_at IS NULL OR created_at + INTERVAL 90 DAY >= '1999-01-01')", EdgeFilter(as_of=D.AS_OF, current_only=True), validity=True)
_filtered("filter_status", "status IN ('O', 'P')", EdgeFilter(statuses=("O", "P")))


def _labelled(s, d):
    """Labels are asked for only of nodes of schema; others tell nothing."""
    of = checked_broadcast(D.nodes(s, d).select("id", F.lower("type").alias("label")).filter(F.col("label").isin(*G.SCHEMA_LABELS)).dropDuplicates(["id"]))
    return D.edges(s, d).filter(F.col("rel") != "supplied_by").join(of.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src", "left").join(of.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst", "left")


plain(
    "keep_relation", "edges nodes",
    """SELECT rel, split_part(src, '/', 1) AS from_kind, CAST(count(*) FILTER (WHERE rel <> 'view') AS BIGINT) AS kept, count(*) AS every FROM edges WHERE rel <> 'supplied_by' GROUP BY 1, 2""",
    lambda s, d: _labelled(s, d).withColumn("name", F.when(F.col("rel") == "view", F.lit(" Page ")).otherwise(F.col("rel"))).groupBy("rel", F.split("src", "/")[0].alias("from_kind")).agg(F.sum(G.keep_relation(F.col("name"), F.col("src_label"), F.col("dst_label")).cast("long")).alias("kept"), F.count("*").alias("every")),
)
plain(
    "beam_filtered", "edges",
    "SELECT edge_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY edge_id, dst) AS k FROM edges WHERE rel IN ('contains', 'fulfilled_by')) WHERE k <= 3",
    lambda s, d: _capped(D.edges(s, d).filter(F.col("rel").isin("contains", "fulfilled_by")), 3),
)


def _capped(edges, n):
    from pyspark.sql import Window as W

    return edges.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy("edge_id", "dst"))).filter(F.col("k") <= n).select("edge_id", "src", "dst")


def _normalize(s, d):
    from ..operators.paths import normalized_edges

    e = D.edges(s, d).filter(F.col("rel").isin("part_of", "located_in"))
    e = e.select(F.when(F.col("rel") == "part_of", F.col("edge_id")).alias("edge_id"), "src", "dst", F.when(F.col("rel") == "part_of", F.col("rel")).alias("rel"), F.when(F.col("rel") != "part_of", F.col("rel")).alias("relationship"))
    return normalized_edges(e, D.nodes(s, d)).select("edge_id", "relation", "src_label", "dst_label")


plain(
    "normalize_edges", "edges nodes",
    """SELECT CASE WHEN rel = 'part_of' THEN edge_id ELSE concat_ws('|', src, rel, dst) END AS edge_id, rel AS relation, a.label AS src_label, b.label AS dst_label
       FROM edges LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst WHERE rel IN ('part_of', 'located_in')""",
    _normalize,
)
plain("persistable_links", "confidences", "SELECT src, rel, dst, raw AS confidence FROM confidences WHERE raw >= 0.8 AND src LIKE '%/%' AND dst LIKE '%/%' AND trim(rel) <> ''", lambda s, d: __import__("pathloom.sources.sinks", fromlist=["x"]).persistable(D.confidences(D.facts(s, d)).withColumnRenamed("raw", "confidence")).select("src", "rel", "dst", "confidence"))


# -- joins and signals

plain("bridge_factor", "nodes bridges", "SELECT id, round(CASE WHEN strength > 0 THEN 1 + ln(1 + strength) * 0.1 * 1.5 ELSE 1.0 END, 9) AS factor FROM nodes LEFT JOIN bridges ON entity = id WHERE type IN ('Supplier', 'Nation')", lambda s, d: D.nodes(s, d).filter(F.col("type").isin("Supplier", "Nation")).join(D.bridges(s, d).withColumnRenamed("entity", "id"), "id", "left").select("id", F.round(S.bridge_factor(F.coalesce("strength", F.lit(0.0))), 9).alias("factor")))


def _pairs(s, d):
    from ..operators.scoring import symmetric_affinity

    r = D.read(s, d, "region").select("r_name")
    pairs = r.select(F.col("r_name").alias("a")).join(r.select(F.col("r_name").alias("b")), F.col("a") <= F.concat("b", F.lit("~")))
    return symmetric_affinity(pairs, D.affinities(s, d))


AFFINE = "SELECT a.r_name AS a, b.r_name AS b, coalesce(score, 0.0) AS s FROM region a JOIN region b ON a.r_name <= b.r_name || '~' LEFT JOIN affinities ON from_c = least(a.r_name, b.r_name) AND to_c = greatest(a.r_name, b.r_name)"
plain("affinity_lookup", "affinities", f"SELECT a, b, round(s, 9) AS affinity FROM ({AFFINE})", lambda s, d: _pairs(s, d).select("a", "b", F.round("affinity", 9).alias("affinity")))
plain("affinity_factor", "affinities", f"SELECT a, b, round(CASE WHEN s > 0 AND a <> b THEN 1 + s * 1.5 ELSE 1.0 END, 9) AS factor FROM ({AFFINE})", lambda s, d: _pairs(s, d).select("a", "b", F.round(F.when(F.col("a") != F.col("b"), S.affinity_factor(F.col("affinity"))).otherwise(1.0), 9).alias("factor")))
plain("membership_ambiguity", "membership", "SELECT entity, count(DISTINCT community) AS communities FROM (SELECT * FROM membership UNION ALL SELECT entity, 'OTHER', algorithm FROM membership WHERE entity LIKE 'Nation/1%') GROUP BY entity HAVING count(DISTINCT community) > 1", lambda s, d: D.membership(s, d).unionByName(D.membership(s, d).filter(F.col("entity").like("Nation/1%")).withColumn("community", F.lit("OTHER"))).groupBy("entity").agg(F.count_distinct("community").alias("communities")).filter("communities > 1"))
plain("bridges_from_community", "bridges", "SELECT entity, strength FROM bridges WHERE community = 'ASIA' AND strength >= 1", lambda s, d: D.bridges(s, d).filter((F.col("community") == "ASIA") & (F.col("strength") >= 1)).select("entity", "strength"))
plain("top_bridges", "bridges", "SELECT entity, strength FROM bridges ORDER BY strength DESC, entity LIMIT 10", lambda s, d: D.bridges(s, d).orderBy(F.col("strength").desc(), "entity").limit(10).select("entity", "strength"))
plain("strongest_affinities", "affinities", "SELECT from_c, to_c, round(score, 9) AS score FROM affinities ORDER BY score DESC, from_c, to_c LIMIT 5", lambda s, d: D.affinities(s, d).orderBy(F.col("score").desc(), "from_c", "to_c").limit(5).select("from_c", "to_c", F.round("score", 9).alias("score")))


# -- weights and confidences


def _signals(s, d):
    return D.confidences(D.edges(s, d)).withColumns({"raw_confidence": F.col("raw"), "model_posterior": F.col("posterior"), "calibration": F.col("calib")})


def _weighted(s, d):
    priors = s.createDataFrame([("contains", 0.5), ("placed", 2.0)], "rel string, prior double")
    return G.effective_weight(_signals(s, d), priors, D.AS_OF, 30.0, True).select("edge_id", "src", "dst", F.round("effective_weight", 9).alias("effective_weight"))


DECAY = "coalesce(pow(2.0, -greatest(CAST(epoch(TIMESTAMP '1999-01-01') - floor(epoch(created_at)) AS DOUBLE) / 86400.0, 0) / 30.0), 1.0)"
FUSED = "coalesce(raw, 0.5) * coalesce(posterior, 0.5) * coalesce(calib, 0.5)"
plain("effective_weight", "edges confidences", f"SELECT edge_id, src, dst, round(weight * CASE rel WHEN 'contains' THEN 0.5 WHEN 'placed' THEN 2.0 ELSE 1.0 END * {DECAY} * {FUSED}, 9) AS effective_weight FROM edges JOIN confidences USING (src, rel, dst)", _weighted)
plain("fused_confidence", "confidences", f"SELECT src, rel, dst, round({FUSED}, 9) AS fused FROM confidences", lambda s, d: D.confidences(D.facts(s, d)).select("src", "rel", "dst", F.round(S.fused_confidence(F.col("raw"), F.col("posterior"), F.col("calib")), 9).alias("fused")))
plain(
    "combine_confidence", "confidences",
    """WITH l AS (SELECT src, rel, dst, CASE WHEN raw IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN posterior IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN calib IS NOT NULL THEN 0.1 ELSE 0 END AS w,
         coalesce(0.5 * ln(least(greatest(raw, 1e-6), 1 - 1e-6) / (1 - least(greatest(raw, 1e-6), 1 - 1e-6))), 0) + coalesce(0.4 * ln(least(greatest(posterior, 1e-6), 1 - 1e-6) / (1 - least(greatest(posterior, 1e-6), 1 - 1e-6))), 0)
         + coalesce(0.1 * ln(least(greatest(calib, 1e-6), 1 - 1e-6) / (1 - least(greatest(calib, 1e-6), 1 - 1e-6))), 0) AS t FROM confidences)
       SELECT src, rel, dst, CASE WHEN w > 0 THEN round(1 / (1 + exp(-t / w)), 9) END AS confidence FROM l""",
    lambda s, d: D.confidences(D.facts(s, d)).select("src", "rel", "dst", F.round(S.combine_confidence(F.col("raw"), F.col("posterior"), F.col("calib")), 9).alias("confidence")),
)
plain("confidence_constant", "edges", "SELECT DISTINCT src, rel, dst, 0.8::DOUBLE AS confidence FROM edges", lambda s, d: paths.default_confidence(D.facts(s, d)))
plain("transition_probs", "edges", "SELECT src, dst, round(sum(greatest(weight, 0)) / max(t), 9) AS share FROM edges JOIN (SELECT src, sum(greatest(weight, 0)) AS t FROM edges GROUP BY src) USING (src) GROUP BY src, dst", lambda s, d: ranking.weighted_transition(D.edges(s, d)).select("src", "dst", F.round("share", 9).alias("share")))
plain(
    "triad_closure", "edges",
    """WITH p AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND rel IN ('contains', 'supplied_by', 'fulfilled_by', 'neighbors')),
       w AS (SELECT a.src AS u, b.dst AS w FROM p a JOIN p b ON a.dst = b.src WHERE a.src <> b.dst)
       SELECT CAST(count(*) AS BIGINT) AS wedges, CAST(count(p.src) AS BIGINT) AS triads, round(count(p.src)::DOUBLE / count(*), 9) AS closure FROM w LEFT JOIN p ON p.src = w.u AND p.dst = w.w""",
    lambda s, d: aggregates.wedges_and_triads(D.edges(s, d), ("contains", "supplied_by", "fulfilled_by", "neighbors"), D.coding(s, d)).select(F.col("wedges").cast("long").alias("wedges"), F.col("triads").cast("long").alias("triads"), F.round("closure", 9).alias("closure")),
)
