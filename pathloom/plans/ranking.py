"""Queries of node ranking, beam search, path scores and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BeamParams
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import linking, paths, ranking, scoring

from ..sources import derived as D
from .access import SEEDS, ids, plain

ALPHA = 0.15
START = "start AS (SELECT 'Customer/1' AS id, 0.5::DOUBLE AS mass UNION ALL SELECT 'Customer/2', 0.5)"
UNIFORM = "t AS (SELECT src, dst, count(*)::DOUBLE / max(d) AS share FROM edges JOIN (SELECT src, count(*) AS d FROM edges GROUP BY src) USING (src) GROUP BY src, dst)"
WEIGHTED = "t AS (SELECT src, dst, sum(greatest(weight, 0)) / max(w) AS share FROM edges JOIN (SELECT src, sum(greatest(weight, 0)) AS w FROM edges GROUP BY src) USING (src) GROUP BY src, dst)"


def start(s):
    return ranking.personalization(ids(s, SEEDS))


def rounded(df, *names, places=9):
    return df.withColumns({n: F.round(n, places) for n in names})


def power_sql(steps):
    parts = [f"r{k + 1} AS (SELECT dst AS id, sum(mass * share) * {1 - ALPHA} AS mass FROM r{k} JOIN t ON src = id GROUP BY dst)" for k in range(steps - 1)]
    union = " UNION ALL ".join(f"SELECT id, mass * {ALPHA} AS m FROM r{k}" for k in range(steps))
    return ", ".join([START, UNIFORM, "r0 AS (SELECT * FROM start)", *parts, f"ppr AS (SELECT id, round(sum(m), 9) AS score FROM ({union}) GROUP BY id)"])


@D.stored()
def reached(s, d):
    """The edges of all nodes that walks from the seeds can reach, found hop by hop; a step from them needs no others."""
    return G.reachable(ids(s, SEEDS), lambda of: D.edges(s, d, of))


@D.stored()
def uniform(s, d):
    return ranking.adjacency(reached(s, d))


@D.stored()
def weighted(s, d):
    return ranking.adjacency(reached(s, d), weighted=True)


def ppr(s, d, steps=5):
    return rounded(ranking.power_ppr(start(s), uniform(s, d), ALPHA, steps), "score")


plain("personalization", None, "SELECT id, mass / sum(mass) OVER () AS mass FROM (SELECT 'Customer/1' AS id, 2.0::DOUBLE AS mass UNION ALL SELECT 'Customer/2', 1.0 + 1.0)", lambda s, d: ranking.personalization(ids(s, ["Customer/1", "Customer/2", "Customer/1"]), s.createDataFrame([("Customer/2", 1.0)], "id string, mass double")))
plain("ppr_power_k", "edges", f"WITH {power_sql(5)} SELECT id, score FROM ppr", ppr)


def _walks_sql(steps):
    out = [START, WEIGHTED, "x0 AS (SELECT * FROM start)"]
    for k in range(steps - 1):
        out.append(f"x{k + 1} AS (SELECT id, sum(mass) AS mass FROM (SELECT id, {ALPHA} * mass * (SELECT sum(mass) FROM x{k}) AS mass FROM start UNION ALL SELECT dst, {1 - ALPHA} * x.mass * share FROM x{k} x JOIN t ON src = x.id) GROUP BY id)")
    union = " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(steps))
    return ", ".join([*out, f"v AS (SELECT id, sum(mass) AS mass FROM ({union}) GROUP BY id)"])


def expected(s, d, steps=5):
    return ranking.expected_walks(start(s), weighted(s, d), ALPHA, steps)


plain("mc_ppr_expected", "edges", f"WITH {_walks_sql(5)} SELECT id, round(mass / (SELECT sum(mass) FROM v), 9) AS score FROM v", lambda s, d: rounded(expected(s, d), "score"))


def push(s, d):
    return ranking.push_ppr(start(s), reached(s, d), ALPHA, 1e-4, None, uniform(s, d))


#: Rounds that the SQL of pushes unrolls. Those after the last hot node change nothing; at sf0.1 it takes 13.
UNROLLED = 40


def _push_sql(name, start_sql, eps, rounds, edges="edges"):
    """CTEs that end in {name}(id, score): pushes of ``rounds`` rounds over ``edges`` (src, dst)."""
    out = [f"{name}_d AS MATERIALIZED (SELECT src, count(*)::DOUBLE AS d FROM {edges} GROUP BY src)", f"{name}_r0 AS MATERIALIZED (SELECT id, mass, TRUE AS hot FROM {start_sql})"]
    for k in range(rounds):
        sent = f"SELECT e.dst AS id, r.mass / d * {1 - ALPHA} AS mass FROM {name}_r{k} r JOIN {name}_d ON src = r.id JOIN {edges} e ON e.src = r.id WHERE hot"
        out.append(f"{name}_r{k + 1} AS MATERIALIZED (SELECT id, mass, mass / greatest(coalesce(d, 1), 1) > {eps} AS hot FROM (SELECT id, sum(mass) AS mass FROM ({sent} UNION ALL SELECT id, mass FROM {name}_r{k} WHERE NOT hot) GROUP BY id) LEFT JOIN {name}_d ON src = id)")
    kept = " UNION ALL ".join(f"SELECT id, mass * {ALPHA} AS m FROM {name}_r{k} WHERE hot" for k in range(rounds))
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT id, sum(m) AS score FROM ({kept}) GROUP BY id)"])


def _visits_sql(steps):
    """CTEs that end in v(id, mass): visits of restarting walks, as in ``_walks_sql`` but for many steps."""
    out = [WEIGHTED.replace("t AS (", "t AS MATERIALIZED ("), "x0 AS MATERIALIZED (SELECT * FROM start)"]
    for k in range(steps - 1):
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT id, sum(mass) AS mass FROM (SELECT id, {ALPHA} * mass * (SELECT sum(mass) FROM x{k}) AS mass FROM start UNION ALL SELECT dst, {1 - ALPHA} * x.mass * share FROM x{k} x JOIN t ON src = x.id) GROUP BY id)")
    union = " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(steps))
    return ", ".join([*out, f"v AS MATERIALIZED (SELECT id, sum(mass) / (SELECT sum(mass) FROM ({union})) AS score FROM ({union}) GROUP BY id)"])


PUSH = _push_sql("pushed", "start", 1e-4, UNROLLED)
plain("push_ppr", "edges", f"WITH {START}, {PUSH} SELECT id, round(score, 9) AS score FROM pushed", lambda s, d: rounded(push(s, d), "score"))
plain(
    "mixed_ppr", "edges",
    f"""WITH {START}, {PUSH}, {_visits_sql(40)}, m AS (SELECT greatest(1 - greatest(sum(score), 1e-12), 0) AS rest FROM pushed),
        b AS (SELECT id, sum(score) AS score FROM (SELECT id, score FROM pushed UNION ALL SELECT id, score * rest FROM v, m) GROUP BY id), n AS (SELECT id, score / (SELECT sum(score) FROM b) AS score FROM b)
        SELECT id, round(score, 9) AS score FROM n ORDER BY round(score, 12) DESC, id LIMIT 200""",
    lambda s, d: rounded(ranking.mix(push(s, d), expected(s, d, 40), 200), "score"),
)
plain("find_anchors", "edges", f"WITH {START}, {PUSH} SELECT id, round(score, 9) AS score FROM pushed ORDER BY round(score, 12) DESC, id LIMIT 20", lambda s, d: rounded(ranking.top(push(s, d), 20), "score"))
TARGETS = ("Nation/1", "Nation/2", "Region/1")


def _hits_sql(steps):
    out = ["y0 AS MATERIALIZED (SELECT * FROM start)"]
    out += [f"y{k + 1} AS MATERIALIZED (SELECT dst AS id, sum(mass * share) * {1 - ALPHA} AS mass FROM y{k} JOIN t ON src = id GROUP BY dst)" for k in range(steps - 1)]
    return ", ".join([*out, f"hits AS (SELECT id, sum(mass) AS mass FROM ({' UNION ALL '.join(f'SELECT * FROM y{k}' for k in range(steps))}) GROUP BY id)"])


plain(
    "bippr", "edges",
    f"""WITH {START}, {UNIFORM.replace("t AS (", "t AS MATERIALIZED (")}, targets AS (SELECT unnest({list(TARGETS)}) AS id), back_start AS (SELECT id, 1.0::DOUBLE / 3 AS mass FROM targets), turned AS MATERIALIZED (SELECT dst AS src, src AS dst FROM edges),
        {_push_sql("back", "back_start", 1e-4, 10, "turned")}, {_hits_sql(10)}, b AS (SELECT id, coalesce(score, 0) * coalesce(mass, 0) AS score FROM targets LEFT JOIN back USING (id) LEFT JOIN hits USING (id))
        SELECT id, round(CASE WHEN (SELECT sum(score) FROM b) > 0 THEN score / (SELECT sum(score) FROM b) ELSE 0 END, 9) AS score FROM b""",
    lambda s, d: rounded(ranking.bippr(start(s), ids(s, TARGETS), D.edges(s, d), ALPHA, transition=uniform(s, d)), "score"),
)
plain("walk_index_hits", None, None, lambda s, d: ranking.walk_hits(ranking.sampled_walks(ids(s, SEEDS), reached(s, d), 10, 6)))


def _pagerank_sql(steps):
    out = ["i AS (SELECT DISTINCT id FROM nodes)", "e AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i))"]
    out += ["t AS (SELECT src, dst, count(*)::DOUBLE / max(d) AS share FROM e JOIN (SELECT src, count(*) AS d FROM e GROUP BY src) USING (src) GROUP BY src, dst)", "n AS (SELECT count(*)::DOUBLE AS n FROM i)"]
    out.append("x0 AS (SELECT id, 1.0 / (SELECT n FROM n) AS mass FROM i)")
    a, b = ALPHA, 1 - ALPHA
    for k in range(steps):
        lost = f"(SELECT coalesce(sum(mass), 0) * {b} FROM x{k} WHERE id NOT IN (SELECT src FROM t))"
        moved = f"(SELECT dst AS id, sum(mass * share) * {b} AS moved FROM x{k} JOIN t ON src = id GROUP BY dst)"
        out.append(f"z{k} AS (SELECT id, {a} / n + {b} * ({a} * mass + coalesce(moved, 0) + {lost} / n - {a} / n) AS z FROM x{k} LEFT JOIN {moved} USING (id), n)")
        out.append(f"x{k + 1} AS (SELECT id, z / (SELECT sum(z) FROM z{k}) AS mass FROM z{k})")
    return ", ".join(out) + f" SELECT id, round(mass, 9) AS score FROM x{steps}"


plain("global_pagerank", "edges nodes", f"WITH {_pagerank_sql(10)}", lambda s, d: rounded(ranking.global_pagerank(D.nodes(s, d), D.edges(s, d), ALPHA, 10, None), "score"))
plain(
    "khop_path_mass", "edges",
    f"WITH {START}, {UNIFORM}, r1 AS (SELECT dst AS id, sum(mass * share) * 0.85 AS mass FROM start JOIN t ON src = id GROUP BY dst), r2 AS (SELECT dst AS id, sum(mass * share) * 0.85 AS mass FROM r1 JOIN t ON src = id GROUP BY dst), r3 AS (SELECT dst AS id, sum(mass * share) * 0.85 AS mass FROM r2 JOIN t ON src = id GROUP BY dst) SELECT id, round(sum(mass), 9) AS mass FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY id",
    lambda s, d: _khop(s, d),
)


def _khop(s, d):
    return rounded(ranking._summed(ranking.steps_of(start(s), uniform(s, d), ALPHA, 4)[1:]), "mass")


# -- beam search

RANKS = "ranks AS (SELECT id, score FROM ppr ORDER BY score DESC, id LIMIT 200)"
WIDTH, MOST = 64, 50


def _beam_sql(hops=3):
    # a hop's ties go by nodes, then by edge ids, as in the operator
    out = [power_sql(5), RANKS, "h0 AS (SELECT 0.0::DOUBLE AS total, [id] AS nodes, CAST([] AS VARCHAR[]) AS ids FROM start)"]
    for k in range(hops):
        step = "round(h.total + 0.6 * ln(greatest(coalesce(r.score, 0.0), 1e-12)) + 0.15 * ln(greatest(0.8::DOUBLE, 1e-12)), 9)"
        out.append(f"g{k + 1} AS (SELECT {step} AS total, list_append(h.nodes, e.dst) AS nodes, list_append(h.ids, e.edge_id) AS ids FROM h{k} h JOIN edges e ON e.src = h.nodes[-1] LEFT JOIN ranks r ON r.id = e.dst WHERE NOT list_contains(h.nodes, e.dst))")
        out.append(f"h{k + 1} AS (SELECT * FROM g{k + 1} ORDER BY total DESC, nodes, ids LIMIT {WIDTH})")
    union = " UNION ALL ".join(f"SELECT {k + 1} AS hop, * FROM h{k + 1}" for k in range(hops))
    return ", ".join([*out, f"kept AS (SELECT * FROM ({union}) ORDER BY total DESC, nodes, ids LIMIT {MOST})", "paths AS (SELECT row_number() OVER (ORDER BY total DESC, nodes, ids) AS path_id, * FROM kept)"])


def ranks(s, d):
    return ranking.cut(ranking.top(ppr(s, d), 200))


def beam(s, d, of=None):
    edges = paths.default_confidence(reached(s, d))
    return paths.beam_search(edges, ids(s, SEEDS), ranks(s, d) if of is None else of, BeamParams(3, WIDTH, MOST))


def beam_paths(s, d, of=None):
    """The paths, numbered; their lineage is cut as several branches read them."""
    return ranking.cut(paths.numbered(beam(s, d, of)))


BEAM = _beam_sql()
plain("beam_search", "edges", f"WITH {BEAM} SELECT CAST(hop AS INTEGER) AS hop, round(total, 6) AS score, array_to_string(nodes, '>') AS nodes, array_to_string(ids, '>') AS ids FROM kept", lambda s, d: beam(s, d).select("hop", F.round("score", 6).alias("score"), F.concat_ws(">", "nodes").alias("nodes"), F.concat_ws(">", F.transform("edges", lambda e: e["edge_id"])).alias("ids")))

# the score of a path from its nodes: ranks and bridges by power mean, communities of neighbours by affinity
SCORED = f"""{BEAM}, spots AS (SELECT path_id, hop, unnest(nodes) AS id FROM paths),
 strongest AS (SELECT entity AS id, max(strength) AS strength FROM bridges GROUP BY entity),
 n AS (SELECT path_id, max(hop) AS hop, pow(avg(pow(greatest(coalesce(r.score, 1e-12), 1e-12), 0.5)), 2.0) AS rank_mean, pow(avg(pow(CASE WHEN strength > 0 THEN 1 + ln(1 + strength) * 0.1 * 1.5 ELSE 1.0 END, 0.5)), 2.0) AS bridge_mean FROM spots LEFT JOIN ranks r USING (id) LEFT JOIN strongest USING (id) GROUP BY path_id),
 pe AS (SELECT path_id, i AS position, nodes[i] AS src, nodes[i + 1] AS dst, ids[i] AS edge_id FROM (SELECT *, unnest(range(1, len(nodes))) AS i FROM paths)),
 ea AS (SELECT path_id, exp(sum(ln(CASE WHEN a.community <> b.community AND score > 0 THEN 1 + score * 1.5 ELSE 1.0 END))) AS affinity FROM pe LEFT JOIN membership a ON a.entity = src LEFT JOIN membership b ON b.entity = dst LEFT JOIN affinities ON from_c = least(a.community, b.community) AND to_c = greatest(a.community, b.community) GROUP BY path_id),
 scored AS (SELECT path_id, pow(0.8, hop) * rank_mean * bridge_mean * affinity AS path_score FROM n JOIN ea USING (path_id))"""
SIGNALS = "edges bridges membership affinities"


def scored(s, d, of=None):
    of = ranks(s, d) if of is None else of
    return ranking.cut(scoring.score_paths(beam_paths(s, d, of), of, D.bridges(s, d), D.membership(s, d), D.affinities(s, d)))


plain("path_score", SIGNALS, f"WITH {SCORED} SELECT path_id, round(path_score, 9) AS path_score FROM scored", lambda s, d: scored(s, d).select(F.col("path_id").cast("long").alias("path_id"), F.round("path_score", 9).alias("path_score")))
plain("scored_paths", SIGNALS, f"WITH {SCORED} SELECT s.path_id, array_to_string(nodes, '>') AS nodes, CAST(hop AS INTEGER) AS hop, round(path_score, 9) AS path_score FROM scored s JOIN paths USING (path_id)", lambda s, d: scored(s, d).select(F.col("path_id").cast("long").alias("path_id"), F.concat_ws(">", "nodes").alias("nodes"), "hop", F.round("path_score", 9).alias("path_score")))
STRENGTH = "(SELECT 1 - exp(sum(ln(greatest(1e-300, 1 - path_score)))) AS v FROM (SELECT path_score FROM scored ORDER BY path_score DESC LIMIT 5))"
RELEVANCE = "(SELECT sum(score) AS v FROM ranks WHERE id IN (SELECT id FROM spots))"
plain("evidence_strength", SIGNALS, f"WITH {SCORED} SELECT round(v, 9) AS evidence_strength FROM {STRENGTH}", lambda s, d: rounded(scoring.evidence_strength(scored(s, d)), "evidence_strength"))
plain("community_relevance", SIGNALS, f"WITH {SCORED} SELECT round(v, 9) AS community_relevance FROM {RELEVANCE}", lambda s, d: _relevance(s, d))
plain("insight_score", SIGNALS, f"WITH {SCORED} SELECT round(e.v, 9) AS evidence_strength, round(c.v, 9) AS community_relevance, round(0.5 * least(greatest(e.v, 0), 1) + 0.2 * least(greatest(c.v, 0), 1) + 0.1 + 0.05, 9) AS insight_score FROM {STRENGTH} e, {RELEVANCE} c", lambda s, d: _insight(s, d))


def _relevance(s, d):
    of = ranks(s, d)
    return rounded(scoring.community_relevance(beam_paths(s, d, of), of), "community_relevance")


def _insight(s, d):
    of = ranks(s, d)
    return rounded(scoring.insight(scored(s, d, of), of), "evidence_strength", "community_relevance", "insight_score")



# -- scalar forms over paths

plain("power_mean", SIGNALS, f"WITH {SCORED} SELECT path_id, round(rank_mean, 9) AS half, round(g, 9) AS zero FROM n JOIN (SELECT path_id, exp(avg(ln(greatest(coalesce(score, 1e-12), 1e-12)))) AS g FROM spots LEFT JOIN ranks USING (id) GROUP BY path_id) USING (path_id)", lambda s, d: scored(s, d).select(F.col("path_id").cast("long").alias("path_id"), F.round(S.power_mean(F.col("decomp.ranks"), 0.5), 9).alias("half"), F.round(S.power_mean(F.col("decomp.ranks"), 0), 9).alias("zero")))
CONF = "coalesce(raw, 0.5) AS c"
plain("geometric_mean", "confidences", "SELECT src, round(exp(avg(ln(least(greatest(coalesce(raw, 0.5), 1e-6), 1.0)))), 9) AS strength FROM confidences GROUP BY src", lambda s, d: D.confidences(D.facts(s, d)).groupBy("src").agg(F.collect_list(F.coalesce("raw", F.lit(0.5))).alias("x")).select("src", F.round(S.geometric_mean(F.col("x")), 9).alias("strength")))
plain("recency_factor", "edges", "SELECT src, round(least(greatest(exp(-sum(CASE WHEN created_at IS NULL THEN NULL ELSE greatest(CAST(epoch(TIMESTAMP '1999-01-01') - floor(epoch(created_at)) AS DOUBLE) / 86400.0, 0) END) / 30.0), 0.5), 1.0), 9) AS factor FROM edges WHERE created_at IS NOT NULL GROUP BY src", lambda s, d: D.edges(s, d).filter("created_at IS NOT NULL").groupBy("src").agg(F.collect_list(F.greatest(S.age_days(F.col("created_at"), D.AS_OF), F.lit(0.0))).alias("x")).select("src", F.round(S.recency_factor(F.col("x")), 9).alias("factor")))

# -- aggregates over the edges of paths

EDGES = f"""{BEAM}, pe AS (SELECT path_id, i AS position, nodes[i] AS src, nodes[i + 1] AS dst, ids[i] AS edge_id FROM (SELECT *, unnest(range(1, len(nodes))) AS i FROM paths)),
 rows AS (SELECT pe.path_id, pe.position, e.rel AS relation, a.label AS src_label, b.label AS dst_label, 0.8::DOUBLE AS confidence, e.created_at, v.dst AS document_id, CASE WHEN e.created_at IS NOT NULL THEN greatest(CAST(epoch(TIMESTAMP '2002-01-01') - floor(epoch(e.created_at)) AS DOUBLE) / 86400.0, 0) END AS age
   FROM pe JOIN (SELECT DISTINCT edge_id, src, dst, rel, created_at FROM edges) e USING (edge_id, src, dst) LEFT JOIN nodes a ON a.id = pe.src LEFT JOIN nodes b ON b.id = pe.dst LEFT JOIN provenance v ON v.src = pe.src)"""
AGG = "edges nodes provenance"
NOW = "2002-01-01"


def edge_rows(s, d):
    e = paths.path_edges(beam_paths(s, d)).withColumnRenamed("rel", "relation")
    label = D.nodes(s, d).select("id", "label")
    e = e.join(label.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src", "left").join(label.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst", "left")
    return e.join(D.provenance(s, d).select("src", F.col("dst").alias("document_id")), "src", "left")


MOTIF = "motif AS (SELECT pattern, count(*) AS edge_count, count(DISTINCT path_id) AS path_count, round(avg(confidence), 4) AS mean_confidence, median(age) AS median_age_days FROM rows JOIN (SELECT path_id, string_agg(relation, '->' ORDER BY position) AS pattern FROM rows GROUP BY path_id) USING (path_id) GROUP BY pattern)"
SHARE = "shares AS (SELECT relation, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM rows GROUP BY relation)"
plain("motifs", AGG, f"WITH {EDGES}, {MOTIF} SELECT pattern, edge_count, path_count, mean_confidence, round(median_age_days, 6) AS median_age_days FROM motif", lambda s, d: rounded(A.motifs(edge_rows(s, d), NOW), "median_age_days", places=6))
plain("relation_shares", AGG, f"WITH {EDGES}, {SHARE} SELECT * FROM shares", lambda s, d: A.relation_shares(edge_rows(s, d)))
plain("dominant_relation", AGG, f"WITH {EDGES}, {SHARE} SELECT relation, share FROM shares ORDER BY share DESC, relation LIMIT 1", lambda s, d: A.dominant_relation(A.relation_shares(edge_rows(s, d))))
COVER = "cover AS (SELECT count(*) AS edges, avg(CASE WHEN document_id IS NULL THEN 0 ELSE 1 END) AS p, sum((CASE WHEN src_label IS NULL THEN 0 ELSE 1 END) + (CASE WHEN dst_label IS NULL THEN 0 ELSE 1 END)) / (2.0 * count(*)) AS l, coalesce(avg(exp(-age / 30.0)), 0) AS r FROM rows)"
plain("provenance_coverage", AGG, f"WITH {EDGES}, {COVER} SELECT round(p, 9) AS provenance_coverage FROM cover", lambda s, d: rounded(A.coverage(edge_rows(s, d), NOW).select("provenance_coverage"), "provenance_coverage"))
plain("label_coverage", AGG, f"WITH {EDGES}, {COVER} SELECT round(l, 9) AS label_coverage FROM cover", lambda s, d: rounded(A.coverage(edge_rows(s, d), NOW).select("label_coverage"), "label_coverage"))
plain("recency_score", AGG, f"WITH {EDGES}, {COVER} SELECT round(r, 9) AS recency FROM cover", lambda s, d: rounded(A.coverage(edge_rows(s, d), NOW).select("recency"), "recency"))
DENSITY = "density AS (SELECT sum(CASE WHEN k <= 2 THEN edge_count END)::DOUBLE / sum(edge_count) AS m FROM (SELECT *, row_number() OVER (ORDER BY edge_count DESC, path_count DESC, pattern) AS k FROM motif))"
plain("motif_density", AGG, f"WITH {EDGES}, {MOTIF}, {DENSITY} SELECT round(m, 9) AS motif_density FROM density", lambda s, d: rounded(A.motif_density(A.motifs(edge_rows(s, d), NOW)), "motif_density"))
plain("snippet_anchors", AGG, f"WITH {EDGES} SELECT path_id, position - 1 AS position, document_id FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY position) AS k FROM rows WHERE path_id <= 50 AND document_id IS NOT NULL) WHERE k <= 2 ORDER BY path_id, position LIMIT 16", lambda s, d: A.snippet_anchors(edge_rows(s, d), paths=50).select(F.col("path_id").cast("long").alias("path_id"), F.col("position").cast("long").alias("position"), "document_id"))


def _priors(s, d):
    e = D.edges(s, d).groupBy(F.col("rel").alias("relation")).agg(F.count("*").alias("n"))
    return e.join(F.broadcast(e.agg(F.sum("n").alias("all")))).select("relation", F.round(F.col("n") / F.col("all"), 6).alias("prior"))


PRIOR = "priors AS (SELECT rel AS relation, round(count(*) / sum(count(*)) OVER (), 6) AS prior FROM edges GROUP BY rel)"
plain("surprise_priors", AGG, f"WITH {EDGES}, {SHARE}, {PRIOR} SELECT relation, round(abs(share - coalesce(prior, 0)), 4) AS surprise FROM shares LEFT JOIN priors USING (relation)", lambda s, d: A.surprise(A.relation_shares(edge_rows(s, d)), _priors(s, d)))
SUMMARY = f"{EDGES}, {MOTIF}, {SHARE}, {COVER}, {DENSITY}, {PRIOR}, lead AS (SELECT relation, share FROM shares ORDER BY share DESC, relation LIMIT 1), one AS (SELECT edges, round(p, 4) AS p, round(l, 4) AS l, round(r, 4) AS r, round(m, 4) AS m, relation, share FROM cover, density, lead)"
_NAMES = lambda names: ", ".join(f"'{n}'" for n in names)
KEPT = f"relation <> '' AND lower(trim(relation)) NOT IN ({_NAMES(G.BANNED)}) AND NOT (lower(trim(relation)) IN ({_NAMES(G.CONDITIONAL)}) AND (coalesce(lower(src_label) IN ({_NAMES(G.SCHEMA_LABELS)}), FALSE) OR coalesce(lower(dst_label) IN ({_NAMES(G.SCHEMA_LABELS)}), FALSE)))"
plain("aggregate_summary", AGG, f"WITH {SUMMARY} SELECT edges, (SELECT count(*) FROM rows WHERE {KEPT}) AS kept_edges, p AS provenance_coverage, l AS label_coverage, r AS recency, m AS motif_density, relation AS dominant_relation, share AS dominant_share FROM one", lambda s, d: A.summary(edge_rows(s, d), NOW))
plain(
    "triage", AGG,
    f"""WITH {SUMMARY}, u AS (SELECT *, round(abs(share - coalesce(prior, 0)), 4) AS su FROM one LEFT JOIN priors USING (relation)),
        b AS (SELECT *, (25 * least(greatest(p, 0), 1) + 25 * least(greatest(r, 0), 1) + 25 * least(su, 1) + 15 * CASE WHEN l < 0.8 THEN least(m, 0.3) ELSE m END + 10) * CASE WHEN edges < 20 THEN 0.6 ELSE 1 END - CASE WHEN l < 0.8 THEN 15 ELSE 0 END AS v FROM u)
        SELECT relation AS dominant_relation, su AS surprise, round_even(least(greatest(v, 0), 100), 0) AS triage FROM b""",
    lambda s, d: A.triage(edge_rows(s, d), NOW, _priors(s, d)).select("dominant_relation", "surprise", "triage"),
)


def _window_rows(s, d, window):
    e = D.edges(s, d).filter(F.col("created_at").between(*[F.to_timestamp(F.lit(t)) for t in window]))
    return e.select(F.col("edge_id").alias("path_id"), F.lit(0).alias("position"), F.col("rel").alias("relation"), F.lit(None).cast("string").alias("src_label"), F.lit(None).cast("string").alias("dst_label"))


BEFORE = ("1997-01-01", "1997-12-31")
plain(
    "baseline_comparison", "edges",
    """WITH a AS (SELECT rel AS relation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM edges WHERE created_at BETWEEN '1998-01-01' AND '1998-12-31' GROUP BY rel),
       b AS (SELECT rel AS relation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM edges WHERE created_at BETWEEN '1997-01-01' AND '1997-12-31' GROUP BY rel),
       c AS (SELECT relation, coalesce(a.share, 0) AS share, coalesce(b.share, 0) AS base_share, coalesce(b.n, 0) AS bn FROM a FULL JOIN b USING (relation))
       SELECT relation, share, base_share, round(share - base_share, 4) AS delta_share, round(100 * round(share - base_share, 4), 2) AS pp_change, CASE WHEN base_share > 0 THEN round(round(share - base_share, 4) / base_share, 4) END AS relative_change, bn < 10 AS low_support FROM c""",
    lambda s, d: A.baseline_comparison(A.relation_shares(_window_rows(s, d, D.WINDOW)), A.relation_shares(_window_rows(s, d, BEFORE))),
)
plain("half_life", None, "SELECT c_custkey, least(greatest(1.5 * (c_custkey % 60), 14.0), 60.0)::DOUBLE AS half_life FROM customer", lambda s, d: D.read(s, d, "customer").select("c_custkey", S.half_life_of_window(F.lit("1998-01-01").cast("timestamp"), F.timestamp_seconds(F.unix_seconds(F.lit("1998-01-01").cast("timestamp")) + (F.col("c_custkey") % 60) * 86400)).alias("half_life")))
plain(
    "insight_decomposition", f"{SIGNALS} confidences",
    f"""WITH {SCORED}, c AS (SELECT pe.path_id, least(greatest(coalesce(raw, 0.5), 1e-6), 1.0) AS c, coalesce(raw, 0.5) AS given FROM pe JOIN (SELECT DISTINCT edge_id, src, rel, dst FROM edges) e USING (edge_id, src, dst) LEFT JOIN confidences f ON f.src = e.src AND f.rel = e.rel AND f.dst = e.dst),
        g AS (SELECT path_id, exp(avg(ln(c))) AS strength, avg(given) AS confidence FROM c GROUP BY path_id), one AS (SELECT avg(strength) AS m, avg(path_score) AS r, avg(confidence) AS c FROM g JOIN scored USING (path_id))
        SELECT round(m, 9) AS mean_strength, round(r, 9) AS mean_rank, round(c, 9) AS mean_confidence, CASE WHEN m >= 0.7 THEN 'High' WHEN m >= 0.4 THEN 'Medium' ELSE 'Low' END AS label, m >= 0.4 AS passes FROM one""",
    lambda s, d: _decomposed(s, d),
)


def _decomposed(s, d):
    """With the confidence of each edge as the derived table gives it."""
    p = scored(s, d)
    own = D.confidences(D.facts(s, d)).select("src", "rel", "dst", F.coalesce("raw", F.lit(0.5)).alias("confidence"))
    e = paths.path_edges(p).drop("confidence").join(own, ["src", "rel", "dst"])
    return rounded(A.insight_decomposition(e, p), "mean_strength", "mean_rank", "mean_confidence").select("mean_strength", "mean_rank", "mean_confidence", "label", "passes")


# -- linking


def _mentions(s, d):
    c = D.read(s, d, "customer")
    near = F.array(*[F.struct(F.concat(F.lit("Customer/"), F.pmod(F.col("c_custkey") + k, F.lit(100)).cast("string")).alias("entity"), (0.9 - 0.1 * k - 0.001 * (F.col("c_custkey") % 50)).alias("score")) for k in range(3)])
    return c.select(F.col("c_custkey").alias("mention_id"), F.col("c_name").alias("surface"), near.alias("candidates"))


LINK = """m AS (SELECT c_custkey AS mention_id, unnest([0, 1, 2]) AS k FROM customer),
 c AS (SELECT mention_id, 'Customer/' || ((mention_id + k) % 100) AS entity, 0.9 - 0.1 * k - 0.001 * (mention_id % 50) AS given FROM m),
 s AS (SELECT mention_id, entity, 0.6 * given + 0.3 * coalesce(score, 0) AS score FROM c LEFT JOIN ppr ON id = entity),
 b AS (SELECT mention_id, entity, round(score, 9) AS score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity) AS k FROM s), linked AS (SELECT * FROM b WHERE k = 1)"""
plain("entity_linking", "edges", f"WITH {power_sql(5)}, {LINK} SELECT mention_id, entity, score, round((score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-9), 6) AS confidence FROM linked", lambda s, d: linking.link(_mentions(s, d), ppr(s, d)).select("mention_id", "entity", F.round("score", 9).alias("score"), F.round("confidence", 6).alias("confidence")))
plain("linked_seeds", "edges", f"WITH {power_sql(5)}, {LINK} SELECT entity AS id FROM linked GROUP BY entity ORDER BY min(mention_id), entity LIMIT 3", lambda s, d: linking.linked_seeds(linking.link(_mentions(s, d), ppr(s, d))))
FITS = """fit AS (SELECT a AS entity, b AS other FROM (SELECT src AS a, dst AS b FROM edges WHERE src LIKE 'Customer/%' UNION SELECT dst, src FROM edges WHERE src LIKE 'Customer/%')),
 n AS (SELECT count(*) AS n FROM linked), times AS (SELECT entity AS other, count(*) AS t FROM linked GROUP BY entity),
 f AS (SELECT s.mention_id, s.entity, sum(t - CASE WHEN l.entity = fit.other THEN 1 ELSE 0 END) AS total FROM s JOIN fit ON fit.entity = s.entity JOIN times USING (other) JOIN linked l ON l.mention_id = s.mention_id GROUP BY s.mention_id, s.entity),
 again AS (SELECT s.mention_id, s.entity, s.score + 0.1 * coalesce(total, 0) / (n - 1) AS score FROM s LEFT JOIN f ON f.mention_id = s.mention_id AND f.entity = s.entity, n),
 best AS (SELECT mention_id, entity, score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity) AS k FROM again), chosen AS (SELECT * FROM best WHERE k = 1)"""
plain(
    "link_coherence", "edges",
    f"WITH {power_sql(5)}, {LINK}, {FITS} SELECT mention_id, entity, round(score, 9) AS score, round((score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-9), 6) AS confidence FROM chosen",
    lambda s, d: rounded(linking.link(_mentions(s, d), ppr(s, d), D.edges(s, d).filter("src LIKE 'Customer/%'").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("score"))).withColumn("confidence", F.round("confidence", 6)), "score"),
)
