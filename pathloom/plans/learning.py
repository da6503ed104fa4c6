"""Queries of rules, Markov-logic quantities, evaluation, calibration and numbers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import mln
from ..operators import evaluation as V
from ..operators import rules as R
from ..sources import derived as D
from ..sources.shared import written
from .access import plain

FACT = "f AS (SELECT DISTINCT src, rel, dst FROM edges)"
SMALL = "f AS (SELECT DISTINCT src, rel, dst FROM edges WHERE rel IN ('located_in', 'part_of', 'neighbors', 'fulfilled_by'))"


def facts(s, d):
    return D.facts(s, d)


def small(s, d):
    return D.facts(s, d, "located_in", "part_of", "neighbors", "fulfilled_by")


def places(s, d):
    return D.facts(s, d, "located_in")


PRIORS = "SELECT rel, count(*) AS support, count(*)::DOUBLE / (SELECT count(*) * count(*) FROM (SELECT src FROM f UNION SELECT dst FROM f)) AS confidence FROM f GROUP BY rel"
CHAINS = """p AS (SELECT a.src AS x, a.rel AS r1, b.rel AS r2, b.dst AS z FROM f a JOIN f b ON a.dst = b.src), b AS (SELECT r1, r2, count(*) AS body FROM p GROUP BY r1, r2),
 s AS (SELECT r1, r2, f.rel AS r3, count(*) AS support FROM p JOIN f ON f.src = x AND f.dst = z GROUP BY r1, r2, f.rel),
 chains AS (SELECT r1, r2, r3, CAST(body AS BIGINT) AS body, CAST(support AS BIGINT) AS support, support::DOUBLE / body AS confidence FROM s JOIN b USING (r1, r2) WHERE support >= 2 AND support::DOUBLE / body >= 0.2)"""
SYMMETRIC = "sym AS (SELECT a.rel, count(*) AS body, count(b.src) AS support, count(b.src)::DOUBLE / count(*) AS confidence FROM f a LEFT JOIN f b ON a.src = b.dst AND a.dst = b.src AND a.rel = b.rel WHERE a.src <> a.dst GROUP BY a.rel HAVING count(b.src) >= 2 AND count(b.src)::DOUBLE / count(*) >= 0.2)"
r9 = lambda df, *c: df.withColumns({x: F.round(x, 9) for x in c})



def _split(held):
    """Both sides of a split, which share no fact."""
    return held.filter("is_known").drop("is_known").unionByName(held.filter("NOT is_known").drop("is_known"))


plain("relation_priors", "edges", f"WITH {FACT} SELECT rel, support, round(confidence, 12) AS confidence FROM ({PRIORS})", lambda s, d: R.relation_priors(facts(s, d), D.entities(s, d)).withColumn("confidence", F.round("confidence", 12)))
plain("middle_nodes", "edges", f"WITH {FACT} SELECT dst AS id FROM f INTERSECT SELECT src FROM f", lambda s, d: R.middle_nodes(facts(s, d)))
plain("all_facts", "edges", f"WITH {FACT} SELECT * FROM f", lambda s, d: _split(R.hold_out(facts(s, d))))
plain("chain_rules", "edges", f"WITH {FACT}, {CHAINS} SELECT r1, r2, r3, body, support, round(confidence, 9) AS confidence FROM chains", lambda s, d: r9(R.chain_rules(facts(s, d), cap=None, coding=D.coding(s, d)), "confidence"))
plain("chain_rules_capped", None, None, lambda s, d: R.chain_rules(facts(s, d), cap=1000))
plain("symmetry_rules", "edges", f"WITH {FACT}, {SYMMETRIC} SELECT rel, body, support, round(confidence, 9) AS confidence FROM sym", lambda s, d: r9(R.symmetry_rules(facts(s, d)), "confidence"))
RULES = f"{FACT}, {CHAINS}, {SYMMETRIC}, rules AS (SELECT 'prior' AS kind, NULL AS r1, NULL AS r2, rel AS r3, support, confidence FROM ({PRIORS}) UNION ALL SELECT 'chain', r1, r2, r3, support, confidence FROM chains UNION ALL SELECT 'symmetry', rel, NULL, rel, support, confidence FROM sym)"


def rules(s, d):
    return R.smart_rules(facts(s, d), cap=None, coding=D.coding(s, d), entities=D.entities(s, d))


plain("smart_rules", "edges", f"WITH {RULES} SELECT kind, r1, r2, r3, support, round(confidence, 12) AS confidence FROM rules", lambda s, d: rules(s, d).withColumn("confidence", F.round("confidence", 12)))
plain("rule_text", "edges", f"WITH {RULES} SELECT CASE kind WHEN 'chain' THEN r1 || '(x,y) ∧ ' || r2 || '(y,z) ⇒ ' || r3 || '(x,z)' WHEN 'symmetry' THEN r1 || '(x,y) ⇒ ' || r3 || '(y,x)' ELSE r3 || '(x,y)' END AS rule FROM rules", lambda s, d: rules(s, d).select(R.rule_text(F.col("kind"), F.col("r1"), F.col("r2"), F.col("r3")).alias("rule")))
plain("rule_quality", "edges", f"WITH {RULES} SELECT round(avg(confidence), 9) AS mean, round(stddev_pop(confidence), 9) AS std, round(min(confidence), 12) AS low, max(confidence) AS high, CAST(sum(CASE WHEN confidence > 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS n_high, CAST(sum(CASE WHEN confidence < 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS n_low FROM rules", lambda s, d: r9(V.rule_quality(rules(s, d)), "mean", "std").withColumn("low", F.round("low", 12)))
plain("rule_confidences", "edges", f"WITH {RULES} SELECT kind, r1, r2, r3, round(1 / (1 + exp(-(4 * confidence - 2))), 9) AS confidence FROM rules", lambda s, d: rules(s, d).select("kind", "r1", "r2", "r3", F.round(S.sigmoid(4 * F.col("confidence") - 2), 9).alias("confidence")))
GROUND = "g AS (SELECT a.src AS x, a.dst AS y, b.dst AS z, f.src IS NOT NULL AS head_holds FROM f a JOIN f b ON a.dst = b.src AND a.rel = 'contains' AND b.rel = 'supplied_by' LEFT JOIN f ON f.src = a.src AND f.rel = 'fulfilled_by' AND f.dst = b.dst)"
plain("positive_groundings", "edges", f"WITH {FACT}, {GROUND} SELECT x, count(*) AS bodies, CAST(sum(CASE WHEN head_holds THEN 1 ELSE 0 END) AS BIGINT) AS heads FROM g GROUP BY x", lambda s, d: _named(s, d, R.counted_groundings(*_chain(s, d))))


def _chain(s, d):
    """(x, y) of contains, (y, z) of supplied_by, (x, z) of fulfilled_by, in numbers."""
    c = D.coding(s, d)
    of = lambda rel, a, b: c.of(rel).select(F.col("s").alias(a), F.col("d").alias(b))
    return of("contains", "x", "y"), of("supplied_by", "y", "z"), of("fulfilled_by", "x", "z")


def _named(s, d, rows):
    return rows.withColumn("x", D.coding(s, d).name(F.col("x")))


def _rule_counts(s, d):
    chain = R.counted_groundings(*_chain(s, d)).agg(F.sum("bodies").alias("groundings"), F.sum("heads").alias("satisfied")).filter("groundings > 0")
    back = D.facts(s, d, "neighbors", "placed")
    other = back.select(F.col("src").alias("dst"), "rel", F.col("dst").alias("src"), F.lit(True).alias("h"))
    rest = back.join(other, ["src", "rel", "dst"], "left").select(F.col("rel").alias("rule"), F.lit(True).alias("body_holds"), F.coalesce("h", F.lit(False)).alias("head_holds"))
    return chain.select(F.lit("chain").alias("rule"), "groundings", "satisfied").unionByName(R.ground_rule_counts(rest))


plain("ground_rule_counts", "edges", f"WITH {FACT}, {GROUND}, e AS (SELECT 'chain' AS rule, head_holds AS h FROM g UNION ALL SELECT a.rel, b.src IS NOT NULL FROM f a LEFT JOIN f b ON b.src = a.dst AND b.dst = a.src AND b.rel = a.rel WHERE a.rel IN ('neighbors', 'placed')) SELECT rule, count(*) AS groundings, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) AS BIGINT) AS satisfied FROM e GROUP BY rule", lambda s, d: _rule_counts(s, d))
plain("expected_rule_counts", "edges confidences", f"WITH {FACT}, {GROUND} SELECT g.x, round(sum(1 - coalesce(a.raw, 0.5) * coalesce(b.raw, 0.5) * (1 - coalesce(c.raw, 0.5))), 6) AS expected FROM g LEFT JOIN confidences a ON a.src = g.x AND a.rel = 'contains' AND a.dst = g.y LEFT JOIN confidences b ON b.src = g.y AND b.rel = 'supplied_by' AND b.dst = g.z LEFT JOIN confidences c ON c.src = g.x AND c.rel = 'fulfilled_by' AND c.dst = g.z GROUP BY g.x", lambda s, d: _named(s, d, R.expected_by_first(*_probable(s, d))).withColumn("expected", F.round("expected", 6)))


def _probable(s, d):
    """The parts of ``_chain`` with the probability q of each fact."""
    c = D.coding(s, d)
    ends = lambda df, a, b, rel: df.withColumns({"src": c.name(F.col(a)), "dst": c.name(F.col(b)), "rel": F.lit(rel)})
    of = lambda df, a, b, rel: D.confidences(ends(df, a, b, rel)).select(a, b, F.coalesce(F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), F.col("raw")), F.lit(0.5)).alias("q"))
    one, two, head = _chain(s, d)
    return of(one, "x", "y", "contains"), of(two, "y", "z", "supplied_by"), of(head, "x", "z", "fulfilled_by")


plain("pseudo_log_odds", "edges confidences", f"WITH {FACT}, {GROUND}, o AS (SELECT g.x, g.z, 1 / (1 + exp(-least(greatest(sum(1.5 * coalesce(a.raw, 0.5) * coalesce(b.raw, 0.5)), -40), 40))) AS p FROM g LEFT JOIN confidences a ON a.src = g.x AND a.rel = 'contains' AND a.dst = g.y LEFT JOIN confidences b ON b.src = g.y AND b.rel = 'supplied_by' AND b.dst = g.z GROUP BY g.x, g.z) SELECT x, count(*) AS heads, round(avg(p), 9) AS mean, round(max(p), 9) AS most FROM o GROUP BY x", lambda s, d: _named(s, d, R.head_log_odds(R.bodies_by_first(*_probable(s, d)[:2]), 1.5, "x", "z").groupBy("x").agg(F.count("*").alias("heads"), F.round(F.avg("p"), 9).alias("mean"), F.round(F.max("p"), 9).alias("most"))))


# neighbors(x,y) ⇒ neighbors(y,x), with a weight of 1.5: each pair of nations is a part of its own, of two facts and two groundings
PAIR = "ln(2 * exp(2 * 1.5) + 2 * exp(1.5))"


def _mutual(s, d):
    """region, and the ground rules of its pairs over numbered facts: nations are few."""
    f = facts(s, d)
    region = f.filter("rel = 'part_of'").select(F.col("src").alias("x"), F.col("dst").alias("region"))
    bound = R.unified(f, [("neighbors", "x", "y")]).join(region, "x").collect()
    out: dict[str, tuple[list, list]] = {}
    for region in sorted({r["region"] for r in bound}):
        pairs = sorted((r["x"], r["y"]) for r in bound if r["region"] == region)
        number = {p: k for k, p in enumerate(pairs)}
        out[region] = pairs, [([number[x, y]], number[y, x]) for x, y in pairs]
    return out


def _partitions(s, d):
    rows = [(region, round(mln.log_partition([1.5] * len(ground), ground, len(pairs)), 6)) for region, (pairs, ground) in _mutual(s, d).items()]
    return s.createDataFrame(rows, "region string, log_partition double")


def _log_probs(s, d):
    import numpy as np

    of = lambda pairs, ground: mln.log_probability([1.5], [0] * len(ground), ground, np.ones(len(pairs), bool), mln.log_partition([1.5] * len(ground), ground, len(pairs)))
    return s.createDataFrame([(region, round(of(*x), 6)) for region, x in _mutual(s, d).items()], "region string, log_prob double")


REGIONS = "r AS (SELECT p.dst AS region, count(*) AS n FROM edges n JOIN edges p ON p.rel = 'part_of' AND p.src = n.src WHERE n.rel = 'neighbors' GROUP BY p.dst)"
plain("mln_exact_partition", "edges", f"WITH {REGIONS} SELECT region, round(n / 2 * {PAIR}, 6) AS log_partition FROM r", _partitions)
plain("mln_log_prob", "edges", f"WITH {REGIONS} SELECT region, round(n * 1.5 - n / 2 * {PAIR}, 6) AS log_prob FROM r", _log_probs)
plain("all_corruptions", "edges", f"WITH {SMALL}, p AS (SELECT * FROM f WHERE rel = 'located_in'), t AS (SELECT DISTINCT rel, dst AS tail FROM f) SELECT DISTINCT src, rel, tail AS dst FROM p JOIN t USING (rel) WHERE tail <> dst EXCEPT SELECT * FROM f", lambda s, d: R.corruptions(small(s, d), places(s, d)))
plain("negative_samples", None, None, lambda s, d: _negatives(s, d))


def _negatives(s, d):
    c = D.coding(s, d)
    if c.rels.count() > R.MOST_RELATIONS:
        return R.negative_samples(facts(s, d), facts(s, d), 4, entities=D.entities(s, d))
    return R.negative_codes(c, D.entities(s, d), 4).join(F.broadcast(c.rels), "r").select(c.name(F.col("s")).alias("src"), "rel", c.name(F.col("d")).alias("dst"))


# -- link prediction over located_in, scored by a rule on the ids


def _scored(s, d):
    f = places(s, d)
    tails = f.select(F.col("dst").alias("tail")).distinct()
    key = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    pairs = f.select("src", "rel").distinct().join(F.broadcast(tails))  # nations: bounded
    return pairs.withColumn("score", ((key("src") * 7 + key("tail") * 13) % 23).cast("double"))


SCORES = f"{SMALL}, p AS (SELECT * FROM f WHERE rel = 'located_in'), sc AS (SELECT src, rel, tail, ((CAST(regexp_extract(src, '([0-9]+)$', 1) AS BIGINT) * 7 + CAST(regexp_extract(tail, '([0-9]+)$', 1) AS BIGINT) * 13) % 23)::DOUBLE AS score FROM (SELECT DISTINCT src, rel FROM p), (SELECT DISTINCT dst AS tail FROM p)), known AS (SELECT * FROM p WHERE CAST(regexp_extract(src, '([0-9]+)$', 1) AS BIGINT) % 2 = 0), rk AS (SELECT p.src, p.rel, p.dst, 1 + (SELECT count(*) FROM sc o WHERE o.src = p.src AND o.tail <> p.dst AND o.score > t.score AND NOT EXISTS (SELECT 1 FROM known k WHERE k.src = o.src AND k.rel = o.rel AND k.dst = o.tail)) AS rank FROM p JOIN sc t ON t.src = p.src AND t.tail = p.dst)"


def _ranks(s, d):
    f = places(s, d)
    return V.filtered_ranks(_scored(s, d), f, f.filter(F.regexp_extract("src", "([0-9]+)$", 1).cast("long") % 2 == 0))


HEADS = "h AS (SELECT src AS head, rel, tail AS dst, score FROM sc), hk AS (SELECT p.src, p.rel, p.dst, 1 + (SELECT count(*) FROM h o WHERE o.dst = p.dst AND o.head <> p.src AND o.score > t.score AND NOT EXISTS (SELECT 1 FROM known k WHERE k.src = o.head AND k.rel = o.rel AND k.dst = o.dst)) AS rank FROM p JOIN h t ON t.head = p.src AND t.dst = p.dst)"


def _head_ranks(s, d):
    f = places(s, d)
    heads = _scored(s, d).select(F.col("src").alias("head"), "rel", F.col("tail").alias("dst"), "score")
    return V.filtered_head_ranks(heads, f, f.filter(F.regexp_extract("src", "([0-9]+)$", 1).cast("long") % 2 == 0))


plain("filtered_head_rank", "edges", f"WITH {SCORES}, {HEADS} SELECT * FROM hk", _head_ranks)
METRICS = "round(avg(1.0 / rank), 9) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 9) AS hits_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 9) AS hits_3, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 9) AS hits_10, round(avg(rank), 9) AS mean_rank, median(rank) AS median_rank"
plain(
    "ablation_metrics", "edges",
    f"WITH {SCORES}, {HEADS} SELECT 'both' AS variant, {METRICS} FROM (SELECT rank FROM rk UNION ALL SELECT rank FROM hk) UNION ALL SELECT 'heads', {METRICS} FROM hk UNION ALL SELECT 'tails', {METRICS} FROM rk",
    lambda s, d: _ablation(s, d),
)


def _ablation(s, d):
    tails, heads = written(_ranks(s, d).select("rank")), written(_head_ranks(s, d).select("rank"))
    return r9(V.ablation({"both": tails.unionByName(heads), "heads": heads, "tails": tails}), "mrr", "hits_1", "hits_3", "hits_10", "mean_rank")


plain("candidate_cross", "edges", f"WITH {SCORES} SELECT src, rel, tail, score FROM sc", _scored)
plain("filtered_rank", "edges", f"WITH {SCORES} SELECT * FROM rk", _ranks)
plain("ranking_metrics", "edges", f"WITH {SCORES} SELECT round(avg(1.0 / rank), 9) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 9) AS hits_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 9) AS hits_3, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 9) AS hits_10, round(avg(rank), 9) AS mean_rank, median(rank) AS median_rank FROM rk", lambda s, d: r9(V.ranking_metrics(_ranks(s, d)), "mrr", "hits_1", "hits_3", "hits_10", "mean_rank"))
plain("entity_ranking", "edges", f"WITH {SCORES} SELECT tail, round(avg(score), 9) AS score FROM sc GROUP BY tail ORDER BY avg(score) DESC, tail LIMIT 10", lambda s, d: r9(V.entity_ranking(_scored(s, d)), "score"))
plain("kg_statistics", "edges", f"WITH {FACT} SELECT (SELECT count(*) FROM (SELECT src FROM f UNION SELECT dst FROM f)) AS entities, count(DISTINCT rel) AS relations, count(*) AS facts FROM f", lambda s, d: facts(s, d).agg(F.count_distinct("rel").alias("relations"), F.count("*").alias("facts")).join(F.broadcast(facts(s, d).select(F.explode(F.array("src", "dst")).alias("e")).agg(F.count_distinct("e").alias("entities")))).select("entities", "relations", "facts"))
plain("kg_neighbors", "edges", "SELECT dst AS id FROM edges WHERE src = 'Nation/3' UNION SELECT src FROM edges WHERE dst = 'Nation/3'", lambda s, d: D.edges(s, d).filter("src = 'Nation/3' OR dst = 'Nation/3'").select(F.when(F.col("src") == "Nation/3", F.col("dst")).otherwise(F.col("src")).alias("id")).distinct())

# -- calibration and other metrics over the raw tables


def _probabilities(s, d):
    return D.read(s, d, "labels").select(((F.col("doc_id") % 101) / 100.0).alias("probability"), F.col("quality").cast("double").alias("label"))


plain("ece", None, "WITH p AS (SELECT (doc_id % 101) / 100.0::DOUBLE AS p, quality::DOUBLE AS y FROM labels), b AS (SELECT ceil(p * 10) AS b, avg(p) AS p, avg(y) AS y, count(*) AS n FROM p WHERE p > 0 GROUP BY 1) SELECT round(sum(abs(p - y) * n) / (SELECT count(*) FROM p), 9) AS ece FROM b", lambda s, d: r9(V.calibration_error(_probabilities(s, d)), "ece"))
plain("recall_at_k", None, "WITH p AS (SELECT conv_id AS q, turn AS item, (turn * 7 + conv_id) % 11 AS score FROM conversations), k AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS k FROM p), r AS (SELECT conv_id AS q, turn AS item FROM conversations WHERE role = 'assistant'), n AS (SELECT q, count(DISTINCT item) AS n FROM r GROUP BY q) SELECT q AS query, round(coalesce((SELECT count(*) FROM k WHERE k.q = n.q AND k <= 2 AND item IN (SELECT item FROM r WHERE r.q = n.q)), 0)::DOUBLE / least(n, 2), 9) AS recall FROM n", lambda s, d: _recall(s, d))


def _recall(s, d):
    c = D.read(s, d, "conversations").select(F.col("conv_id").alias("query"), F.col("turn").alias("item"), ((F.col("turn") * 7 + F.col("conv_id")) % 11).alias("score"), "role")
    return r9(V.recall_at_k(c.drop("role"), c.filter("role = 'assistant'").select("query", "item"), 2), "recall")


plain("latency_percentiles", None, "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 9) AS hit_rate FROM events", lambda s, d: V.latency(D.read(s, d, "events").select(F.col("value").alias("latency"), (F.col("event_type") == "error").alias("hit"))).select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("hit_rate", 9).alias("hit_rate")))
plain("moving_average", None, "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS average FROM events", lambda s, d: D.read(s, d, "events").select("event_id", F.round(F.avg("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)), 6).alias("average")))
plain("log_sum_exp", None, "SELECT event_type, round(max(value) + ln(sum(exp(value - m))), 6) AS lse FROM events JOIN (SELECT event_type, max(value) AS m FROM events GROUP BY event_type) USING (event_type) GROUP BY event_type", lambda s, d: _lse(s, d))


def _lse(s, d):
    e = D.read(s, d, "events")
    m = e.groupBy("event_type").agg(F.max("value").alias("m"))
    return e.join(F.broadcast(m), "event_type").groupBy("event_type").agg(F.round(F.max("m") + F.ln(F.sum(F.exp(F.col("value") - F.col("m")))), 6).alias("lse"))


CLAMPED = "least(greatest((doc_id % 101) / 100.0::DOUBLE, 1e-12), 1 - 1e-12)"
plain("bernoulli_entropy", None, f"SELECT doc_id, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 9) AS entropy FROM (SELECT doc_id, {CLAMPED} AS p FROM labels)", lambda s, d: D.read(s, d, "labels").select("doc_id", F.round(S.bernoulli_entropy((F.col("doc_id") % 101) / 100.0), 9).alias("entropy")))
plain("kl_bernoulli", None, f"SELECT doc_id, round(p * ln(p / 0.3) + (1 - p) * ln((1 - p) / 0.7), 9) AS kl FROM (SELECT doc_id, {CLAMPED} AS p FROM labels)", lambda s, d: D.read(s, d, "labels").select("doc_id", F.round(S.kl_bernoulli((F.col("doc_id") % 101) / 100.0, F.lit(0.3)), 9).alias("kl")))
VEC = "SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(b.embedding, lambda x: x::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _vectors(s, d):
    e = D.read(s, d, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


plain("cosine_similarity", None, f"SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS similarity FROM ({VEC})", lambda s, d: _vectors(s, d).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity")))
plain("euclidean_distance", None, f"SELECT vec_id, round(list_distance(x, y), 6) AS distance FROM ({VEC})", lambda s, d: _vectors(s, d).select("vec_id", F.round(S.euclidean(F.col("embedding"), F.col("other")), 6).alias("distance")))
plain("temperature_sigmoid", None, "SELECT event_id, round(1 / (1 + exp(-((value - 50) / 25) / ln(1 + exp(0.5)))), 9) AS p FROM events", lambda s, d: D.read(s, d, "events").select("event_id", F.round(S.temperature_sigmoid((F.col("value") - 50) / 25, F.lit(0.5)), 9).alias("p")))
plain("uncertainty_measures", "confidences", "SELECT rel, round(avg(-(p * ln(p) + (1 - p) * ln(1 - p))), 9) AS entropy, round(avg(p * (1 - p)), 9) AS variance, round(avg(2 * 1.96 * sqrt(p * (1 - p))), 9) AS width FROM (SELECT rel, least(greatest(raw, 1e-12), 1 - 1e-12) AS p FROM confidences WHERE raw IS NOT NULL) GROUP BY rel", lambda s, d: _uncertainty(s, d))


def _uncertainty(s, d):
    p = S.clamp(F.col("raw"), 1e-12, 1 - 1e-12)
    v = p * (1 - p)
    return r9(D.confidences(facts(s, d)).filter("raw IS NOT NULL").groupBy("rel").agg(F.avg(S.bernoulli_entropy(p)).alias("entropy"), F.avg(v).alias("variance"), F.avg(2 * 1.96 * F.sqrt(v)).alias("width")), "entropy", "variance", "width")


plain("parse_timestamp", None, "SELECT event_id, epoch_us(ts::TIMESTAMP) AS parsed FROM events", lambda s, d: D.read(s, d, "events").select("event_id", F.unix_micros(S.parse_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).alias("parsed")))
plain("pii_redaction", None, r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[EMAIL_REDACTED]', 'g'), '\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}', '[PHONE_REDACTED]', 'g')) AS digest FROM documents", lambda s, d: D.read(s, d, "documents").select("doc_id", F.md5(S.redact_pii(F.col("text"))).alias("digest")))
# pools of adjacent violators by their max-min form over the distinct probabilities
plain(
    "isotonic_calibration", None,
    """WITH p AS (SELECT (doc_id % 101) / 100.0::DOUBLE AS p, avg(quality::DOUBLE) AS y, count(*) AS n FROM labels GROUP BY 1),
       m AS (SELECT a.p AS low, b.p AS high, (SELECT sum(y * n) / sum(n) FROM p WHERE p BETWEEN a.p AND b.p) AS mean FROM p a JOIN p b ON a.p <= b.p),
       t AS (SELECT p.p, m.low, min(mean) AS least FROM p JOIN m ON m.low <= p.p AND m.high >= p.p GROUP BY p.p, m.low)
       SELECT p AS probability, round(max(least), 9) AS calibrated FROM t GROUP BY p""",
    lambda s, d: r9(mln.isotonic(_probabilities(s, d)), "calibrated"),
)
plain("score_edge", None, None, lambda s, d: _score_edge(s, d))
plain("stratified_sample", None, None, lambda s, d: R.sampled(facts(s, d), 20, "stratified", "rel"))
plain("uniform_sample", None, None, lambda s, d: R.sampled(facts(s, d), 500))
plain("weighted_sample", None, None, lambda s, d: R.sampled(D.edges(s, d).select("edge_id", "src", "rel", "dst", "weight"), 500, "weighted", "weight"))
plain("ground_rules", None, None, lambda s, d: R.ground_rule(facts(s, d), *R.parse_rule("contains(x,y) ∧ supplied_by(y,z) ⇒ fulfilled_by(x,z)"), 1000, entities=D.entities(s, d)))


#: Facts that the query's scorer is fitted on, chosen by hash; all facts are scored.
FITTED = 20_000


def _score_edge(s, d):
    from dataclasses import replace

    from ..config import get_profile
    from ..model.scorer import train

    f = facts(s, d)
    return train(f, replace(get_profile("small"), epochs=8, batch_size=1024), most=FITTED, entities=D.entities(s, d)).score(f, distinct=False)
