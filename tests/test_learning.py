"""Grounding, samplers, training, caches and hubs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.config import CapabilityError, RetrievalParams, get_profile
from pathloom.engine import GraphEngine, NeighborCache, ResultCache
from pathloom.model import mln, trainer
from pathloom.operators import aggregates, evaluation, numbering, rules
from pathloom.sources.derived import Graph
from pathloom.sources.sinks import ArtifactStore, RevisionConflictError, read_splits

TRIPLE = "src string, rel string, dst string"


def random_facts(seed, nodes=12, n=60, loops=True):
    rng = random.Random(seed)
    made = {(f"n{rng.randrange(nodes)}", f"r{rng.randrange(3)}", f"n{rng.randrange(nodes)}") for _ in range(n)}
    return sorted(f for f in made if loops or f[0] != f[2])


@pytest.mark.parametrize("seed", range(3))
def test_chain_supports_against_brute_force(spark, seed):
    f = random_facts(seed)
    body, support = {}, {}
    for (x, r1, y), (y2, r2, z) in itertools.product(f, f):
        if y == y2:
            body[r1, r2] = body.get((r1, r2), 0) + 1
            for a, r3, c in f:
                if (a, c) == (x, z):
                    support[r1, r2, r3] = support.get((r1, r2, r3), 0) + 1
    want = {k: (body[k[:2]], n) for k, n in support.items() if n >= 2}
    for cap in (None, 10**6):
        got = rules.chain_rules(spark.createDataFrame(f, TRIPLE), 2, 0.0, cap).collect()
        assert {(r["r1"], r["r2"], r["r3"]): (r["body"], r["support"]) for r in got} == want


def test_wedges_and_triads_against_brute_force(spark):
    pairs = {(a, c) for a, _, c in random_facts(7) if a != c}
    wedges = [(u, w) for (u, v), (v2, w) in itertools.product(pairs, pairs) if v == v2 and u != w]
    row = aggregates.wedges_and_triads(spark.createDataFrame([(a, "r", c) for a, c in pairs], TRIPLE)).first()
    assert (row["wedges"], row["triads"]) == (len(wedges), sum(x in pairs for x in wedges))


def test_no_task_numbers_a_hub(spark):
    """100,000 edges of one node are numbered once each, in parts."""
    hub = spark.range(100_000).select(F.lit("h").alias("src"), F.col("id").alias("dst"))
    got = numbering.places(hub.unionByName(spark.createDataFrame([("a", 1), ("a", 2)], "src string, dst long")), "src", part=1000)
    assert [tuple(r) for r in got.groupBy("src").agg(F.count_distinct("k"), F.min("k"), F.max("k")).orderBy("src").collect()] == [("a", 2, 0, 1), ("h", 100_000, 0, 99_999)]
    assert "hashpartitioning(src" in got._jdf.queryExecution().toString() and "part_of_key" in got._jdf.queryExecution().toString()
    facts = spark.range(3000).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("in").alias("rel"), F.lit("hub").alias("dst")).unionByName(spark.range(3000).select(F.lit("hub").alias("src"), F.lit("out").alias("rel"), F.concat(F.lit("b"), "id").alias("dst")))
    assert rules.capped_pairs(facts, 50).count() <= 50


def test_grounding_by_unification(spark):
    f = random_facts(3, nodes=8)
    known, have = spark.createDataFrame(f, TRIPLE), set(f)
    names = sorted({x for a, _, c in f for x in (a, c)})
    body, head = rules.parse_rule("r0(x,y) ∧ r1(y,z) ∧ r0(z,w) ⇒ r2(x,w)")
    want = {(x, y, z, w) for x, y, z, w in itertools.product(names, repeat=4) if (x, "r0", y) in have and (y, "r1", z) in have and (z, "r0", w) in have}
    assert {(r["x"], r["y"], r["z"], r["w"]) for r in rules.unified(known, body).collect()} == want
    with pytest.raises(ValueError):
        rules.unified(known, [("r0", "x", "y"), ("r1", "v", "w")])
    rows = rules.ground_rule(known, body, head, 40).collect()
    assert 0 < len(rows) <= 40 and {r["body_holds"] for r in rows} == {True, False}
    for r in rows:
        assert all(tuple(b) in have for b in r["body"]) == r["body_holds"] and (tuple(r["head"]) in have) == r["head_holds"]


def test_samplers(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 4).alias("g"), F.when(F.col("id") < 100, 100.0).otherwise(0.1).alias("w"))
    assert rules.sampled(rows, 30).count() == 30
    assert rules.sampled(rows, 50, "weighted", "w").filter("id < 100").count() > 45
    assert {r["count"] for r in rules.sampled(rows, 7, "stratified", "g").groupBy("g").count().collect()} == {7}
    assert sorted(map(str, rules.sampled(rows, 30).collect())) == sorted(map(str, rules.sampled(rows.repartition(5), 30).collect()))
    assert rules.batched(rows, 100).groupBy("batch").count().count() == 10
    with pytest.raises(ValueError):
        rules.sampled(rows, 1, "other")


def test_ranks_of_heads(spark):
    scored = spark.createDataFrame([("a", "r", "t", 1.0), ("b", "r", "t", 3.0), ("c", "r", "t", 2.0)], "head string, rel string, dst string, score double")
    truth = spark.createDataFrame([("a", "r", "t")], TRIPLE)
    known = spark.createDataFrame([("b", "r", "t")], TRIPLE)
    assert evaluation.filtered_head_ranks(scored, truth, known).first()["rank"] == 2
    tails = spark.createDataFrame([("a", "r", "t", 1.0), ("a", "r", "u", 0.5)], "src string, rel string, tail string, score double")
    both = evaluation.link_prediction(tails, scored, truth, known)
    assert {(r["side"], r["rank"]) for r in both.collect()} == {("tail", 1), ("head", 2)}
    assert evaluation.ablation({"x": both}).first()["mrr"] == pytest.approx(0.75)


def test_markov_logic_arrays():
    ground, q = [([0, 1], 2), ([], 0), ([2], 1)], np.array([0.3, 0.6, 0.2])
    plain = np.zeros(3)
    for w, (body, head) in zip([1.0, 0.5, 2.0], ground, strict=True):
        plain[head] += w * np.prod(q[body])
        for i in body:
            plain[i] -= w * np.prod([q[j] for j in body if j != i]) * (1 - q[head])
    assert np.allclose(mln.log_odds(np.array([1.0, 0.5, 2.0]), [0, 1, 2], ground, q), plain)
    whole = mln.exact_log_partition([1.0, 0.5, 2.0], ground, 3)
    assert mln.log_partition([1.0, 0.5, 2.0], ground, 3) == pytest.approx(whole)
    apart = ground + [([3], 4)]
    assert mln.log_partition([1.0, 0.5, 2.0, 0.7], apart, 6) == pytest.approx(mln.exact_log_partition([1.0, 0.5, 2.0, 0.7], apart, 6))
    total = sum(np.exp(mln.log_probability([1.0, 0.5, 2.0], [0, 1, 2], ground, np.array(w, bool))) for w in itertools.product([0, 1], repeat=3))
    assert total == pytest.approx(1.0)


def test_calibrators(spark):
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 2, 4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * logits - 1)))).astype(float)
    assert mln.calibrate_platt(logits, labels) == pytest.approx((0.5, -1.0), abs=0.15)
    rows = spark.createDataFrame([(float(1 / (1 + np.exp(-x))), float(y)) for x, y in zip(logits[:500], labels[:500], strict=True)], "probability double, label double")
    assert abs(mln.platt(rows).agg(F.avg("calibrated")).first()[0] - labels[:500].mean()) < 0.05


def cluster(k=30):
    return [t for i in range(k) for t in ((f"a{i}", "r", f"b{i}"), (f"b{i}", "s", f"c{i % 5}"), (f"a{i}", "t", f"c{i % 5}"))]


def test_training(spark):
    seen = []
    got = trainer.train_model(spark.createDataFrame(cluster(), TRIPLE), get_profile("small"), after=seen.append)
    assert seen == got.history and {r["part"] for r in seen} == {"scorer", "rules"}
    assert max(r["mrr"] for r in seen if r["part"] == "scorer") == got.best_mrr > 0
    assert [r["text"] for r in got.rules] == ["r(x,y) ∧ s(y,z) ⇒ t(x,z)"] and got.rules[0]["weight"] > 0.5
    again = trainer.Trained.from_document(got.to_document())
    assert again.rules == got.rules and again.platt == got.platt and "" in again.temperatures
    new = spark.createDataFrame([("a0", "t", "c0"), ("a0", "t", "c1"), ("zz", "t", "c1")], TRIPLE)
    assert [r["dst"] for r in trainer.predict_unknown(got.scorer, new, spark.createDataFrame(cluster(), TRIPLE), 5).collect()] == ["c1", "c1"]


def engine(spark, **settings):
    edges = spark.createDataFrame([(f"e{k}", a, r, b, 1.0, None) for k, (a, r, b) in enumerate(cluster(12))], "edge_id string, src string, rel string, dst string, weight double, created_at timestamp")
    ids = sorted({x for a, _, b in cluster(12) for x in (a, b)})
    nodes = spark.createDataFrame([(i, "T", i) for i in ids], "id string, type string, label string")
    given = edges.select("src", "rel", "dst", F.lit(0.9).alias("raw"), F.lit(0.8).alias("posterior"), F.lit(1.0).alias("calib"))
    return GraphEngine(spark, Graph(nodes, edges, confidences=given), RetrievalParams(push_rounds=3, walk_length=3, dynamic_scale=False), **settings)


def test_priors_and_fusion_reach_the_paths(spark):
    plain = engine(spark).retrieve(["a0"], max_paths=10, hop_limit=1)
    priors = spark.createDataFrame([("r", 0.5), ("t", 0.01)], "rel string, prior double")
    weighed = engine(spark, priors=priors, fuse=True).retrieve(["a0"], max_paths=10, hop_limit=1)
    edge = {r["edges"][0]["rel"]: (r["edges"][0]["confidence"], r["path_score"]) for r in weighed.paths.collect()}
    assert edge["r"][0] == pytest.approx(0.72) and edge["t"][1] < edge["r"][1] / 10
    rank = lambda r: {x["id"]: x["score"] for x in r.ranks.collect()}
    assert rank(weighed)["b0"] / rank(weighed)["c0"] > rank(plain)["b0"] / rank(plain)["c0"]
    assert plain.usage.paths == 2 and not plain.usage.hit_budget
    with pytest.raises(CapabilityError):
        GraphEngine(spark, Graph(plain.ranks, plain.ranks), fuse=True)


def test_caches(spark):
    e = engine(spark)
    assert e.neighbors.warm(["a0", "b0", "zz"]) == 3
    for _ in range(10):
        assert len(e.neighbors.get("a0")) == 2
    assert e.neighbors.stats()["hit_rate"] == 1.0
    small = NeighborCache(e, size=1, most=1)
    with pytest.raises(CapabilityError):
        small.get("a0")
    small.most = 100
    small.get("a0"), small.get("b0"), small.get("a0")
    assert small.stats() == {"size": 1, "hits": 0, "misses": 4, "hit_rate": 0.0}
    first = e._ranks(["a0"], e.params, e.rule, None, None, e._weighed(e.edges()))
    assert e._ranks(["a0"], e.params, e.rule, None, None, e._weighed(e.edges())) is first
    e.refresh()
    assert e._ranks(["a0"], e.params, e.rule, None, None, e._weighed(e.edges())) is not first
    c = ResultCache(2)
    for k in range(3):
        c.put((k,), k)
    assert c.get((0,)) is None and c.get((2,)) == 2


def test_the_winner_of_a_race_serves(spark, tmp_path):
    """Another driver saves a model between load and save."""
    mine, other = engine(spark, store=ArtifactStore(str(tmp_path)), model=get_profile("small")), engine(spark, store=ArtifactStore(str(tmp_path)), model=get_profile("small"))
    load, raced = mine.store.load, []

    def late(key):
        if not raced:
            raced.append(None)
            held = load(key)
            other.ensure_model()
            return held
        return load(key)

    mine.store.load = late
    assert mine.ensure_model() and mine.score_edge("a0", "r", "b0") == other.score_edge("a0", "r", "b0")
    mine.store.load = load
    with pytest.raises(RevisionConflictError):
        mine.store.save("edge-plausibility", {}, None)


def test_splits(spark, tmp_path):
    for name, facts in (("train.txt", cluster(4)), ("valid.txt", [("a0", "r", "b1")]), ("test.txt", [("a1", "r", "b0"), ("new", "q", "b0")])):
        (tmp_path / name).write_text("".join("\t".join(f) + "\n" for f in facts) + "bad line\n")
    got = read_splits(spark, str(tmp_path))
    assert tuple(got.sizes().first()) == (12, 1, 2, 13, 4) and got.every().count() == 15
    assert got.graph().edges.count() == 12 and got.graph().nodes.count() == 12
