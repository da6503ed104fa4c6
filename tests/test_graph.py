"""Operators on graphs small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from pathloom.config import BeamParams, CapabilityError, ConfigurationError, EdgeFilter, GraphConfig, RetrievalParams, get_profile, model_config_from_json
from pathloom.engine import GraphEngine, redact_text
from pathloom.operators import aggregates, evaluation, linking, paths, ranking, rules, scoring
from pathloom.operators import graph as G
from pathloom.sources.derived import Graph
from pathloom.sources.sinks import ArtifactStore, MetricsLog, ParquetLinkWriter, RevisionConflictError, is_older, read_triples_tsv

EDGE = "edge_id string, src string, rel string, dst string, weight double, created_at timestamp"


def edges(spark, triples):
    return spark.createDataFrame([(f"e{k}", a, r, b, 1.0, None) for k, (a, r, b) in enumerate(triples)], EDGE)


def nodes(spark, names):
    return spark.createDataFrame([(n, "T", n) for n in names], "id string, type string, label string")


@pytest.fixture(scope="module")
def four(spark):
    """A to B and C, B to C, C to A; D stands alone."""
    return edges(spark, [("A", "rel1", "B"), ("A", "rel2", "C"), ("B", "rel3", "C"), ("C", "rel4", "A")])


def got(df, key="id", value="score"):
    return {r[key]: r[value] for r in df.collect()}


def plain_power(out, start, alpha, steps):
    r, s = dict(start), {}
    for _ in range(steps):
        new = {}
        for u, m in r.items():
            s[u] = s.get(u, 0) + alpha * m
            for v in out.get(u, []):
                new[v] = new.get(v, 0) + (1 - alpha) * m / len(out[u])
        r = new
    return s


def test_parallel_edges_all_stay(spark):
    e = edges(spark, [("nodes/start", "requires", "nodes/end")] * 151)
    found = G.neighbors(e, spark.createDataFrame([("nodes/start",)], "id string"), nodes(spark, ["nodes/start", "nodes/end"]))
    assert found.select("edge_id").distinct().count() == 151


def test_canonical_edges_keep_the_row_and_read_only_what_is_mapped(spark):
    raw = spark.createDataFrame([("a/1", "b/2", "likes", "x", [0.1, 0.2], "S1")], "f string, t string, r string, w string, embedding array<double>, src_doc string")
    e = G.canonical_edges(raw, GraphConfig(source="f", target="t", relation="r", edge_id=None, weight="w", created_at=None, inline_sources=("src_doc",))).first()
    assert (e["src"], e["rel"], e["dst"], e["weight"], e["status"]) == ("a/1", "likes", "b/2", 1.0, None)
    assert e["assertion"]["embedding"] == [0.1, 0.2] and e["inline_sources"] == ["S1"] and e["edge_id"].startswith("kg/")


def test_filters_refuse_half_a_setting():
    for bad in ({"community_mode": "mapping"}, {"community_mode": "other"}, {"current_only": True}):
        with pytest.raises(ConfigurationError):
            EdgeFilter(**bad)
    with pytest.raises(ConfigurationError):
        GraphConfig(source=" ")


def test_power_ppr_and_push(spark, four):
    start = ranking.personalization(spark.createDataFrame([("A",)], "id string"))
    want = plain_power({"A": ["B", "C"], "B": ["C"], "C": ["A"]}, {"A": 1.0}, 0.1, 6)
    assert got(ranking.power_ppr(start, ranking.uniform_transition(four), 0.1, 6)) == pytest.approx(want)
    limit = plain_power({"A": ["B", "C"], "B": ["C"], "C": ["A"]}, {"A": 1.0}, 0.1, 300)
    push = got(ranking.push_ppr(start, four, 0.1, 1e-3, 40))
    assert all(0 <= limit[k] - push[k] < 0.05 for k in push) and sum(push.values()) <= 1


def test_walks_mix_and_targets(spark, four):
    start = ranking.personalization(spark.createDataFrame([("A",)], "id string"))
    walks = got(ranking.expected_walks(start, ranking.weighted_transition(four), 0.2, 10))
    assert sum(walks.values()) == pytest.approx(1) and max(walks, key=walks.get) == "A"
    push = ranking.push_ppr(start, four, 0.2, 1e-2, 5)
    assert sum(got(ranking.mix(push, ranking.expected_walks(start, ranking.weighted_transition(four), 0.2, 5))).values()) == pytest.approx(1)
    targets = got(ranking.bippr(start, spark.createDataFrame([("B",), ("D",)], "id string"), four))
    assert targets["B"] == pytest.approx(1) and targets["D"] == 0


def test_sampled_walks_follow_edges(spark, four):
    walks = ranking.cut(ranking.sampled_walks(spark.createDataFrame([("A",)], "id string"), four, 20, 5))
    step = walks.alias("a").join(walks.alias("b"), (F.col("a.walk") == F.col("b.walk")) & (F.col("b.step") == F.col("a.step") + 1))
    pairs = {(r[0], r[1]) for r in step.select("a.node", "b.node").distinct().collect()}
    assert pairs <= {("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")} and pairs
    again = ranking.refresh_walks(walks, spark.createDataFrame([("B",)], "id string"), four, walks=20, length=5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, walks.collect()))


def test_global_pagerank_sums_to_one_with_a_dangling_node(spark):
    pairs = ["AB", "AC", "BD", "CE", "DF", "EF", "FA", "FG"]
    e = edges(spark, [(a, "r", b) for a, b in pairs] + [("A", "r", "outside")])
    scores = got(ranking.global_pagerank(nodes(spark, "ABCDEFG"), e, steps=30, tolerance=1e-6))
    assert sum(scores.values()) == pytest.approx(1) and len(scores) == 7 and max(scores, key=scores.get) in "AF"


def chain(spark):
    return paths.default_confidence(edges(spark, [("A", "rel", "B"), ("B", "rel", "C"), ("C", "rel", "D"), ("C", "rel", "A")]))


def test_beam_gives_simple_paths_of_every_hop(spark):
    found = paths.beam_search(chain(spark), spark.createDataFrame([("A",)], "id string"), spark.createDataFrame([("B", 0.3)], "id string, score double"), BeamParams(3, 64, 50)).collect()
    assert sorted(">".join(r["nodes"]) for r in found) == ["A>B", "A>B>C", "A>B>C>D"]
    score = {len(r["edges"]): r["score"] for r in found}
    assert score[1] == pytest.approx(0.6 * math.log(0.3) + 0.15 * math.log(0.8), abs=1e-8)
    narrow = paths.beam_search(chain(spark), spark.createDataFrame([("A",), ("B",)], "id string"), spark.createDataFrame([("B", 0.3)], "id string, score double"), BeamParams(2, 1, 50)).count()
    assert narrow == 2


def test_path_score(spark):
    e = paths.default_confidence(edges(spark, [("A", "rel1", "B"), ("B", "rel2", "C")]), 0.9)
    ranks = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.1)], "id string, score double")
    p = paths.numbered(paths.beam_search(e, spark.createDataFrame([("A",)], "id string"), ranks, BeamParams(2, 8, 8)).filter("hop = 2"))
    mean = (sum(math.sqrt(x) for x in (0.5, 0.3, 0.1)) / 3) ** 2
    assert scoring.score_paths(p, ranks).first()["path_score"] == pytest.approx(0.81 * mean)
    bridges = spark.createDataFrame([("B", 2.0)], "entity string, strength double")
    factor = 1 + math.log(3) * 0.15
    assert scoring.score_paths(p, ranks, bridges).first()["path_score"] == pytest.approx(0.81 * mean * ((2 + math.sqrt(factor)) / 3) ** 2)


ROWS = "path_id int, position int, relation string, src_label string, dst_label string, confidence double, created_at timestamp, document_id string"


def test_aggregates_and_triage(spark):
    rows = spark.createDataFrame([(1, 0, "owns", "a", "b", 0.9, None, "d1"), (1, 1, "sells", "b", None, 0.7, None, None), (2, 0, "owns", "c", "d", 0.5, None, "d1"), (2, 1, "contains", "table", "x", 0.5, None, None), (3, 0, "ID", "x", "y", 0.5, None, "d2")], ROWS)
    m = {r["pattern"]: (r["edge_count"], r["path_count"], r["mean_confidence"], r["median_age_days"]) for r in aggregates.motifs(rows, "2020-01-01").collect()}
    assert m == {"owns->sells": (2, 1, 0.8, None), "owns": (1, 1, 0.5, None)}
    assert got(aggregates.relation_shares(rows), "relation", "share") == {"owns": 0.6667, "sells": 0.3333}
    one = aggregates.summary(rows, "2020-01-01").first()
    assert (one["edges"], one["kept_edges"], one["provenance_coverage"], one["label_coverage"], one["recency"], one["dominant_relation"]) == (5, 3, 0.6, 0.9, 0.0, "owns")
    t = aggregates.triage(rows, "2020-01-01", spark.createDataFrame([("owns", 0.3)], "relation string, prior double")).first()
    assert t["triage"] == round(0.6 * (25 * 0.6 + 25 * 0.3667 + 15 * 1.0 + 10))
    empty = aggregates.triage(rows.limit(0), "2020-01-01").first()
    assert empty["edges"] == 0 and empty["triage"] == 0.0


def test_baseline_comparison_joins_both_sides(spark):
    a = spark.createDataFrame([("x", 0.6, 6), ("y", 0.4, 4)], "relation string, share double, count long")
    b = spark.createDataFrame([("x", 0.2, 20), ("z", 0.8, 80)], "relation string, share double, count long")
    r = {x["relation"]: (x["delta_share"], x["relative_change"], x["low_support"]) for x in aggregates.baseline_comparison(a, b).collect()}
    assert r == {"x": (0.4, 2.0, False), "y": (0.4, None, True), "z": (-0.8, -1.0, False)}


def test_linking(spark):
    kind = "mention_id int, surface string, candidates array<struct<entity:string,score:double>>"
    m = spark.createDataFrame([(1, "Apple", [("Apple_Company", 0.8), ("Apple_Fruit", 0.2)]), (2, "Tim Cook", [("Tim_Cook_CEO", 0.9), ("Tim_Cook_Chef", 0.1)])], kind)
    linked = {r["mention_id"]: (r["entity"], r["confidence"]) for r in linking.link(m).collect()}
    assert linked == {1: ("Apple_Company", 0.0), 2: ("Tim_Cook_CEO", 1.0)}
    fit = spark.createDataFrame([("Apple_Fruit", "Tim_Cook_CEO", 100.0)], "a string, b string, score double")
    assert got(linking.link(m, coherence=fit), "mention_id", "entity")[1] == "Apple_Fruit"
    assert [r["id"] for r in linking.linked_seeds(linking.link(m)).collect()] == ["Apple_Company", "Tim_Cook_CEO"]


TRIPLE = "src string, rel string, dst string"


def test_chain_rules(spark):
    known = spark.createDataFrame([t for i in range(150) for t in ((f"a/{i}", "r", f"b/{i}"), (f"b/{i}", "r", f"c/{i}"), (f"a/{i}", "r", f"c/{i}"))], TRIPLE)
    assert [tuple(r) for r in rules.chain_rules(known).collect()] == [("r", "r", "r", 150, 150, 1.0)]
    hub = spark.createDataFrame([(f"A/{i}", "in", "hub") for i in range(200)] + [("hub", "out", f"B/{i}") for i in range(200)], TRIPLE)
    drawn = rules.capped_pairs(hub, 75)
    assert 60 <= drawn.count() <= 75 and drawn.distinct().count() == drawn.count()
    weak = spark.createDataFrame([("a", "r1", "hub"), ("a", "r3", "b/0"), *[("hub", "r2", f"b/{i}") for i in range(30)]], TRIPLE)
    assert rules.chain_rules(weak).count() == 0


def test_symmetry_text_and_negatives(spark):
    known = spark.createDataFrame([("a", "s", "b"), ("b", "s", "a"), ("c", "s", "d"), ("x", "t", "x")], TRIPLE)
    assert [tuple(r) for r in rules.symmetry_rules(known).collect()] == [("s", 3, 2, 2 / 3)]
    assert rules.parse_rule("r1(x,y) ∧ r2(y,z) ⇒ r3(x,z)") == ([("r1", "x", "y"), ("r2", "y", "z")], ("r3", "x", "z"))
    assert rules.is_variable("?A") and rules.is_variable("x") and not rules.is_variable("A")
    bad = rules.negative_samples(known, known, 4)
    assert bad.join(known, ["src", "rel", "dst"], "left_semi").count() == 0 and bad.filter("src = dst").count() == 0
    held = rules.hold_out(known, 0.5)
    assert held.count() == 4


def test_metrics(spark):
    s = spark.createDataFrame([("a", "r", "x", 3.0), ("a", "r", "y", 2.0), ("a", "r", "z", 2.0), ("a", "r", "w", 1.0)], "src string, rel string, tail string, score double")
    truth = spark.createDataFrame([("a", "r", "z")], TRIPLE)
    assert evaluation.filtered_ranks(s, truth, truth.limit(0)).first()["rank"] == 2
    assert evaluation.filtered_ranks(s, truth, spark.createDataFrame([("a", "r", "x"), ("a", "r", "z")], TRIPLE)).first()["rank"] == 1
    rows = spark.createDataFrame([(0.0, 1.0), (0.1, 0.0), (0.95, 1.0)], "probability double, label double")
    assert evaluation.calibration_error(rows).first()["ece"] == pytest.approx((0.1 + 0.05) / 3)


def graph(spark):
    pairs = [(f"A{i}", "x", f"B{i}") for i in range(6)] + [(f"B{i}", "y", f"C{i % 2}") for i in range(6)] + [("A0", "x", f"B{i}") for i in range(1, 4)]
    return Graph(nodes(spark, {n for a, _, b in pairs for n in (a, b)}), edges(spark, pairs))


def test_engine_retrieves_and_learns(spark, tmp_path):
    e = GraphEngine(spark, graph(spark), RetrievalParams(push_rounds=4, walk_length=4), store=ArtifactStore(str(tmp_path / "m")), model=get_profile("small"), metrics=MetricsLog(str(tmp_path / "log")))
    found = e.retrieve(["A0"], max_paths=10, hop_limit=2).to_dict()
    assert len(found["paths"]) == 8 and found["paths"][0]["path_score"] >= found["paths"][-1]["path_score"]
    assert 0 <= found["triage"]["triage"] <= 100 and "A0" in {r["id"] for r in found["topk_ppr"]}
    assert e.score_edge("A0", "x", "B0") == 0.8 and e.ensure_model() and not e.ensure_model()
    assert e.score_edge("A0", "x", "B0") > e.score_edge("C1", "x", "A5")
    with pytest.raises(CapabilityError):
        e.retrieve(["A0"], include_baseline=True)
    assert e.get_neighbors("B0").count() == 2 and e.find_anchors(["A0"], 3).count() == 3
    nothing = e.retrieve(["nowhere"]).to_dict()
    assert nothing["paths"] == [] and nothing["insight"]["insight_score"] >= 0.15


def test_stores_and_sinks(spark, tmp_path):
    store = ArtifactStore(str(tmp_path / "s"))
    first = store.save("k", {"a": 1})
    with pytest.raises(RevisionConflictError):
        store.save("k", {"a": 2})
    store.save("k", {"a": 2}, first)
    assert store.load("k")[0] == {"a": 2} and store.load("other") is None
    assert is_older("1.9", "1.10") and not is_older("1.0.0", "1")
    links = spark.createDataFrame([("a/1", "r", "b/2", 0.9), ("a/1", "r", "b/2", 0.5), ("a", "r", "b/2", 0.9), ("a/1", " ", "b/2", 0.9)], "src string, rel string, dst string, confidence double")
    ParquetLinkWriter(str(tmp_path / "links")).write_links(links)
    assert spark.read.parquet(str(tmp_path / "links")).count() == 1
    (tmp_path / "t.tsv").write_text("a\tr\tb\nbroken\nc\tr\td\n")
    assert read_triples_tsv(spark, str(tmp_path / "t.tsv")).count() == 2
    assert redact_text("a@b.org or 555-123-4567") == "[EMAIL_REDACTED] or [PHONE_REDACTED]"


def test_settings():
    assert model_config_from_json('{"learning_rate": 1}').learning_rate == 1.0
    with pytest.raises(ConfigurationError):
        get_profile("no such")
