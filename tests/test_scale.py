"""Steps whose work once grew faster than their input, and what they must still give."""

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathloom.operators import evaluation, numbering, rules
from pathloom.operators import graph as G
from pathloom.sources import derived as D
from pathloom.sources import shared

TRIPLE = "src string, rel string, dst string"


def test_heads_are_ranked_without_meeting_each_other(spark):
    n = 60_000
    at = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("src"), F.lit("in").alias("rel"), F.lit("N").alias("dst"), F.col("id").cast("double").alias("score"))
    began = time.time()
    ranks = evaluation.filtered_head_ranks(at.withColumnRenamed("src", "head"), at.select("src", "rel", "dst"), at.filter("score >= 59990").select("src", "rel", "dst"))
    got = ranks.agg(F.count("*"), F.sum("rank"), F.max("rank"), F.min("rank")).first()
    assert time.time() - began < 60  # 3.6 * 10^9 pairs take minutes
    assert tuple(got) == (n, sum(max(1, n - 10 - k) for k in range(n)), n - 10, 1)


@pytest.mark.parametrize("part", [3, 1000])
def test_ranks_are_those_of_a_count_by_hand(spark, part, monkeypatch):
    monkeypatch.setattr(evaluation, "above", lambda *a: numbering.above(*a, part=part))
    rng = random.Random(5)
    rows = [(s, "r", f"t{k}", rng.choice([None, float("nan"), 0.0, -0.0, *[float(x) for x in range(40)]])) for s in "ab" for k in range(100)]
    truths, known = rng.sample(rows, 60), rng.sample(rows, 80)
    held, of = {(s, t) for s, _, t, _ in known}, lambda x: float("inf") if x != x else x  # NaN is largest
    want = {(s, t): 1 + sum(1 for a, _, b, y in rows if a == s and b != t and (a, b) not in held and None not in (x, y) and of(y) > of(x)) for s, _, t, x in truths}
    frame = lambda rows: spark.createDataFrame([r[:3] for r in rows], TRIPLE)
    got = evaluation.filtered_ranks(spark.createDataFrame(rows, "src string, rel string, tail string, score double"), frame(truths), frame(known))
    assert {(r["src"], r["dst"]): r["rank"] for r in got.collect()} == want


# -- over the smallest tables: what is shuffled and written

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@tables
def test_edges_are_not_written_and_a_filter_leaves_out_tables(spark, monkeypatch):
    monkeypatch.setattr(D, "written", lambda *a: pytest.fail("edges were written"))
    shared.forget()
    plan = entry.queries()["filter_allowed_rel"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders" in plan
    assert entry.queries()["all_facts"](spark, DIR).count() > 0


@tables
@pytest.mark.parametrize("relations", [(), ("located_in",), ("contains", "view")])
def test_facts_and_entities_are_those_of_the_edges(spark, relations):
    every = D.edges(spark, DIR).select("src", "rel", "dst").distinct()
    assert rows(D.facts(spark, DIR, *relations)) == rows(every.filter(F.col("rel").isin(*relations)) if relations else every)
    assert rows(D.entities(spark, DIR)) == rows(every.select(F.explode(F.array("src", "dst"))).distinct())


@tables
def test_numbers_stand_for_facts(spark):
    c = D.coding(spark, DIR)
    named = c.known.join(c.rels, "r").select(c.name(F.col("s")).alias("src"), "rel", c.name(F.col("d")).alias("dst"), (c.number(c.name(F.col("s"))) == F.col("s")) & (c.number(c.name(F.col("d"))) == F.col("d")))
    assert rows(named) == [(*f, True) for f in rows(D.facts(spark, DIR))]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The tables with null keys, repeated lines and a hub."""
    at, db = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    for t in "region nation customer supplier part orders events documents labels".split():
        db.execute(f"COPY (SELECT * FROM '{DIR}/{t}.parquet') TO '{at}/{t}.parquet' (FORMAT parquet)")
    change = "CASE WHEN {0} % 17 = 3 THEN NULL WHEN l_linenumber = 1 AND {0} % 3 = 0 THEN 1 ELSE {0} END AS {0}"
    keys = ", ".join(change.format(k) for k in ("l_orderkey", "l_partkey", "l_suppkey"))
    db.execute(f"COPY (SELECT * REPLACE ({keys}) FROM '{DIR}/lineitem.parquet' UNION ALL SELECT * FROM '{DIR}/lineitem.parquet' WHERE l_orderkey < 50) TO '{at}/lineitem.parquet' (FORMAT parquet)")
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS c_custkey) FROM '{DIR}/customer.parquet') TO '{at}/customer.parquet' (FORMAT parquet)")
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey END AS s_suppkey) FROM '{DIR}/supplier.parquet') TO '{at}/supplier.parquet' (FORMAT parquet)")
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return at, db


@tables
@pytest.mark.parametrize("name", ["all_facts", "positive_groundings", "ground_rule_counts", "expected_rule_counts", "pseudo_log_odds", "triad_closure", "training_snapshot", "mixed_ppr", "filtered_head_rank"])
def test_odd_tables_agree_with_sql(spark, odd, name):
    from .test_queries import rows as shown

    assert shown(entry.queries()[name](spark, odd[0]).toPandas()) == shown(odd[1].execute(entry.oracle_sql()[name]).df())


def test_bodies_of_a_hub_are_counted_not_made(spark):
    n = 20_000  # 4 * 10^8 bodies through one node
    out = spark.range(n).select(F.lit(0).cast("long").alias("y"), F.col("id").alias("z"))
    one = spark.range(n).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("y"))
    head = spark.createDataFrame([(3, 4), (3, 5), (9, n + 1)], "x long, z long")
    began = time.time()
    got = {r["x"]: (r["bodies"], r["heads"]) for r in rules.counted_groundings(one, out, head).filter("x IN (3, 4, 9)").collect()}
    assert got == {3: (n, 2), 4: (n, 0), 9: (n, 0)} and time.time() - began < 60


@pytest.mark.parametrize("most", [2, 4096])
def test_bodies_in_parts(spark, most, monkeypatch):
    monkeypatch.setattr(rules, "LIST", most)
    monkeypatch.setattr(rules, "BODIES", 5)
    rng = random.Random(3)
    one, two, head = ({(rng.randrange(5), rng.randrange(5)): rng.randrange(100) / 100 for _ in range(15)} for _ in range(3))
    frame = lambda d, a, b: spark.createDataFrame([(*k, q) for k, q in d.items()], f"{a} long, {b} long, q double")
    parts = frame(one, "x", "y"), frame(two, "y", "z"), frame(head, "x", "z")
    want = sorted((x, z, p * q) for (x, y), p in one.items() for (v, z), q in two.items() if v == y)
    assert sorted(map(tuple, rules.bodies_by_first(*parts[:2]).collect())) == want
    counts = {}
    for (x, y), p in one.items():
        for (v, z), q in two.items():
            if v == y:
                counts[x] = counts.get(x, 0) + 1 - p * q * (1 - head.get((x, z), 0.5))
    assert {r["x"]: r["expected"] for r in rules.expected_by_first(*parts).collect()} == pytest.approx(counts)


def test_chains_by_kind_are_those_of_the_corners(spark):
    rng = random.Random(11)
    facts = {(k, rng.randrange(2), m) for _ in range(400) for k, m in [(rng.randrange(40), rng.randrange(40))] if k % 2 <= m % 2} | {(k, 1, k) for k in range(4)}
    known = spark.createDataFrame(sorted(facts), "s long, r long, d long")
    got = rules.chains_by_kind(known, lambda c: c % 2)
    assert rows(got) == rows(rules.closed_chains(known)) and got.count() > 3
    hub = [(4 * k, 0, 1) for k in range(1, 200)] + [(1, 0, 4 * k + 2) for k in range(200)] + [(4 * k, 0, 2) for k in range(1, 200)] + [(4, 0, 4 * k + 2) for k in range(1, 200)]
    hub = spark.createDataFrame(hub, "s long, r long, d long")
    assert rules.chains_by_kind(hub, lambda c: F.lit(0)) is None or rows(rules.chains_by_kind(hub, lambda c: F.lit(0))) == rows(rules.closed_chains(hub))


@pytest.mark.parametrize("few", [0, 1000])
def test_corruptions_go_in_parts(spark, few, monkeypatch):
    monkeypatch.setattr(rules, "MOST_BROADCAST", few)
    monkeypatch.setattr(rules, "TAILS", 7)
    facts = [(f"a{k}", f"r{k % 2}", f"t{k % 30}") for k in range(60)]
    known = spark.createDataFrame(facts, TRIPLE)
    want = {(s, r, t) for s, r, d in facts for _, q, t in facts if q == r and t != d} - set(facts)
    bad = rules.corruptions(known, known)
    assert rows(bad) == sorted(want)
    if few:
        assert "SortMergeJoin [rel" not in bad._jdf.queryExecution().executedPlan().toString()  # no task holds a relation


@tables
def test_negatives_by_numbers_are_those_by_names(spark):
    f = D.facts(spark, DIR)
    c = D.coding(spark, DIR)
    drawn = rules.negative_codes(c, D.entities(spark, DIR), 1).join(c.rels, "r").select(c.name(F.col("s")), "rel", c.name(F.col("d")))
    assert rows(drawn) == rows(rules.negative_samples(f, f, 1))


def test_a_batch_scores_each_triple_of_vectors_once(spark):
    from pathloom.config import get_profile
    from pathloom.model import scorer

    model = scorer.Scorer.fresh(["a", "b"], ["r"], get_profile("small"), 1)
    edges = spark.createDataFrame([(f"x{k}" if k else "a", "r", "b") for k in range(500)] + [("a", "q", None)], TRIPLE)
    got = {r["src"]: r["confidence"] for r in model.score(edges).filter("rel = 'r'").collect()}
    want = model.probabilities(["a", "x1"], ["r", "r"], ["b", "b"])
    assert len(got) == 500 and got["a"] == pytest.approx(want[0]) and {round(v, 12) for k, v in got.items() if k != "a"} == {round(want[1], 12)}


def test_reachable_edges_and_snapshots(spark):
    triples = [("A", "x", "B"), ("B", "x", "C"), ("B", "x", "C"), ("C", "x", "A"), ("D", "x", "A"), ("A", "x", None)]
    e = spark.createDataFrame(triples, TRIPLE)
    seeds = spark.createDataFrame([("A",), ("Z",)], "id string")
    got = G.reachable(seeds, lambda of: e.join(of.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "rel", "dst"))
    assert rows(got) == sorted([t for t in triples if t[0] != "D"], key=str)
    nodes = spark.createDataFrame([(n, "T") for n in "ABD"], "id string, type string")
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    assert rows(G.training_snapshot(e, nodes, ends)) == rows(G.training_snapshot(e, nodes))
