"""Negative samples over all facts, and the numbers of nodes they are drawn by."""

import os

import pytest

import __spark_entry__ as entry
from pathloom.operators import rules
from pathloom.sources import derived as D

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 7, 4096])
def test_each_number_is_given_once(spark, parts):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(500)], "id string")
    assert sorted(r["k"] for r in rules.numbered(nodes, parts).collect()) == list(range(500))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_the_query_takes_every_relation(spark):
    known = {tuple(r) for r in rules.facts(D.edges(spark, DIR)).collect()}
    bad = [tuple(r) for r in entry.queries()["negative_samples"](spark, DIR).collect()]
    assert {r for _, r, _ in bad} == {r for _, r, _ in known} and not known & set(bad)
