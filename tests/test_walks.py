"""Walks of the stated length."""

from pathloom.config import RetrievalParams
from pathloom.engine import GraphEngine
from pathloom.operators import ranking
from tests.test_graph import graph


def test_the_engine_walks_as_long_as_stated(spark, monkeypatch):
    seen, walk = [], ranking.expected_walks
    monkeypatch.setattr(ranking, "expected_walks", lambda *a: seen.append(a[-1]) or walk(*a))
    GraphEngine(spark, graph(spark), RetrievalParams(push_rounds=2, walk_length=10)).retrieve(["A0"], max_paths=10, hop_limit=1)
    assert set(seen) == {10}
