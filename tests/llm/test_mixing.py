"""The mix where one doc_id has many rows."""

import pytest

from pathloom.llm import mixing
from tests.llm.helpers import frame


@pytest.mark.parametrize("texts", [720, 1])
def test_rows_of_one_doc_id_are_split_at_the_boundary(spark, tmp_path, texts):
    """Most rows have no doc_id: of different texts, or of one."""
    rows = [(None, f"t{k % texts} " * 5, "en", f"s{k % 3}", 0) for k in range(720)] + [(k, "w " * 5, "en", f"s{k % 3}", 0) for k in range(480)]
    docs = frame(spark, rows, folder=tmp_path / "d")
    target = {r["source"]: r["target"] for r in mixing.plan(docs).select("source", "target").distinct().collect()}
    taken = {r["source"]: 5 * r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)


@pytest.mark.parametrize("ids", ["all alike", "none"])
def test_a_source_of_one_id_meets_its_target(spark, tmp_path, ids):
    """One source's rows share an id (or have none); the other's are distinct."""
    rows = [(7 if ids == "all alike" else None, f"a{k} " * (1 + k % 9), "en", "b", 0) for k in range(1000)] + [(k, "w " * (1 + k % 9), "en", "a", 0) for k in range(1000)]
    p = mixing.plan(frame(spark, rows, folder=tmp_path / "d")).toPandas()
    taken = (p["size"] * p["copies"]).groupby(p["source"]).sum()
    assert (abs(taken - p.groupby("source")["target"].first()) <= 9).all()


def test_sql_splits_ties_as_the_query_does(spark, tmp_path):
    import duckdb

    rows = [(k % 4 or None, f"t{k % 40} " * (1 + k % 5), "en", f"s{k % 3}" if k % 7 else None, 0) for k in range(900)] + [(None, None, None, None, None)] * 2
    frame(spark, rows, folder=tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()
    got = mixing.op5_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
