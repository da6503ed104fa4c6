"""Each query with SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    shown = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_agrees_with_sql(spark, db, name):
    assert rows(entry.queries()[name](spark, DIR).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streams(spark):
    from pathloom.streaming import events as E

    source = spark.createDataFrame([], E.EVENTS)
    assert E.since(source, "2000-01-01").count() == 0
    for build, mode in ((E.windowed, "append"), (E.sessions, "append"), (E.edge_counts, "complete")):
        stream = spark.readStream.schema(E.EVENTS).parquet(DIR + "/events.parquet*")
        q = build(stream).writeStream.format("memory").queryName(f"q_{build.__name__}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        assert mode == "append" or spark.table(f"q_{build.__name__}").count() > 0
