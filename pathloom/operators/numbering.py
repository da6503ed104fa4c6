"""Numbers for the rows of each key, where one key may hold a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import checked_broadcast, cut, written

#: Rows of one key that a task numbers, on the average.
PART = 50_000


def places(rows: DataFrame, key: str, into: str = "k", part: int = PART) -> DataFrame:
    """``rows`` with a number from 0 on among the rows of ``key``, the same each time."""
    return running(rows.withColumn("one_row", F.lit(1).cast("long")), key, "one_row", into, part).drop("one_row")


def running(rows: DataFrame, key: str, value: str, into: str, part: int = PART) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of ``key`` before each, in an order that is the same each time.

    Rows are dealt to parts by a hash of all their columns, summed within key and part in the order of
    their columns, and moved behind the key's parts before, of which there are few.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    most = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, math.ceil(most / part))
    before = lambda w: F.coalesce(F.sum(value).over(w.orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if parts == 1:
        return rows.withColumn(into, before(W.partitionBy(key)))
    dealt = rows.withColumn("part_of_key", F.pmod(F.xxhash64(*columns), F.lit(parts)))
    sizes = cut(dealt.groupBy(key, "part_of_key").agg(F.sum(value).alias("n")))
    ahead = sizes.select(key, "part_of_key", (F.sum("n").over(W.partitionBy(key).orderBy("part_of_key")) - F.col("n")).alias("before_part"))
    inside = dealt.withColumn("in_part", before(W.partitionBy(key, "part_of_key")))
    return inside.join(ahead, [key, "part_of_key"]).select(*columns, (F.col("before_part") + F.col("in_part")).alias(into))


def above(counts: DataFrame, keys: list[str], score: str, value: str, into: str, part: int = PART) -> DataFrame:
    """``counts`` (a row for each score of a key) with the sum of ``value`` over the key's larger scores.

    A key of many scores falls into ranges of scores, cut at its own quantiles, which are summed apart.
    """
    counts = written(counts.select(*keys, score, value))
    most = counts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, math.ceil(most / part))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if parts == 1:
        return counts.withColumn(into, before(W.partitionBy(*keys).orderBy(F.col(score).desc()), value))
    at = F.percentile_approx(score, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(100 * parts)).alias("cuts")
    cuts = cut(counts.groupBy(*keys).agg(F.count("*").alias("scores"), at).filter(F.col("scores") > part).drop("scores"))
    place = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col(score))), F.lit(0))
    dealt = counts.join(checked_broadcast(cuts), keys, "left").withColumn("range_of_key", F.when(F.col("cuts").isNull(), 0).otherwise(place)).drop("cuts")
    sizes = dealt.groupBy(*keys, "range_of_key").agg(F.sum(value).alias("n"))
    ahead = sizes.select(*keys, "range_of_key", before(W.partitionBy(*keys).orderBy(F.col("range_of_key").desc()), "n").alias("before_range"))
    inside = dealt.withColumn("in_range", before(W.partitionBy(*keys, "range_of_key").orderBy(F.col(score).desc()), value))
    return inside.join(ahead, [*keys, "range_of_key"]).select(*keys, score, value, (F.col("before_range") + F.col("in_range")).alias(into))


def numbered(nodes: DataFrame, parts: int = 4096) -> DataFrame:
    """``nodes`` (distinct id) with k from 0 on, each once: places within parts by hash, after the nodes of the parts before."""
    dealt = nodes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    place = F.row_number().over(W.partitionBy("part").orderBy("id")) - 1
    return dealt.withColumn("place", place).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("place")).cast("long").alias("k"))


def coded(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``facts`` (src, rel, dst) with s, r, d in the place of names, whole numbers; and the relations (rel, r), which are few."""
    facts = written(facts.select("src", "rel", "dst"))
    nodes = facts.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    numbers = written(numbered(nodes))
    of = checked_broadcast(numbers)
    rels = cut(numbered(facts.select(F.col("rel").alias("id")).distinct(), 1).select(F.col("id").alias("rel"), F.col("k").alias("r")))
    out = facts.join(checked_broadcast(rels), "rel").join(of.select(F.col("id").alias("src"), F.col("k").alias("s")), "src").join(of.select(F.col("id").alias("dst"), F.col("k").alias("d")), "dst")
    return written(out.select("s", "r", "d")), rels
