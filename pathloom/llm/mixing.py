"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

A source takes every document ``floor(target / size)`` times, and the rest of its budget once more
from the documents whose hash lies under a threshold. The thresholds come from histograms: words by
source and hash bucket, then the boundary bucket of each source alone in finer buckets, and so on.
No pass sorts documents, and what is grouped is bounded by sources x buckets.

Edge cases: a null text has size 0 and a null source is a source of its own, last in order. A null
doc_id is hashed as the empty string. Rows of one doc_id are told apart by their texts, and then by
their places, so the boundary may fall among them. Long texts are counted whole. An empty table gives
an empty result. Extra columns, of any names, are kept by ``mix`` and ignored by ``plan``. Place is
that of a scan: the input should be read from files, not be shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, fresh, table, whole, words

#: Relative weights, dealt to the sources in order and repeated.
WEIGHTS = (1, 2, 3)
#: A source, and a document, is taken so many times at most.
MOST = 3
#: Hash digits (hex) that one histogram resolves, those of one hash, and all that there are.
DIGITS, OF_ONE = 3, 15
ALL_DIGITS = 3 * OF_ONE


def doc_hash(doc_id: Column) -> Column:
    """60 bits as hex, the same in any SQL engine; cells of a histogram are prefixes."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, OF_ONE)


def row_hash(doc_id: Column, text: Column, place: Column) -> Column:
    """``doc_hash``, then as many digits of the text and of the row's place: rows of one doc_id differ, and the order of others stays."""
    return F.concat(doc_hash(doc_id), doc_hash(text), doc_hash(place))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to the same with ``target``: shares by weight, capped, excess reshared.

    Resharing until no source is above its cap ends at ``min(cap, level * weight)``. Sources in the
    order of cap / weight fill up first; the level is what the others get for a weight of 1.
    The table has a row for each source, so its windows over all rows are short.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = first.rowsBetween(W.unboundedPreceding, -1)
    filled = (
        capped.withColumn("total", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    level = (F.col("total") - F.col("full")).cast("double") / F.col("open")
    full = F.col("cap") <= F.col("level") * F.col("weight")
    # the level that holds is that of the first source which doesn't fill up; later ones are lower
    held = F.max(F.when(~full, F.col("level"))).over(every)
    return filled.withColumn("level", level).select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(held * F.col("weight")).alias("target"))


def _thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: hashes under ``below`` are taken; so is ``exact``, if that comes nearer.

    ``docs``: source, hash, size. Level by level only the boundary cell of each source is resolved.
    """
    budget = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    edge = checked_broadcast(targets.filter("source_size > 0").select("source", budget.alias("left"), F.lit("").alias("cell")))
    inside = docs
    for digits in range(DIGITS, ALL_DIGITS + 1, DIGITS):
        cells = inside.groupBy("source", F.substring("hash", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        at = edge.select(F.col("source").alias("of"), F.col("cell").alias("within"), F.col("left").alias("left"))
        cells = cells.join(at, F.col("source").eqNullSafe(F.col("of")) & F.col("bucket").startswith(F.col("within"))).drop("of", "within")
        upto = W.partitionBy("source").orderBy("bucket")
        cells = cells.withColumn("cum", F.sum("words").over(upto))
        # the first bucket that reaches over the budget; if none does, all are taken
        edge = (
            cells.groupBy("source")
            .agg(
                F.min_by(F.struct("bucket", "words", "n", (F.col("left") - F.col("cum") + F.col("words")).alias("left")), F.when(F.col("cum") > F.col("left"), F.col("bucket"))).alias("b"),
            )
            .select("source", F.col("b.bucket").alias("cell"), F.col("b.words").alias("words"), F.col("b.n").alias("n"), F.col("b.left").alias("left"))
            .filter(F.col("cell").isNotNull())
        )
        edge = checked_broadcast(cut(edge))
        if digits < ALL_DIGITS:
            if edge.filter("n > 1").isEmpty():
                break
            inside = docs.join(edge.select(F.col("source").alias("of"), F.col("cell").alias("within")), F.col("source").eqNullSafe(F.col("of")) & F.col("hash").startswith(F.col("within")), "left_semi")
    # the last cell is one document: take it if the total comes nearer so
    return edge.select("source", "cell", (F.abs(F.col("words") - F.col("left")) < F.col("left")).alias("with_cell"))


def _sized(docs: DataFrame, place: str, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, source, size and hash."""
    return docs.select(*keep, "source", F.size(words(whole("text"))).cast("long").alias("size"), row_hash(F.col("doc_id"), F.col("text"), F.col(place)).alias("hash"))


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    (place,) = fresh(docs, "place")
    return docs.withColumn(place, F.monotonically_increasing_id()), place


def _rules(sized: DataFrame, weights, most: int) -> DataFrame:
    """rule_source, source_size, target, cell, with_cell: a row for each source."""
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    edges = _thresholds(sized.select("source", "hash", "size"), targets)
    both = targets.join(edges.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    return checked_broadcast(cut(both.select(F.col("source").alias("rule_source"), "source_size", "target", "cell", "with_cell")))


def _copies(rows: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """``rows`` (source, hash, ...) with source_size, target and copies."""
    once = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    at = F.substring(F.col("hash"), F.lit(1), F.length("cell"))
    # a cell is missing where the budget reaches over the last document
    more = F.when(F.col("cell").isNull(), (F.col("target") > once * F.col("source_size")).cast("int")).otherwise(((at < F.col("cell")) | ((at == F.col("cell")) & F.col("with_cell"))).cast("int"))
    joined = rows.join(rules, F.col("source").eqNullSafe(F.col("rule_source")))
    return joined.withColumn("copies", F.least(F.lit(most), once + more).cast("int")).drop("rule_source", "cell", "with_cell")


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of ``docs``."""
    sized = cut(_sized(*_placed(docs), "doc_id"))
    return _copies(sized, _rules(sized, weights, most), most).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; its columns only."""
    placed, place = _placed(docs)
    rules = _rules(cut(_sized(placed, place)), weights, most)
    hashed = row_hash(F.col("doc_id"), F.col("text"), F.col(place))
    packed = placed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mixed_row"), F.col("source"), hashed.alias("hash"))
    taken = _copies(packed, rules, most).filter("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col("mixed_row").getField(c).alias(c) for c in docs.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same by sorting: what the thresholds must agree with.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) || substr(md5(coalesce(text, '')), 1, 15) AS hash
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM per
), filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_open
  FROM weighed
), levels AS (
  SELECT *, CAST(total - before AS DOUBLE) / left_open AS level FROM filled
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE)
              ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target
  FROM levels
), joined AS (
  SELECT s.doc_id, s.size, s.hash, t.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS once
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), summed AS (
  SELECT *, target - once * source_size AS budget,
         sum(size) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM joined
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(3, once + CASE
         WHEN upto <= budget THEN 1
         WHEN upto - size <= budget AND abs(size - (budget - (upto - size))) < budget - (upto - size) THEN 1
         ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
