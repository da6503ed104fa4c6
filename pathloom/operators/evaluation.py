"""Metrics of rankings, calibration, latency and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import above


def filtered_ranks(scored: DataFrame, truths: DataFrame, known: DataFrame) -> DataFrame:
    """src, rel, dst, rank of each truth: 1 + candidates of larger score that aren't known.

    ``scored``: src, rel, tail, score, each candidate once. Ties share the best rank. Candidates are counted by score and
    the counts summed from the largest score down; no truth meets the candidates of its key.
    """
    marks = truths.select("src", "rel", F.col("dst").alias("tail"), F.lit(1).alias("asked"), F.lit(0).alias("held"))
    marks = marks.unionByName(known.select("src", "rel", F.col("dst").alias("tail"), F.lit(0).alias("asked"), F.lit(1).alias("held")))
    marks = marks.groupBy("src", "rel", "tail").agg(F.max("asked").alias("asked"), F.max("held").alias("held"))
    marked = scored.select("src", "rel", "tail", "score").join(marks, ["src", "rel", "tail"], "left")
    counts = marked.groupBy("src", "rel", "score").agg(F.sum(F.when(F.coalesce("held", F.lit(0)) == 0, 1).otherwise(0)).alias("n"))
    better = above(counts.filter(F.col("score").isNotNull()), ["src", "rel"], "score", "n", "better")
    own = marked.filter("asked = 1").select("src", "rel", F.col("tail").alias("dst"), "score")
    return own.join(better, ["src", "rel", "score"], "left").select("src", "rel", "dst", (1 + F.coalesce("better", F.lit(0))).alias("rank"))


def filtered_head_ranks(scored: DataFrame, truths: DataFrame, known: DataFrame) -> DataFrame:
    """The same among heads. ``scored``: head, rel, dst, score."""
    turn = lambda df: df.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    tails = scored.select(F.col("dst").alias("src"), "rel", F.col("head").alias("tail"), "score")
    return filtered_ranks(tails, turn(truths), turn(known)).select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"), "rank")


def link_prediction(tails: DataFrame, heads: DataFrame, truths: DataFrame, known: DataFrame) -> DataFrame:
    """src, rel, dst, side, rank: each truth against other tails and against other heads."""
    of = lambda df, side: df.withColumn("side", F.lit(side))
    return of(filtered_ranks(tails, truths, known), "tail").unionByName(of(filtered_head_ranks(heads, truths, known), "head"))


def ablation(variants: dict[str, DataFrame]) -> DataFrame:
    """variant and its metrics, a row for each; the ranks (rank) of each variant."""
    out = None
    for name, ranks in variants.items():
        row = ranking_metrics(ranks).select(F.lit(name).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    """One row: MRR, hits at 1, 3 and 10, mean and median rank."""
    hits = lambda k: F.avg((F.col("rank") <= k).cast("int")).alias(f"hits_{k}")
    return ranks.agg(F.avg(1 / F.col("rank")).alias("mrr"), hits(1), hits(3), hits(10), F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error of (probability, label) over bins closed on the right; 0 is in none."""
    binned = rows.filter("probability > 0").groupBy(F.ceil(F.col("probability") * bins).alias("bin")).agg(F.avg("probability").alias("p"), F.avg("label").alias("y"), F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return binned.join(F.broadcast(total)).agg(F.coalesce(F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n") / F.col("total")), F.lit(0.0)).alias("ece"))


def recall_at_k(predicted: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query, recall: of (query, item, score), how many of the relevant are in the first k, out of min(k, relevant)."""
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "item"))
    first = predicted.withColumn("place", place).filter(F.col("place") <= k)
    hits = first.join(relevant, ["query", "item"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    n = relevant.groupBy("query").agg(F.count_distinct("item").alias("n"))
    return n.join(hits, "query", "left").select("query", (F.coalesce("hits", F.lit(0)) / F.least("n", F.lit(k))).alias("recall"))


def latency(rows: DataFrame) -> DataFrame:
    """One row: exact median and 95th percentile of ``latency`` with interpolation, and the share of budget hits."""
    return rows.agg(F.percentile("latency", F.lit(0.5)).alias("p50"), F.percentile("latency", F.lit(0.95)).alias("p95"), F.avg(F.col("hit").cast("int")).alias("hit_rate"))


def rule_quality(rules: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return rules.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), F.sum((c > 0.8).cast("int")).alias("n_high"), F.sum((c < 0.2).cast("int")).alias("n_low"))


def entity_ranking(scored: DataFrame, k: int = 10) -> DataFrame:
    """tail, mean score; the best."""
    return scored.groupBy("tail").agg(F.avg("score").alias("score")).orderBy(F.col("score").desc(), "tail").limit(k)
