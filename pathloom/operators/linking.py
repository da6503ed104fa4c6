"""Entity linking by candidate score, prior and coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def link(mentions: DataFrame, prior: DataFrame | None = None, coherence: DataFrame | None = None, top_k: int = 5, rounds: int = 2, weights=(0.6, 0.3, 0.1)) -> DataFrame:
    """mention_id, entity, score, confidence: the best candidate of each mention.

    ``coherence`` (a, b, score) pairs entities; each round scores against the choices of the last one.
    The confidence is the score between the least and the largest of all mentions.
    """
    x = mentions.select("mention_id", F.explode("candidates").alias("c")).select("mention_id", F.col("c.entity").alias("entity"), F.col("c.score").alias("given"))
    place = F.row_number().over(W.partitionBy("mention_id").orderBy(F.col("given").desc(), "entity"))
    x = x.withColumn("place", place).filter(F.col("place") <= top_k).drop("place")
    if prior is not None:
        x = x.join(prior.select(F.col("id").alias("entity"), F.col("score").alias("prior")), "entity", "left")
    else:
        x = x.withColumn("prior", F.lit(0.0))
    base = weights[0] * F.col("given") + weights[1] * F.coalesce("prior", F.lit(0.0))
    best = W.partitionBy("mention_id").orderBy(F.col("score").desc(), "entity")
    pick = lambda df: df.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")
    chosen = pick(x.withColumn("score", base))
    if coherence is not None:
        both = coherence.select("a", "b", "score").unionByName(coherence.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        pairs = both.groupBy(F.col("a").alias("entity"), F.col("b").alias("other")).agg(F.max("score").alias("fit"))
        for _ in range(rounds - 1):
            count = chosen.agg(F.count("*").alias("n"))
            linked = chosen.groupBy(F.col("entity").alias("other")).agg(F.count("*").alias("times"))
            own = chosen.select("mention_id", F.col("entity").alias("own"))
            fits = x.join(pairs, "entity").join(linked, "other").join(own, "mention_id")
            # the mention's own choice isn't among the others
            times = F.col("times") - F.when(F.col("own") == F.col("other"), 1).otherwise(0)
            total = fits.groupBy("mention_id", "entity").agg(F.sum(F.col("fit") * times).alias("total"))
            scored = x.join(total, ["mention_id", "entity"], "left").join(F.broadcast(count))
            mean = F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0)
            chosen = pick(scored.withColumn("score", base + weights[2] * mean).drop("total", "n"))
    ends = chosen.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))
    return chosen.join(F.broadcast(ends)).select("mention_id", "entity", "score", ((F.col("score") - F.col("low")) / spread).alias("confidence"))


def linked_seeds(linked: DataFrame, n: int = 3) -> DataFrame:
    """id: the first distinct entities in order of mentions."""
    return linked.groupBy(F.col("entity").alias("id")).agg(F.min("mention_id").alias("first")).orderBy("first", "id").limit(n).select("id")
