"""Node ranking: power-form, push and expected Monte-Carlo PPR, mixing, BiPPR, global PageRank, walks.

Every step is a join of scores with a transition and a sum by target; loops over steps run on the
driver. A transition is written once, in ranges of its source, unless it is a table already. Scores
that are counted to be few are broadcast to it, so a step shuffles only partial sums; more are joined
by a shuffle. A step reads the scores of the last one more than once, so each is kept in the shared
checkpoint folder.
"""

from __future__ import annotations

import itertools
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checked_broadcast, cut, written
from .graph import degrees, reverse
from .numbering import numbered, places, running


def personalization(seeds: DataFrame, prior: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """id, mass summing to 1: one for each occurrence of a seed, and the prior; without any, all nodes alike."""
    rows = seeds.select("id", F.lit(1.0).alias("mass"))
    if prior is not None:
        rows = rows.unionByName(prior.select("id", F.col("mass").cast("double").alias("mass")))
    rows = rows.filter("mass > 0")
    if nodes is not None and rows.isEmpty():
        rows = nodes.select("id", F.lit(1.0).alias("mass"))
    total = rows.agg(F.sum("mass").alias("total"))
    return rows.groupBy("id").agg(F.sum("mass").alias("mass")).join(F.broadcast(total)).select("id", (F.col("mass") / F.col("total")).alias("mass"))


def uniform_transition(edges: DataFrame) -> DataFrame:
    """src, dst, share, degree: the part of a node's mass that each target gets; parallel edges count each."""
    n = degrees(edges).withColumnRenamed("id", "src")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(n, "src").select("src", "dst", (F.col("n").cast("double") / F.col("degree")).alias("share"), "degree")


def weighted_transition(edges: DataFrame) -> DataFrame:
    """The same in proportion to weights; negative ones count as 0."""
    weight = F.greatest(F.col("weight"), F.lit(0.0))
    total = edges.groupBy("src").agg(F.sum(weight).alias("total")).filter("total > 0")
    return edges.groupBy("src", "dst").agg(F.sum(weight).alias("w")).join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share"))


def adjacency(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """src, dst, w, dst_total: an edge's weight (or 1), and the weight that leaves its target; a step's whole input."""
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) if weighted else F.lit(1.0)
    return _with_totals(edges.select("src", "dst", w.alias("w")).filter("w > 0"))


def _with_totals(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(F.col("src").alias("dst")).agg(F.sum("w").alias("dst_total"))
    return rows.join(out, "dst", "left").select("src", "dst", "w", F.coalesce("dst_total", F.lit(0.0)).alias("dst_total"))


def prepared(transition: DataFrame) -> DataFrame:
    """An adjacency stays; a transition by shares becomes one, as a table that steps read again and again."""
    return transition if "dst_total" in transition.columns else written(_with_totals(transition.select("src", "dst", F.col("share").alias("w"))))


def _started(start: DataFrame, adjacent: DataFrame) -> DataFrame:
    """id, mass, total of the nodes to start from."""
    start = cut(start.select("id", "mass"))
    totals = adjacent.join(checked_broadcast(start.select(F.col("id").alias("src"))), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("total"))
    return cut(start.join(totals, "id", "left").select("id", "mass", F.coalesce("total", F.lit(0.0)).alias("total")))


def _sent(x: DataFrame, adjacent: DataFrame, part: float = 1.0) -> DataFrame:
    """id, mass, total: what each edge carries of ``x`` (id, mass, total), whose lineage is cut, times ``part``."""
    unit = x.filter("total > 0").select(F.col("id").alias("src"), (F.col("mass") / F.col("total") * part).alias("unit"))
    return adjacent.join(checked_broadcast(unit), "src").select(F.col("dst").alias("id"), (F.col("unit") * F.col("w")).alias("mass"), F.col("dst_total").alias("total"))


def _gathered(sent: DataFrame) -> DataFrame:
    return sent.groupBy("id").agg(F.sum("mass").alias("mass"), F.max("total").alias("total"))


def _summed(parts: list[DataFrame], name: str = "mass") -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum(name).alias(name))


def steps_of(start: DataFrame, transition: DataFrame, alpha: float, steps: int) -> list[DataFrame]:
    """id, mass of ``start`` and after each step but the last, less what ends with ``alpha`` and what dangles."""
    adjacent = prepared(transition)
    x, parts = _started(start, adjacent), []
    for k in range(steps):
        parts.append(x.select("id", "mass"))
        if k < steps - 1:
            x = cut(_gathered(_sent(x, adjacent, 1 - alpha)))
    return parts


def power_ppr(start: DataFrame, transition: DataFrame, alpha: float, steps: int) -> DataFrame:
    """id, score after a fixed number of steps; dangling mass is lost."""
    return _summed(steps_of(start, transition, alpha, steps)).select("id", (F.col("mass") * alpha).alias("score"))


def push_ppr(start: DataFrame, edges: DataFrame, alpha: float = 0.15, eps: float = 1e-4, rounds: int | None = 20, transition: DataFrame | None = None) -> DataFrame:
    """id, score by local push: in each round only nodes whose residual per out-edge is over ``eps`` push.

    Seeds always push once; without ``rounds``, nodes push until none is hot. A lower bound of the power form, within the residual that is left.
    ``transition``: ``adjacency(edges)``, written, if it is at hand.
    """
    adjacent = written(adjacency(edges)) if transition is None else transition
    residual, parts = _started(start, adjacent).withColumn("hot", F.lit(True)), []
    per_edge = F.col("mass") / F.greatest("total", F.lit(1.0)) > eps
    for k in itertools.count() if rounds is None else range(rounds):
        hot = residual.filter("hot")
        if k and hot.isEmpty():
            break
        parts.append(hot.select("id", (F.col("mass") * alpha).alias("mass")))
        after = _gathered(_sent(hot, adjacent, 1 - alpha).unionByName(residual.filter("NOT hot").drop("hot")))
        residual = cut(after.withColumn("hot", per_edge))
    return _summed(parts).withColumnRenamed("mass", "score")


def expected_walks(start: DataFrame, transition: DataFrame, alpha: float, steps: int) -> DataFrame:
    """id, score: the expected share of visits of restarting walks of ``steps`` steps."""
    adjacent = prepared(transition)
    start, parts = _started(start, adjacent), []
    x = start
    for k in range(steps):
        parts.append(x.select("id", "mass"))
        if k < steps - 1:
            total = x.agg(F.sum("mass")).first()[0] or 0.0
            x = cut(_gathered(_sent(x, adjacent, 1 - alpha).unionByName(start.withColumn("mass", F.col("mass") * total * alpha))))
    visits = cut(_summed(parts))
    return visits.join(F.broadcast(visits.agg(F.sum("mass").alias("all")))).select("id", (F.col("mass") / F.col("all")).alias("score"))


def top(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` best; what differs by less than rounding is a tie, which goes by id."""
    return scores.orderBy(F.round("score", 12).desc(), "id").limit(n)


def mix(push: DataFrame, walks: DataFrame, topn: int = 200) -> DataFrame:
    """id, score: push, with walks for the mass that push left, made to sum to 1."""
    mass = push.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("mass"))
    rest = walks.join(F.broadcast(mass)).select("id", (F.col("score") * F.greatest(1 - F.greatest("mass", F.lit(1e-12)), F.lit(0.0))).alias("score"))
    both = _summed([push.select("id", "score"), rest], "score")
    total = both.agg(F.sum("score").alias("total"))
    return top(both.join(F.broadcast(total)).select("id", (F.col("score") / F.col("total")).alias("score")), topn)


def bippr(start: DataFrame, targets: DataFrame, edges: DataFrame, alpha: float = 0.15, rmax: float = 1e-4, rounds: int = 10, length: int = 10, transition: DataFrame | None = None) -> DataFrame:
    """id, score of each target: reverse push from the targets times expected visits from the sources."""
    n = targets.agg(F.count("*").alias("n"))
    back = push_ppr(targets.join(F.broadcast(n)).select("id", (F.lit(1.0) / F.col("n")).alias("mass")), reverse(edges), alpha, rmax, rounds)
    hits = _summed(steps_of(start, written(adjacency(edges)) if transition is None else transition, alpha, length))
    both = targets.select("id").distinct().join(back, "id", "left").join(hits, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * F.coalesce("mass", F.lit(0.0))).alias("score"))
    total = both.agg(F.sum("score").alias("total"))
    return both.join(F.broadcast(total)).select("id", F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.0).alias("score"))


def global_pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.15, steps: int = 100, tolerance: float | None = 1e-8) -> DataFrame:
    """id, score of all nodes; edges that leave the node set are left out.

    A step: self-retention, uniform dangling mass, a second teleport and normalisation. All mass is 1
    before it, so the sum that it is divided by is the same in every step. What a step moved and what
    is dangling after it are summed in one pass over its result.
    """
    names = written(numbered(nodes.select("id").distinct()))  # steps are sums by whole numbers, not by names
    of = checked_broadcast(names)
    inside = edges.select(F.col("src").alias("from"), F.col("dst").alias("to")).join(of.select(F.col("id").alias("from"), F.col("k").alias("src")), "from").join(of.select(F.col("id").alias("to"), F.col("k").alias("dst")), "to")
    adjacent = written(adjacency(inside))
    totals = adjacent.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("total"))
    x = cut(names.select(F.col("k").alias("id")).join(totals, "id", "left").select("id", F.coalesce("total", F.lit(0.0)).alias("total")))
    n, lost = x.count(), x.filter("total = 0").count()
    x, lost = x.select("id", F.lit(1.0 / max(n, 1)).alias("mass"), "total"), lost / max(n, 1)
    divisor = alpha + (1 - alpha) ** 2
    for _ in range(steps):
        moved = _sent(x, adjacent, 1 - alpha).withColumn("was", F.lit(0.0))
        both = moved.unionByName(x.select("id", (F.col("mass") * alpha).alias("mass"), "total", F.col("mass").alias("was")))
        y = both.groupBy("id").agg(F.sum("mass").alias("y"), F.max("total").alias("total"), F.sum("was").alias("was"))
        z = F.lit(alpha) / n + (1 - alpha) * (F.col("y") + (1 - alpha) * lost / n - alpha / n)
        x = cut(y.select("id", (z / divisor).alias("mass"), "total", "was"))
        told = x.agg(F.coalesce(F.sum(F.when(F.col("total") == 0, F.col("mass"))), F.lit(0.0)), F.sum(F.abs(F.col("mass") - F.col("was")))).first()
        lost = told[0]
        if tolerance is not None and (told[1] is None or told[1] < tolerance):
            break
    else:
        if tolerance is not None:
            warnings.warn(f"global ranks moved by {told[1]:.3g} in the last of {steps} steps", RuntimeWarning, stacklevel=2)
    return names.join(x.select(F.col("id").alias("k"), F.col("mass").alias("score")), "k").select("id", "score")


def sampled_walks(sources: DataFrame, edges: DataFrame, walks: int = 10, length: int = 10, alpha: float = 0.15, seed: int = 42) -> DataFrame:
    """src, walk, step, node of alpha-terminated walks. The next edge is drawn by a hash of walk and step.

    Neighbours are numbered; a draw is a number among them, found by a join.
    """
    ranked = places(edges.select("src", "dst", "edge_id"), "src", "k").select(F.col("src").alias("node"), "k", F.col("dst").alias("next"))
    degree = degrees(edges).withColumnRenamed("id", "node")
    at = sources.select(F.col("id").alias("src")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).select("src", "walk", F.lit(0).alias("step"), F.col("src").alias("node"))
    out = at
    for step in range(1, length):
        draw = lambda what: F.pmod(F.xxhash64("src", "walk", F.lit(step), F.lit(what), F.lit(seed)), F.lit(1 << 30)).cast("double") / (1 << 30)
        going = at.filter(draw("stop") >= alpha).join(degree, "node").withColumn("k", F.floor(draw("edge") * F.col("degree")).cast("long"))
        at = cut(going.join(ranked, ["node", "k"]).select("src", "walk", F.lit(step).alias("step"), F.col("next").alias("node")))
        out = out.unionByName(at)
    return out


def walk_hits(walks: DataFrame) -> DataFrame:
    return walks.groupBy("src", "node").agg(F.count("*").alias("hits"))


def refresh_walks(index: DataFrame, changed: DataFrame, edges: DataFrame, **settings) -> DataFrame:
    """The index after edges of the nodes ``changed`` (id) came or went: sources whose walks visit them walk again."""
    stale = index.join(changed.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("src").alias("id")).unionByName(changed.select("id")).distinct()
    stale = stale.join(index.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    fresh = sampled_walks(stale, edges, **settings)
    return index.join(stale.select(F.col("id").alias("src")), "src", "left_anti").unionByName(fresh)


def alias_tables(edges: DataFrame) -> DataFrame:
    """src, dst, low, high: where a uniform draw falls for each weighted edge; for draws by range."""
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    rows = edges.select("src", "dst", "edge_id", weight.alias("weight"))
    total = rows.groupBy("src").agg(F.sum("weight").alias("total"))
    placed = running(rows, "src", "weight", "before").join(total, "src")
    low = F.col("before") / F.col("total")
    return placed.select("src", "dst", "edge_id", low.alias("low"), (low + F.col("weight") / F.col("total")).alias("high"))
