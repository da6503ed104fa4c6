"""Rule mining and grounding over facts (src, rel, dst), each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp, sigmoid
from ..sources.shared import MOST_BROADCAST, checked_broadcast, cut, written
from .numbering import coded, numbered, places


def facts(triples: DataFrame) -> DataFrame:
    return triples.select("src", "rel", "dst").dropDuplicates()


def relation_priors(known: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """rel, support, confidence: of all pairs of entities, how many a relation joins. ``entities``: the ids of ``known``, if they are at hand."""
    if entities is None:
        entities = known.select(F.col("src").alias("e")).unionByName(known.select(F.col("dst").alias("e"))).distinct()
    n = entities.agg(F.count("*").alias("n"))
    return known.groupBy("rel").agg(F.count("*").alias("support")).join(F.broadcast(n)).select("rel", "support", (F.col("support").cast("double") / (F.col("n") * F.col("n"))).alias("confidence"))


def middle_nodes(known: DataFrame) -> DataFrame:
    return known.select(F.col("dst").alias("id")).intersect(known.select(F.col("src").alias("id")))


def _by_middle(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, r1, y) and (y, r2, z) of facts (s, r, d)."""
    return known.select(F.col("s").alias("x"), F.col("r").alias("r1"), F.col("d").alias("y")), known.select(F.col("s").alias("y"), F.col("r").alias("r2"), F.col("d").alias("z"))


def _bodies(into: DataFrame, out: DataFrame) -> DataFrame:
    """r1, r2, body: products of degrees at each middle node; no pair is made."""
    ins, outs = into.groupBy("y", "r1").agg(F.count("*").alias("n1")), out.groupBy("y", "r2").agg(F.count("*").alias("n2"))
    return ins.join(outs, "y").groupBy("r1", "r2").agg(F.sum(F.col("n1") * F.col("n2")).alias("body"))


def drawn_pairs(known: DataFrame, cap: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Of facts (s, r, d): the middle nodes y of more than ``cap`` pairs, and x, r1, y, r2, z of at most ``cap`` pairs of each.

    Edges in and out are numbered, pair numbers are drawn by hash and joined back, so the full product
    of a hub is never made, nor are its edges sorted by one task.
    """
    into, out = _by_middle(known)
    n = into.groupBy("y").agg(F.count("*").alias("n_in")).join(out.groupBy("y").agg(F.count("*").alias("n_out")), "y")
    total = F.col("n_in") * F.col("n_out")
    hot = cut(n.filter(total > cap))
    few = checked_broadcast(hot.select("y"))
    draws = F.sequence(F.lit(0).cast("long"), F.lit(cap - 1).cast("long"))
    drawn = hot.select("y", "n_out", F.explode(F.array_distinct(F.transform(draws, lambda k: F.pmod(F.xxhash64("y", k, F.lit(seed)), total)))).alias("p"))
    drawn = drawn.select("y", F.floor(F.col("p") / F.col("n_out")).alias("i"), (F.col("p") % F.col("n_out")).alias("o"))
    ins, outs = places(into.join(few, "y", "left_semi"), "y", "i"), places(out.join(few, "y", "left_semi"), "y", "o")
    return few, written(drawn.join(ins, ["y", "i"]).join(outs, ["y", "o"]).select("x", "r1", "y", "r2", "z"))


def _pairs(known: DataFrame, cap: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Of facts (s, r, d): r1, r2, body, and x, r1, y, r2, z of at most ``cap`` pairs at each middle node."""
    into, out = _by_middle(known)
    few, drawn = drawn_pairs(known, cap, seed)
    into, out = into.join(few, "y", "left_anti"), out.join(few, "y", "left_anti")
    body = _bodies(into, out).unionByName(drawn.groupBy("r1", "r2").agg(F.count("*").alias("body"))).groupBy("r1", "r2").agg(F.sum("body").alias("body"))
    return body, into.join(out, "y").select("x", "r1", "y", "r2", "z").unionByName(drawn)


def capped_pairs(known: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """x, r1, y, r2, z of at most ``cap`` joins at each middle node; one with no more pairs gives all of them."""
    return _pairs(known.select(F.col("src").alias("s"), F.col("rel").alias("r"), F.col("dst").alias("d")), cap, seed)[1]


def all_pairs(known: DataFrame) -> DataFrame:
    first = known.select(F.col("src").alias("x"), F.col("rel").alias("r1"), F.col("dst").alias("y"))
    return first.join(known.select(F.col("src").alias("y"), F.col("rel").alias("r2"), F.col("dst").alias("z")), "y")


def closed_chains(known: DataFrame) -> DataFrame:
    """r1, r2, r3, support: how many x, y, z have r1(x,y), r2(y,z) and r3(x,z), of distinct facts (s, r, d).

    Of three distinct nodes the one of fewest facts is the corner that a triangle is found from: there
    a node has no more than about the root of all facts towards nodes of more, so a hub's pairs are
    never made. Three facts that don't go in a circle are one chain with its head. Loops are counted apart.
    """
    plain, loops = known.filter("s <> d"), known.filter("s = d").select(F.col("s").alias("l"), F.col("r").alias("rl"))
    degree = checked_broadcast(cut(plain.select(F.explode(F.array("s", "d")).alias("n")).groupBy("n").agg(F.count("*").alias("w"))))
    both = plain.join(degree.select(F.col("n").alias("s"), F.col("w").alias("ws")), "s").join(degree.select(F.col("n").alias("d"), F.col("w").alias("wd")), "d")
    up = F.struct("ws", "s") < F.struct("wd", "d")
    edge = written(both.select(F.when(up, F.col("s")).otherwise(F.col("d")).alias("lo"), F.when(up, F.col("d")).otherwise(F.col("s")).alias("hi"), F.greatest("ws", "wd").alias("w"), "r", up.alias("f")))
    side = lambda p: edge.select("lo", F.col("hi").alias(f"hi_{p}"), F.col("w").alias(f"w_{p}"), F.col("r").alias(f"r_{p}"), F.col("f").alias(f"f_{p}"))
    corners = side("a").join(side("b"), "lo").filter((F.col("w_a") < F.col("w_b")) | ((F.col("w_a") == F.col("w_b")) & (F.col("hi_a") < F.col("hi_b"))))
    closing = edge.select(F.col("lo").alias("hi_a"), F.col("hi").alias("hi_b"), F.col("r").alias("r_c"), F.col("f").alias("f_c"))
    found = corners.join(closing.hint("shuffle_hash"), ["hi_a", "hi_b"]).groupBy("f_a", "f_b", "f_c", "r_a", "r_b", "r_c").agg(F.count("*").alias("n"))
    # by the directions of the corner's two edges and the closing one: which edges are first, second and head
    orders = {(True, True, True): "acb", (True, True, False): "bca", (True, False, False): "bac", (False, True, True): "abc", (False, False, True): "cba", (False, False, False): "cab"}
    role = lambda k: F.coalesce(*[F.when((F.col("f_a") == a) & (F.col("f_b") == b) & (F.col("f_c") == c), F.col(f"r_{names[k]}")) for (a, b, c), names in orders.items()])
    parts = [found.select(role(0).alias("r1"), role(1).alias("r2"), role(2).alias("r3"), "n").filter(F.col("r1").isNotNull())]
    if not loops.isEmpty():
        of = lambda a, b, r: known.select(F.col("s").alias(a), F.col("d").alias(b), F.col("r").alias(r))
        one = F.lit(1).cast("long").alias("n")
        at = lambda c: loops.select(F.col("l").alias(c), F.col("rl").alias(f"r_{c}"))
        out, back = of("x", "z", "r2").filter("x <> z"), of("x", "z", "r3").filter("x <> z")
        parts.append(at("x").join(out, "x").join(back, ["x", "z"]).select(F.col("r_x").alias("r1"), "r2", "r3", one))
        parts.append(at("z").join(out, "z").join(back, ["x", "z"]).select(F.col("r2").alias("r1"), F.col("r_z").alias("r2"), "r3", one))
        there, again = of("x", "y", "r1").filter("x <> y"), of("y", "x", "r2")
        parts.append(at("x").join(there, "x").join(again, ["x", "y"]).select("r1", "r2", F.col("r_x").alias("r3"), one))
        parts.append(at("x").join(loops.select(F.col("l").alias("x"), F.col("rl").alias("r2")), "x").join(loops.select(F.col("l").alias("x"), F.col("rl").alias("r3")), "x").select(F.col("r_x").alias("r1"), "r2", "r3", one))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("r1", "r2", "r3").agg(F.sum("n").alias("support"))


#: Pairs at a corner for each fact, up to which chains are found from that corner.
FEW_PAIRS = 16


def chains_by_kind(known: DataFrame, kind: Callable[[Column], Column]) -> DataFrame | None:
    """What ``closed_chains`` gives, where ``kind`` tells the kinds of nodes apart: only relations whose kinds can close are joined.

    The three facts are found from the corner of fewest pairs. None if a corner of few pairs is missing, or kinds are many.
    """
    typed = [tuple(t) for t in known.select(kind(F.col("s")), "r", kind(F.col("d"))).distinct().limit(1000).collect()]
    chains = [(a, b, c) for a in typed for b in typed if a[2] == b[0] for c in typed if c[0] == a[0] and c[2] == b[2]] if len(typed) < 1000 else None
    if chains is None or len(chains) > 100:
        return None
    of = lambda t, a, b: known.filter((F.col("r") == t[1]) & (kind(F.col("s")) == t[0]) & (kind(F.col("d")) == t[2])).select(F.col("s").alias(a), F.col("d").alias(b))
    parts = [known.select(F.col("r").alias("r1"), F.col("r").alias("r2"), F.col("r").alias("r3"), F.lit(0).cast("long").alias("n")).limit(0)]
    for first, second, third in chains:
        sides = of(first, "x", "y"), of(second, "y", "z"), of(third, "x", "z")
        size = sum(f.count() for f in sides)
        for corner, (i, j, k) in (("x", (0, 2, 1)), ("z", (1, 2, 0)), ("y", (0, 1, 2))):
            n = [sides[p].groupBy(corner).agg(F.count("*").alias(f"n{p}")) for p in (i, j)]
            pairs = n[0].join(n[1], corner).agg(F.sum(F.col(f"n{i}") * F.col(f"n{j}"))).first()[0] or 0
            if pairs <= FEW_PAIRS * size:
                break
        else:
            return None
        other = [c for c in ("x", "y", "z") if c != corner]
        found = sides[i].join(sides[j], corner).select(*other).join(sides[k], other).agg(F.count("*").alias("n"))
        parts.append(found.select(*[F.lit(t[1]).cast("long").alias(f"r{m + 1}") for m, t in enumerate((first, second, third))], "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0").groupBy("r1", "r2", "r3").agg(F.sum("n").alias("support"))


def chain_rules(known: DataFrame, min_support: int = 2, min_confidence: float = 0.2, cap: int | None = 1000, coding=None) -> DataFrame:
    """r1, r2, r3, body, support, confidence of r1(x,y) and r2(y,z) => r3(x,z).

    Bodies are products of degrees. Without a cap supports are counted triangle by triangle; with one,
    middle nodes of more pairs count with those that were drawn. ``coding``: ``known`` in numbers (known, rels, kind), if it is at hand.
    """
    known, rels = coded(known) if coding is None else (coding.known, coding.rels)
    if cap is None:
        support = None if coding is None else chains_by_kind(known, coding.kind)
        support = cut((closed_chains(known) if support is None else support).filter(F.col("support") >= min_support))
        into, out = _by_middle(known)
        few = lambda c: checked_broadcast(cut(support.select(c).distinct()))  # noqa: E731  a row for each relation
        body = _bodies(into.join(few("r1"), "r1", "left_semi"), out.join(few("r2"), "r2", "left_semi"))
    else:
        body, pairs = _pairs(known, cap)
        heads = known.select(F.col("s").alias("x"), F.col("r").alias("r3"), F.col("d").alias("z"))
        support = pairs.join(heads.hint("shuffle_hash"), ["x", "z"]).groupBy("r1", "r2", "r3").agg(F.count("*").alias("support"))
    rules = support.join(body, ["r1", "r2"]).withColumn("confidence", F.col("support").cast("double") / F.col("body"))
    rules = cut(rules.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)))
    for c in ("r1", "r2", "r3"):
        rules = rules.withColumnRenamed(c, "r").join(checked_broadcast(rels), "r").drop("r").withColumnRenamed("rel", c)
    return rules.select("r1", "r2", "r3", "body", "support", "confidence")


def symmetry_rules(known: DataFrame, min_support: int = 2, min_confidence: float = 0.2) -> DataFrame:
    """rel, body, support, confidence of r(u,v) => r(v,u); ordered pairs of different nodes count.

    A fact and the one that turns it round are rows of one unordered pair, so facts are shuffled once.
    """
    pairs = known.filter("src <> dst").groupBy("rel", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("n"))
    both = F.when(F.col("rel").isNotNull() & (F.col("n") == 2), F.col("n")).otherwise(0)
    rules = pairs.groupBy("rel").agg(F.sum("n").alias("body"), F.sum(both).alias("support")).withColumn("confidence", F.col("support").cast("double") / F.col("body"))
    return rules.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))


def smart_rules(known: DataFrame, cap: int | None = 1000, coding=None, entities: DataFrame | None = None) -> DataFrame:
    """kind, r1, r2, r3, support, confidence: priors, chains and symmetries."""
    none = F.lit(None).cast("string")
    prior = relation_priors(known, entities).select(F.lit("prior").alias("kind"), none.alias("r1"), none.alias("r2"), F.col("rel").alias("r3"), "support", "confidence")
    chain = chain_rules(known, cap=cap, coding=coding).select(F.lit("chain").alias("kind"), "r1", "r2", "r3", "support", "confidence")
    if coding is None:
        found = symmetry_rules(known)
    else:
        found = symmetry_rules(coding.known.select(F.col("s").alias("src"), F.col("r").alias("rel"), F.col("d").alias("dst"))).withColumnRenamed("rel", "r").join(F.broadcast(coding.rels), "r")
    symmetry = found.select(F.lit("symmetry").alias("kind"), F.col("rel").alias("r1"), none.alias("r2"), F.col("rel").alias("r3"), "support", "confidence")
    return prior.unionByName(chain).unionByName(symmetry)


def rule_text(kind: Column, r1: Column, r2: Column, r3: Column) -> Column:
    return (
        F.when(kind == "chain", F.concat(r1, F.lit("(x,y) ∧ "), r2, F.lit("(y,z) ⇒ "), r3, F.lit("(x,z)")))
        .when(kind == "symmetry", F.concat(r1, F.lit("(x,y) ⇒ "), r3, F.lit("(y,x)")))
        .otherwise(F.concat(r3, F.lit("(x,y)")))
    )


def parse_rule(text: str) -> tuple[list[tuple[str, str, str]], tuple[str, str, str]]:
    """Body and head atoms (relation, first, second) of a rule in text."""
    import re

    body, sep, head = text.partition("⇒") if "⇒" in text else text.partition("=>")
    if not sep:
        body, head = "", text
    atoms = lambda s: [(r.strip(), a.strip(), b.strip()) for r, a, b in re.findall(r"([^\s(∧,][^(∧]*)\(\s*([^,()]+),\s*([^,()]+)\)", s)]
    heads = atoms(head)
    if len(heads) != 1:
        raise ValueError(f"a rule has one head: {text!r}")
    return atoms(body), heads[0]


def is_variable(term: str) -> bool:
    return term.startswith("?") or term[:1].islower()


def groundings(known: DataFrame, r1: str, r2: str, r3: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """x, y, z, head_holds of bodies of a chain rule that hold; by hash at most ``limit``."""
    pairs = all_pairs(known.filter(F.col("rel").isin(r1, r2))).filter((F.col("r1") == r1) & (F.col("r2") == r2))
    heads = known.filter(F.col("rel") == r3).select(F.col("src").alias("x"), F.col("dst").alias("z"), F.lit(True).alias("h"))
    out = pairs.select("x", "y", "z").join(heads, ["x", "z"], "left").select("x", "y", "z", F.coalesce("h", F.lit(False)).alias("head_holds"))
    return out if limit is None else out.orderBy(F.xxhash64("x", "y", "z", F.lit(seed)), "x", "y", "z").limit(limit)


def counted_groundings(one: DataFrame, two: DataFrame, head: DataFrame) -> DataFrame:
    """x, bodies, heads: how many (x,y) and (y,z) meet at y, and how many of those have (x,z). Bodies aren't made, only counted.

    ``one``: x, y; ``two``: y, z; ``head``: x, z; each row once.
    """
    bodies = one.join(two.groupBy("y").agg(F.count("*").alias("n")), "y").groupBy("x").agg(F.sum("n").alias("bodies"))
    heads = one.join(head, "x").join(two, ["y", "z"], "left_semi").groupBy("x").agg(F.count("*").alias("heads"))
    return bodies.join(heads, "x", "left").select("x", "bodies", F.coalesce("heads", F.lit(0)).cast("long").alias("heads"))


def expected_by_first(one: DataFrame, two: DataFrame, head: DataFrame, default: float = 0.5) -> DataFrame:
    """x, expected: what ``expected_counts`` gives by x, of the same three with q each; a head that isn't known has ``default``.

    All bodies are counted by sums at y as though no head were known; those of known heads are put right.
    """
    at = two.groupBy("y").agg(F.count("*").alias("n"), F.sum("q").alias("q2"))
    every = one.join(at, "y").groupBy("x").agg(F.sum(F.col("n") - F.col("q") * F.col("q2") * (1 - default)).alias("every"))
    held = one.join(head.select("x", "z", F.col("q").alias("head_q")), "x").join(two.select("y", "z", F.col("q").alias("q2")), ["y", "z"])
    more = held.groupBy("x").agg(F.sum(F.col("q") * F.col("q2") * (F.col("head_q") - default)).alias("more"))
    return every.join(more, "x", "left").select("x", (F.col("every") + F.coalesce("more", F.lit(0.0))).alias("expected"))


#: Facts of one node that travel as one row, and bodies that a task holds, on the average.
LIST, BODIES = 4096, 1_000_000


def bodies_by_first(one: DataFrame, two: DataFrame) -> DataFrame:
    """x, z, body_q of each (x,y) and (y,z), in parts by x. The facts of y travel to x as arrays, not as a row each."""
    out = two.groupBy("y").agg(F.count("*").alias("n_out"))
    most, bodies = one.groupBy("y").agg(F.count("*").alias("n_in")).join(out, "y").agg(F.max("n_out"), F.sum(F.col("n_in") * F.col("n_out"))).first()
    low, high = two.agg(F.min("z"), F.max("z")).first()
    narrow = "int" if high is not None and -(1 << 31) <= low and high < 1 << 31 else "long"
    part = F.pmod(F.xxhash64("z"), F.lit(-(-most // LIST))) if (most or 0) > LIST else F.lit(0)
    lists = two.groupBy("y", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("z", "q"))).alias("to"))
    lists = lists.select("y", F.transform("to", lambda t: t["z"].cast(narrow)).alias("zs"), F.transform("to", lambda t: t["q"]).alias("qs"))
    moved = one.join(lists, "y").select("x", "q", "zs", "qs").repartition(max(1, -(-(bodies or 0) // BODIES)), "x")
    return moved.select("x", "q", F.explode(F.arrays_zip("zs", "qs")).alias("t")).select("x", F.col("t.zs").cast("long").alias("z"), (F.col("q") * F.col("t.qs")).alias("body_q"))


def with_probabilities(bound: DataFrame, q: DataFrame, r1: str, r2: str, r3: str, default: float = 0.5) -> DataFrame:
    """``bound`` (x, y, z) of a chain rule with the probabilities of body and head, ``body_q`` and ``head_q``. ``q``: src, rel, dst, q."""
    of = lambda rel, a, b, name: q.filter(F.col("rel") == rel).select(F.col("src").alias(a), F.col("dst").alias(b), F.col("q").alias(name))
    out = bound.join(of(r1, "x", "y", "q1"), ["x", "y"], "left").join(of(r2, "y", "z", "q2"), ["y", "z"], "left").join(of(r3, "x", "z", "head_q"), ["x", "z"], "left")
    return out.na.fill(default, ["q1", "q2", "head_q"]).withColumn("body_q", F.col("q1") * F.col("q2")).drop("q1", "q2")


def expected_counts(rows: DataFrame, *by: str) -> DataFrame:
    """``by`` and how many ground rules (body_q, head_q) are expected to hold, facts being independent."""
    return rows.groupBy(*by).agg(F.sum(1 - F.col("body_q") * (1 - F.col("head_q"))).alias("expected"))


def head_log_odds(rows: DataFrame, weight: float, *head: str) -> DataFrame:
    """``head`` columns, and a head's probability given the bodies that support it, at most 40 log-odds either way."""
    odds = F.sum(weight * F.col("body_q"))
    return rows.groupBy(*head).agg(sigmoid(clamp(odds, -40.0, 40.0)).alias("p"))


Atom = tuple[str, str, str]


def unified(known: DataFrame, atoms: list[Atom], of: tuple[str, str, str] = ("src", "rel", "dst")) -> DataFrame:
    """A column for each variable of ``atoms`` (relation, first, second): all bindings under which every atom is a fact.

    Atoms are joined in their order on the variables that they share with those before; constants are filters.
    """
    out = None
    src, rel, dst = of
    for name, first, second in atoms:
        rows = known.filter(F.col(rel) == name)
        for column, term in ((src, first), (dst, second)):
            if not is_variable(term):
                rows = rows.filter(F.col(column) == term)
        if first == second:
            rows = rows.filter(F.col(src) == F.col(dst))
        rows = rows.select(*{t: F.col(c).alias(t) for c, t in ((src, first), (dst, second)) if is_variable(t)}.values())
        if out is None:
            out = rows
        else:
            shared = [c for c in rows.columns if c in out.columns]
            if not shared:
                raise ValueError("an atom of a body must share a variable with those before it")
            out = out.join(rows, shared)
    return out


def ground_rule(known: DataFrame, body: list[Atom], head: Atom, limit: int = 1000, seed: int = 42, entities: DataFrame | None = None) -> DataFrame:
    """body, head (arrays of src, rel, dst), body_holds, head_holds: ground rules of a rule, ``limit`` at most.

    Half of them, by hash, have a body that holds; the rest bind variables to nodes drawn by hash, and
    are kept where the body doesn't hold: where an atom of it isn't a fact, which only facts of its few nodes can tell.
    ``entities``: the ids of ``known``, if they are at hand.
    """
    variables = list(dict.fromkeys(t for _, a, b in [*body, head] for t in (a, b) if is_variable(t)))
    bound = unified(known, body)
    order = F.xxhash64(*[F.col(c) for c in bound.columns], F.lit(seed))
    seen = bound.orderBy(order, *bound.columns).limit(limit // 2).withColumn("body_holds", F.lit(True))
    nodes = written(numbered(known.select(F.explode(F.array("src", "dst")).alias("id")).distinct() if entities is None else entities))
    n = nodes.count()
    draws = known.sparkSession.range(limit - limit // 2)
    for k, v in enumerate(variables):
        pick = F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(max(n, 1)))
        draws = draws.withColumn("k", pick).join(nodes.select(F.col("id").alias(v), "k"), "k").drop("k")
    free = cut(draws.drop("id").distinct())
    holds = free
    for a in body:
        one = unified(known, [a])
        if one.columns:
            near = one.join(checked_broadcast(free.select(*one.columns).distinct()), one.columns, "left_semi").distinct()
            holds = holds.join(near, one.columns, "left_semi")
        elif one.isEmpty():
            holds = holds.limit(0)
    free = free.join(holds.select(*bound.columns).distinct(), bound.columns, "left_anti").withColumn("body_holds", F.lit(False))
    both = seen.unionByName(free, allowMissingColumns=True).na.drop(subset=variables)
    term = lambda t: F.col(t) if is_variable(t) else F.lit(t)
    atom = lambda a: F.struct(term(a[1]).alias("src"), F.lit(a[0]).alias("rel"), term(a[2]).alias("dst"))
    made = both.select(F.array(*[atom(a) for a in body]).alias("body"), atom(head).alias("head"), "body_holds")
    heads = known.select(F.struct("src", "rel", "dst").alias("head"), F.lit(True).alias("h")).filter(F.col("head.rel") == head[0])
    return made.join(heads, "head", "left").select("body", "head", "body_holds", F.coalesce("h", F.lit(False)).alias("head_holds"))


def sampled(rows: DataFrame, n: int, by: str = "uniform", column: str | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows by hash: ``uniform``; ``weighted`` by a column of positive weights; ``stratified``, ``n`` of each value of a column."""
    names = [F.col(f"`{c}`") for c in rows.columns]
    u = (F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(1 << 52)) + 1).cast("double") / (1 << 52)
    if by == "uniform":
        return rows.withColumn("draw_of_row", u).orderBy("draw_of_row").limit(n).drop("draw_of_row")
    if by == "weighted":  # the least of exponential waits, each at its row's rate
        return rows.filter(F.col(column) > 0).withColumn("draw_of_row", -F.ln(u) / F.col(column)).orderBy("draw_of_row").limit(n).drop("draw_of_row")
    if by == "stratified":
        place = F.row_number().over(W.partitionBy(column).orderBy("draw_of_row"))  # cut to n a value before it is shuffled
        return rows.withColumn("draw_of_row", u).withColumn("place_of_row", place).filter(F.col("place_of_row") <= n).drop("draw_of_row", "place_of_row")
    raise ValueError(f"unknown way to sample {by!r}")


def batched(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``batch``: batches of some ``size`` rows, dealt by hash."""
    batches = max(1, -(-rows.count() // size))
    return rows.withColumn("batch", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.lit(seed)), F.lit(batches)))


def ground_rule_counts(grounded: DataFrame) -> DataFrame:
    """rule, groundings, satisfied of rows (rule, body_holds, head_holds); a body that fails counts as satisfied."""
    return grounded.groupBy("rule").agg(F.count("*").alias("groundings"), F.sum((~F.col("body_holds") | F.col("head_holds")).cast("int")).alias("satisfied"))


#: Tails that a task sets against the positives of a relation, where tails are too many to broadcast.
TAILS = 10_000


def corruptions(known: DataFrame, positives: DataFrame) -> DataFrame:
    """All facts that arise from ``positives`` by another tail of the same relation and aren't known.

    Few tails are broadcast; more are dealt to parts, each of which meets the positives of its relation in a task of its own.
    """
    tails = cut(known.select("rel", F.col("dst").alias("tail")).distinct())
    n = tails.count()
    if n <= MOST_BROADCAST:
        made = positives.join(F.broadcast(tails), "rel")
    else:
        parts = -(-n // TAILS)
        dealt = tails.withColumn("part", F.pmod(F.xxhash64("tail"), F.lit(parts)))
        made = positives.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(dealt, ["rel", "part"])
    return made.filter("tail <> dst").select("src", "rel", F.col("tail").alias("dst")).distinct().join(known, ["src", "rel", "dst"], "left_anti")


def _draws(n: int, per_side: int, seed: int) -> Column:
    """c, k: so many draws of a fact (src, rel, dst), each the number of a node."""
    return F.transform(F.sequence(F.lit(0), F.lit(2 * per_side - 1)), lambda c: F.struct(c.alias("c"), F.pmod(F.xxhash64("src", "rel", "dst", c, F.lit(seed)), F.lit(max(n, 1))).alias("k")))


def negative_samples(known: DataFrame, positives: DataFrame, per_side: int = 4, seed: int = 42, entities: DataFrame | None = None) -> DataFrame:
    """src, rel, dst: so many corrupted heads and tails of each positive, drawn by hash among the nodes, none known. ``entities``: the ids of ``known``, if they are at hand."""
    nodes = known.select(F.col("src").alias("id")).unionByName(known.select(F.col("dst").alias("id"))).distinct() if entities is None else entities
    numbers = written(numbered(nodes))
    draws = positives.select("src", "rel", "dst", F.explode(_draws(numbers.count(), per_side, seed)).alias("draw")).select("src", "rel", "dst", "draw.*").join(numbers, "k")
    made = draws.select(F.when(F.col("c") < per_side, F.col("id")).otherwise(F.col("src")).alias("src"), "rel", F.when(F.col("c") < per_side, F.col("dst")).otherwise(F.col("id")).alias("dst"))
    return made.filter("src <> dst").distinct().join(known, ["src", "rel", "dst"], "left_anti")


#: Relations that a packed draw has room for.
MOST_RELATIONS = 4096


def negative_codes(coding, entities: DataFrame, per_side: int = 4, seed: int = 42) -> DataFrame:
    """What ``negative_samples`` draws of all facts of a coding, by its numbers: s, r, d. A draw is two numbers wide."""
    numbers = written(numbered(entities).select("k", coding.number(F.col("id")).alias("node")))
    named = coding.known.join(F.broadcast(coding.rels), "r").select("s", "r", "d", coding.name(F.col("s")).alias("src"), "rel", coding.name(F.col("d")).alias("dst"))
    draws = named.select("s", "r", "d", F.explode(_draws(numbers.count(), per_side, seed)).alias("draw"))
    head = F.col("draw.c") < per_side
    narrow = draws.select(F.col("draw.k").alias("k"), (F.shiftleft(F.when(head, F.col("d")).otherwise(F.col("s")), 13) + F.shiftleft(F.col("r"), 1) + F.when(head, 1).otherwise(0)).alias("end"))
    made = narrow.join(numbers, "k")
    other, is_head = F.shiftright("end", 13), F.col("end").bitwiseAND(1) == 1
    made = made.select(F.when(is_head, F.col("node")).otherwise(other).alias("s"), F.shiftright("end", 1).bitwiseAND(4095).alias("r"), F.when(is_head, other).otherwise(F.col("node")).alias("d"))
    # one grouping tells drawn facts from known ones
    both = made.filter("s <> d").withColumn("known", F.lit(False)).unionByName(coding.known.select("s", "r", "d", F.lit(True).alias("known")))
    return both.groupBy("s", "r", "d").agg(F.bool_or("known").alias("known")).filter("NOT known").drop("known")


def hold_out(known: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """``known`` with ``is_known``: false for a share of facts, chosen by hash."""
    return known.withColumn("is_known", F.pmod(F.xxhash64("src", "rel", "dst", F.lit(seed)), F.lit(10_000)) >= int(share * 10_000))
