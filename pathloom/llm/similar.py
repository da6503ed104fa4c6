"""SimHash near-dedup with an exact check: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Candidates are made as in ``simhash``: fingerprints, pigeonhole blocks, Hamming check. They are
checked by the sets. Three bits miss many such pairs, and so many bits that none is missed leave no
blocks to deal by; so an exact join finds the pairs that the fingerprints miss.

All such pairs are found, not most of them. In any one order of all shingles, two sets that are so
similar share one of the first ``n - ceil(0.8 n) + 1`` of either, so texts are compared where they
share one of those (prefix filter). The order puts shingles last that a sample of texts shows to be
common, so a common passage makes no large groups; how good the sample is changes costs, not results.
Pairs whose sizes or parity bitmaps rule 0.8 out are left out, the others are checked by their sets.

Equal sets are one node. A group's pairs are made in two rounds: neighbours by size and by node, checked
with the pairs of near fingerprints, and only then all pairs of texts that aren't linked yet, so a large group of copies isn't squared.

Edge cases are those of ``simhash``: ASCII case and white space don't count; a text of fewer words
than a shingle is one shingle; null texts and texts without words are alike; the row that stays of a
component has the smallest doc_id, null being the largest, and of equal ones is the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checked_broadcast, cut, fresh, shuffle_width, small_batches
from .simhash import _LOWER, _SPACES, NEAR, SEED, components

SHINGLE, SIMILAR = 5, 0.8
#: Neighbours on each side that a row of a group is compared with before the last round.
REACH = 3
#: One text of so many tells which shingles are common; those of at least ``OFTEN`` such texts, ``MOST`` of them.
SAMPLE, OFTEN, MOST = 8, 8, 100_000
_WORDS = 4


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending."""
    import xxhash

    flat = _SPACES.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)).strip(b" ")
    if not flat:
        return np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    n = max(len(gaps) + 2 - shingle, 1)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(flat[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64, n).view(np.int64))


def parities(s: np.ndarray) -> np.ndarray:
    """Bytes of a bitmap: whether each cell has an odd number of a set's members. Two differ in as many bits as the sets do in members at most."""
    cells = max(64 * _WORDS, 1 << (2 * len(s) - 1).bit_length() if len(s) else 0)
    return np.packbits(np.bincount(s & (cells - 1), minlength=cells).astype(np.uint8) & 1)


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes of the same set."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, size), axis=0)


def _columns(docs: DataFrame, fields: str, made, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and what ``made`` gives for a batch of texts: arrays for ``fields``."""
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text_of_row"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(fields).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = made(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=schema.names)

    return rows.mapInArrow(run, schema)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def shingle_sets(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of ``docs`` and s, the set of its text."""
    return _columns(docs, "s array<long>", lambda texts: [_lists([shingles(t, shingle) for t in texts])], *keep)


def common(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Shingles that many texts of a sample have, the rarest first."""
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    seen = shingle_sets(sample, shingle=shingle).select(F.explode("s").alias("key")).groupBy("key").count().filter(F.col("count") >= OFTEN)
    found = seen.orderBy(F.col("count").desc(), "key").limit(MOST).collect()  # bounded
    return np.array([r["key"] for r in reversed(found)], np.int64)


def marks(docs: DataFrame, *keep: str, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of ``docs`` with node (one for equal sets), n, fp, bits, wide and keys.

    Fp is the text's fingerprint. Bits and wide are the parities of the set's cells, of 256 cells and of twice as many as the set has. The keys are the shingles by which a set meets all that are similar to it.
    """
    hot = common(docs, shingle)
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))  # MOST at most

    def prefix(s: np.ndarray) -> np.ndarray:
        known, place = shared.value
        rank = np.zeros(len(s), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            rank = np.where(known[at] == s, 1 + place[at], 0)
        return s[np.argsort(rank, kind="stable")[: len(s) - math.ceil(similar * len(s) - 1e-9) + 1]]

    def made(texts: list[str | None]) -> list[pa.Array]:
        import xxhash

        sets = [shingles(t, shingle) for t in texts]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        wide = [parities(s) for s in sets]
        bits = [folded(w, 8 * _WORDS).tobytes() for w in wide]
        fps = pa.array([simhash.fingerprint(t) for t in texts], pa.int64())
        return [pa.array(node), pa.array([len(s) for s in sets], pa.int32()), fps, pa.array(bits, pa.binary()), pa.array([w.tobytes() for w in wide], pa.binary()), _lists([prefix(s) for s in sets])]

    return _columns(docs, "node long, n int, fp long, bits binary, wide binary, keys array<long>", made, *keep)


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node), sorted, without repeated ones and keys of one node; a row waits until the next differs."""
    key, node, out = np.zeros(0, np.int64), np.zeros(0, np.int64), True
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        node = np.concatenate([node, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(key) < 2:
            continue
        first = np.r_[True, (np.diff(key) != 0) | (np.diff(node) != 0)]
        key, node = key[first], node[first]
        same = key[1:] == key[:-1]
        # of the row that waits, ``out`` says whether it has been seen to be alone
        met = np.r_[not out, same] | np.r_[same, False]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][met[:-1]]), pa.array(node[:-1][met[:-1]])], names=["key", "node"])
        out = not met[-1]
        key, node = key[-1:], node[-1:]
    if len(key) and not out:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])


def _candidates(similar: float, whole: bool):
    """Rows (key, node, n, root, bits), sorted by key, to pairs that may be similar and have different roots."""

    def may(n: np.ndarray, root: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of places pass."""
        fit = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= similar * np.maximum(n[a], n[b]) - 1e-9)
        a, b, at = a[fit], b[fit], np.flatnonzero(fit)
        return at[np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= _most(n[a] + n[b], similar)]

    def found(keys, nodes, n, root, bits) -> pa.RecordBatch:
        left, right = [], []

        def take(a: np.ndarray, b: np.ndarray) -> None:
            at = may(n, root, bits, a, b)
            left.append(nodes[a[at]])
            right.append(nodes[b[at]])

        if whole:
            bounds = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)]
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if y - x <= REACH + 1:
                    continue  # compared before
                _, of, count = np.unique(root[x:y], return_inverse=True, return_counts=True)
                group = np.arange(x, y)
                for i in x + np.flatnonzero(of != count.argmax()):
                    take(np.full(len(group), i), group)
        else:
            for order in (np.arange(len(keys)), np.lexsort((n, keys))):  # rows come by node
                for d in range(1, REACH + 1):
                    at = np.flatnonzero(keys[order[:-d]] == keys[order[d:]])
                    take(order[at], order[at + d])
        a, b = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        key, node, n, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        bits = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, _WORDS)
        return [key, node, n.astype(np.int64), root, bits]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            last = now[0][-1]
            if held and held[0][0][0] == last:
                held.append(now)  # all of one key, which may go on
                continue
            now = [np.concatenate(c) for c in zip(*held, now, strict=True)]
            start = np.flatnonzero(now[0] != last)
            cut_at = int(start[-1]) + 1 if len(start) else 0
            if cut_at:
                yield found(*(c[:cut_at] for c in now))
            held = [[c[cut_at:] for c in now]]
        if held:
            yield found(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _most(both: np.ndarray, similar: float) -> np.ndarray:
    """In how many members similar sets of so many together differ at most."""
    return both - 2 * np.ceil(both * similar / (1 + similar) - 1e-9)


def _by_bitmaps(similar: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(w, np.uint8) for w in batch.column(k).to_pylist()] for k in (3, 4))
            differ = np.array([np.bitwise_count(folded(a, size := min(len(a), len(b))) ^ folded(b, size)).sum(dtype=np.int64) for a, b in zip(x, y, strict=True)], np.int64)
            kept = pa.array(differ <= _most(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), similar))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in range(2)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, about: DataFrame, docs: DataFrame, similar: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar: by their bitmaps, and what these leave by the sets."""
    of = lambda end, df, *cols: df.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in cols])
    wide = pairs.join(of("a", about, "n", "wide"), "a").join(of("b", about, "n", "wide"), "b")
    left = cut(wide.select("a", "b", F.expr("n_a + n_b"), "wide_a", "wide_b").mapInArrow(_by_bitmaps(similar), "a long, b long"))
    ids = cut(about.join(checked_broadcast(left.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi").select("node", "at"))
    sets = cut(shingle_sets(docs.join(checked_broadcast(ids), "at"), "node", shingle=shingle))
    both = left.join(of("a", sets, "s"), "a").join(of("b", sets, "s"), "b")
    same = both.select("a", "b", (F.size("s_a") + F.size("s_b")).alias("n"), F.size(F.array_intersect("s_a", "s_b")).alias("k"))
    return same.filter(F.col("k") >= similar * (F.col("n") - F.col("k")) - 1e-9).select("a", "b")


def near_pairs(marked: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b): nodes of ``marked`` whose fingerprints are near, as many pairs as connect what is connected within a block."""
    of = cut(marked.select("fp", "node").distinct())
    first = cut(of.groupBy("fp").agg(F.min("node").alias("first")))
    end = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"first_{name}"))
    across = cut(simhash.near_edges(first.select("fp"), near)).join(end("a"), "a").join(end("b"), "b").select("first_a", "first_b")
    both = of.join(first, "fp").select("first", "node").union(across).toDF("a", "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")


def roots(docs: DataFrame, marked: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """(node, root) of each node of ``marked`` that is linked to another; a component has one root. Both have ``at``, the row's place."""
    width = shuffle_width(marked.sparkSession)
    keys = marked.select(F.explode("keys").alias("key"), "node").repartition(width, "key").sortWithinPartitions("key", "node")
    about = marked.groupBy("node").agg(F.min(F.struct("at", "n", "bits", "wide")).alias("of")).select("node", "of.*")
    shared = cut(keys.mapInArrow(_shared, "key long, node long"))
    about = cut(about.join(checked_broadcast(shared.select("node").distinct()), "node", "left_semi"))

    def in_groups(whole: bool) -> DataFrame:
        of = about if edges is None else about.join(linked, "node", "left")
        of = cut(of.select("node", "n", (F.col("node") if edges is None else F.coalesce("root", "node")).alias("root"), "bits"))
        dealt = shared.join(checked_broadcast(of), "node").select("key", "node", "n", "root", "bits").repartition(width, "key").sortWithinPartitions("key", "node")
        found = dealt.mapInArrow(_candidates(similar, whole), "a long, b long")
        return cut(found.distinct()) if whole else found

    edges, linked = None, about.select("node", F.col("node").alias("root")).limit(0)
    for whole in (False, True):
        pairs = in_groups(whole) if whole else cut(near_pairs(marked, near).union(in_groups(whole)).distinct())
        if pairs.isEmpty():
            continue
        new = cut(_verified(pairs, about, docs, similar, shingle))
        if new.isEmpty():
            continue
        edges = new if edges is None else edges.unionByName(new)
        linked = cut(components(edges))
    return linked


def drop_similar(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and of equal ones the first."""
    (place,) = fresh(docs, "place")
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    rows = placed.select(F.col(place).alias("at"), F.col("doc_id").alias("id"), "text")
    marked = cut(marks(rows, "at", "id", similar=similar, shingle=shingle))
    first = marked.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first")).join(roots(rows, marked, similar, shingle, near), "node", "left")
    kept = cut(first.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.at").alias(place)))
    return only(placed, place, kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def only(placed: DataFrame, place: str, kept: DataFrame, rows: int = 500_000) -> DataFrame:
    """The rows of ``placed`` whose place is one of ``kept``'s, distinct.

    Places are packed as a mask for each 64. If the masks are counted to be few they are broadcast, and no text moves; else rows meet them in a join.
    """
    block, bit, mask = fresh(placed, "block_of", "bit_of", "mask_of")
    of = lambda df: df.withColumn(block, F.shiftright(place, 6)).withColumn(bit, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(place) % 64).cast("int")))
    masks = cut(of(kept).groupBy(block).agg(F.bit_or(bit).alias(mask)))
    met = of(placed).join(checked_broadcast(masks, rows), block)  # 16 bytes a row
    return met.filter(F.col(bit).bitwiseAND(F.col(mask)) != 0)
