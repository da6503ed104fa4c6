"""SimHash near-dedup: pigeonhole blocks, Hamming check, components.

A fingerprint has 64 bits, each the majority of that bit in the hashes of a text's shingles. Two
fingerprints that differ in ``NEAR`` bits at most share one of ``NEAR + 1`` blocks of bits, so they
are compared within blocks. Equal fingerprints are one node, however many texts have them. A block's
group that grows over ``GROUP`` nodes is split again by the blocks of its other bits, by the same
principle, so no task holds an unbounded group and no near pair is lost. A group gives the edges of a
spanning forest only, not all near pairs. Components follow by alternating stars over edges.

Edge cases: a null text or one without words has fingerprint zero, which links like any other; a text
of fewer words than a shingle is one shingle; a null doc_id is larger than any other, and the
component of such rows alone is null; repeated rows share a component; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, shuffle_width, small_batches, table

SHINGLE, SEED, NEAR, BITS = 3, 42, 3, 64
#: Nodes of one block value that one task compares.
GROUP = 4096
#: With so few bits left, a group is split no further: it has 2 ** FEW nodes at most.
FEW = 12

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As a signed 64-bit number."""
    import xxhash

    flat = _SPACES.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)).strip(b" ")
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    n = len(gaps) + 1 - (shingle - 1)
    if n <= 1:
        return int(np.uint64(xxhash.xxh64_intdigest(flat, seed)).astype(np.int64))
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(flat[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64, n)
    # how often each byte value occurs in each of the 8 lanes, then bits of byte values
    lanes = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(n, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (lanes @ _TABLE).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE, seed: int = SEED, into: str = "fp") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the fingerprint of its text."""
    from pyspark.sql.types import LongType, StructType

    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text_of_row"))
    schema = StructType(rows.schema.fields[:-1]).add(into, LongType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t, shingle, seed) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], into])

    return rows.mapInArrow(run, schema)


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    edges = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _masked(bits: Iterable[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _near_edges(near: int):
    """Sorted rows (key, fp) to the edges of a spanning forest of near fingerprints within each key."""

    def linked(fps: np.ndarray) -> list[tuple[int, int]]:
        parent = list(range(len(fps)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        if len(fps) > 2048:  # rows against the rest: the square stays small in memory
            pairs = ((i, i + 1 + np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= near)) for i in range(len(fps) - 1))
        else:
            a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= near, 1))
            pairs = ((i, [j]) for i, j in zip(a.tolist(), b.tolist(), strict=True))
        for i, js in pairs:
            for j in js:
                x, y = root(i), root(int(j))
                if x != y:
                    parent[y] = x
                    out.append((int(fps[i]), int(fps[j])))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate([[0], cuts, [len(keys)]])
            sizes = np.diff(bounds)
            for k in np.flatnonzero(sizes > 8):
                found += linked(fps[bounds[k] : bounds[k + 1]].view(np.uint64))
            # short groups, which are most, all at once: each row with the one d rows behind
            a, b = [], []
            small = np.repeat(sizes <= 8, sizes)
            for d in range(1, 8):
                near_by = (keys[:-d] == keys[d:]) & small[:-d] if len(keys) > d else np.zeros(0, bool)
                at = np.flatnonzero(near_by)
                at = at[np.bitwise_count((fps[at] ^ fps[at + d]).view(np.uint64)) <= near]
                a.append(fps[at])
                b.append(fps[at + d])
            left = np.concatenate([*a, np.array([x for x, _ in found], np.uint64).view(np.int64)])
            right = np.concatenate([*b, np.array([y for _, y in found], np.uint64).view(np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if whole:
                yield edges(keys[:whole], fps[:whole])
            held_key, held = keys[whole:], fps[whole:]
        if len(held):
            yield edges(held_key, held)

    return run


def near_edges(nodes: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """(a, b): near pairs of ``nodes`` (distinct fp), as many as connect what is connected within a block.

    A path is the blocks that rows have been dealt by. Groups over ``group`` go on to the blocks of the
    bits that their path leaves, all paths in one table; at few bits left a group can't be large.
    """
    spark, parts = nodes.sparkSession, near + 1
    paths, todo, done = [list(range(BITS))], nodes.select("fp", F.lit(0).alias("path")), None
    while todo is not None:
        longer = [(path, block) for path in paths for block in _blocks(path, parts)]
        paths = [[b for b in path if b not in block] for path, block in longer]
        masks = F.array(*[F.lit(_masked(set(range(BITS)) - set(path))) for path in paths])
        rows = todo.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.col("path") * parts + k)).alias("path"))
        rows = rows.select("fp", "path", F.xxhash64("path", F.col("fp").bitwiseAND(masks[F.col("path")])).alias("key"))
        todo, last = None, max(map(len, paths)) <= FEW
        if not last:
            hot = cut(rows.groupBy("key").count().filter(F.col("count") > group).select("key"))
            if not hot.isEmpty():
                todo = cut(rows.join(hot, "key", "left_semi").select("fp", "path"))
                rows = rows.join(hot, "key", "left_anti")
        rows = rows.select("key", "fp")
        done = rows if done is None else done.unionByName(rows)
    return done.repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "fp").mapInArrow(_near_edges(near), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root the smallest node reachable.

    Large and small stars by turns: each round links the neighbours of a node to the smallest of
    them. The edges end as stars around the roots after a number of rounds that grows with the
    logarithm of the longest path. Neighbours are never gathered: a round is a minimum and a join.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: larger neighbours of a node go to its smallest
        large = both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down.withColumnRenamed("b", "n"), F.col("b") == F.col("n"))
        after = cut(small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(down.select(F.col("m").alias("a"), "b")).filter("a < b").distinct())
        told = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == before:
            return after.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(after.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before, edges = told, after


def roots(marked: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """(fp, root) of each fingerprint of ``marked``; a component has one root."""
    nodes = cut(marked.select("fp").distinct())
    linked = components(near_edges(nodes, near, group))
    return nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_classes(docs: DataFrame, near: int = NEAR, shingle: int = SHINGLE, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    marked = cut(fingerprints(docs, "doc_id", shingle=shingle, seed=seed))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots(marked, near, group), "fp")
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(least.join(smallest, "root").select(F.col("fp").alias("of_fp"), "component_id"))
    return marked.join(of, F.col("fp") == F.col("of_fp")).drop("of_fp")


def drop_near(docs: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and of equal ones the first."""
    (place,) = fresh(docs, "place")
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    marked = cut(fingerprints(placed, place, "doc_id"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", place)
    of = marked.groupBy("fp").agg(F.min(rank).alias("first")).join(roots(marked, near, group), "fp")
    kept = cut(of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first").getField(place).alias(place)))
    return placed.join(kept, place, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
