"""Exact top-k search by inner product on a bit-sliced index.

Vectors are quantised to ``floor(256 * x)``. A block of rows is held as bitmaps, one for each bit of
each component. A query's scores are themselves bit slices: for each bit of the query's components,
highest first, the sum so far is doubled and the slices of the components with that bit are added,
with ANDs and XORs over bitmaps. The top k rows are then found from the most significant slice
downward, and rows that are equal in all slices are resolved by smaller vec_id.

Rows and queries are dealt to cells of a grid, so a task holds ``ROWS`` rows and ``QUERIES`` queries
however large the table is, and each cell gives k rows a query for the final ranking. Every query must
meet every row, so the work is their product; what is sent is each row once for ``QUERIES`` queries and
each query once for ``ROWS`` rows. Tables that fill few cells are cut finer, to have ``CELLS`` of them.

Edge cases: a vector that is null, or holds a null or non-finite component, takes no part; nor does a
null vec_id. Components that a shorter vector lacks count as 0. Rows with the query's vec_id are its
own; other repeated rows are candidates each. A query id that repeats asks once, with its smallest
vector. Fewer candidates than k give fewer rows; empty tables give empty results; further columns, of
any names, are ignored. Ties go to the smaller vec_id. Scores are whole numbers of 64 bits: a pair that
might pass 2^62 raises an OverflowError, as no score would be right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SCALE, K, EVERY = 256, 5, 50
ROWS, QUERIES, CELLS = 131_072, 32_768, 64
#: Bits of a slice that are scored at once: queries times rows.
AT_ONCE = 1 << 20
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, codes of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("codes"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), width), np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


class BitSliced:
    """Slices of non-negative attributes of rows; ``slices[attribute][bit]`` is a bitmap in 64-bit words."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.words = -(-n // 64)
        bits = max(1, int(values.max(initial=0)).bit_length())
        padded = np.zeros((values.shape[1], self.words * 64), np.int64)
        padded[:, :n] = values.T
        self.slices = [[np.packbits((column >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(bits)] for column in padded]
        self.rows = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def scores(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the weighted sums; each has a bitmap for each row of ``weights``."""
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        total: list[np.ndarray] = []
        for level in range(int(weights.max(initial=0)).bit_length() - 1, -1, -1):
            if total:
                total.insert(0, np.zeros_like(total[0]))
            for attribute, w in zip(self.slices, (weights >> level & 1).T, strict=True):
                if not w.any():
                    continue
                mask = np.where(w, full, np.uint64(0))[:, None]
                carry = None
                for b, x in enumerate(attribute):
                    x = x & mask
                    if b == len(total):
                        total.append(x if carry is None else x ^ carry)
                        carry = None if carry is None else x & carry
                        continue
                    was = total[b]
                    half = was ^ x
                    if carry is None:
                        total[b], carry = half, was & x
                    else:
                        total[b], carry = half ^ carry, (was & x) | (half & carry)
                b = len(attribute)
                while carry is not None and carry.any():
                    if b == len(total):
                        total.append(carry)
                        break
                    total[b], carry = total[b] ^ carry, total[b] & carry
                    b += 1
        return total

    def top(self, slices: list[np.ndarray], among: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
        """For each query the rows of its k largest sums; of equal ones at the boundary, the first rows."""
        sure, equal = np.zeros_like(among), among.copy()
        for s in reversed(slices):
            more = sure | (equal & s)
            count = np.bitwise_count(more).sum(axis=1)[:, None]
            over = count > k
            equal = np.where(over, equal & s, np.where(count == k, np.uint64(0), equal & ~s))
            sure = np.where(over, sure, more)
        out = []
        for a, b in zip(sure, equal, strict=True):
            rows = np.flatnonzero(np.unpackbits(a.view(np.uint8), bitorder="little"))
            if len(rows) < k and b.any():
                rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(b.view(np.uint8), bitorder="little"))[: k - len(rows)]])
            out.append(rows)
        return out


def search_block(ids: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best rows for each query."""
    order = np.argsort(ids, kind="stable")
    ids, codes = ids[order], codes[order]
    if float(np.abs(codes).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, codes.shape[1]) >= 1 << 60:
        raise OverflowError("scores of these vectors may not fit into 64 bits")
    # shift both sides to be non-negative; what the shift of a query adds differs by row: an attribute
    low, q_low = min(0, int(codes.min(initial=0))), min(0, int(queries.min(initial=0)))
    shifted = codes - low
    sums = shifted.sum(axis=1)
    most = int(sums.max(initial=0))
    index = BitSliced(np.column_stack([shifted, most - sums]))
    weights = np.column_stack([queries - q_low, np.full(len(queries), -q_low)])
    same = -q_low * most
    constant = low * (queries - q_low).sum(axis=1) + q_low * low * codes.shape[1] - same
    out = []
    step = max(1, AT_ONCE // (64 * index.words))
    for at in range(0, len(queries), step):
        part = slice(at, at + step)
        slices = index.scores(weights[part])
        among = np.repeat(index.rows[None, :], len(query_ids[part]), axis=0)
        for row, q in zip(among, query_ids[part], strict=True):
            a, b = np.searchsorted(ids, q), np.searchsorted(ids, q, "right")
            for p in range(a, b):
                row[p // 64] &= ~(np.uint64(1) << np.uint64(p % 64))
        for j, (q, rows) in enumerate(zip(query_ids[part], index.top(slices, among, k), strict=True)):
            for p in rows.tolist():
                value = sum(int(s[j, p // 64] >> np.uint64(p % 64) & np.uint64(1)) << b for b, s in enumerate(slices))
                out.append((int(q), int(ids[p]), value + int(constant[at + j])))
    return out


def _cell(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if rows.num_rows and queries.num_rows:
            width = max(max(map(len, t.column("codes").to_pylist()), default=0) for t in (rows, queries))
            found = search_block(rows.column("vec_id").to_numpy(), _matrix(rows.column("codes"), width), queries.column("vec_id").to_numpy(), _matrix(queries.column("codes"), width), k)
        return pa.table([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _upto(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``vectors`` for each of ``queries`` (vec_id, embedding)."""
    base, asked = quantised(vectors, scale), quantised(queries, scale).groupBy("vec_id").agg(F.min("codes").alias("codes"))
    n, across = vectors.count(), max(1, -(-queries.count() // QUERIES))
    down = max(1, -(-n // rows), min(CELLS // across, n // 1024))
    # by place, not by id, so repeated ids don't gather in one cell
    base = base.withColumn("r", F.monotonically_increasing_id() % down).withColumn("s", F.explode(_upto(across)))
    asked = asked.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("long")).withColumn("r", F.explode(_upto(down)))
    found = base.groupBy("r", "s").cogroup(asked.groupBy("r", "s")).applyInArrow(_cell(k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS codes
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.codes, c.codes) AS BIGINT) AS score
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
