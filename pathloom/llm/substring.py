"""Substring dedup by fixed-block anchors: repeats of ``WINDOW`` words or more.

Index: the non-overlapping blocks of ``BLOCK`` words of every document, from its start. A window of
``2 * BLOCK - 1`` words always holds one of them whole. Probe: every rolling block of every document.
A hit is a rolling block that is an indexed block of another document. Only windows around hits are
extended: each gets a 96-bit hash of its words, and one that a document of smaller id has too is a
repeat; the words that repeats cover are the maximal exact repeats, and go.

Edge cases: a null or empty text has no words; rows of equal doc_id don't remove from each other; a
null doc_id is larger than any id; a long text is a chunk alone, whole; empty tables give empty
results; further columns, of any names, are ignored.
Blocks are told apart by some 40 bits, which may only give hits too many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .common import cut, shuffle_width, small_batches, table

WINDOW = 13
SENT1 = "bucket long, chunk long, indexed binary, low binary"
SENT2 = "bucket long, chunk long, high binary, more binary, least binary"
ANSWER = "chunk long, round int, bucket long, flags binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

U = np.uint64


@lru_cache(1)
def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers: of byte values (white space 0), of places in a word, of places in a window (two sets)."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    of_byte, of_place, of_word = (rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) | U(1) for n in (256, 256, 128))
    of_byte[[32, 9, 10, 11, 12, 13]] = 0
    return of_byte, of_place, of_word


class Words:
    """The words of a chunk: hashes, the document of each, and where that ends."""

    def __init__(self, docs: C.Docs):
        of_byte, of_place, _ = _numbers()
        data, n = docs.data, len(docs.data)
        value = of_byte[data]
        solid = value != 0
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        at = docs.offsets[:-1][docs.offsets[:-1] < n]
        begins[at] = solid[at]
        self.starts = np.flatnonzero(begins)
        self.hash = np.zeros(0, np.uint64)
        if len(self.starts):
            first = self.starts[0]
            place = np.arange(first, n) - np.repeat(self.starts, np.diff(np.append(self.starts, n)))
            if place.max() > 255:  # spaces after a word may reach there; long words get a hash of their own
                np.minimum(place, 255, out=place)
            value = value[first:] * of_place[place]
            self.hash = np.add.reduceat(value, self.starts - first)
            lengths = np.add.reduceat(solid[first:].astype(np.int64), self.starts - first)
            for k in np.flatnonzero(lengths > 255):
                word = data[self.starts[k] : self.starts[k] + lengths[k]].tobytes()
                self.hash[k] = U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
            self.hash = C.mixed(self.hash ^ lengths.astype(np.uint64))
        self.first = np.searchsorted(self.starts, docs.offsets)  # first word of each document
        counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(docs)), counts)
        self.left = np.repeat(self.first[1:], counts) - np.arange(len(self.hash))  # words from here to the document's end
        self.of_doc = np.arange(len(self.hash)) - np.repeat(self.first[:-1], counts)
        self.ids = docs.ids[self.doc] if len(docs) else np.zeros(0, np.int64)

    def rolling(self, width: int, family: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of ``width`` words from every place (or each of ``at``); a place must have so many left."""
        numbers = _numbers()[2][family * 64 :]
        if at is None:
            n = max(0, len(self.hash) - width + 1)
            out = np.zeros(n, np.uint64)
            for k in range(width):
                out += self.hash[k : k + n] * numbers[k]
        else:
            out = np.zeros(len(at), np.uint64)
            for k in range(width):
                out += self.hash[at + k] * numbers[k]
        return C.mixed(out)


class Probes:
    """The distinct rolling blocks of a chunk in order of bucket and hash, and which documents have them."""

    def __init__(self, words: Words, block: int, buckets: int):
        self.words, self.buckets = words, buckets
        self.at = np.flatnonzero(words.left[: max(0, len(words.hash) - block + 1)] >= block)
        h = words.rolling(block, 0)[self.at]
        key = ((h >> U(32)) % U(buckets)) << U(32) | (h & U(0xFFFFFFFF))
        self.order = np.argsort(key, kind="stable")
        key, ids = key[self.order], words.ids[self.at][self.order]
        indexed = words.of_doc[self.at][self.order] % block == 0
        self.begin = C.firsts(key)
        self.key = key[self.begin]
        self.edges = np.searchsorted(self.key, np.arange(buckets + 1, dtype=np.uint64) << U(32))
        if len(self.begin):
            self.indexed = np.logical_or.reduceat(indexed, self.begin)
            least = np.minimum.reduceat(np.where(indexed, ids, C.NO_ID), self.begin)
            self.hit = self.indexed & (least < np.maximum.reduceat(ids, self.begin))
        else:
            self.indexed = self.hit = np.zeros(0, bool)

    def hits(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each word of the chunk, whether a hit begins there."""
        hit = self.hit.copy()
        for b, flags in answers.items():
            a, z = self.edges[b], self.edges[b + 1]
            hit[a:z] |= C.unbits(flags, z - a)
        out = np.zeros(len(self.words.hash), bool)
        out[self.at[self.order]] = C.spread(hit, self.begin, len(self.order)) if len(hit) else False
        return out


class Windows:
    """The distinct windows of a chunk around hits, in order of bucket and hash."""

    def __init__(self, words: Words, hits: np.ndarray, window: int, block: int, buckets: int):
        around = C.in_next(hits, window - block + 1) & (words.left >= window)
        self.at = np.flatnonzero(around)
        high = words.rolling(window, 0, self.at)
        more = (words.rolling(window, 1, self.at) >> U(32)).astype(np.uint32)
        bucket = (high % U(buckets)).astype(np.int64)
        self.order = np.lexsort((more, high, bucket))
        bucket, high, more, ids = bucket[self.order], high[self.order], more[self.order], words.ids[self.at][self.order]
        self.begin = C.firsts(high, more)
        self.high, self.more = high[self.begin], more[self.begin]
        self.least = np.minimum.reduceat(ids, self.begin) if len(ids) else ids
        self.edges = np.searchsorted(bucket[self.begin], np.arange(buckets + 1))
        self.words, self.ids = words, ids

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each word, whether a window begins there that a document of smaller id has."""
        earlier = np.zeros(len(self.high), bool)
        for b, flags in answers.items():
            a, z = self.edges[b], self.edges[b + 1]
            earlier[a:z] = C.unbits(flags, z - a)
        out = np.zeros(len(self.words.hash), bool)
        n = len(self.order)
        if n:
            out[self.at[self.order]] = C.spread(earlier, self.begin, n) | (C.spread(self.least, self.begin, n) < self.ids)
        return out


def _probe(window: int, block: int, buckets: int):
    schema = C.arrow_schema(SENT1)

    def work(chunk: int, docs: C.Docs) -> Iterator[tuple]:
        probes = Probes(Words(docs), block, buckets)
        for b in range(buckets):
            a, z = probes.edges[b], probes.edges[b + 1]
            if a < z:
                yield b, chunk, C.bits(probes.indexed[a:z]), C.planes((probes.key[a:z] & U(0xFFFFFFFF)).astype("<u4"))

    return lambda batches: C.by_chunk(batches, work, schema)


def _match(sent: pa.Table) -> pa.Table:
    """Of each block, whether several chunks have it and one of them in its index."""
    bucket = sent.column("bucket")[0].as_py()
    low = [C.unplanes(x, "<u4") for x in sent.column("low").to_pylist()]
    indexed = [C.unbits(x, len(v)) for x, v in zip(sent.column("indexed").to_pylist(), low, strict=True)]
    return _answers(1, bucket, sent.column("chunk").to_pylist(), low, _matched(np.concatenate(low), np.concatenate(indexed)))


def _matched(low: np.ndarray, indexed: np.ndarray) -> np.ndarray:
    order = np.argsort(low, kind="stable")
    begin = C.firsts(low[order])
    size = np.diff(np.append(begin, len(low)))
    out = np.zeros(len(low), bool)
    out[order] = np.repeat((size > 1) & np.logical_or.reduceat(indexed[order], begin), size)
    return out


def _answers(number: int, bucket: int, chunks: list[int], parts: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    rows, at = [], 0
    for chunk, part in zip(chunks, parts, strict=True):
        own = flags[at : at + len(part)]
        at += len(part)
        if own.any():
            rows.append((chunk, number, bucket, C.bits(own)))
    return pa.Table.from_batches([C.record(rows, C.arrow_schema(ANSWER))])


def _answered(answers: pa.Table, number: int) -> dict[int, bytes]:
    return {r["bucket"]: r["flags"] for r in answers.to_pylist() if r["round"] == number}


def _windows(docs: C.Docs, answers: pa.Table, window: int, block: int, buckets: int) -> Windows:
    words = Words(docs)
    return Windows(words, Probes(words, block, buckets).hits(_answered(answers, 1)), window, block, buckets)


def _extend(window: int, block: int, buckets: int):
    schema = C.arrow_schema(SENT2)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            w = _windows(C.Docs(rows), answers, window, block, buckets)
            for b in range(buckets):
                a, z = w.edges[b], w.edges[b + 1]
                if a < z:
                    out.append((b, rows.column("chunk")[0].as_py(), C.planes(w.high[a:z]), C.planes(w.more[a:z]), C.planes(w.least[a:z])))
        return pa.Table.from_batches([C.record(out, schema)])

    return run


def _earlier(sent: pa.Table) -> pa.Table:
    """Of each window, whether another chunk has it in a document of smaller id."""
    high, more, least = ([C.unplanes(x, k) for x in sent.column(c).to_pylist()] for c, k in (("high", "<u8"), ("more", "<u4"), ("least", "<i8")))
    h, m, ids = np.concatenate(high), np.concatenate(more), np.concatenate(least)
    order = np.lexsort((m, h))
    begin = C.firsts(h[order], m[order])
    flags = np.zeros(len(h), bool)
    flags[order] = C.spread(np.minimum.reduceat(ids[order], begin), begin, len(h)) < ids[order]
    return _answers(2, sent.column("bucket")[0].as_py(), sent.column("chunk").to_pylist(), high, flags)


def _kept(window: int, block: int, buckets: int):
    schema = C.arrow_schema(RESULT)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            docs = C.Docs(rows)
            w = _windows(docs, answers, window, block, buckets)
            covered = C.in_last(w.repeated(_answered(answers, 2)), window)
            for k, doc_id in enumerate(docs.doc_ids.to_pylist()):
                words, gone = docs.bytes_of(k).split(), covered[w.words.first[k] : w.words.first[k + 1]]
                kept = words if not gone.any() else compress(words, ~gone)
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.Table.from_batches([C.record(out, schema)])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    block, buckets = (window + 1) // 2, shuffle_width(spark)
    rows = C.chunked(docs)
    sent = rows.mapInArrow(_probe(window, block, buckets), SENT1)
    first = cut(sent.groupBy("bucket").applyInArrow(_match, ANSWER))
    grouped = rows.groupBy("chunk")
    windows = grouped.cogroup(first.groupBy("chunk")).applyInArrow(_extend(window, block, buckets), SENT2)
    second = windows.groupBy("bucket").applyInArrow(_earlier, ANSWER)
    return rows.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(_kept(window, block, buckets), RESULT)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
