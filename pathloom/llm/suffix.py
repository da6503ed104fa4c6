"""Exact repeats of ``LENGTH`` bytes by common-prefix interval trees over enhanced suffix arrays.

A suffix array over a whole corpus would be one sort of all its bytes. Only suffixes that can matter
are sorted, and each group of them on its own: every window of ``LENGTH`` bytes has an anchor, its
``GRAM`` bytes of least hash, which depends on the window's content alone. Equal windows have equal
anchors at the same place. So suffixes at anchors whose bytes occur once are left out, and the others
are sorted by anchor. For each anchor the enhanced suffix array (suffixes in order, and the lengths of
their common prefixes) is scanned with a stack, which gives the tree of common-prefix intervals. In an
interval, all occurrences agree to the right; they are ordered by what stands to the left, and where
occurrences agree there too, both extensions together are a maximal repeat with all its occurrences.
Each occurrence learns how far to the left it is repeated at each length to the right, and bytes that
repeats of ``LENGTH`` cover are removed.

An anchor with over ``GROUP`` occurrences isn't gathered: its windows are hashed (96 bits), each sent
once by each chunk, and counted by hash. So nothing is dropped and no group is unbounded.

Edge cases: a null or empty text is no bytes; matches may overlap and may lie in one document; rows
of equal doc_id, or of none, are documents of their own; empty tables give empty results; further
columns, of any names, are ignored. Texts of any length are read in segments; a long one is a chunk alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .common import cut, shuffle_width, small_batches, table

LENGTH, GRAM = 400, 64
#: Occurrences of an anchor that one task sorts; beyond, its windows are counted by hash.
GROUP = 2048
SEGMENT = 1 << 21
SENT1 = "bucket long, chunk long, anchors binary, counts binary"
ANSWER1 = "chunk long, bucket long, known binary, hot binary"
SENT2 = "bucket long, chunk long, kind int, anchors binary, docs binary, places binary, low binary, high binary, bytes binary"
ANSWER2 = "chunk long, docs binary, starts binary, ends binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

U = np.uint64


@lru_cache(1)
def _numbers() -> list[list[np.uint64]]:
    rng = np.random.Generator(np.random.PCG64(8191))
    return [[U(int(x) | 1) for x in rng.integers(0, 1 << 64, 16, np.uint64)] for _ in range(2)]


def gram_hashes(data: np.ndarray, width: int, family: int = 0) -> dict[int, np.ndarray]:
    """Hashes of 8, 16, ... ``width`` bytes from each place; by doubling."""
    numbers, n = _numbers()[family], len(data) - 7
    h = np.empty(max(0, n), np.uint64)
    for k in range(min(8, max(0, n))):
        h[k::8] = data[k : k + (len(data) - k) // 8 * 8].view("<u8")[: len(h[k::8])]
    h *= numbers[0]
    h ^= h >> U(29)
    out, size, step = {8: h}, 8, 1
    while size < width:
        n = len(data) - 2 * size + 1
        h = out[size][: max(0, n)] * numbers[step] + out[size][size : size + max(0, n)]
        h ^= h >> U(32)
        h *= numbers[step + 1]
        h ^= h >> U(29)
        size, step = 2 * size, step + 2
        out[size] = h
    return out


def window_hashes(data: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the window at each place, from two families of hashes."""
    out = []
    for family in range(2):
        numbers = _numbers()[family]
        grams = gram_hashes(data, 1 << (length.bit_length() - 1), family)
        total, done = np.zeros(len(at), np.uint64), 0
        for size in sorted(grams, reverse=True):
            while length - done >= size:
                total = C.mixed(total * numbers[14] + grams[size][at + done])
                done += size
        if done < length:  # what is shorter than 8 bytes, with some before it
            total = C.mixed(total * numbers[15] + grams[8][at + length - 8])
        out.append(total)
    return out[0], (out[1] >> U(32)).astype(np.uint32)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row: minima from both ends of blocks meet."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class Runs:
    """Runs of windows that share an anchor, in one chunk: anchor's hash, document, place, first and last window."""

    def __init__(self, docs: C.Docs, length: int, gram: int, segment: int = SEGMENT):
        parts: list[tuple] = []
        for data, doc, base in segments(docs, length, segment):
            parts.append(self._of(data, doc, base, length, gram))
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64)
        self.hash, self.doc, self.place, self.first, self.last = (np.concatenate([p[k] for p in parts]).astype(t) if parts else np.zeros(0, t) for k, t in enumerate(kinds))

    @staticmethod
    def _of(data: np.ndarray, doc: np.ndarray, base: np.ndarray, length: int, gram: int) -> tuple:
        """``doc``: where each document begins in ``data``, with the end; ``base``: (document, its bytes before)."""
        h = gram_hashes(data, gram)[gram]
        n = len(data) - length + 1
        # 40 bits of the hash and the place: of equal grams the first
        least = sliding_least(h & ~U(0xFFFFFF) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        anchor = (least & U(0xFFFFFF)).astype(np.int64)
        whole = np.repeat(np.maximum(doc[1:] - length + 1, doc[:-1]), np.diff(doc))[:n] > np.arange(n)  # windows in one document
        begin = np.flatnonzero(whole & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1]]))
        end = np.flatnonzero(whole & np.concatenate([(anchor[1:] != anchor[:-1]) | ~whole[1:], [True]]))
        k = np.searchsorted(doc, begin, "right") - 1
        shift = base[k, 1] - doc[k]
        at = anchor[begin]
        return h[at], base[k, 0], at + shift, begin + shift, end + shift


def segments(docs: C.Docs, length: int, size: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of a chunk's documents in parts that hold each window of ``length`` once."""
    pieces, total = [], 0
    for k in range(len(docs)):
        a, z = int(docs.offsets[k]), int(docs.offsets[k + 1])
        for at in range(a, max(a, z - length + 1), size - length):
            upto = min(z, at + size - 1)
            if total + upto - at > size and pieces:
                yield _joined(docs, pieces)
                pieces, total = [], 0
            pieces.append((k, at, upto))
            total += upto - at
    if pieces:
        yield _joined(docs, pieces)


def _joined(docs: C.Docs, pieces: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.concatenate([docs.data[a:z] for _, a, z in pieces])
    starts = np.cumsum([0] + [z - a for _, a, z in pieces])
    return data, starts, np.array([(k, a - int(docs.offsets[k])) for k, a, _ in pieces], np.int64)


class Anchors:
    """The distinct anchors of a chunk in order of bucket and hash."""

    def __init__(self, runs: Runs, buckets: int):
        bucket = (runs.hash % U(buckets)).astype(np.int64)
        self.order = np.lexsort((runs.hash, bucket))
        self.begin = C.firsts(runs.hash[self.order])
        self.hash = runs.hash[self.order][self.begin]
        self.size = np.diff(np.append(self.begin, len(self.order)))
        self.edges = np.searchsorted(bucket[self.order][self.begin], np.arange(buckets + 1))

    def told(self, answers: list[dict], name: str) -> np.ndarray:
        """A flag of each run."""
        flags = np.zeros(len(self.hash), bool)
        for r in answers:
            a, z = self.edges[r["bucket"]], self.edges[r["bucket"] + 1]
            flags[a:z] = C.unbits(r[name], z - a)
        out = np.zeros(len(self.order), bool)
        out[self.order] = np.repeat(flags, self.size)
        return out


def _count(length: int, gram: int, segment: int, buckets: int):
    schema = C.arrow_schema(SENT1)

    def work(chunk: int, docs: C.Docs) -> Iterator[tuple]:
        anchors = Anchors(Runs(docs, length, gram, segment), buckets)
        for b in range(buckets):
            a, z = anchors.edges[b], anchors.edges[b + 1]
            if a < z:
                yield b, chunk, anchors.hash[a:z].tobytes(), anchors.size[a:z].astype("<u4").tobytes()

    return lambda batches: C.by_chunk(batches, work, schema)


def _known(group: int):
    """Of each anchor, whether it occurs twice or more, and whether more often than a task should hold."""

    def run(sent: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u8") for x in sent.column("anchors").to_pylist()]
        every, n = np.concatenate(hashes), np.concatenate([np.frombuffer(x, "<u4") for x in sent.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        begin = C.firsts(every[order])
        total = np.zeros(len(every), np.int64)
        total[order] = C.spread(np.add.reduceat(n[order], begin), begin, len(every))
        rows, at, bucket = [], 0, sent.column("bucket")[0].as_py()
        for chunk, part in zip(sent.column("chunk").to_pylist(), hashes, strict=True):
            own = total[at : at + len(part)]
            at += len(part)
            if (own > 1).any():
                rows.append((chunk, bucket, C.bits(own > 1), C.bits(own > group)))
        return pa.Table.from_batches([C.record(rows, C.arrow_schema(ANSWER1))])

    return run


def _contexts(length: int, gram: int, segment: int, buckets: int):
    """The surroundings of each known anchor, for its bucket; for hot anchors the hashes of their windows."""
    schema = C.arrow_schema(SENT2)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and answers.num_rows:
            docs, chunk = C.Docs(rows), rows.column("chunk")[0].as_py()
            runs = Runs(docs, length, gram, segment)
            anchors, told = Anchors(runs, buckets), answers.to_pylist()
            hot = anchors.told(told, "hot")
            known = np.flatnonzero(anchors.told(told, "known") & ~hot)
            known = known[np.argsort(runs.hash[known] % U(buckets), kind="stable")]
            bucket = (runs.hash[known] % U(buckets)).astype(np.int64)
            for a, z in C.groups(C.firsts(bucket), len(known)):
                k = known[a:z]
                texts = [docs.data[docs.offsets[d] + i : docs.offsets[d] + j + length].tobytes() for d, i, j in zip(runs.doc[k], runs.first[k], runs.last[k], strict=True)]
                out.append((int(bucket[a]), chunk, 0, runs.hash[k].tobytes(), runs.doc[k].astype("<u4").tobytes(), runs.place[k].tobytes(), runs.first[k].tobytes(), runs.last[k].tobytes(), b"".join(texts)))
            out += _windows(docs, chunk, runs, np.flatnonzero(hot), length, buckets)
        return pa.Table.from_batches([C.record(out, schema)])

    return run


def _windows(docs: C.Docs, chunk: int, runs: Runs, hot: np.ndarray, length: int, buckets: int) -> Iterator[tuple]:
    """The distinct windows of hot anchors by bucket: their hashes and, run by run, where they begin."""
    high, more, doc, at = [], [], [], []
    for d in np.unique(runs.doc[hot]):
        own = hot[runs.doc[hot] == d]
        low, top = int(runs.first[own].min()), int(runs.last[own].max())
        places = np.concatenate([np.arange(i, j + 1) for i, j in zip(runs.first[own], runs.last[own], strict=True)])
        data = docs.data[docs.offsets[d] + low : docs.offsets[d] + top + length]
        a, b = window_hashes(data, length, places - low)
        high.append(a)
        more.append(b)
        doc.append(np.full(len(places), d, np.uint32))
        at.append(places)
    if not high:
        return
    high, more, doc, at = (np.concatenate(x) for x in (high, more, doc, at))
    bucket = (high % U(buckets)).astype(np.int64)
    order = np.lexsort((more, high, bucket))
    bucket, high, more, doc, at = bucket[order], high[order], more[order], doc[order], at[order]
    for a, z in C.groups(C.firsts(bucket), len(bucket)):
        # of a window that the chunk has several times only the first is sent with its hash; all with their place
        new = C.firsts(high[a:z], more[a:z])
        times = np.diff(np.append(new, z - a)).astype("<u4")
        yield int(bucket[a]), chunk, 1, C.planes(high[a:z][new]), doc[a:z].tobytes(), at[a:z].tobytes(), times.tobytes(), C.planes(more[a:z][new]), b""


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # they agree up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each node of the tree, from the prefixes of neighbours, with a stack."""
    stack: list[tuple[int, int]] = []
    for k, p in enumerate([*prefixes, 0]):
        first = k
        while stack and stack[-1][0] > p:
            length, first = stack.pop()
            yield length, first, k
        if p and (not stack or stack[-1][0] < p):
            stack.append((p, first))


class LeastOf:
    """The least of values between two places, by a table of the least of each power of two in a row."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the values from each ``a`` up to, but not with, ``b``, which is larger."""
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << k)])
        return out


def maximal_repeats(texts: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For distinct (text, place of the anchor in it): (left, right) extents that others share, together ``length`` at least.

    What stands to the left is sorted once, with the prefixes that neighbours share; an interval's members
    are taken in that order, and what two of them share is the least of the prefixes between.
    """
    order = sorted(range(len(texts)), key=lambda k: texts[k][0][texts[k][1] :])
    right = [texts[k][0][texts[k][1] :] for k in order]
    left = [texts[k][0][: texts[k][1]][::-1] for k in order]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    by_left = np.array(sorted(range(len(texts)), key=left.__getitem__), np.int64)
    rank = np.empty(len(texts), np.int64)
    rank[by_left] = np.arange(len(texts))
    shared = LeastOf(np.array([common(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)], np.int64))
    reach = np.full(len(texts), -1)  # by left rank: how far to the left it is already known to be repeated, with a longer prefix
    for prefix, first, last in intervals([common(a, b) for a, b in zip(right, right[1:], strict=False)]):
        inside = np.sort(rank[first : last + 1])
        near = shared.between(inside[:-1], inside[1:])
        extent = np.maximum(np.append(0, near), np.append(near, 0))
        # to the left nothing new unless the extension differs from that of the intervals inside
        new = np.flatnonzero((extent > reach[inside]) & (extent + prefix >= length))
        reach[inside[new]] = extent[new]
        for k, e in zip(by_left[inside[new]].tolist(), extent[new].tolist(), strict=True):
            out[order[k]].append((e, prefix))
    return out


def _repeats(length: int):
    schema = C.arrow_schema(ANSWER2)

    def run(sent: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        rows = sent.to_pylist()
        _sorted([r for r in rows if r["kind"] == 0], length, found)
        _counted([r for r in rows if r["kind"] == 1], length, found)
        out = [(chunk, *(np.concatenate(x).tobytes() for x in zip(*parts, strict=True))) for chunk, parts in found.items()]
        return pa.Table.from_batches([C.record(out, schema)])

    return run


def _sorted(rows: list[dict], length: int, found: dict) -> None:
    if not rows:
        return
    sizes = [len(r["anchors"]) // 8 for r in rows]
    chunk = np.repeat([r["chunk"] for r in rows], sizes)
    hashes, doc, place, low, high = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("anchors", "<u8"), ("docs", "<u4"), ("places", "<i8"), ("low", "<i8"), ("high", "<i8")))
    texts: list[bytes] = []
    for r in rows:
        at, data = 0, r["bytes"]
        for n in (np.frombuffer(r["high"], "<i8") - np.frombuffer(r["low"], "<i8") + length).tolist():
            texts.append(data[at : at + n])
            at += n
    order = np.argsort(hashes, kind="stable")
    start, end = np.full(len(order), -1, np.int64), np.full(len(order), -1, np.int64)
    more: list[tuple[int, int, int]] = []
    for a, z in C.groups(C.firsts(hashes[order]), len(order)):
        if z - a < 2:
            continue
        same: dict[tuple[bytes, int], list[int]] = {}
        for k in order[a:z].tolist():
            same.setdefault((texts[k], int(place[k] - low[k])), []).append(k)
        for ks in same.values():
            if len(ks) > 1:  # all of it occurs again
                start[ks], end[ks] = low[ks], high[ks] + length
        if len(same) > 1:
            distinct = list(same.items())
            for (_, ks), extents in zip(distinct, maximal_repeats([x for x, _ in distinct], length), strict=True):
                if len(ks) == 1:
                    more += [(ks[0], place[ks[0]] - left, place[ks[0]] + right) for left, right in extents]
    whole = np.flatnonzero(start >= 0)
    which = np.concatenate([whole, np.array([k for k, _, _ in more], np.int64)])
    start = np.concatenate([start[whole], np.array([s for _, s, _ in more], np.int64)])
    end = np.concatenate([end[whole], np.array([e for _, _, e in more], np.int64)])
    _tell(found, chunk[which], doc[which], start, end)


def _counted(rows: list[dict], length: int, found: dict) -> None:
    if not rows:
        return
    high, more = [C.unplanes(r["anchors"], "<u8") for r in rows], [C.unplanes(r["high"], "<u4") for r in rows]
    times = np.concatenate([np.frombuffer(r["low"], "<u4") for r in rows]).astype(np.int64)
    h, m = np.concatenate(high), np.concatenate(more)
    order = np.lexsort((m, h))
    begin = C.firsts(h[order], m[order])
    twice = np.zeros(len(h), bool)
    twice[order] = C.spread(np.add.reduceat(times[order], begin) > 1, begin, len(h))
    flags = np.repeat(twice, times)
    doc, at = np.concatenate([np.frombuffer(r["docs"], "<u4") for r in rows])[flags], np.concatenate([np.frombuffer(r["places"], "<i8") for r in rows])[flags]
    chunk = np.repeat([r["chunk"] for r in rows], [len(r["docs"]) // 4 for r in rows])[flags]
    _tell(found, chunk, doc, at, at + length)


def _tell(found: dict, chunk: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    order = np.argsort(chunk, kind="stable")
    for a, z in C.groups(C.firsts(chunk[order]), len(order)):
        k = order[a:z]
        found.setdefault(int(chunk[k[0]]), []).append((doc[k].astype("<u4"), start[k].astype("<i8"), end[k].astype("<i8")))


def _cleaned(rows: pa.Table, answers: pa.Table) -> pa.Table:
    out = []
    if rows.num_rows:
        docs = C.Docs(rows)
        change = np.zeros(int(docs.offsets[-1]) + 1, np.int32)
        for r in answers.to_pylist():
            base = docs.offsets[np.frombuffer(r["docs"], "<u4")]
            np.add.at(change, base + np.frombuffer(r["starts"], "<i8"), 1)
            np.add.at(change, base + np.frombuffer(r["ends"], "<i8"), -1)
        gone = np.cumsum(change[:-1]) > 0
        for k, doc_id in enumerate(docs.doc_ids.to_pylist()):
            a, z = docs.offsets[k], docs.offsets[k + 1]
            kept = docs.data[a:z][~gone[a:z]]
            out.append((doc_id, int(z - a), int(z - a) - len(kept), C.removed_spans(gone[a:z]), hashlib.sha256(kept.tobytes()).hexdigest()))
    return pa.Table.from_batches([C.record(out, C.arrow_schema(RESULT))])


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = shuffle_width(spark)
    rows = C.chunked(docs)
    sent = rows.mapInArrow(_count(length, gram, segment, buckets), SENT1)
    known = cut(sent.groupBy("bucket").applyInArrow(_known(group), ANSWER1))
    contexts = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_contexts(length, gram, segment, buckets), SENT2)
    repeats = contexts.groupBy("bucket").applyInArrow(_repeats(length), ANSWER2)
    return rows.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_cleaned, RESULT)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents"))
