"""Chunks of documents that exchange packed hashes: what the exact-repeat operators share.

A chunk is a run of rows of the input, by their place. Its tokens are hashed where it is read; what
other chunks must see is packed, one row for each hash bucket; each bucket answers each chunk. A
chunk is made again from the same rows when answers arrive, so an answer may be as short as a bit for
each hash that was sent, in the order of sending. Buckets hold equal shares of all hashes, and a
chunk sends a hash once however often it has it, so no hash gathers rows in one task.

A chunk is ``ROWS`` rows, or one row of over ``LONG`` bytes, so what a task holds at once is bounded but
for a single text. Places are those of a scan: the input should be read from files, not be shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 128
LONG = 1 << 20
#: Ids are compared as they are; a null one is larger than any.
NO_ID = np.iinfo(np.int64).max


def chunked(docs: DataFrame, rows: int = ROWS, long: int = LONG) -> DataFrame:
    """chunk, place, doc_id, text; long rows have negative chunks."""
    place = F.monotonically_increasing_id()
    chunk = F.when(F.octet_length("text") > long, -1 - place).otherwise(F.floor(place / rows))
    return docs.select(chunk.cast("long").alias("chunk"), place.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Docs:
    """The rows of one chunk: ids, and their UTF-8 bytes one after the other."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        table = table.sort_by("place") if isinstance(table, pa.Table) else table
        self.doc_ids = table.column("doc_id")
        self.ids = np.array([NO_ID if x is None else x for x in self.doc_ids.to_pylist()], np.int64)
        text = table.column("text")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        text = pa.concat_arrays([text.cast(pa.large_binary())])
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0)
        lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(text).to_pylist()], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        if text.null_count or text.offset:
            self.data = np.frombuffer(b"".join(x or b"" for x in text.to_pylist()), np.uint8)
        else:
            start = np.frombuffer(text.buffers()[1], np.int64, 1)[0] if len(text) else 0
            self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[start : start + self.offsets[-1]] if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.ids)

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def by_chunk(batches: Iterable[pa.RecordBatch], work: Callable[[int, Docs], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``work`` on each chunk of a scan, where its rows follow each other."""
    held: list[pa.RecordBatch] = []

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        yield record(list(work(rows.column("chunk")[0].as_py(), Docs(rows))), schema)

    for batch in batches:
        ids = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if ids[a] < 0:  # long rows stand alone, within the chunk of others
                yield from done([batch.slice(a, b - a)])
                continue
            if held and held[-1].column(0)[0].as_py() != ids[a]:
                yield from done(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from done(held)


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: what is alike in sorted numbers then compresses."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def groups(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Where each group begins and ends."""
    return zip(starts.tolist(), [*starts[1:].tolist(), n] if len(starts) else [], strict=True)


def spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value of each group for each of its rows."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def in_last(flags: np.ndarray, width: int) -> np.ndarray:
    """For each place, whether a flag is set there or at one of the ``width - 1`` places before."""
    c = np.concatenate([[0], np.cumsum(flags)])
    return c[1:] > c[np.maximum(np.arange(1, len(c)) - width, 0)]


def in_next(flags: np.ndarray, width: int) -> np.ndarray:
    return in_last(flags[::-1], width)[::-1]


def removed_spans(flags: np.ndarray) -> int:
    """How many maximal runs are flagged."""
    return int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())
