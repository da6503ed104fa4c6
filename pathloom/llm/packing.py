"""Packing documents into sequences: first-fit decreasing on a tournament tree of bin capacities.

Documents are tokenized where they are read. Whole stretches of ``LENGTH`` ids fill a sequence each;
what is left of a document goes to one of many randomised groups, and each group is packed on its
own: the pieces in decreasing length, each into the first sequence with room, which a tournament tree
over the free room of the sequences finds in logarithmic time. Sequences that stay emptier than
``SLACK`` are packed anew by cutting: their pieces follow each other, cut where a sequence is full,
and the end of the group goes into sequences whose lengths are powers of two, which aren't padded.

Edge cases: a null or empty text is the end id alone; repeated rows and null ids are packed like any
other, as groups are dealt by id and place, so that no id gathers in one, and the pieces of a row
carry its place (``row``), which tells copies apart; a long text is tokenized whole and leaves in
pieces; an empty table gives an empty result; further columns, of any names, are ignored. A group holds some ``GROUP`` pieces, however many
documents there are.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

LENGTH = 2048
END_ID = 1
#: Documents in a group, on the average.
GROUP = 4096
#: A sequence with no more room than this stays as first-fit decreasing made it.
SLACK = 4
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"
_ROWS = "pack_group long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, ids binary"


class Encoder:
    """Ids of whole texts. White space ends a token in this vocabulary's rules, so words are encoded once.

    Texts of Latin-1 are lowered first, as the tokenizer would; punctuation behind a letter is a token
    by itself, and a word of Latin-1 letters goes to the merges as it is. The memo is bounded: when its
    young half is full it becomes the old one, from which words that come again return.
    """

    YOUNG, LONGEST = 300_000, 40
    #: Punctuation behind a letter and before white space, which a space may as well stand before.
    TAIL = r"([a-z\x{E0}-\x{F6}\x{F8}-\x{FF}])([[:punct:]]+)([ \n]|$)"
    ODD = re.compile("[\x1c-\x1f]")  # not white space to the tokenizer, but so to others

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            bare = json.load(f)
        bare |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # a control token's string is one id wherever it stands
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # bytes as the vocabulary writes them: printable ones as they are, others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}

    def _bytes(self, texts: list[str], by=None) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if w.isalpha() and w.islower() and max(w) <= "\xff"]
        out = dict(zip(plain, self._bytes([w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in plain], self.merges), strict=True))
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, self._bytes(rest), strict=True))

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of words that aren't in the young memo."""
        if len(self.young) > self.YOUNG:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        young |= (known := {w: old[w] for w in missing if w in old})
        got = self._encoded(list(missing - known.keys()))
        young |= {w: x for w, x in got.items() if len(w) <= self.LONGEST}
        return known | got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text end."""
        low = [t.lower() if _latin(t) else t for t in texts]
        odd = {k for k, t in enumerate(low) if self.ODD.search(t) or any(x in t for x in self.special)}
        if not odd:
            return self._by_words(low)
        # rare: these by the tokenizer alone
        every, ends = self._by_words([t for k, t in enumerate(low) if k not in odd])
        usual = iter(np.split(every, ends[:-1]) if len(ends) else [])
        parts = [np.frombuffer(self._bytes([t])[0], self.kind) if k in odd else next(usual) for k, t in enumerate(texts)]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def _by_words(self, low: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lowered = pa.array(low, pa.large_string())
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, self.TAIL, r"\1 \2\3"))
        found = lists.flatten().dictionary_encode()
        words = found.dictionary.to_pylist()
        ids = list(map(self.young.get, words))
        missing = {w for w, x in zip(words, ids, strict=True) if x is None}
        if missing:
            learnt = self._learn(missing)
            ids = [learnt[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        # the ids of each occurrence, from those of the distinct words one after the other
        every = np.frombuffer(b"".join(ids), self.kind)
        size = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        begin = np.cumsum(size) - size
        which = found.indices.to_numpy()
        n = size[which]
        upto = np.cumsum(n)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[which] - (upto - n), n)
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        return every[at], np.concatenate([[0], upto])[ends]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(2)
def encoder(path: str | None) -> Encoder:
    """One for each worker process, so that tasks share its memo."""
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _mixed(x: int) -> int:
    """A 64-bit finalizer: ids in a row land in groups at random, the same each time."""
    x &= 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 33)


def _tokenized(groups: int, length: int, path: str | None):
    schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in _ROWS.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        gc.disable()  # the memo is large, and no cycles are made here
        end = np.array([END_ID], own.kind)
        for batch in batches:
            rows: list[tuple] = []
            every, ends = own.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc, place, a, z in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                ids = np.concatenate([every[a:z], end])
                n = len(ids)
                group = _mixed(_mixed(doc or 0) + place) % groups
                whole = n // length * length
                rows += [(group, doc, at, length, crc(ids[at : at + length]), n, place, None) for at in range(0, whole, length)]
                if whole < n:
                    rows.append((group, doc, whole, n - whole, crc(ids[whole:]), n, place, ids[whole:].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


class Tournament:
    """A binary tree whose leaves are sequences and whose nodes hold the largest free room below."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """The first bin with ``need`` free, and its free room before; the room is taken."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        had = room[at]
        room[at] -= need
        leaf = at
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return leaf - self.leaves, had


def first_fit_decreasing(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces are taken longest first, equal ones in the given order."""
    tree, out = Tournament(max(1, len(lengths)), length), [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at, had = tree.place(lengths[k])
        out[k] = (at, length - had)
    return out


def _packed(length: int, slack: int):
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        pieces = sorted(rows.drop_columns(["pack_group"]).to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"], r["row"]))
        out, used = [], 0

        def put(p: dict, start: int, n: int, value: int, sequence: int, offset: int) -> None:
            out.append((p["doc_id"], p["start"] + start, n, value, p["doc_tokens"], (group << 32) + sequence, offset, p["row"]))

        whole = [p for p in pieces if p["ids"] is None]
        for p in whole:
            put(p, 0, p["length"], p["ids_crc32"], used, 0)
            used += 1
        rest = pieces[len(whole) :]
        bins: dict[int, list[tuple[int, dict]]] = {}
        for p, (at, offset) in zip(rest, first_fit_decreasing([p["length"] for p in rest], length), strict=True):
            bins.setdefault(at, []).append((offset, p))
        loose = []
        for _, held in sorted(bins.items()):
            if sum(p["length"] for _, p in held) >= length - slack:
                for offset, p in held:
                    put(p, 0, p["length"], p["ids_crc32"], used, offset)
                used += 1
            else:
                loose += [p for _, p in held]
        left = sum(p["length"] for p in loose)
        room, at = 0, 0
        for p in loose:
            ids, start = np.frombuffer(p["ids"], "<u2" if len(p["ids"]) == 2 * p["length"] else "<u4"), 0
            while start < len(ids):
                if not room:  # a new sequence: full, or the largest power of two that is left
                    room, at = min(length, 1 << (left.bit_length() - 1)) if left < length else length, 0
                    used += 1
                n = min(room, len(ids) - start)
                put(p, start, n, crc(ids[start : start + n]), used - 1, at)
                room, at, start, left = room - n, at + n, start + n, left - n
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def pack(docs: DataFrame, length: int = LENGTH, group: int = GROUP, slack: int = SLACK, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece (``PIECES``) of the texts of ``docs``. ``vocabulary``: a path that executors have."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    groups = max(1, -(-docs.count() // group))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id()).mapInArrow(_tokenized(groups, length, vocabulary), _ROWS)
    return rows.groupBy("pack_group").applyInArrow(_packed(length, slack), PIECES)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
