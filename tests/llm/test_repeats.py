import hashlib

import pytest

from pathloom.llm import chunks, substring, suffix
from tests.llm.helpers import DOCS, corpus, frame, words


def plain_bytes(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    count = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False))
        out.append((str(r[0]), len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def plain_words(rows, window):
    big = 1 << 62
    first = {}
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), big if r[0] is None else r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if r[0] is None else r[0]):
                gone[k : k + window] = [True] * window
        out.append((str(r[0]), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


def shown(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize(("length", "gram", "group", "rows_of_chunk", "segment"), [(400, 64, 2048, 128, 1 << 21), (400, 64, 2, 7, 1200), (100, 16, 3, 128, 1 << 21), (37, 16, 2048, 5, 500), (37, 8, 1, 128, 300)])
def test_bytes_against_brute_force(spark, tmp_path, monkeypatch, length, gram, group, rows_of_chunk, segment):
    rows = corpus(seed=length)
    docs = frame(spark, rows, folder=tmp_path / "d")
    monkeypatch.setattr(chunks.chunked, "__defaults__", (rows_of_chunk, 1 << 20 if rows_of_chunk > 5 else 1000))
    assert shown(suffix.dedup_suffixes(docs, length, gram, group, segment)) == plain_bytes(rows, length)


@pytest.mark.parametrize("size", [450, 1000, 1 << 21])
def test_segments_hold_each_window_once(size):
    import pyarrow as pa

    texts = ["a" * 399, "b" * 400, "c" * 2500, "", None, "d" * 1000]
    docs = chunks.Docs(pa.table({"place": range(6), "doc_id": range(6), "text": pa.array(texts, pa.string())}))
    seen = []
    for data, starts, base in suffix.segments(docs, 400, size):
        assert len(data) == starts[-1]
        for k, (doc, before) in enumerate(base.tolist()):
            seen += [(doc, before + j) for j in range(starts[k + 1] - starts[k] - 399)]
    assert sorted(seen) == [(k, j) for k, t in enumerate(texts) for j in range(len(t or "") - 399)]


def test_intervals_are_those_of_the_tree():
    texts = sorted([b"banana", b"band", b"bandit", b"ban", b"cat", b"cats", b"dog"])
    prefixes = [suffix.common(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    want = set()
    for a in range(len(texts)):
        for z in range(a + 1, len(texts)):
            p = min(prefixes[a:z])
            if p and (a == 0 or prefixes[a - 1] < p) and (z == len(texts) - 1 or prefixes[z] < p):
                want.add((p, a, z))
    assert set(suffix.intervals(prefixes)) == want


@pytest.mark.parametrize("seed", range(4))
def test_maximal_repeats_against_all_pairs(seed):
    """Contexts of one anchor; each learns the extents that it shares with another, but for those that lie in others."""
    import os.path
    import random

    rng, length = random.Random(seed), 9
    texts = list({("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) + "XYZ" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), None) for _ in range(70)})
    texts = [(t.encode(), t.index("XYZ")) for t, _ in texts]
    lcp = lambda a, b: len(os.path.commonprefix([a, b]))
    cover = lambda pairs: {(a, b) for e, p in pairs for a in range(e + 1) for b in range(p + 1) if a + b >= length}
    for (t, at), got in zip(texts, suffix.maximal_repeats(texts, length), strict=True):
        want = [(lcp(t[:at][::-1], u[:k][::-1]), lcp(t[at:], u[k:])) for u, k in texts if (u, k) != (t, at)]
        assert cover(got) == cover([(e, p) for e, p in want if e + p >= length])


@pytest.mark.parametrize(("window", "rows_of_chunk"), [(13, 128), (13, 3), (5, 10)])
def test_words_against_brute_force(spark, tmp_path, monkeypatch, window, rows_of_chunk):
    rows = corpus(seed=window)
    docs = frame(spark, rows, folder=tmp_path / "d")
    monkeypatch.setattr(chunks.chunked, "__defaults__", (rows_of_chunk, 1 << 20 if rows_of_chunk > 5 else 1000))
    assert shown(substring.dedup_substrings(docs, window)) == plain_words(rows, window)


def test_empty(spark):
    docs = frame(spark, [], DOCS)
    assert suffix.dedup_suffixes(docs).count() == 0
    assert substring.dedup_substrings(docs).count() == 0
