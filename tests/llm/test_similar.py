import random

import pytest

from pathloom.llm import similar, simhash
from tests.llm.helpers import DOCS, corpus, frame, words


def plain_set(text, k=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def plain_kept(rows):
    """The groups of rows that linked sets make."""
    sets = sorted({plain_set(r[1]) for r in rows}, key=sorted)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                parent[root(i)] = root(j)
    of = {s: root(k) for k, s in enumerate(sets)}
    first = {}
    for r in rows:
        key = of[plain_set(r[1])]
        rank = (r[0] is None, r[0] or 0)
        first[key] = min(first.get(key, rank), rank)
    return sorted(str(None if none else i) for none, i in first.values())


def edited(n=6, copies=30, seed=3):
    """Texts with copies of one to eight changed words: similarities on both sides of the bound."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(40)]
    for g in range(n):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 90, 200]))] + (passage if g % 2 else [])
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("often", [8, 1])
def test_all_similar_pairs_are_linked(spark, tmp_path, monkeypatch, often):
    monkeypatch.setattr(similar, "OFTEN", often)
    for name, rows in (("corpus", corpus()), ("edited", edited())):
        docs = frame(spark, rows, folder=tmp_path / name).selectExpr("*", "1 AS place", "2 AS node", "3 AS n")
        got = similar.drop_similar(docs)
        assert got.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in got.collect()) == plain_kept(rows)


def test_the_stage_drops_a_copy_that_the_thin_query_keeps(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, edited(), folder=tmp_path / "d")
    want = plain_kept(edited())
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(str(r["doc_id"]) for r in stage(spark, docs, "").collect()) == want
    assert simhash.drop_near(docs).count() > len(want)


def test_empty(spark):
    assert similar.drop_similar(frame(spark, [], DOCS)).count() == 0


def test_the_stage_links_by_fingerprints_before_the_join(spark, tmp_path, monkeypatch):
    """Without pairs from the join, copies of near fingerprints and similar sets still go, and no others."""
    import corpus_pipeline

    base = [f"w{k}" for k in range(300)]
    texts = [base, [*base, "tail"], base[:200] + [f"v{k}" for k in range(100)], [f"z{k % 9}" for k in range(3600)], [f"z{k % 9}" for k in range(3600)] + [f"x{k}" for k in range(8)]]
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)]
    bits, sets = [simhash.fingerprint(r[1]) % (1 << 64) for r in rows], [plain_set(r[1]) for r in rows]
    near = {(i, j) for j in range(5) for i in range(j) if (bits[i] ^ bits[j]).bit_count() <= 3}
    alike = {(i, j) for j in range(5) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert (0, 1) in near and (0, 1) in alike and (3, 4) in near - alike
    monkeypatch.setattr(similar, "_candidates", lambda similar, whole: lambda batches: (b.select(["key", "node"]).rename_columns(["a", "b"]).slice(0, 0) for b in batches))
    docs = frame(spark, rows, folder=tmp_path / "d")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted({0, 1, 2, 3, 4} - {j for _, j in near & alike})


def test_near_pairs_connect_near_fingerprints(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:25]] + fps[:5]
    rows = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    got = similar.near_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()
    assert all(r["a"] < r["b"] and (fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 3 for r in got)
    linked = {(k, k + 40) for k in range(25)} | {(k, k + 65) for k in range(5)}
    assert linked <= {(r["a"], r["b"]) for r in got}
