import xxhash

from pathloom.llm import simhash
from tests.llm.helpers import DOCS, corpus, frame, words


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, near):
    todo, out = set(fps), {}
    while todo:
        seen, edge = set(), {min(todo)}
        while edge:
            seen |= edge
            edge = {b for a in edge for b in todo - seen if (a ^ b).bit_count() <= near}
        out |= dict.fromkeys(seen, min(seen))
        todo -= seen
    return out


def expect(rows, near):
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(fps, near)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[roots[f]] = min(least.get(roots[f], r[0]), r[0])
    return sorted((str(r[0]), f, least.get(roots[f])) for r, f in zip(rows, fps, strict=True))


def test_fingerprints():
    for text in (None, "", " \t", "A b", "a b C", "Ä b c d E", "x " * 50, "a\x1cb c\x85d e"):
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_components_whole_and_split(spark, tmp_path):
    rows = corpus()
    docs = frame(spark, rows, folder=tmp_path / "d")
    for near, group in ((3, 4096), (3, 4), (3, 1)):
        got = simhash.near_classes(docs, near=near, group=group).collect()
        assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == expect(rows, near)


def test_near_pairs_of_any_bits(spark):
    base = 0x123456789ABCDEF0
    fps = [base ^ x for x in (0, 1, 1 << 63, 7 << 20, 1 | 1 << 30 | 1 << 60, 0xF, 0xFF << 8, 0xFFF << 40, 0xFFFFF)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for group in (4096, 2):
        edges = simhash.near_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), group=group)
        found = {r["node"] % (1 << 64): r["root"] for r in simhash.components(edges).collect()}
        want = plain_components(fps, 3)
        for a in fps:
            for b in fps:
                same = found.get(a, a) == found.get(b, b) if a in found and b in found else a == b
                assert same == (want[a] == want[b])


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_drop_near_keeps_one_of_each(spark, tmp_path):
    rows = corpus()
    docs = frame(spark, rows, folder=tmp_path / "d").selectExpr("*", "1 AS place", "2 AS fp")
    got = simhash.drop_near(docs)
    assert got.columns == docs.columns
    roots = plain_components([plain_fingerprint(r[1]) for r in rows], 3)
    kept = [roots[plain_fingerprint(r["text"])] for r in got.collect()]
    assert sorted(kept) == sorted(set(roots.values()))


def test_empty(spark):
    docs = frame(spark, [], DOCS)
    assert simhash.near_classes(docs).count() == 0
    assert simhash.drop_near(docs).count() == 0
