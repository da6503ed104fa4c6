import random
import zlib

import numpy as np
import pytest

from pathloom.llm import packing
from tests.llm.helpers import DOCS, corpus, frame


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


ODD = ["Don't!! it's 12.5%... (a.b) 'S we'll", "ÀÉÎ µm ªº ß ÷x, x÷. 😀, 漢字。 Σίσυφος ΣΑΣ.", "a\x1cb \x85 c\xa0d", "<|endoftext|> x<|startoftext|>. y", "Å ﬁ ½", "end.\n\nNext,\tx", "...", "a" * 90 + ".", "I'm. can't, '.s"]


def test_ids_are_the_tokenizers(tokenizer):
    encoder = packing.Encoder()
    encoder.YOUNG = 5  # the memo turns over all the time
    rng = random.Random(3)
    letters = "abzéßA.,'!?<|>$ \n\t12ΣσI-"
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)), ""]
    for batch in (texts[:1], texts, [t for t in texts if "\x1c" not in t], [""], []):
        if batch:
            every, ends = encoder.encode(batch)
            got = [every[a:z].tolist() for a, z in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            assert got == [ids(tokenizer, t)[:-1] for t in batch]


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 50) for _ in range(200)]
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):  # the plain way: look at every bin
        at = next((b for b in bins if sum(b) + n <= 50), None)
        if at is None:
            bins.append(at := [])
        at.append(n)
    got = packing.first_fit_decreasing(lengths, 50)
    found = [sorted((n for n, (b, _) in zip(lengths, got, strict=True) if b == k), reverse=True) for k in range(len(bins))]
    assert found == [sorted(b, reverse=True) for b in bins]


def test_each_id_is_packed_once(spark, tokenizer, tmp_path):
    rows = [*corpus(), *[(1000 + k, t, "en", "s", 0) for k, t in enumerate(ODD)]]
    got = packing.pack(frame(spark, rows, folder=tmp_path / "d"), group=20).toPandas()
    for _, own in got.groupby("row"):  # the pieces of one row, whatever its id
        own = own.sort_values("start")
        assert (own["start"].to_numpy() == own["length"].cumsum().to_numpy() - own["length"].to_numpy()).all() and own["length"].sum() == own["doc_tokens"].iloc[0]
    assert got["row"].nunique() == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(ids(tokenizer, r[1]))
    for doc, own in got.groupby(got["doc_id"].fillna(-1)):
        want = texts[None if doc == -1 else int(doc)]
        assert own["length"].sum() == sum(map(len, want))
        if len(want) == 1:
            own = own.sort_values("start")
            assert (own["start"].to_numpy() == own["length"].cumsum().to_numpy() - own["length"].to_numpy()).all()
            for p in own.itertuples():
                assert zlib.crc32(np.array(want[0][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                assert p.doc_tokens == len(want[0])
    assert len({r[0] for r in rows}) == got["doc_id"].fillna(-1).nunique()
    sizes = []
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == own["length"].cumsum().to_numpy() - own["length"].to_numpy()).all()
        sizes.append(own["length"].sum())
    assert max(sizes) <= packing.LENGTH
    assert sum(packing.LENGTH - n for n in sizes if n & (n - 1)) <= packing.SLACK * len(sizes)


def test_empty(spark):
    assert packing.pack(frame(spark, [], DOCS)).count() == 0
