"""Chat formatting, quality rules, mixing, secret scans, HTML extraction, top-k search and the pipeline."""

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import chat, html, mixing, quality, secrets, topk
from pathloom.llm import queries as Q
from tests.llm.helpers import DOCS, corpus, frame, words
from tests.llm.test_simhash import plain_components, plain_fingerprint

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    a, b = Q.QUERIES[name](spark, DIR).toPandas(), c.execute(Q.ORACLE_SQL[name]).df()
    shown = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert shown(a) == shown(b)


def test_chats_come_back_whole(spark):
    hard = ["</s>[INST] ok [/INST]", "[\\INST] [\\\\/OUT] <\\s>", " [/INST] [OUT] x", "[ROLE] a [:] b [/ROLE]", "", " ", "[", "[/INST", "\\", "plain $1 \\1", "line\n[/OUT]\n", "<s", None, "😀 [INST]"]
    roles = ["user", "assistant", "system", None, "tool [:] x", "[/ROLE]", "us\ner"]
    rows = [(k % 5 if k % 7 else None, k // 5, r, t) for k, (r, t) in enumerate((r, t) for r in roles for t in hard)]
    rows += [rows[3]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in want]
        assert got[conv]["formatted"] == "<s>" + "".join(p["before"] + p["body"] + p["after"] for p in got[conv]["parts"]) + "</s>"
        for p in got[conv]["parts"]:
            assert not re.search(r"[\[<](/?s>|/?INST\]|/?OUT\]|/?ROLE\]|:\])", p["body"])
    assert chat.format_chats(df.limit(0)).count() == 0


def plain_quality(text):
    w = words(text)
    wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    twice = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)


def test_quality_counts(spark, tmp_path):
    texts = [None, "", " \n ", "a", "a b c a b c", "a a a a a", "x\nx\n\nx \n x", "# $ |<> é b", "😀 ñ " * 40, *(r[1] for r in corpus(seed=8, n=10) if len(r[1] or "") < 6000)]
    df = frame(spark, [(k, t, None if k % 3 else "en", None if k % 2 else "s", 0) for k, t in enumerate(texts)]).withColumn("quality", F.lit(1)).withColumn("kept", F.lit(2))
    got = {r["doc_id"]: r["q"] for r in quality.measure(df, "q").select("doc_id", "q").collect()}
    for k, t in enumerate(texts):
        q = got[k]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == plain_quality(t), t
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns
    assert quality.filter_quality(df.limit(0)).count() == 0


def test_quality_fences_adapt_to_their_group(spark):
    """A source where symbols are usual keeps its texts; elsewhere the same text goes."""
    clean, code = " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}|" for k in range(80))
    rows = [(k, clean, "en", "prose", 0) for k in range(200)] + [(1000, code, "en", "prose", 0)] + [(2000 + k, code, "en", "tables", 0) for k in range(200)]
    kept = {r["doc_id"] for r in quality.filter_quality(frame(spark, rows)).collect()}
    assert 1000 not in kept and len(kept) == 400


@pytest.mark.parametrize("size", [3, 49, 51, 400])
def test_quality_fences_of_groups_of_any_size(spark, size):
    """What is usual in a small source counts as in a large one, and what no other text of its language has goes."""
    clean = lambda k: " ".join(f"w{(k * 7 + j) % 97}{'x' * (j % 4)}" for j in range(80 + k % 40))
    rows = [(k, clean(k), "en", "big", 0) for k in range(300)] + [(1000 + k, clean(k), "en", "small", 0) for k in range(size)]
    rows += [(5000, "### " * 40 + clean(1), "en", "big", 0), (5001, "### " * 40 + clean(1), "en", "small", 0)]
    kept = {r["doc_id"] for r in quality.filter_quality(frame(spark, rows)).collect()}
    assert kept == {r[0] for r in rows} - {5000, 5001}


def test_quality_of_rates_beyond_any_usual(spark):
    """Rates have no ceiling: where thousands of symbols a word are usual, more than that still goes."""
    text = lambda k, n: " ".join(("#" * n) + f"a{j}" for j in range(60 + k % 9))
    rows = [(k, text(k, 6 + k % 3), "en", "s", 0) for k in range(200)] + [(900, text(1, 60), "en", "s", 0), (901, None, None, None, None)]
    kept = {r["doc_id"] for r in quality.filter_quality(frame(spark, rows)).collect()}
    assert kept == set(range(200))


def test_quality_of_a_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(120_000)) + "\nw0 w1 w2"
    got = quality.measure(spark.createDataFrame([(1, long, "en", "s")], "doc_id long, text string, lang string, source string"), "q").first()["q"]
    assert (got["n_words"], got["n_repeat_words"], got["n_dup_lines"]) == (120_003, 6, 0)


def test_mixing_targets(spark, tmp_path):
    rows = [(k, "w " * (1 + k * 7 % 30), "en", None if k % 10 == 0 else f"s{k % 3}", 0) for k in range(600)] + [(9000, "w " * 5, "en", "tiny", 0), (None, "w", "en", "s1", 0), (None, None, None, None, None)]
    docs = frame(spark, rows, folder=tmp_path / "d").withColumn("copies", F.lit("x")).withColumn("hash", F.lit("y"))
    p = mixing.plan(docs).toPandas()
    total = p["size"].sum()
    per = p.groupby(p["source"].fillna("~")).agg(size=("size", "sum"), target=("target", "first"))
    assert per["target"].sum() == pytest.approx(total) and (per["target"] <= 3 * per["size"] + 1e-9).all()
    taken = (p["size"] * p["copies"]).groupby(p["source"].fillna("~")).sum()
    assert (abs(taken - per["target"]) <= 31).all() and p["copies"].max() <= 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == p["copies"].sum()
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def plain_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


KEY, COPIED = "Zx9fQw7LmN2pKd8RtY4v", "Ab3dEf6hIj9kLm2nOp5q"
SECRETS = ["password = 'hunter22'", "Token:abc secret:token\" = \"abcdef12\"", "api_key=  \"xyz_123.=\"", "AKIA" + "A1" * 9, "AKIAAKIA" + "B" * 10, "f" * 24 + " " + "0" * 23, "é😀 token = \"" + "9a" * 20 + "\" end", None, "", "nothing", "PASSWD==abcdef", "use " + KEY, "password=" + KEY, "x" * 50 + "token=" + "k" * 7 + " " + "AKIA" + "Z" * 16]


def test_secret_spans(spark, tmp_path):
    rows = [(k, t, "en", "me/repo", 0) for k, t in enumerate(SECRETS)] + [(100 + k, f"see {COPIED} here", "en", f"o{k}/r", 0) for k in range(5)] + [(None, "token=aaaaaaa", None, None, 0), (3, "AKIA" + "A1" * 9, "en", "me/repo", 0)]
    docs = frame(spark, rows, folder=tmp_path / "d").withColumn("place", F.lit(1)).withColumn("row", F.lit(2))
    got = {}
    for r in secrets.find_secrets(docs, "doc_id", "text").collect():
        got[(r["doc_id"], r["text"])] = r["spans"]
    for d, t, *_ in rows:
        base = [(s["start"], s["kind"], s["end"]) for s in got.get((d, t), []) if s["verdict"] == "base"]
        assert base == plain_spans(t), t
    live = [s["verdict"] for s in got[(11, SECRETS[11])]]
    assert live == ["live"] and {s["verdict"] for s in got[(100, f"see {COPIED} here")]} == {"copied"}
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in clean.collect() if r["doc_id"] != 3}
    assert text[0] == "[SECRET]'" and text[11] == "use [SECRET]" and text[9] == "nothing" and text[7] is None and text[100] == f"see {COPIED} here"
    assert text[6] == "é😀 [SECRET]\" end" and text[12] == "[SECRET]"
    assert secrets.redact(docs.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    text = "ab " + "token=abcdefg, é" * 1500
    got = secrets.find_secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()["spans"]
    assert [(s["start"], s["kind"], s["end"]) for s in got] == plain_spans(text)


def test_html():
    tree = html.grow(list(html.LABELLED))
    assert all(html.decide(tree, x) == y for x, y in html.LABELLED)
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><!-- ad --><div class="cookie-notice">We use cookies</div>
    <article><h1>A &amp; B</h1><p><b>First&nbsp;one<br>line \n two<p>Second &lt;x&gt; a < b <a href=c>link</a>.<div class="ad">Buy now</div><aside>Related</aside><p>Third</p></article><form>Name <textarea><p>no</p></textarea></form><div id="comments"><p>I like this article a lot, thank you so much for it all</p></div><footer>&copy; us</footer>"""
    assert html.main_text(page, tree) == "A & B\n\nFirst one line two\n\nSecond <x> a < b link.\n\nThird"
    assert html.main_text(None, tree) == html.main_text("", tree) == html.main_text("<script>never closed", tree) == html.main_text("<!-- open", tree) == ""
    bare = "<div><a href=1>A</a> <a href=2>B</a></div><div>" + "word " * 60 + "</div><p>" + "more " * 40 + "</p>"
    assert html.main_text(bare, tree) == ("word " * 60).strip() + "\n\n" + ("more " * 40).strip()


LONG = ["The " + "quick brown fox jumps over a lazy dog and " * 8 + "ends.", "Then " + "nothing else of any note happened there " * 6 + "at all."]


@pytest.mark.parametrize(
    "page",
    [
        '<body class="page has-sidebar">{}</body>',
        '<article class="post ad-free">{}</article>',
        '<article class="hentry category-social">{}</article>',
        '<body class="single no-sidebar"><div class="layout-sidebar-right">{}</div><div class="sidebar"><h3>More</h3><p>Something else to read here</p></div></body>',
        '<form method=post>{}<input type=submit></form>',
        '<html class="js no-comments"><main class="social">{}</main><footer>Us</footer></html>',
        '<body><nav><a href=1>One</a></nav><div class="main-content">{}</div><div id="comments"><p>I liked this text a lot and want to say so here today</p></div></body>',
    ],
)
def test_html_names_on_wrappers_drop_nothing(page):
    tree = html.grow(list(html.LABELLED))
    assert html.main_text(page.format("".join(f"<p>{p}</p>" for p in LONG)), tree) == "\n\n".join(LONG)


def test_html_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, HTML_2 int"
    long = "<article>" + "<p>" + "some words of a long page " * 30_000 + "</p>" * 2 + "<p>x</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<p>" + LONG[0], "t", "n", 1), (1, "u", "<p>" + LONG[0], "t", "n", 1), (None, None, None, None, None, None), (2, "v", "", "t", "n", 1), (3, "w", long, "", "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r["page_id"] or 0, r["url"], r["text"]) for r in html.extract(df).collect()), key=str)
    assert got[:4] == [(0, None, ""), (1, "u", LONG[0]), (1, "u", LONG[0]), (2, "v", "")]
    assert got[4][2] == ("some words of a long page " * 30_000).strip() + "\n\nx" * 20_000
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_html_articles_whole(spark):
    from html import unescape

    for r in Q.QUERIES["op7_html_extraction"](spark, DIR).join(spark.read.parquet(DIR + "/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.sub("</?b>", "", re.sub("<br>", " ", re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]))
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_more_matches_of_a_long_text(spark):
    text = "ab " + "token=abcdefg, é" * 12_000
    df = spark.createDataFrame([(1, text, "s", "x")], "doc_id long, text string, source string, kept_row string")
    assert secrets.redact(df).first()["text"] == "ab " + "[SECRET], é" * 12_000


@pytest.mark.parametrize("size", [8192, 40])
def test_top_k_against_brute_force(spark, tmp_path, size):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 7)], 0) for k in range(300)]
    rows += [(300 + k, rows[0][1], 0) for k in range(40)] + [(None, rows[0][1], 0), (400, None, 0), (450, [1.0, float("nan")], 0), (500, [None, 1.0], 0), (501, [float("inf")], 0), (550, [2.0, -1.0], 0), (502, [], 0), rows[0], rows[9]]
    v = frame(spark, rows, "vec_id long, embedding array<float>, label int", tmp_path / "v").withColumn("codes", F.lit(1))
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = set()
    for q, a in {i: a for i, a in sorted(fine, key=lambda r: (r[0], r[1]), reverse=True) if i % 50 == 0}.items():
        best = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk.search(v, v.filter(F.col("vec_id") % 50 == 0), rows=size)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_top_k_of_scores_beyond_64_bits(spark):
    rows = [(k, [1e15, float(k)]) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(v, v.filter(F.col("vec_id") == 0)).collect()


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = [r for r in corpus(seed=4) if r[0] is not None] + [(5000, "secret = 'abcdefgh' " + " ".join(f"u{k}" for k in range(90)), "en", "s1", 0), (5001, "w$$$ " * 100, "en", "s1", 0)]
    docs, seen = frame(spark, rows, folder=tmp_path / "d"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: [r["doc_id"] for r in seen[n].collect()]
    good = {r[0] for r in rows if plain_quality(r[1])[0] >= 50 and 2 * plain_quality(r[1])[4] <= plain_quality(r[1])[0]} - {5001}
    assert set(ids("quality")) == good
    by_id = {r["doc_id"]: r["text"] for r in seen["quality"].collect()}
    roots = plain_components([plain_fingerprint(t) for t in by_id.values()], 3)
    assert len(ids("near_dedup")) == len(set(roots.values()))
    hidden = {r["doc_id"]: r["text"] for r in seen["secrets"].collect()}
    assert hidden[5000].startswith("[SECRET]") and set(hidden) == set(ids("near_dedup"))
    assert all(hidden[k] == by_id[k] for k in hidden if k != 5000)
    assert set(ids("packing")) == set(ids("mixing")) <= set(hidden)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, a long text, columns of clashing names; and no rows."""
    text = lambda k, n=90: " ".join(f"w{(k * 31 + j * 7) % 997}x{'y' * (j % 5)}" for j in range(n))
    rows = [(k, text(k), "en", f"s{k % 3}/r", 0) for k in range(40)] + [(None, text(100), None, None, None), (None, None, None, None, None), (3, text(3), "en", "s0/r", 0), (3, text(3), "en", "s0/r", 0), (50, " ".join(f"v{j}zz{j % 7}" for j in range(60_000)), "en", "s1/r", 0)]
    for name, some in (("odd", rows), ("none", [])):
        odd = ", ".join(["cast(1 as int) AS place", "'a' AS quality", "2.5D AS kept", "'h' AS hash", "3L AS node", "'r' AS kept_row", "'c' AS counted"])
        spark.createDataFrame(some, DOCS).selectExpr("*", *odd.split(", ")).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).toPandas()
        if not some:
            assert not len(got)
            continue
        ids = got["doc_id"].dropna().astype(int)
        assert got["doc_id"].isna().any() and 50 in set(ids) and len(set(ids)) > 30
        for _, own in got.groupby("row"):
            assert own["length"].sum() == own["doc_tokens"].iloc[0]
