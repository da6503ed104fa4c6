"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut into blocks of text at block tags. A block has its words, the share of them inside
links, the same of the blocks before and after, and where it stands: in an article, in page furniture
(menus, headers, footers, sidebars, forms), or under a class or id that names such things; and how much
of the page's text the innermost of these holds, as a name on what wraps the whole page says nothing. A decision tree over these features, grown from the small labelled table below,
keeps or drops each block. The kept blocks are the text, in page order.

The table's rows are the blocks of ``PAGES``, page shapes written for this purpose and labelled there
block by block, and hand-labelled blocks beside them. No page of the corpus is among them.

Edge cases: null or empty html gives an empty text; tags that are never closed end with what holds
them; a comment or script that isn't closed runs to the end; a lone ``<`` is text; repeated rows and
null ids give a row each; very long pages are read whole, in time that grows with their length; empty
tables give empty results; further columns, of any names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

# Names of HTML elements by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body br-less caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset search".split())
MAIN = frozenset("article main".split())
#: Their content is no text of the page, markup in it included.
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
#: Elements whose whole content is dropped.
HIDDEN = frozenset("head select button svg object canvas audio video math map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name what isn't the article.
OFF = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|comment\w*|cookies?|consent|disqus|disclaimer|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|outbrain|pagination|pager|popup|promo\w*|related|replies|respond|search|share|sharing|sidebar|social|sponsor\w*|subscribe|subscription|taboola|tags|toolbar|widget|contentinfo|complementary|alert|alerts)(?:$|[\s_-])",
    re.I,
)
#: Words beside them that make a name one of the page's kind or settings: ``has-sidebar``, ``ad-free``, ``category-social``.
ABOUT = re.compile(r"(?:^|[_-])(?:category|disabled|enabled|free|has|layout|no|not|template|type|with|without)(?:$|[_-])", re.I)
#: A name on these never says that what they hold isn't the article.
WHOLE = frozenset("html body main article".split())
#: Words that name the article's own container.
ON = re.compile(r"(?:^|[\s_-])(?:article|article-?body|content|entry|entry-?content|main|maincontent|post|post-?body|story|text)(?:$|[\s_-])", re.I)

#: Elements whose end tags are often left out.
LEAVES = frozenset("p li dd dt td th tr option".split()) | HEADINGS
ROOT = ("", False, False, False, False, -1)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool
    off: bool
    heading: bool
    within: int
    features: tuple = field(default=())

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def blocks(html: str) -> list[Block]:
    """The flat blocks of text of a page that have a word, with their features."""
    out: list[Block] = []
    stack: list[tuple] = []  # name, article, furniture, off, hidden, innermost element that is furniture or off
    above: list[int] = []  # of each such element the one around it
    pieces: list[tuple[str, bool]] = []
    state, heading, links, at = ROOT, False, 0, 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(unescape(p) for p, _ in pieces).split())
            if text:
                linked = len(" ".join(unescape(p) for p, a in pieces if a).split())
                n = len(text.split(" "))
                out.append(Block(text, n, min(n, linked), state[1], state[2], state[3], heading, state[5]))
            pieces.clear()

    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                if not state[4]:
                    pieces.append((m[0], links > 0))
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            pieces.append((" ", False))
            continue
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if name in BLOCKS:
                flush()
            continue
        if name not in BLOCKS and name not in HIDDEN and (closing or not _named(rest)):
            if closing and any(s[0] == name for s in stack):  # an inline element that was held for its name
                flush()
                while stack and stack.pop()[0] != name:
                    pass
                state = stack[-1] if stack else ROOT
            continue
        flush()
        if name in HEADINGS:
            heading = not closing
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                links = 0
        elif name not in VOID:
            # a new paragraph, item or cell ends the one before, which may have been held for its name
            if name in LEAVES and stack and stack[-1][0] == name:
                stack.pop()
                state = stack[-1] if stack else ROOT
            if name not in LEAVES or _named(rest):
                article, furniture, off, hidden = _place(name, rest)
                within = state[5]
                if furniture or off:
                    above.append(within)
                    within = len(above) - 1
                stack.append((name, state[1] or article, state[2] or furniture, state[3] or off, state[4] or hidden, within))
        if name == "p":
            links = 0
        state = stack[-1] if stack else ROOT
    flush()
    inside = [0] * len(above)
    for b in out:
        if b.within >= 0:
            inside[b.within] += b.words - b.linked
    for k in range(len(above) - 1, -1, -1):  # what is inside came later
        if above[k] >= 0:
            inside[above[k]] += inside[k]
    every = max(1, sum(b.words - b.linked for b in out))
    for k, b in enumerate(out):
        before, after = out[k - 1] if k else None, out[k + 1] if k + 1 < len(out) else None
        b.features = (
            int(b.article), int(b.furniture), int(b.off), int(b.heading), b.words, b.density,
            before.words if before else 0, before.density if before else 0.0, after.words if after else 0, after.density if after else 0.0,
            inside[b.within] / every if b.within >= 0 else 1.0,
        )
    return out


def _named(rest: str) -> bool:
    """Whether a class, id, role or style tells something about the element."""
    return bool(rest) and any(_told(rest))


def _told(rest: str) -> tuple[bool, bool, bool]:
    """On, off, hidden by attributes."""
    on = off = hidden = False
    for name, *value in _ATTRIBUTE.findall(rest):
        name, text = name.lower(), "".join(value)
        if name in ("class", "id", "role", "itemprop"):
            for word in re.sub(r"([a-z])([A-Z])", r"\1-\2", text).split():
                if not ABOUT.search(word):
                    off = off or bool(OFF.search(word))
                    on = on or bool(ON.search(word))
        elif name == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", text, re.I))
        elif name == "hidden" or (name == "aria-hidden" and text.lower() == "true"):
            hidden = True
    return on and not off, off, hidden


def _place(name: str, rest: str) -> tuple[bool, bool, bool, bool]:
    """Article, furniture, off and hidden by an element itself."""
    on, off, hidden = _told(rest)
    return name in MAIN or on, name in FURNITURE, off and name not in WHOLE, hidden or name in HIDDEN


#: Labelled page shapes. Each block is marked by its first word, ``+`` for main text and ``-`` for what isn't; ``+40`` is a block of so many words.
PAGES = (
    # names on what wraps the page or the article
    '<body class="blog has-sidebar"><div class="page-wrap has-sidebar"><h1>+6</h1><p>+70</p><p>+45</p><p>+9</p></div><div class="sidebar"><p>-20</p><p>-6</p></div></body>',
    '<body><div class="sidebar-page"><h1>+5</h1><p>+80</p><p>+30</p><p>+55</p><div class="sidebar"><h3>-2</h3><p>-25</p></div></div></body>',
    '<body><div id="ad-free-promo"><h1>+5</h1><p>+60</p><p>+62</p><p>+4</p></div><div class="ad">-14</div></body>',
    '<body><form id="aspnetForm"><div><a>-1</a> <a>-1</a></div><h1>+7</h1><p>+65</p><p>+90</p><p>+12</p><div class="footer"><p>-9</p></div></form></body>',
    '<body><form><h2>+4</h2><p>+40</p><p>+35</p><ul><li>+8</li><li>+11</li></ul><nav><a>-2</a></nav></form></body>',
    '<body><article class="post category-social"><header><h1>+8</h1></header><p>+75</p><p>+50</p><div class="share"><a>-1</a> <a>-1</a></div></article><div id="comments"><p>-40</p><p>-55</p></div></body>',
    '<div class="widget-area-page"><article><h1>+6</h1><p>+90</p><p>+120</p></article></div>',
    # readers' comments: long, without links, and sometimes most of the page
    '<article><h1>+6</h1><p>+50</p><p>+40</p></article><section id="comments"><div class="comment"><p>-60</p></div><div class="comment"><p>-90</p></div><div class="comment"><p>-45</p></div></section>',
    '<div class="post"><h1>+5</h1><p>+70</p></div><ol class="comment-list"><li class="comment"><p>-50</p><li class="comment"><p>-35</p><li class="comment"><p>-20</p></ol><form><p>-5</p></form>',
    # a small page with a large notice
    '<div class="cookie-consent"><p>-60</p></div><article><h1>+4</h1><p>+30</p><p>+25</p></article><footer>-6</footer>',
)


def _labelled_page(page: str) -> list[tuple[tuple, int]]:
    filled = re.sub(r"[+-](\d+)", lambda m: " ".join([m[0][0], *["w"] * (int(m[1]) - 1)]), page)
    return [(b.features, int(b.text[0] == "+")) for b in blocks(filled)]


#: Labelled blocks: article, furniture, off, heading, words, link density, the same two of the block
#: before and of the block after; and whether the block belongs to the main text. None of them holds most of its page.
BLOCKS_ALONE = (
    # paragraphs and headings of an article, long and short, beside whatever stands around it
    ((1, 0, 0, 1, 8, 0.0, 6, 1.0, 60, 0.0), 1), ((1, 0, 0, 0, 60, 0.0, 8, 0.0, 80, 0.05), 1), ((1, 0, 0, 0, 4, 0.0, 90, 0.0, 12, 1.0), 1),
    ((1, 0, 0, 0, 1, 0.0, 1, 0.0, 1, 0.0), 1), ((1, 0, 0, 0, 200, 0.1, 3, 0.0, 2, 1.0), 1), ((1, 0, 0, 0, 12, 0.5, 40, 0.0, 40, 0.0), 1),
    ((1, 0, 0, 0, 2, 1.0, 40, 0.0, 35, 0.0), 1), ((1, 0, 0, 1, 2, 0.0, 0, 0.0, 0, 0.0), 1), ((1, 0, 0, 0, 30, 0.0, 0, 0.0, 0, 0.0), 1),
    ((1, 1, 0, 1, 9, 0.0, 1, 1.0, 40, 0.0), 1), ((1, 1, 0, 1, 6, 0.0, 9, 0.0, 3, 0.0), 1), ((1, 1, 0, 1, 12, 0.0, 0, 0.0, 4, 0.4), 1), ((1, 0, 0, 0, 3, 0.0, 2, 0.0, 5, 0.0), 1), ((1, 0, 0, 0, 6, 1.0, 6, 1.0, 6, 1.0), 1),
    # notices, adverts, comments and sidebars, inside the article or not
    ((1, 0, 1, 0, 20, 0.0, 60, 0.0, 60, 0.0), 0), ((1, 0, 1, 0, 90, 0.0, 30, 0.0, 30, 0.0), 0), ((1, 0, 1, 1, 1, 0.0, 70, 0.0, 14, 0.0), 0),
    ((0, 0, 1, 0, 40, 0.0, 1, 1.0, 10, 0.0), 0), ((0, 0, 1, 0, 8, 0.0, 1, 1.0, 8, 0.0), 0), ((0, 0, 1, 0, 150, 0.0, 8, 0.0, 5, 0.5), 0),
    ((1, 1, 1, 0, 30, 0.2, 30, 0.0, 30, 0.0), 0), ((0, 1, 1, 0, 60, 0.0, 5, 1.0, 5, 0.0), 0), ((1, 0, 1, 0, 4, 1.0, 50, 0.0, 4, 1.0), 0),
    # furniture by its element
    ((0, 1, 0, 0, 1, 1.0, 0, 0.0, 1, 1.0), 0), ((0, 1, 0, 0, 2, 1.0, 1, 1.0, 2, 1.0), 0), ((0, 1, 0, 0, 14, 0.0, 90, 0.0, 0, 0.0), 0),
    ((0, 1, 0, 0, 70, 0.0, 80, 0.0, 6, 0.3), 0), ((0, 1, 0, 1, 5, 0.0, 0, 0.0, 3, 1.0), 0), ((1, 1, 0, 0, 25, 0.1, 60, 0.0, 60, 0.0), 0),
    ((1, 1, 0, 0, 3, 0.3, 9, 0.0, 50, 0.0), 0), ((1, 1, 0, 0, 2, 0.0, 5, 1.0, 40, 0.0), 0), ((1, 1, 0, 0, 20, 0.0, 2, 1.0, 2, 1.0), 0), ((0, 1, 0, 1, 12, 0.0, 40, 0.0, 30, 0.0), 0), ((1, 1, 0, 0, 90, 0.0, 60, 0.0, 0, 0.0), 0),
    # pages that name nothing: long blocks with few links, and what is short between them
    ((0, 0, 0, 0, 80, 0.02, 6, 0.0, 70, 0.0), 1), ((0, 0, 0, 0, 45, 0.0, 90, 0.0, 1, 1.0), 1), ((0, 0, 0, 0, 25, 0.1, 40, 0.0, 50, 0.0), 1),
    ((0, 0, 0, 1, 7, 0.0, 2, 1.0, 60, 0.0), 1), ((0, 0, 0, 0, 9, 0.0, 55, 0.0, 60, 0.0), 1), ((0, 0, 0, 0, 120, 0.2, 3, 1.0, 3, 1.0), 1),
    ((0, 0, 0, 0, 18, 0.0, 30, 0.0, 30, 0.0), 1), ((0, 0, 0, 0, 22, 0.0, 2, 1.0, 25, 0.0), 1), ((0, 0, 0, 1, 4, 0.0, 30, 0.0, 45, 0.0), 1),
    # the same pages: lists of links and scraps
    ((0, 0, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0), 0), ((0, 0, 0, 0, 4, 1.0, 3, 1.0, 5, 1.0), 0), ((0, 0, 0, 0, 30, 0.9, 2, 1.0, 3, 1.0), 0),
    ((0, 0, 0, 0, 3, 0.0, 1, 1.0, 1, 1.0), 0), ((0, 0, 0, 0, 8, 0.0, 2, 1.0, 3, 0.5), 0), ((0, 0, 0, 0, 6, 0.6, 80, 0.0, 4, 1.0), 0),
    ((0, 0, 0, 0, 40, 0.8, 60, 0.0, 60, 0.0), 0), ((0, 0, 0, 1, 3, 1.0, 3, 1.0, 4, 1.0), 0), ((0, 0, 0, 0, 5, 0.0, 60, 0.0, 0, 0.0), 0),
)


#: Shares of the page in what holds the blocks above, by turns, where they are furniture or off; else it is the page.
SHARES = (0.005, 0.03, 0.1, 0.3)
LABELLED = tuple(((*x, SHARES[k % len(SHARES)] if x[1] or x[2] else 1.0), y) for k, (x, y) in enumerate(BLOCKS_ALONE)) + tuple(r for p in PAGES for r in _labelled_page(p))


def grow(rows: list[tuple[tuple, int]], depth: int = 8) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, tree up to it, tree above) or a label."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part: list) -> float:
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:], strict=False):
            at = (a + b) / 2
            low, high = [r for r in rows if r[0][f] <= at], [r for r in rows if r[0][f] > at]
            score = impurity(low) + impurity(high)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, at, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def decide(tree: tuple | int, features: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(html: str | None, tree: tuple | int) -> str:
    return "\n\n".join(b.text for b in blocks(html or "") if decide(tree, b.features))


def extract(pages: DataFrame, labelled=LABELLED) -> DataFrame:
    """page_id, url, text of every page."""
    small_batches(pages.sparkSession)
    tree = grow(list(labelled))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
