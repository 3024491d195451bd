"""Main text of web pages by shallow features of flat text blocks.

A page is cut into a flat row of text blocks at block-level tags.  Each block has its word
count and link density and those of its neighbours, and says where it stands: whether in the
page's core, the innermost container that holds most of its plain words; in an article or main
element, or an article within an article, which HTML means for comments; in an element whose tag or role
is boilerplate; in a section that a heading such as "3 comments" opens; and how large a share of its containers' class and id
names are names of boilerplate, so that "related-work" is weaker evidence than "related".  A decision
tree, grown when a worker starts from the blocks of the labelled page layouts below, says
which blocks are main text.

Tags of any length are scanned in one forward pass whose patterns end at the next < or are
consumed; quotes that hold < or > are followed once each, so broken markup and very long pages
stay linear.

Defined results: null and empty pages have empty text; comments, scripts, styles, the head and
hidden elements hold no text; an element that isn't closed ends with its parent; character
references are decoded once; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.bpe import slices
from veritome.llm.common import table, whole_texts

# HTML's elements by their role here.
SILENT = ("script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "select", "canvas", "audio", "video")
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body button center details dialog div dl fieldset figure footer form head header main menu nav ol p search section table td th tr ul li h1 h2 h3 h4 h5 h6 span".split())
VOID = frozenset("hr br img input meta link source area base col embed track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog button head search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
BOILER_NAMES = frozenset("ad ads adsense adverts advert advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright crumbs disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter newsletters notice notices notification pagination paywall popup promo promoted promotion related recommended replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar tracking widget widgets".split())
#: Names that say where or how, not what; they count neither way.
NEUTRAL_NAMES = frozenset("a area article articles bar block body bottom box button buttons c col column container content entry first form global group holder id inner item items js l last left link links list local main outer p page panel post posts primary region right row secondary section site slot static stories sub text thread top u unit view wrap wrapper".split())
#: Names of boilerplate that an article inside doesn't lift.
FIRM_NAMES = frozenset("advert advertisement adverts advertising comment comments discussion disqus promo promoted recommended related replies reply respond responses sidebar sponsor sponsored".split())
CORE_TAGS = frozenset("article body center div main section td".split())
#: Share of the page's plain words that its core holds more than, and its least number of blocks.
CORE_SHARE, CORE_BLOCKS = 0.6, 2

# Every alternative ends at the next < at the latest, but for comments and silent elements, which are consumed.
_NAME = r"(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]{0,40})"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>"
    rf"|<(?P<raw>{'|'.join(SILENT)})\b[^<>]*+(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    rf"""|<{_NAME}(?P<attrs>(?:[^<>"']|"[^"<>]*+"|'[^'<>]*+')*+)/?>"""
    r"|(?P<odd><(?=/?[a-zA-Z]))",
    re.DOTALL | re.IGNORECASE,
)
#: Tags with < or > in quotes, or a quote that doesn't close.
_OPENING, _BARE, _TO_QUOTE = re.compile(f"<{_NAME}"), re.compile(r"</?[a-zA-Z][^<>]*+>"), re.compile(r"""[^<>"']*+""")
_CLOSING = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in SILENT}
# An attribute's name and value; read one after another from a tag's name on, so that no value is taken for a name.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_NOTICE = re.compile(r"(?i)©|\(c\) ?\d{4}|all rights reserved|uses? cookies|accept (?:all )?cookies|privacy (?:policy|notice|settings)|your privacy|terms of (?:use|service)")
_CUE = re.compile(r"(?i)(?:\d+ |no |all |reader |user )?(?:comments?|replies|responses|reactions)(?: \(?\d+\)?| so far)?:?|(?:leave|post|add|write) (?:a|your) (?:comment|reply)|join the (?:discussion|conversation)|what (?:do you|readers) think\??")


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    node: int
    #: Open article and main elements.
    inside: int
    #: Open article elements.
    articles: int
    named: float
    firm: bool
    cued: bool
    heading: int
    notice: bool


class Frame:
    """An open element, and what its text inherits from it."""

    __slots__ = ("articles", "cued", "firm", "inside", "named", "node", "tag")

    def __init__(self, tag: str, node: int, inside: int = 0, articles: int = 0, named: float = 0.0, firm: bool = False, cued: bool = False) -> None:
        self.tag, self.node, self.inside, self.articles, self.named, self.firm, self.cued = tag, node, inside, articles, named, firm, cued


class Outline:
    """Elements in order of their start tags: where they end, and the plain words and blocks they contain, in articles and elsewhere."""

    def __init__(self) -> None:
        self.parent, self.end, self.holds = [-1], [-1], [True]
        self.inside, self.outside = [(0, 0)], [(0, 0)]

    def add(self, tag: str, parent: int) -> int:
        for column, value in ((self.parent, parent), (self.end, -1), (self.holds, tag in CORE_TAGS), (self.inside, (0, 0)), (self.outside, (0, 0))):
            column.append(value)
        return len(self.parent) - 1

    def count(self, node: int, words: int, inside: bool, blocks: int = 1) -> None:
        column = self.inside if inside else self.outside
        w, n = column[node]
        column[node] = w + words, n + blocks

    def close(self, node: int) -> None:
        self.end[node] = len(self.parent)
        if node:
            for inside, (words, n) in ((True, self.inside[node]), (False, self.outside[node])):
                self.count(self.parent[node], words, inside, n)

    def core(self) -> range:
        """The elements of the innermost container that has most of the plain words in articles, or of all if no article has any."""
        own = self.inside if self.inside[0][1] else self.outside
        large = (i for i in range(len(own) - 1, 0, -1) if self.holds[i] and own[i][0] > CORE_SHARE * own[0][0] and own[i][1] >= min(CORE_BLOCKS, own[0][1]))
        node = next(large, 0)
        if node == 0 and own is self.inside:  # several articles: their innermost common container
            node = max((i for i in range(len(own)) if self.holds[i] and own[i] == own[0]), default=0)
        return range(node, self.end[node])


def _share(value: str) -> tuple[float, bool]:
    """Of the names in a class or id, the largest share of words that name boilerplate, and whether one of all such words is firm."""
    share, firm = 0.0, False
    for name in value.split():
        words = [w for w in map(str.lower, _NAMES.findall(name)) if w not in NEUTRAL_NAMES]
        known = [w for w in words if w in BOILER_NAMES]
        if known:
            share = max(share, len(known) / len(words))
            firm = firm or (len(known) == len(words) and not FIRM_NAMES.isdisjoint(known))
    return share, firm


def _marks(tag: str, attrs: str) -> tuple[bool, float, bool]:
    """(hidden, share of boilerplate names, whether tag, role or names are boilerplate that an article inside doesn't lift)."""
    named, firm = 0.0, tag in BOILER_TAGS
    if not attrs or attrs.isspace():
        return False, named, firm
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            return True, named, firm
        if name == "role" and value.lower() in BOILER_ROLES:
            firm = True
        elif name in ("class", "id") and tag not in ("body", "html"):
            share, own = _share(value)
            if tag not in ("article", "main"):
                named = max(named, share)
            firm = firm or own
    return False, named, firm


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose attributes begin at ``at`` ends, -1 if it doesn't.

    ``dead`` holds opening quotes from which no end is reached, so all calls together are linear.
    """
    seen = []
    while True:
        at = _TO_QUOTE.match(page, at).end()
        c = page[at : at + 1]
        if c == ">":
            return at + 1
        close = page.find(c, at + 1) if c and c != "<" and at not in dead else -1
        if close < 0:
            dead.update(seen, (at,))
            return -1
        seen.append(at)
        at = close + 1


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str, bool]]:
    """(start, end, tag, whether an end tag, attributes, whether silent) of every token of the page, in order."""
    at, dead = 0, set()
    while m := _TOKEN.search(page, at):
        start, at = m.span()
        if not m["odd"]:
            yield start, at, m["tag"] or "", bool(m["end"]), m["attrs"] or "", bool(m["raw"])
            continue
        name = _OPENING.match(page, start)
        end = _tag_end(page, name.end(), dead)
        if end < 0:
            if bare := _BARE.match(page, start):
                at = bare.end()
                yield start, at, "", False, "", False
            continue
        at, attrs = end, page[name.end() : end - 1]
        if name["tag"].lower() in _CLOSING and not name["end"]:
            if not attrs.endswith("/"):
                close = _CLOSING[name["tag"].lower()].search(page, end)
                at = close.end() if close else len(page)
            yield start, at, "", False, "", True
        else:
            yield start, at, name["tag"], bool(name["end"]), attrs, False


def blocks(page: str) -> tuple[list[Block], range]:
    """Text blocks of a page, in order, and the elements of its core."""
    out: list[Block] = []
    outline = Outline()
    stack = [Frame("", 0)]
    #: How many of each tag are open, so that an end tag without a start looks for none, however deep the page.
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    in_link: list[bool] = []
    link, heading, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal text, in_link
        if text and not hidden:
            joined = "".join(text)
            words = (html.unescape(joined) if "&" in joined else joined).split()
            if words:
                linked = sum(len(t.split()) for t, on in zip(text, in_link, strict=True) if on)
                whole = " ".join(words)
                own = stack[-1]
                if len(words) <= 5 and _CUE.fullmatch(whole):
                    next(f for f in reversed(stack) if f.tag not in HEADINGS and f.tag not in ("p", "span")).cued = own.cued = True
                b = Block(whole, len(words), min(1.0, linked / len(words)), own.node, own.inside, own.articles, own.named, own.firm, own.cued, heading, bool(_NOTICE.search(whole)))
                out.append(b)
                if not (b.firm or b.cued or b.named == 1):
                    outline.count(own.node, max(0, len(words) - linked), own.inside > 0)
        text, in_link = [], []

    def leave() -> None:
        nonlocal hidden
        frame = stack.pop()
        open_tags[frame.tag] -= 1
        outline.close(frame.node)
        if hidden > len(stack):
            hidden = 0

    at = 0
    for start, stop, tag, is_end, attrs, silent in _tokens(page):
        if start > at:
            text.append(page[at:start])
            in_link.append(link > 0)
        at = stop
        if not tag:
            if silent:
                text.append(" ")
                in_link.append(False)
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if is_end else 1
            continue
        if tag == "br":
            text.append(" ")
            in_link.append(link > 0)
            continue
        if tag in BLOCK:
            flush()
            link = 0
        if tag in HEADINGS:
            heading = 0 if is_end else int(tag[1])
        if tag not in CONTAINERS or tag in VOID:
            continue
        if is_end:
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    if hidden > k:
                        flush()
                    while len(stack) > k:
                        leave()
                    break
                if tag in ("p", "span", "li", "td", "th", "tr") and stack[k].tag in ("article", "main", "div", "section", "body", "nav", "aside", "footer", "header", "form"):
                    break
            continue
        if tag == "body":
            while len(stack) > 1:
                leave()
        while stack[-1].tag in ("p", *HEADINGS) and tag in BLOCK:
            leave()
        if tag == "li" and stack[-1].tag == "li":
            leave()
        up = stack[-1]
        unseen, named, firm = _marks(tag, attrs)
        if tag == "header" and not up.inside:
            firm = True
        if unseen and not hidden:
            flush()
            hidden = len(stack) + 1
        article = tag in ("article", "main")
        # An article in a container of boilerplate by name alone isn't boilerplate.
        frame = Frame(tag, outline.add(tag, up.node), up.inside + article, up.articles + (tag == "article"), named if article else max(up.named, named), up.firm or firm, up.cued)
        stack.append(frame)
        open_tags[tag] += 1
    if at < len(page):
        text.append(page[at:])
        in_link.append(link > 0)
    flush()
    while stack:
        leave()
    return out, outline.core()


#: In the order in which equally good splits are preferred.
FEATURES = ("core", "link_density", "words", "density_before", "density_after", "cued", "nested", "firm", "named", "notice", "heading", "words_before", "words_after", "inside", "has_article")


def features(page: str) -> tuple[list[str], list[tuple[float, ...]]]:
    """Text and features of each block."""
    flat, core = blocks(page)
    has_article = any(b.inside and not (b.firm or b.cued or b.named == 1) for b in flat)
    none = (0, 0.0)
    around = [none, *((b.words, b.link_density) for b in flat), none]
    rows = [
        (b.node in core, b.link_density, b.words, before[1], after[1], b.cued, b.articles > 1, b.firm, b.named, b.notice, b.heading, before[0], after[0], b.inside > 0, has_article)
        for b, before, after in zip(flat, around, around[2:], strict=False)
    ]
    return [b.text for b in flat], rows


#: The labelled table: page layouts, whose text +n is n words of main text; all other text is boilerplate, of which -n is n words.
LAYOUTS = (
    # An article element with menus, adverts, forms, notices and footers around and inside.
    "<header><h1>-3</h1></header><nav><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></nav><div class=ad>-8</div><article><h1>+8</h1><p>+60</p><p>+1</p><p>+45</p><p>+2</p></article><footer>-6 © <a>-2</a></footer>",
    "<div class=top-bar><a>-2</a></div><article><h2>+6</h2><p>+20</p><div class='ad unit'>-25</div><p>+90</p><aside><p>-30</p></aside><ul><li>+3</li><li>+5</li><li>+1 <a>+2</a></li></ul><form><label>-2</label></form><p>+12</p></article><div class=related-posts><h3>-2</h3><a>-6</a><p><a>-7</a></p></div>",
    "<main><h1>+5</h1><p>+5</p><p>+3</p></main><aside class=sidebar><h3>-2</h3><p>-90</p></aside><footer><p>-40 all rights reserved</p></footer>",
    "<article><h1>+9</h1><p>+70</p><section id=tags-and-labels><h2>+3</h2><p>+60</p><p>+4</p></section><section id=share-of-energy><h2>+4</h2><p>+50</p></section><div class=related-work><p>+45</p><p>+6</p></div><div class=share-buttons>-4</div><div class=tags><a>-1</a> <a>-1</a></div></article>",
    "<article><p>+80</p><p>+3</p><div class=replies><p>-25</p><p>-3</p></div></article>",
    "<article><h1>+4</h1><p>+40</p><p>+9</p><section id=comments><h3>12 comments</h3><article><p>-30</p></article><article><p>-4</p></article></section></article>",
    "<article><h1>+4</h1><p>+120</p><p>+30</p><h3>Comments</h3><div><p>-20</p><p>-2</p></div><div><p>-45</p></div></article>",
    "<article><p>+50</p><article><p>-18</p></article><article><p>-60</p><p>-3</p></article></article><p>-12</p>",
    "<div class='page with-sidebar'><article><h1>+6</h1><p>+30</p><blockquote>+20</blockquote><table><tr><td>+2</td><td>+1</td></tr></table><p>+14</p></article><div class=sidebar><p>-50</p><ul><li><a>-3</a></li><li><a>-4</a></li></ul></div></div>",
    "<article><h1><a>+7</a></h1><p>+60</p><p><a>+5</a></p><p>+30 <a>+20</a></p><ul><li><a>+6</a> +4</li><li>+9</li></ul><p>+70 all rights reserved +5</p></article><div>-30 privacy policy</div><div>-4</div>",
    "<article><p>+30</p><p>+25</p><h4>2 replies</h4><p>-40</p><ul><li>-10</li><li>-60</li></ul></article>",
    "<article><h1>+6</h1><p>+90</p><p>+4</p><article><h4>-2</h4><p>-70</p></article></article><footer>-5</footer>",
    "<article><p>+30</p><ul><li><a>-1</a></li><li><a>-3</a></li><li><a>-2</a></li></ul><p>+40</p><p>+20 <a>+8</a></p><p><a>+4</a></p><p>+50</p></article>",
    "<article><p>+1</p></article><div class=cookie-notice>-20</div><div>-15 we use cookies</div>",
    "<article><h1>+3</h1><p>+2</p><p>+5</p></article><p>-100</p><div><p>-60</p></div>",
    "<article><header><h1>+8</h1></header><p>+35</p><ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-1</a></li></ul><p>+40</p><div class=newsletter-signup><p>-15</p></div><p>+8</p></article>",
    "<article><h1>+8</h1><p>+20</p><div class=notice-of-meeting><p>+30</p></div><div id=search-for-life><p>+40</p><p>+2</p></div><div class=promo-box>-12</div></article>",
    "<nav><a>-1</a><a>-1</a></nav><main><article><h2>+5</h2><p>+50</p></article><article><h2>+7</h2><p>+40</p><p>+6</p></article></main><footer><p>-10</p></footer>",
    # No article element: the core is told by where most words stand.
    "<div id=nav><a>-1</a><a>-2</a></div><h1>+6</h1><p>+60</p><p>+40</p><p>+2</p><div id=footer>-8 © -2</div>",
    "<div class=header><p>-3</p></div><div><h1>+7</h1><p>+50</p><p>+12</p><p>+90</p><h2>+2</h2><p>+4</p><p>+33</p></div><div><p>-25</p></div><div><p>-14 your privacy -20</p></div>",
    "<div><h2>+3</h2><p>+30</p><p>+3</p><p>+30</p></div><div>-2 © -2</div>",
    "<div><ul><li><a>-1</a></li><li><a>-2</a></li></ul></div><div><div><p>+40</p></div><div><p>+35</p><p>+1</p></div><div><p>+55</p></div></div><div><h3>Leave a reply</h3><p>-12</p></div>",
    "<table><tr><td><a>-2</a><p><a>-3</a></p></td><td><h1>+5</h1><p>+70</p><p>+8</p><p>+20 <a>+3</a></p></td></tr></table><p>-9 terms of use</p>",
    "<h1>+9</h1><div><p>+40</p><p>+40</p><p>+5</p></div><h3>3 comments</h3><p>-15</p><p>-30</p>",
    "<p>+100</p>", "<p>+13</p>", "<p>+40</p><p>+3</p>", "<h1>+3</h1><p>+25</p><p>+2</p>", "+50", "<div>+6</div>",
    "<div class=menu><p>-2</p><p>-3</p></div><p>+20</p><p>+30</p><div class=sponsored-links><p>-30</p></div>",
    "<div><p>+60</p><p>+30</p><div class=social-share><p>-6</p></div><p>+4</p></div><div class=widget-area><p>-40</p><p>-3</p></div><div><p>-8</p><p>-30</p></div>",
    "<p><a>-2</a></p><p><a>-3</a></p><p><a>-1</a></p><p>+80</p><p>+45</p><p><a>-8</a></p><p><a>-4</a></p>",
    "<div><p><a>-4</a> -1</p><p><a>-4</a></p></div><div><p>+45 <a>+6</a></p><p>+30 <a>+10</a></p><p>+5</p></div><form><p>-6</p></form>",
    "<ul><li>+8</li><li>+12</li><li>+3</li></ul><p>+20</p>", "<dl><dt>+2</dt><dd>+14</dd><dt>+1</dt><dd>+9</dd></dl>",
    "<div class=related><h4>-2</h4><p>-20</p></div><div class=entry><p>+70</p><p>+20</p></div><div class=comment-list><p>-60</p><p>-35</p></div>",
    "<div role=navigation><p>-5</p></div><div role=main><h2>+4</h2><p>+15</p><p>+25</p><p>+1</p></div><div role=contentinfo><p>-20</p></div>",
)
#: Each layout counts with its numbers of words and with these multiples of them.
SCALES = (1.0, 0.2, 0.5, 2.0, 6.0)
_COUNT = re.compile(r"([+-])(\d+)")


def drawn(layout: str, scale: float) -> str:
    """The page of a layout: main text is the word "main", other text "other"."""
    return _COUNT.sub(lambda m: " ".join(["main" if m[1] == "+" else "other"] * max(1, round(int(m[2]) * scale))), layout)


def labelled(layouts: tuple[str, ...] = LAYOUTS, scales: tuple[float, ...] = SCALES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the layouts."""
    x, y = [], []
    for page in (drawn(one, s) for one in layouts for s in scales):
        texts, rows = features(page)
        x += rows
        y += [t.startswith("main") for t in texts]
    return np.array(x, float), np.array(y, float)


#: Least number of labelled blocks in a leaf.
LEAST = 4


class Tree:
    """A binary decision tree grown by Gini impurity until leaves are pure or no split leaves ``LEAST`` rows on both sides."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.feature, self.leaf = -1, float(y.mean()) if len(y) else 0.0
        if self.leaf in (0.0, 1.0):
            return
        best = (np.inf, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                on = x[:, f] <= cut
                if min(on.sum(), (~on).sum()) < LEAST:
                    continue
                best = min(best, (sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[on], y[~on])), f, float(cut)))
        if best[1] < 0:
            return
        _, self.feature, self.cut = best
        on = x[:, self.feature] <= self.cut
        self.low, self.high = Tree(x[on], y[on]), Tree(x[~on], y[~on])

    def __call__(self, row: tuple[float, ...]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.leaf > 0.5


def trained_tree() -> Tree:
    return Tree(*labelled())


def main_text(page: str, tree: Tree) -> str:
    texts, rows = features(page)
    return "\n\n".join(t for t, row in zip(texts, rows, strict=True) if tree(row))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text) of every whole page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained_tree()
        for b in batches:
            text = [main_text(p, tree) for _, page in slices(iter([b])) for p in page]
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array(text, pa.string())], ["_id", *(f"_{i}" for i in range(len(keep))), "_text"])

    rows = pages.select(pages[id_col].alias("_id"), pages[html_col].cast("string").alias("_html"), *(pages[c].alias(f"_{i}") for i, c in enumerate(keep)))
    schema = rows.drop("_html").withColumn("_text", F.lit("").cast("string")).schema
    return whole_texts(rows).mapInArrow(run, schema).toDF(id_col, *keep, "text")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
