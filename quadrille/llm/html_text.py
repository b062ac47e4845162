"""HTML extraction: flat text blocks, neighbour features, and a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  A block's features are its
word count and link density, those of its neighbours, and what encloses it (landmark elements,
and words in class, id or role).  Such a word makes an element chrome with all inside it, but for
two cases: an article or main element ends the chrome of wrappers that only their class or id
names so, and an element that holds most of the page's words is not chrome for a part of a
compound (has-sidebar, tag-news), nor an article or main element for any class.  For an article
both hold only where it has most of the page's words, as comments and teasers are often articles.
A form is chrome with all its text, but for a form wrapped around the page: one that holds an article,
main or nav element or a first heading.  Where a page marks its article, the blocks beside it are told
to the tree by a feature of their own.  A decision tree, grown here on the small labelled table below,
says which blocks are main text.

Elements that hold no text of the page (scripts, styles, templates, form controls, comments of the
markup, the head) are left out before blocks are made.  Character references are decoded, white
space inside a block becomes one space, blocks are joined by one newline in page order.

Defined results: null and empty pages, and pages without a main block, give an empty text; rows
repeated in full give repeated rows; unclosed and misnested tags are closed at the next block.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
_SKIP = {"head", "script", "style", "template", "svg", "math", "canvas", "object", "audio", "video", "select", "button", "textarea", "iframe", "noscript", "datalist", "option", "label", "dialog", "xmp", "noembed", "noframes", "title", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_FORM = {"form", "fieldset"}
_HELD = {"article", "main", "nav", "h1"}  # a form with one of these is a wrapper of the page
_LANDMARK = {"nav", "footer", "aside", "menu", "header"}
_CHROME = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menus?|sidebars?|side-?bar|side|footer|foot|header|masthead|breadcrumbs?|cookies?\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|more-?stories|trending|widgets?|toolbar|pagination|pager|comments?|commentlist|disqus|replies|reply|respond|reviews?|discussion|copyright|legal|disclaimer|skip|search|tags?|byline-?links|outbrain|taboola|teasers?|navigation|contentinfo|complementary)(?=$|[\s_-])", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-?body|main|main-?content|content|post|post-?body|entry|entry-?content|story|story-?body|text|body)(?=$|[\s_-])", re.I)
_NOTICE = re.compile(r"^\s*(?:©|\(c\)|copyright\b|all rights reserved|we use cookies|this (?:web)?site uses cookies|advertisement\b|sponsored\b|subscribe\b|sign up\b|share this\b)", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "main", "article", "notice", "heading", "beside")


class Block:
    __slots__ = ("text", "words", "linked", "chrome", "main", "article", "heading")

    def __init__(self, text, words, linked, chrome, main, article, heading):
        self.text, self.words, self.linked, self.chrome, self.main, self.article, self.heading = text, words, linked, chrome, main, article, heading


class Mark:
    """An element that says something of the text in it: chrome (certain: by element or role; plain: a whole class word), main text."""

    __slots__ = ("name", "chrome", "certain", "plain", "main", "most", "wraps")

    def __init__(self, name, chrome, certain, plain, main):
        self.name, self.chrome, self.certain, self.plain, self.main, self.most, self.wraps = name, chrome, certain, plain, main, False, False


_P_CLOSERS = _BLOCK - {"html", "body"}


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    page = page or ""
    stack: list[tuple[str, int, bool, int]] = []  # name, chrome, marked, article
    marks: list[Mark] = []  # all elements that say something of chrome or main text
    path: list[int] = []  # those that are open
    paths: list[tuple[int, ...]] = []  # of each block
    articles = 0
    parts: list[str] = []
    linked: list[str] = []
    skip, link, heading = 0, 0, 0

    def flush():
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                share = len(_html.unescape(" ".join(linked)).split()) / words if linked else 0.0
                out.append(Block(text, words, min(share, 1.0), False, False, articles > 0, heading > 0))
                paths.append(tuple(path))
            parts.clear()
            linked.clear()

    def pop(to: int):
        nonlocal skip, link, heading, articles
        while len(stack) > to:
            name, c, marked, a = stack.pop()
            if marked:
                path.pop()
            articles -= a
            skip -= name in _SKIP or c == 2
            link -= name == "a"
            heading -= name in ("h1", "h2", "h3", "h4", "h5", "h6")

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at and not skip:
            parts.append(page[at:upto])
            if link:
                linked.append(page[at:upto])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # end tag
            if name in _BLOCK:
                flush()
            elif name == "br" and not skip:
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in ("article", "main", "body", "html", "table") and name not in ("article", "main", "body", "html", "table", "nav", "footer", "aside", "section", "div"):
                    break
            continue
        if name == "br":
            if not skip:
                parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if name in _VOID:
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _P_CLOSERS:  # a block ends an open paragraph and the inline elements in it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    pop(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        if name == "body":  # a head that was never closed ends here
            for k, x in enumerate(stack):
                if x[0] == "head":
                    pop(k)
                    break
        chrome = main = 0
        certain = plain = False
        if m[3].strip():
            hidden = False
            for x in _ATTRIBUTE.finditer(m[3]):
                value = x[2] or x[3] or x[4] or ""
                key = x[1].lower()
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
                elif key in ("class", "id", "role", "itemprop") and name not in ("body", "html"):
                    if _CHROME.search(value):
                        chrome = 1
                        certain |= key == "role"
                        plain |= any(_CHROME.fullmatch(w) for w in value.split())
                    main |= bool(_MAIN.search(value))
            if hidden:
                chrome = 2
        if name in _HELD:
            for k in path:
                marks[k].wraps = True
        inside = any(x[0] == "article" for x in stack)
        if name in _LANDMARK and not (name == "header" and inside):
            chrome, certain = max(chrome, 1), True
        if chrome == 1 and main and name in ("article", "main"):
            chrome = 0
        article = int(name in ("article", "main"))
        marked = bool(chrome or main or article or name in _FORM)
        if marked:
            path.append(len(marks))
            marks.append(Mark(name, chrome > 0, certain, plain, bool(main)))
        stack.append((name, chrome, marked, article))
        articles += article
        skip += name in _SKIP or chrome == 2
        link += name == "a"
        heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    settle(out, paths, marks)
    return out


def settle(found: list[Block], paths: list[tuple[int, ...]], marks: list[Mark]) -> None:
    """Sets chrome and main of the blocks, now that it is known how much text each element holds."""
    held, total = [0] * len(marks), sum(b.words for b in found)
    for b, path in zip(found, paths):
        for k in path:
            held[k] += b.words
    for m, words in zip(marks, held):
        m.most = 2 * words > total
        if m.name in _FORM and not m.wraps:
            m.chrome = m.certain = True
        if m.chrome and not m.certain and m.most and (m.name in ("article", "main") or not m.plain):
            m.chrome = False
    for b, path in zip(found, paths):
        certain = likely = False
        for m in (marks[k] for k in path):
            if not m.chrome and (m.name == "main" or m.name == "article" and m.most):
                likely = False
            certain |= m.chrome and m.certain
            likely |= m.chrome
            b.main |= m.main and not m.chrome
        b.chrome = certain or likely


def block_features(found: list[Block]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(found):
        x[i, 0], x[i, 1] = b.words, b.linked
        x[i, 6:11] = b.chrome, b.main, b.article, bool(_NOTICE.search(b.text)), b.heading
    if any(b.article for b in found):
        x[:, 11] = [not b.article for b in found]
    if n:
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
    return x


#: The labelled table: words, links, words and links before, words and links after, in chrome, in an
#: element marked as content, in article or main, starts like a notice, heading -> main text?
LABELLED = (
    # a page with landmarks: menu, banner, article, footer
    ((1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 0), 0), ((1, 1.0, 1, 1.0, 7, 0.0, 1, 0, 0, 0, 0), 0), ((7, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0, 0), 0),
    ((9, 0.0, 7, 0.0, 40, 0.0, 0, 0, 1, 0, 1), 1), ((40, 0.0, 9, 0.0, 85, 0.05, 0, 0, 1, 0, 0), 1), ((85, 0.05, 40, 0.0, 3, 0.0, 0, 0, 1, 0, 0), 1),
    ((3, 0.0, 85, 0.05, 60, 0.0, 0, 0, 1, 0, 0), 1), ((1, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1, 0, 0), 1), ((60, 0.0, 3, 0.0, 12, 0.1, 0, 0, 1, 0, 0), 1),
    ((12, 0.1, 60, 0.0, 0, 0.0, 1, 0, 0, 1, 0), 0), ((11, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1, 0), 0), ((2, 1.0, 40, 0.0, 40, 0.0, 0, 0, 1, 0, 0), 1),
    ((30, 0.0, 60, 0.0, 20, 0.0, 1, 0, 1, 0, 0), 0), ((20, 0.0, 30, 0.0, 30, 0.0, 1, 0, 1, 0, 0), 0), ((120, 0.0, 20, 0.0, 8, 0.0, 1, 0, 1, 0, 0), 0),
    ((6, 1.0, 120, 0.0, 6, 1.0, 1, 0, 1, 0, 0), 0), ((5, 0.0, 60, 0.0, 25, 0.0, 1, 0, 0, 0, 1), 0), ((25, 0.0, 5, 0.0, 30, 0.0, 1, 0, 0, 0, 0), 0),
    # content marked by class only
    ((8, 0.0, 1, 1.0, 50, 0.0, 0, 1, 0, 0, 1), 1), ((50, 0.02, 8, 0.0, 44, 0.0, 0, 1, 0, 0, 0), 1), ((2, 0.0, 50, 0.0, 44, 0.0, 0, 1, 0, 0, 0), 1),
    ((5, 1.0, 50, 0.0, 5, 1.0, 0, 1, 0, 0, 0), 0), ((6, 0.9, 5, 1.0, 4, 1.0, 0, 1, 0, 0, 0), 0), ((44, 0.0, 2, 0.0, 6, 0.0, 0, 1, 0, 0, 0), 1),
    ((35, 0.0, 44, 0.0, 20, 0.0, 1, 1, 0, 0, 0), 0), ((9, 0.0, 44, 0.0, 3, 1.0, 1, 1, 0, 0, 0), 0),
    # bare markup: words, links and neighbours decide
    ((1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), 0), ((2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0, 0), 0), ((12, 0.8, 2, 1.0, 5, 0.9, 0, 0, 0, 0, 0), 0),
    ((30, 0.7, 12, 0.8, 8, 0.9, 0, 0, 0, 0, 0), 0), ((6, 0.0, 2, 1.0, 55, 0.0, 0, 0, 0, 0, 1), 1), ((55, 0.0, 6, 0.0, 70, 0.05, 0, 0, 0, 0, 0), 1),
    ((70, 0.05, 55, 0.0, 40, 0.0, 0, 0, 0, 0, 0), 1), ((22, 0.1, 70, 0.0, 18, 0.0, 0, 0, 0, 0, 0), 1), ((18, 0.0, 22, 0.1, 4, 0.0, 0, 0, 0, 0, 0), 1),
    ((14, 0.0, 55, 0.0, 30, 0.0, 0, 0, 0, 0, 0), 1), ((16, 0.0, 30, 0.0, 44, 0.0, 0, 0, 0, 0, 0), 1), ((3, 0.0, 55, 0.0, 70, 0.0, 0, 0, 0, 0, 0), 1),
    ((5, 0.0, 48, 0.0, 60, 0.0, 0, 0, 0, 0, 0), 1), ((4, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0), 0), ((3, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0, 0, 0), 0),
    ((6, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 0, 0), 0), ((9, 0.1, 40, 0.0, 0, 0.0, 0, 0, 0, 1, 0), 0), ((12, 0.0, 0, 0.0, 6, 1.0, 0, 0, 0, 1, 0), 0),
    ((25, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 1, 0), 0), ((30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 1), ((4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 0),
)


#: Blocks of one page each, all of one kind: (words of the blocks in order, link share, chrome, main, article, heading) -> main text?
#: What a page marks as its article is main text whatever its length, and chrome is not.
RUNS = (
    (((1, 40, 2, 90, 15, 300, 1), 0.0, 0, 0, 1, 0), 1), (((60, 5, 1, 1, 30, 700), 0.0, 0, 0, 1, 0), 1), (((3, 12, 4, 2, 8), 0.0, 0, 0, 1, 1), 1), (((2, 6, 30, 150), 0.3, 0, 0, 1, 0), 1),
    (((1, 4, 2, 20, 1), 1.0, 0, 0, 1, 0), 1), (((45, 10, 80, 1, 200), 0.0, 0, 1, 1, 0), 1), (((7, 25, 3), 0.6, 0, 0, 1, 0), 1), (((12, 5, 33), 0.0, 0, 0, 1, 0), 1),
    (((1, 1, 2, 1, 3, 1), 1.0, 1, 0, 0, 0), 0), (((1, 2, 1, 4), 1.0, 1, 0, 1, 0), 0), (((40, 90, 6, 200), 0.0, 1, 0, 0, 0), 0), (((35, 80, 12, 300, 2), 0.0, 1, 0, 1, 0), 0),
    (((5, 9, 3), 0.0, 1, 0, 0, 1), 0), (((8, 3, 5), 0.0, 1, 0, 1, 1), 0), (((15, 60, 33), 0.2, 1, 1, 0, 0), 0), (((18, 44, 7), 0.5, 1, 1, 1, 0), 0),
    (((30, 55, 18, 120), 0.0, 0, 1, 0, 0), 1), (((4, 2, 9, 40, 3), 0.0, 0, 1, 0, 0), 1), (((3, 2, 5, 4), 1.0, 0, 1, 0, 0), 0), (((50, 25, 90, 33), 0.05, 0, 0, 0, 0), 1),
    (((2, 3, 1, 2, 4), 1.0, 0, 0, 0, 0), 0), (((12, 20, 30), 0.85, 0, 0, 0, 0), 0), (((3, 2, 4, 1), 0.0, 0, 0, 0, 0), 0),
)


#: Blocks of one page each that also has an article elsewhere: (words, link share, chrome, main, heading); none is main text.
BESIDE = (
    ((1, 40, 2, 90, 15, 300, 1), 0.0, 0, 0, 0), ((60, 5, 1, 30, 700), 0.0, 0, 0, 0), ((2, 6, 30, 150), 0.3, 0, 0, 0), ((45, 10, 80, 1, 200), 0.0, 0, 1, 0), ((7, 25, 3, 400), 0.1, 0, 1, 0),
    ((3, 12, 4, 2, 8), 0.0, 0, 0, 1), ((3, 12, 4, 2, 8), 0.0, 0, 1, 1), ((4, 2, 9, 40, 3), 0.0, 0, 1, 0), ((50, 25, 90, 33), 0.05, 0, 0, 0), ((30, 55, 18, 120), 0.0, 0, 0, 0), ((1, 2, 20, 5), 1.0, 0, 0, 0),
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The table as features and labels; the runs become one row per block."""
    x, y = [(*r, 0) for r, _ in LABELLED], [c for _, c in LABELLED]
    for (words, link, chrome, main, article, heading), c in RUNS:
        page = [Block("", w, link, chrome, main, article, heading) for w in words]
        x += block_features(page).tolist()
        y += [c] * len(page)
    for words, link, chrome, main, heading in BESIDE:
        page = [Block("", w, link, chrome, main, False, heading) for w in words]
        rows = block_features(page)
        rows[:, -1] = 1
        x += rows.tolist()
        y += [0] * len(page)
    return np.array(x, float), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A CART by Gini impurity: (feature, threshold, left, right) or a class."""
    if depth == 0 or len(set(y)) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            gini = sum(2 * p * (1 - p) * w for p, w in ((y[left].mean(), left.sum()), (y[~left].mean(), (~left).sum())))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, t, left)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, left = best
    return (f, float(t), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    left = x[:, f] <= t
    out = np.zeros(len(x), int)
    out[left], out[~left] = predict(a, x[left]), predict(b, x[~left])
    return out


def train():
    return grow(*labelled())


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = predict(tree, block_features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    common.small_batches(pages.sparkSession)
    tree = train()
    kinds = pages.schema

    def run(batches):
        for pdf in batches:
            text = [main_text(h, tree) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
