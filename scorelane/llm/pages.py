"""Main text of web pages: flat text blocks and a decision tree.

A page is read once: comments and the contents of scripts, styles and other invisible
elements are dropped, every block-level tag ends a text block, character references are
decoded. A block's features are its words, its link density, those of its neighbours,
and where it stands (inside an article or main element; inside navigation, header,
footer, aside, form or an element whose class or id names such a thing). A small CART
tree, grown at import from the labelled table below, says which blocks are main text.

An article or main element inside a form or an element with such a name is no part of it,
unless it has such a name too. Inside an article the weak names do not count. Where nothing else is main text, forms and names do not
count. Of elements without an end only scripts, styles and comments go to the page's end.

Null and empty pages, and pages without a main block, give an empty text. Unclosed and
stray tags, and a '<' that starts no tag, are tolerated. Comments and scripts leave no space.
Repeated rows get a row each, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by what they do.
INVISIBLE = "noscript|template|svg|head|title|iframe|object|select|textarea|button|canvas"
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ASIDE = set("nav header footer aside form menu dialog fieldset figure".split())
HINTS = re.compile(r"\b(?:nav\w*|menu\w*|head(?:er)?|foot(?:er)?|side\w*|aside|ads?|adverts?|advertisement|sponsor\w*|promo\w*|banner|cookies?|notice|consent|popup|modal|overlay|subscribe|newsletter|signup|login|share|social|related|recommend\w*|breadcrumbs?|comments?|respon\w+|repl(?:y|ies)|disqus|widget|pager|pagination|tags?|copyright|legal|disclaimer|search|form)\b", re.I)
#: Names that say little of an element inside an article, where sections are named by what they tell of.
WEAK = re.compile(r"\b(?:head(?:er)?|tags?|search|form|widget|login|legal|notice|banner)\b", re.I)
_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<({INVISIBLE})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?</\2\s*>|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_MARK = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")

#: Words and link density of a neighbour, in the table below.
_BESIDE = ((0, 0.0), (1, 1.0), (2, 0.0), (9, 0.0), (18, 0.0), (30, 0.0), (60, 0.0))
#: Labelled blocks: words, link density, words before, density before, words after, density after, in article, in something aside, main?
LABELLED = (
    (60, 0.0, 8, 0.0, 45, 0.0, 1, 0, 1), (8, 0.0, 3, 1.0, 60, 0.0, 1, 0, 1), (2, 0.0, 40, 0.0, 30, 0.0, 1, 0, 1), (150, 0.05, 90, 0.0, 80, 0.0, 1, 0, 1),
    (20, 0.1, 70, 0.0, 6, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (5, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1), (35, 0.3, 20, 0.0, 50, 0.1, 1, 0, 1),
    (90, 0.0, 60, 0.0, 12, 0.2, 1, 0, 1), (12, 0.0, 4, 0.0, 4, 0.0, 1, 0, 1), (3, 0.0, 2, 1.0, 15, 0.0, 1, 0, 1), (400, 0.0, 10, 0.0, 9, 0.0, 1, 0, 1),
    (55, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1), (80, 0.02, 9, 0.0, 70, 0.0, 0, 0, 1), (30, 0.0, 60, 0.0, 25, 0.0, 0, 0, 1), (120, 0.1, 5, 1.0, 6, 0.5, 0, 0, 1),
    (14, 0.0, 45, 0.0, 60, 0.0, 0, 0, 1), (9, 0.0, 3, 1.0, 80, 0.0, 0, 0, 1), (45, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (25, 0.05, 30, 0.0, 5, 0.0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 1, 0), (12, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0), (30, 0.0, 50, 0.0, 10, 0.0, 0, 1, 0),
    (60, 0.1, 20, 0.0, 30, 0.0, 0, 1, 0), (25, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0), (8, 0.0, 60, 0.0, 12, 0.0, 0, 1, 0), (100, 0.0, 60, 0.0, 40, 0.0, 0, 1, 0),
    (40, 0.0, 55, 0.0, 35, 0.0, 1, 1, 0), (6, 0.0, 50, 0.0, 40, 0.0, 1, 1, 0), (15, 0.9, 45, 0.0, 3, 1.0, 1, 1, 0), (80, 0.0, 30, 0.0, 60, 0.0, 1, 1, 0),
    (3, 1.0, 80, 0.0, 4, 1.0, 1, 0, 0), (9, 1.0, 20, 0.0, 9, 1.0, 1, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0), (14, 0.9, 60, 0.0, 12, 0.9, 1, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (5, 1.0, 40, 0.0, 5, 1.0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), (6, 0.7, 4, 0.8, 5, 0.9, 0, 0, 0),
    (4, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0), (7, 0.1, 2, 1.0, 4, 0.5, 0, 0, 0), (2, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0), (20, 0.8, 8, 0.9, 15, 0.8, 0, 0, 0),
    # Inside an article unlinked blocks are text beside anything, linked ones and those in something aside are not.
    *((words, 0.0, *b, *a, 1, 0, 1) for words in (1, 3, 9, 25, 60) for b in _BESIDE for a in _BESIDE),
    *((words, 1.0, *b, *a, inside, 0, 0) for words in (1, 3, 9) for inside in (0, 1) for b in _BESIDE for a in _BESIDE),
    *((words, 0.0, *b, *a, inside, 1, 0) for words in (1, 9, 60) for inside in (0, 1) for b in _BESIDE for a in _BESIDE),
    # Outside of one the neighbours tell: a blurb between links is no text, a short line above long text is its heading.
    *((words, 0.0, *b, *a, 0, 0, 1) for words in (25, 60, 150) for b in _BESIDE for a in _BESIDE),
    *((words, 0.0, *b, *a, 0, 0, not (b[1] and a[1])) for words in (10, 14, 20) for b in _BESIDE for a in _BESIDE),
    *((words, 0.0, *b, *a, 0, 0, a[0] >= 30) for words in (1, 3, 7) for b in _BESIDE for a in _BESIDE),
)


class Tree:
    """CART by Gini impurity; grown until pure."""

    def __init__(self, rows: np.ndarray, depth: int = 12) -> None:
        x, y = rows[:, :-1], rows[:, -1]
        self.answer = float(y.mean()) >= 0.5
        self.feature = -1
        if depth and 0 < y.mean() < 1:
            best = None
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] < cut
                    p, q = y[low].mean(), y[~low].mean()
                    impurity = low.mean() * p * (1 - p) + (1 - low.mean()) * q * (1 - q)
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, float(cut), low)
            if best:
                _, self.feature, self.cut, low = best
                self.low, self.high = Tree(rows[low], depth - 1), Tree(rows[~low], depth - 1)

    def __call__(self, x: list[float]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] < node.cut else node.high
        return node.answer


TREE = Tree(np.array(LABELLED, float))


def blocks(page: str) -> list[tuple[str, int, int, bool, int]]:
    """(text, words, words in links, in article, in something aside: 1 by a form or a name only, 2 by an element) of each block that has words."""
    page = _HIDDEN.sub(lambda m: "" if m[1] or m[0].startswith("<!--") else " ", page.replace("\x00", ""))
    out: list[tuple[str, int, int, bool, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    article, aside = False, 0
    link = linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, text.count(" ") + 1, linked, article, aside))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if link:
            linked += len(html.unescape(raw).split())

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2].lower()
        if name == "a":
            link = 0 if m[1] else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close()
            link = 0
            if m[1]:
                if any(x[0] == name for x in stack):
                    while (was := stack.pop())[0] != name:
                        pass
                    article, aside = was[1], was[2]
            elif name not in _VOID and name not in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                stack.append((name, article, aside))
                names = " ".join(_MARK.sub(" ", next(filter(None, x.groups()), "")) for x in _NAMED.finditer(m[3])) if m[3] else ""
                if name in ("article", "main") and (not aside or aside == 1 and not article and not HINTS.search(names)):
                    article, aside = True, 0
                if name in ASIDE and name != "form" and not (name in ("header", "figure") and article):
                    aside = 2
                elif name == "form" or names and name not in ("article", "main", "body", "html") and HINTS.search(WEAK.sub(" ", names) if article else names):
                    aside = max(aside, 1)
    add(page[at:])
    close()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    edge = ("", 0, 0, False, 0)
    density = lambda b: min(1.0, b[2] / b[1]) if b[1] else 0.0
    for most in (0, 1):  # a page that is all in forms or elements with such names is read without them
        kept = []
        for before, b, after in zip([edge, *found], found, [*found[1:], edge]):
            if TREE([b[1], density(b), before[1], density(before), after[1], density(after), b[3], b[4] > most]):
                kept.append(b[0])
        if kept:
            break
    return "\n\n".join(kept)


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(x) for x in text]})

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInPandas(run, "page_id long, url string, text string, n_chars long")
