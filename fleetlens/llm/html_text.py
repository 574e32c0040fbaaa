"""Operator 3: main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams start tags, end tags and text; block elements cut the page into lines, and each
line has a ratio of its characters to its tags. The ratios are smoothed by a Gaussian along the page and clustered in
two; the lines of the high cluster show where the content is. The region is the deepest element that holds most of
their text; lines inside `article` or `main` weigh more, and a region inside one grows to its borders. All lines of the
region that no menu, advert, form, notice or comment element encloses are the article.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

SIGMA = 1.5
#: The region is the deepest element with this share of the text of content lines.
SHARE = 0.8
#: An article element is the region with this share already, and its lines count so many times.
ARTICLE_SHARE, ARTICLE_WEIGHT = 0.5, 2
#: A line of two or more links is a menu if this share of its text is inside links, outside of articles.
LINKS = 0.8

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style template noscript svg math iframe object head title canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select textarea option fieldset".split())
#: Words of class, id and role names that mark boilerplate.
MARKS = frozenset(
    "ad ads adbox adsense advert advertisement advertisements adverts advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist disqus replies respond sidebar side widget widgets menu nav "
    "navbar navigation navigate breadcrumb breadcrumbs toc pagination pager header masthead footer foot colophon "
    "copyright share sharing social related recommended recommendations teaser teasers tags complementary contentinfo "
    "search toolbar skip".split())
#: Of those, the ones that count on an element that is itself an article.
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments related recommended teaser".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"[^a-z0-9]+")
_OPEN_END = re.compile(r"<[a-zA-Z/!?][^<>]*$")


class _Lines(HTMLParser):
    """Collects the lines of a page: text, tags, characters inside links, links, enclosing elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, tuple[int, ...]]] = []
        self.stack: list[tuple[str, int, bool]] = []  # name, number, whether it is boilerplate or hidden
        self.names: list[str] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.dropped = 0

    def flush_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, max(1, self.tags), self.linked, self.links, tuple(n for _, n, _ in self.stack)))
            self.tags = 0
        self.text, self.linked, self.links = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag not in INLINE and tag != "br":
                self.flush_line()
            return
        if tag not in INLINE:
            self.flush_line()
        if tag == "a":
            self.links += 1
        words: set[str] = set()
        for name, value in attrs:
            if name in ("class", "role") and value and tag not in HEADINGS:
                words.update(_NAME.split(value.lower()))
            elif name == "id" and value and tag not in HEADINGS and not any(n in ARTICLES for n, _, _ in self.stack):
                words.add(value.strip().lower())  # an id of several words is the name of a section
        if tag in ("html", "body"):
            drop = False
        elif tag in ARTICLES:
            drop = bool(words & ARTICLE_MARKS)
            if not drop and any(d for n, _, d in self.stack if n in BOILERPLATE):
                # an article inside a menu or a header: that one was never closed
                while any(d for _, _, d in self.stack):
                    self._pop()
        else:
            drop = tag in HIDDEN or tag in BOILERPLATE or bool(words & MARKS)
        if tag in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and self.stack and self.stack[-1][0] == tag:
            self._pop()
        self.names.append(tag)
        self.stack.append((tag, len(self.names) - 1, drop))
        self.dropped += drop

    def _pop(self) -> None:
        self.dropped -= self.stack.pop()[2]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush_line()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                while len(self.stack) > depth:
                    self._pop()
                break
            if tag in INLINE and self.stack[depth][0] not in INLINE:
                break  # a stray end of an inline element closes no block

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        self.text.append(data)
        if any(n == "a" for n, _, _ in self.stack[-3:]):
            self.linked += len(data.strip())


def _smoothed(ratios: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def _high_cluster(values: np.ndarray) -> np.ndarray:
    """Two-means along a line; all where the values hardly differ."""
    low, high = float(values.min()), float(values.max())
    if high <= 2 * low:
        return np.ones(len(values), bool)
    for _ in range(50):
        upper = values > (low + high) / 2
        new = float(values[~upper].mean()) if (~upper).any() else low, float(values[upper].mean()) if upper.any() else high
        if new == (low, high):
            break
        low, high = new
    return values > (low + high) / 2


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, white space made one space. Empty for a page without text."""
    parser = _Lines()
    html = _OPEN_END.sub("", html or "")
    for at in range(0, len(html), 1 << 16):
        parser.feed(html[at:at + (1 << 16)])
    parser.close()
    parser.flush_line()
    lines = parser.lines
    if not lines:
        return ""
    names = parser.names
    article = [next((n for n in reversed(path) if names[n] in ARTICLES), None) for *_, path in lines]
    weight = [1 if n is None else ARTICLE_WEIGHT for n in article]
    content = _high_cluster(_smoothed(np.array([w * len(t) / tags for (t, tags, *_), w in zip(lines, weight)])))
    held: dict[int, int] = {}
    total = 0
    for (text, _, _, _, path), high, w in zip(lines, content, weight):
        if high:
            total += w * len(text)
            for n in path:
                held[n] = held.get(n, 0) + w * len(text)
    region = max((
        n for n, size in held.items()
        if names[n] != "p" and names[n] not in INLINE and size >= (ARTICLE_SHARE if names[n] in ARTICLES else SHARE) * total), default=None)
    around = next((n for (*_, path), n in zip(lines, article) if region in path and n is not None), None)
    first, last = 0, len(lines)
    if around is not None and around <= region:
        # the clusters have found the article; it is taken whole, the outermost of several in each other
        path = next(path for *_, path in lines if region in path)
        region = next(n for n in path if names[n] in ARTICLES)
    elif region is None or names[region] in ("html", "body"):
        # nothing but the page itself holds the content: from its first dense line, with the heading, to its last
        high = np.flatnonzero(content)
        first, last = int(high[0]), int(high[-1]) + 1
        while first and any(names[n] in HEADINGS for n in lines[first - 1][4]):
            first -= 1
    return " ".join(
        text for (text, _, linked, links, path), n in zip(lines[first:last], article[first:last])
        if (region is None or region in path) and (n is not None or not (links > 1 and linked >= LINKS * len(text))))


@pandas_udf(T.StringType())
def _texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """The rows of `pages` without `html`, with the main text in `into`.

    A null or empty page, and one with nothing but boilerplate, has the empty text; broken and unclosed markup is read
    as far as it goes; repeated rows are extracted alike; an empty table stays empty. A column named `into` is replaced.
    """
    done = pages.withColumn(into, _texts(F.col(html)))
    return done.drop(html) if into != html else done
