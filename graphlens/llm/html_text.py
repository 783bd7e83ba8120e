"""Operator 2: main text of web pages by text-to-tag ratios of parser events.

The standard library's streaming parser turns a page into lines: a line is the text between two
block boundaries, with its number of tags and link characters and the container it stands in. Each
line's text-to-tag ratio is smoothed with a Gaussian; lines over a threshold taken from the page's
own ratios cluster into content regions. A region claims its container, the nearest <article> or
<main>, or else the smallest container that holds all its blocks, so list items, cells, short
paragraphs and headings between long ones stay. Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments have ratio zero: they take no part in regions and never enter the text.

Defined results: null, empty or text-free html gives the empty text; broken markup is read as
browsers do where an element ends with its parent; repeated rows come back once each; null ids and
urls are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Width of the Gaussian in lines, and the share of the ratios' mean that counts as content.
SIGMA, SHARE = 1.0, 0.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img".split()
)
DROPPED = frozenset(
    "head script style noscript template svg math canvas iframe object nav aside footer form button select textarea"
    " dialog menu audio video map".split()
)
HOLDERS = frozenset(
    "html body main article section div header footer nav aside form table td th tr ul ol li dl blockquote".split()
)
#: Holders that are part of the text around them.
PARTS = frozenset("ul ol li dl blockquote table tr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
IN_HEAD = frozenset("title meta link base style script noscript template".split())
SELF_ENDING = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# Words in class, id and role that name what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar"
    " navigation menu menubar breadcrumb breadcrumbs sidebar side rail footer foot masthead comment comments reply replies"
    " respond disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription signup login search share sharing social related recommended recommendations widget toolbar"
    " pagination pager copyright disclaimer legal skip complementary contentinfo".split()
)
TOP_MARKS = frozenset("header top topbar site-header".split())
UNMARKED = frozenset("has with no without js hide is".split())
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def _marked(attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether class, id or role names something other than the article."""
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.split():
                words = [w.lower() for w in _NAME.findall(name)]
                if words and words[0] not in UNMARKED and (
                    not MARKS.isdisjoint(words) or not inside and not TOP_MARKS.isdisjoint(words)
                ):
                    return True
    return False


class _Lines(HTMLParser):
    """Collects lines as [text parts, tags, link characters, container, dropped]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, dropped, article or main, holder
        self.lines: list[list] = []
        self.holders: dict[int, tuple[str, int]] = {}  # holder: its tag and the one around it, 0 outside all
        self.count = 0
        self.line: list = [[], 0, 0, (0, 0), False]

    def _state(self) -> tuple[str, bool, int, int]:
        return self.open[-1] if self.open else ("", False, 0, 0)

    def _break(self) -> None:
        if self.line[0]:
            self.lines.append(self.line)
            tags = 0
        else:
            tags = self.line[1]
        _, dropped, article, holder = self._state()
        self.line = [[], tags, 0, (article, holder), dropped]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.line[0].append(" ")
            self.line[1] += 1
            return
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._end("head", frozenset())
        if tag in CLOSES_P:
            self._end("p", HOLDERS)
        if tag in SELF_ENDING:
            for other in SELF_ENDING[tag].split():
                self._end(other, frozenset(("ul", "ol", "dl", "table")))
        _, dropped, article, holder = self._state()
        self.count += 1
        if tag in ("article", "main"):
            out = dropped or _marked([a for a in attrs if a[0] != "role"], True) and tag == "article"
            here = (tag, out, article or self.count, self.count)
        elif tag in ("html", "body"):
            here = (tag, dropped, article, self.count)
        else:
            out = dropped or tag in DROPPED or tag == "header" and not article or _marked(attrs, bool(article))
            here = (tag, out, article, self.count if tag in HOLDERS else holder)
        if here[3] != holder:
            self.holders[here[3]] = (tag, holder)
        changed = here[1] != dropped
        self.open.append(here)
        if tag not in INLINE or changed:
            self._break()
        self.line[1] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing on other elements

    def _end(self, tag: str, walls: frozenset[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                before = self._state()[1]
                del self.open[at:]
                if tag not in INLINE or self._state()[1] != before:
                    self._break()
                return
            if name in walls:
                return

    def handle_endtag(self, tag: str) -> None:
        self.line[1] += 1
        self._end(tag, frozenset() if tag in HOLDERS else HOLDERS)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.line[0].append(data)
        if any(tag == "a" for tag, *_ in self.open[-4:]):
            self.line[2] += len(data.strip())

    def close(self) -> None:
        super().close()
        self._break()


def regions(ratios: np.ndarray, sigma: float = SIGMA, share: float = SHARE) -> np.ndarray:
    """The content region, from 1 on, of each line that is content; 0 for all others.

    Lines whose Gaussian-smoothed ratio is over a share of the mean ratio cluster into regions; inside
    them the lines whose own ratio is over it, too, are content. Lines of ratio zero are boilerplate
    and left out of the smoothing, and do not end a region; at both ends the kernel is cut to the
    lines that there are. The line with the highest smoothed ratio is always in a region.
    """
    labels = np.zeros(len(ratios), dtype=np.int64)
    at = np.flatnonzero(ratios > 0)
    if not len(at):
        return labels
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth, mass = (np.convolve(x, kernel, mode="full")[reach : reach + len(at)] for x in (ratios[at], np.ones(len(at))))
    value, least = smooth / mass, share * ratios[at].mean()
    inside = value >= min(value.max(), least)
    number = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))
    for n in range(1, number[-1] + 1):
        own = inside & (number == n)
        full = own & (ratios[at] >= least)
        labels[at[full if full.any() else own]] = n
    return labels


def _claimed(seeds: set[int], holders: dict[int, tuple[str, int]]) -> set[int]:
    """Holders that a region with these seeds claims: all in the smallest container of the seeds.

    A list, quote, row or table is part of what stands around it. Of the page's own body, only what
    holds a seed is claimed, and its lists, tables and quotes if a seed stands right in it.
    """
    paths = []
    for at in seeds:
        path = [at]
        while path[-1]:
            path.append(holders[path[-1]][1])
        paths.append(path)
    shared = set(paths[0]).intersection(*paths[1:])
    top = next(h for h in paths[0] if h in shared)
    tag = lambda h: holders[h][0] if h else "body"
    while tag(top) in PARTS:
        top = holders[top][1]
    held, whole = {top}, tag(top) not in ("html", "body")
    seeded = {h for path in paths for h in path}
    # a holder comes after the one around it
    for h, (name, outer) in holders.items():
        if outer in held and (whole or outer != top or h in seeded or top in seeds and name in PARTS):
            held.add(h)
    return held if whole or top in seeds else held - {top}


def main_text(html: str | None) -> str:
    """The page's main text: blocks in order, joined by one space."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = []
    for parts, tags, linked, place, dropped in parser.lines:
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, tags, linked, place, dropped))
    ratios = np.array(
        [0.0 if dropped else max(0, len(text) - linked) / max(1, tags) for text, tags, linked, _, dropped in lines]
    )
    found = regions(ratios)
    articles = {line[3][0] for line, n in zip(lines, found, strict=True) if n and line[3][0]}
    if articles:
        return " ".join(t for t, _, _, (a, _), dropped in lines if a in articles and not dropped)
    held: set[int] = set()
    for n in range(1, int(found.max(initial=0)) + 1):
        seeds = {line[3][1] for line, own in zip(lines, found, strict=True) if own == n}
        if seeds:
            held |= _claimed(seeds, parser.holders)
    return " ".join(t for t, _, _, (_, h), dropped in lines if h in held and not dropped)


@F.pandas_udf(T.StringType())
def main_text_of(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(h) for h in pages], dtype=object)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every page."""
    return pages.select(*keep, main_text_of(F.col(html_col).cast("string")).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


#: DuckDB SQL for the synthetic pages: one <article> of headings and paragraphs each.
ORACLE_SQL = r"""
WITH body AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS a FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM body
), plain AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM bare
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM plain
"""
