"""Main text of web pages.

Standard-library parser events are streamed into lines: the text between two
tags that break it. Elements that are never content (menus, forms, adverts, ...)
are left out as they open. Each line has a text-to-tag ratio; the ratios are
smoothed with a Gaussian and cut at a threshold, which gives the clusters of
lines that the content is in. A region is the article or main element that holds
such a cluster, or, on pages without such elements, all of the nearest container
(a div, for instance) that holds every cluster and more than one line, so that
short headings and paragraphs beside the clusters belong to it. If it has no
heading, and its parent has one right in it before, the parent takes its place.
Inside of a region, groups of lines below the threshold go if they are mainly
links: lists of links, and what the name of its element says isn't content.
Inside of an article or main element a list of links stays if it belongs to the
text: under a heading of its own that doesn't name such a thing, or between
lines of prose. A form goes, unless it holds most of the page's text, as on
pages that stand in one form as a whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("script style noscript template iframe object svg canvas nav aside footer button select textarea dialog menu head title".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id names that stand for other things than content, and words that say nothing beside them.
NAMES = frozenset("ad ads adsense advert adverts advertisement advertising advertorial breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion promoted related replies reply share sharing sidebar social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split())
OUTSIDE_NAMES = frozenset("banner header masthead topbar".split())
NEUTRAL = frozenset("after area bar before block body bottom box button buttons center col column container content footer form global group icon icons inner item items js left link links list main mobile outer page panel primary reader row secondary section sidebar signup site slot social sticky text thread top right unit user wrap wrapper".split())
CONTAINER = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are a part of the text around them; any other that isn't inline is a container of lines.
PARTS = HEADINGS | frozenset("address blockquote caption colgroup dd details dl dt figcaption figure hgroup li ol p pre summary table tbody tfoot thead tr ul".split())
LISTS = frozenset("dl ol table ul".split())
#: What the start of an element ends where it is open, and the elements that shield what is open around them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")} | dict.fromkeys(("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot", "tr", "td", "th"))
SHIELDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)} | dict.fromkeys(("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",))
#: Width of the Gaussian in lines, and the threshold as a fraction of the mean smoothed ratio.
SIGMA, THRESHOLD = 1.0, 0.5
#: Share of a group's text in links from which it is mainly links, and the lines of a list of links.
LINKS, LIST = 0.6, 3
#: Share of a page's text from which a form is a container like others.
FORM = 0.5


@lru_cache(maxsize=4096)
def named(names: str, inside: bool) -> int:
    """2 if one of the names of an element (class or id) as a whole stands for something else than content, 1 if a part of one does, else 0."""
    found, bad = 0, NAMES if inside else NAMES | OUTSIDE_NAMES
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        hits = [w in bad for w in words]
        if any(hits):
            if all(h or w in NEUTRAL for h, w in zip(hits, words, strict=True)):
                return 2
            found = 1
        elif any(w in OUTSIDE_NAMES for w in words):
            found = 1
    return found


class _Lines(HTMLParser):
    """Events to lines. All work per tag is constant but for what a tag closes: where each open tag stands is kept by its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, int, int]] = []  # tag, whether it or one around it is left out, region, container, group, form
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # tag -> places in open
        self.text: list[str] = []
        self.lines: list[tuple[str, int, int, int, int, int, int, bool]] = []  # text, tags, characters in links, region, container, group, form, whether a heading
        self.around, self.over, self.odd = [0], [0], [False]  # container around each container; group around each group; whether a name tells against it
        self.tags, self.linked, self.regions, self.forms, self.headings = 0, 0, 0, 0, 0

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.lines.append((text, self.tags, self.linked, *(self.open[-1][2:] if self.open else (0, 0, 0, 0)), self.headings > 0))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
        else:
            self.flush()
            self.leave(("p",), CONTAINER)
            if tag in ENDS:
                self.leave(ENDS[tag], SHIELDS[tag])
        if tag in VOID:
            return
        _, skip, region, node, group, form = self.open[-1] if self.open else ("", False, 0, 0, 0, 0)
        told = 0
        if not skip:
            skip = tag in BOILERPLATE or tag == "header" and not region
            if not skip and tag not in ("html", "body"):
                a = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
                told = max(named(a.get("class", ""), region > 0), named(a.get("id", ""), region > 0)) if a else 0
                skip = told == 2 and tag != "p" or a.get("role", "").lower() in BOILERPLATE_ROLES
        if tag == "form" and not form:
            self.forms += 1
            form = self.forms
        if tag in CONTAINER and not region:
            self.regions += 1
            region = self.regions
        if tag not in INLINE and tag not in ("html", "body"):
            if tag not in PARTS:
                self.around.append(node)
                node = len(self.around) - 1
            if tag not in PARTS or tag in LISTS or told:
                self.over.append(group)
                self.odd.append(told > 0)
                group = len(self.over) - 1
        self.at[tag].append(len(self.open))
        self.headings += tag in HEADINGS
        self.open.append((tag, skip, region, node, group, form))

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def leave(self, tags, shields=()) -> None:
        """Closes the outermost of the tags that are open inside of the innermost shield, and all in it."""
        shield = self.last(shields)
        places = [self.at[t][-1] for t in tags if self.at[t] and self.at[t][-1] > shield]
        if places:
            self.close_to(min(places))

    def close_to(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            self.headings -= tag in HEADINGS

    def handle_endtag(self, tag):
        if tag in INLINE:
            self.tags += 1
        else:
            self.flush()
        if tag not in VOID and self.at[tag]:
            self.close_to(self.at[tag][-1])

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            if self.at["a"]:
                self.linked += len("".join(data.split()))


def _totals(parents: list[int], places: list[int], values) -> list:
    """Sums of the values of the places in each node, those in its descendants included; parents come before their children."""
    total = [0] * len(parents)
    for p, v in zip(places, values, strict=True):
        total[p] += v
    for c in range(len(parents) - 1, 0, -1):
        total[parents[c]] += total[c]
    return total


def _region(around: list[int], held: list[int], headings: list[bool], seeds: list[int]) -> set[int]:
    """The containers of the region: around has the parent of each container, held the container of each line."""
    lines = _totals(around, held, [1] * len(held))
    with_seeds = _totals(around, [held[i] for i in seeds], [1] * len(seeds))
    top = max(c for c in range(len(around)) if with_seeds[c] == len(seeds))  # the innermost: children come after their parents
    while top and lines[top] < 2:
        top = around[top]

    def within(top: int) -> set[int]:
        found = {top}
        for c in range(top + 1, len(around)):
            if around[c] in found:
                found.add(c)
        return found

    region = within(top)
    first = next(i for i, c in enumerate(held) if c in region)
    if top and not any(h for c, h in zip(held, headings, strict=True) if c in region) and any(h and c == around[top] for c, h in zip(held[:first], headings, strict=False)):
        region = within(around[top])
    return region


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def _without_forms(lines: list[tuple]) -> list[tuple]:
    """The lines outside of forms, and those of a form that holds most of the text."""
    size: defaultdict[int, int] = defaultdict(int)
    for line in lines:
        size[line[6]] += len(line[0])
    most = FORM * sum(size.values())
    return [x for x in lines if not x[6] or size[x[6]] > most]


def belongs(first: int, last: int, region: list[int], heading: list[bool], prose: list[bool], text: list[str]) -> bool:
    """Whether the list of links in the lines first to last is a part of the article or main element that it is in."""
    own = region[first]
    before = first - 1
    if own and before > 0 and region[before] == own and heading[before]:
        words = re.findall(r"[a-z]+", text[before].lower())
        return region[before - 1] == own and not (len(words) <= 3 and any(w in NAMES for w in words))
    return bool(own) and any(p and r == own for p, r in zip(prose[:first], region, strict=False)) and any(p and r == own for p, r in zip(prose[last + 1 :], region[last + 1 :], strict=True))


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by an empty line; empty for null, and if there is none."""
    parser = _Lines()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    lines = _without_forms(parser.lines)
    if not lines:
        return ""
    text, tags, linked, region, container, group, _, heading = map(list, zip(*lines, strict=True))
    smooth = smoothed(np.array([len(t) / (1 + n) for t, n in zip(text, tags, strict=True)]))
    least = THRESHOLD * smooth.mean()
    seeds = np.flatnonzero(smooth >= least).tolist()
    regions = {region[i] for i in seeds} - {0}
    if regions:
        chosen = [r in regions for r in region]
    else:
        nodes = _region(parser.around, container, heading, seeds)
        chosen = [c in nodes for c in container]
    # Groups below the threshold that are mainly links.
    over = parser.over
    letters = [len("".join(t.split())) for t in text]
    count, size, links, ratio = (_totals(over, group, v) for v in ([1] * len(text), letters, linked, smooth.tolist()))
    prose = [not h and k < LINKS * n for h, k, n in zip(heading, linked, letters, strict=True)]
    start, end = [len(text)] * len(over), [-1] * len(over)  # a group's lines, and those of the groups in it
    for i, g in enumerate(group):
        start[g], end[g] = min(start[g], i), i
    for g in range(len(over) - 1, 0, -1):
        start[over[g]], end[over[g]] = min(start[over[g]], start[g]), max(end[over[g]], end[g])
    gone = [False] * len(over)
    titles = set()
    for g in range(1, len(over)):
        mainly_links = count[g] > 0 and links[g] >= LINKS * size[g] and ratio[g] < least * count[g]
        gone[g] = gone[over[g]]
        if mainly_links and not gone[g] and (parser.odd[g] or count[g] >= LIST):
            first, last = start[g], end[g]
            gone[g] = parser.odd[g] or not belongs(first, last, region, heading, prose, text)
            if gone[g] and first > 1 and heading[first - 1] and region[first] and region[first - 2] == region[first - 1] == region[first]:
                titles.add(first - 1)  # the heading of what goes
    return "\n\n".join(t for i, (t, c, g) in enumerate(zip(text, chosen, group, strict=True)) if c and not gone[g] and i not in titles)


def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row per row of pages.

    Null and empty pages, and those without text, have an empty text. Pages are
    independent of each other, so rows may repeat; an empty table gives an empty
    table. Markup that isn't closed is closed as browsers do for lists, tables
    and paragraphs. Other columns are not read.
    """
    return pages.select("page_id", "url", F.pandas_udf(_texts, "string")("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
