"""Main text of web pages: parser events, text-to-tag ratio, smoothing, clusters.

The standard library's streaming parser gives events; a block element starts a
new line.  Each line knows its text, the tags in it, the characters inside links,
its block element and the container around it (article, main, section, div, ...).

The text-to-tag ratio of the lines is smoothed with a Gaussian along the page,
and a two-means threshold over the smoothed ratios parts content lines from the
rest.  The content lines make the text: from the first to the last of them, without
what is mostly links, and with REACH lines more at either end; in an article or main
element, from a heading beside the first of them.  All other lines are out, in such
an element as anywhere.

Structure refines that.  Lines in navigation, footers, forms and the like, or in a
container named as such, are no content.  The region is the smallest container that
holds nearly all text of the content lines; those in an article or main element go
before others, and such an element around the region, or beside it, is part of it.
What stands outside the region is out.  Of a region that is no such element, lines
count that stand between its first and last content line, directly in it, or in a part
with content; a heading right before them counts as well.

A name is a weaker sign than an element: it is void where its container holds an
article or main element.

Defined results for odd input: a null or blank page has empty text; broken markup
is read as the parser reads it (elements left open end with the page, an end tag
ends what it leaves open inside, an unclosed head ends with the first element or
text that it cannot hold); repeated rows give repeated rows; an empty table gives
an empty result; other columns are ignored; a page without containers is one
region.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import rows_in_slices

# Elements and names.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea head title".split())
BOILER = frozenset("nav header footer aside form menu dialog button fieldset".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("html head base link meta title style script noscript template".split())
REGIONS = frozenset("article main section div body td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REMARKS = frozenset("comment comments reply replies disqus".split())
NAMES = REMARKS | frozenset(
    "ad ads advert adverts advertisement advertisements banner banners sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts "
    "popup popups modal modals newsletter newsletters subscribe subscription subscriptions respond sidebar sidebars widget widgets related recommended recirc social share shares sharing "
    "breadcrumb breadcrumbs menu menus nav navbar navigation footer footers header headers masthead toolbar pagination pager copyright login signup search".split()
)
# Words in a name that say that it speaks of a part of the text, or of a layout, and not of boilerplate.
OF_TEXT = {"header": frozenset("article entry post story content page".split()), "search": frozenset("result results".split())}
OF_LAYOUT = frozenset("has with without no layout wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend", "option"}
SIGMA = 1.5
#: Share of the content's text that a container must hold to be the region; and of a line's text that links may hold.
NEARLY_ALL, MOST_LINK = 0.9, 0.5
#: Lines that come with the content before and behind it.
REACH = 4
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


@lru_cache(maxsize=4096)
def named_words(names: str) -> frozenset[str]:
    """Words for boilerplate in the class and id of an element."""
    out = set()
    for name in names.split():
        words = frozenset(re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name)) | {name.lower()}
        words = frozenset(w.lower() for w in words)
        if not words & OF_LAYOUT:
            out |= {w for w in words & NAMES if not words & OF_TEXT.get(w.removesuffix("s"), frozenset())}
    return frozenset(out)


class Line(NamedTuple):
    text: str
    tags: int
    link: int
    region: int
    hard: bool  # in an element of boilerplate
    mark: int  # innermost container named as boilerplate, -1 if there is none
    block: str


class Open(NamedTuple):
    tag: str
    region: int
    hard: bool
    mark: int
    silent: bool


class Lines(HTMLParser):
    """Lines of a page, the tree of its regions and the tree of its named containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.lines: list[Line] = []
        self.kinds, self.parents = ["page"], [-1]
        self.mark_parents, self.void = [], []
        self.count: Counter[str] = Counter()  # of elements that are open
        self.text, self.tags, self.link, self.block = [], 0, 0, ""

    def top(self) -> Open:
        return self.open[-1] if self.open else Open("", 0, False, -1, False)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            top = self.top()
            self.lines.append(Line(text, self.tags, self.link, top.region, top.hard, top.mark, self.block))
            self.tags = 0
        self.text, self.link = [], 0

    def handle_starttag(self, tag, attrs):
        if self.count["head"] and tag not in HEAD:
            self.close("head")
        self.tags += 1
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.text.append(" ") if tag == "br" else self.flush()
            return
        if tag in ENDS_P and self.count["p"]:
            self.close("p")
        if tag in BLOCKS:
            self.flush()
            self.block = tag
        _, region, hard, mark, silent = self.top()
        names, role, hidden = "", "", False
        for k, v in attrs:
            if k in ("class", "id"):
                names += f" {v or ''}"
            elif k == "role":
                role = v or ""
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and HIDDEN.search(v):
                hidden = True
        words = named_words(names) if names and tag not in ("body", "html", "main") else frozenset()
        if words & (REMARKS if tag == "article" else NAMES):
            self.mark_parents.append(mark)
            self.void.append(False)
            mark = len(self.void) - 1
        if tag in ("article", "main") and not words & REMARKS and mark >= 0:
            self.void[mark] = True
        if tag in REGIONS:
            self.kinds.append(tag)
            self.parents.append(region)
            region = len(self.kinds) - 1
        self.open.append(Open(tag, region, hard or tag in BOILER or role in ROLES, mark, silent or tag in SILENT or hidden))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if self.count[tag]:
            self.close(tag)
        elif tag in BLOCKS:
            self.flush()
        if tag in BLOCKS:
            self.block = self.top().tag

    def close(self, tag: str) -> None:
        """Leave the innermost element of this name and what is open inside it; an end tag of text stays inside its block."""
        at = len(self.open) - 1
        while self.open[at].tag != tag:
            at -= 1
        if tag not in BLOCKS and tag != "head" and any(x.tag in BLOCKS for x in self.open[at + 1 :]):
            del self.open[at]
            self.count[tag] -= 1
            return
        if any(x.tag in BLOCKS for x in self.open[at:]):
            self.flush()
        self.count.subtract(x.tag for x in self.open[at:])
        del self.open[at:]

    def handle_data(self, data):
        if self.top().tag == "head" and not data.isspace():
            self.close("head")
        if not self.top().silent:
            self.text.append(data)
            if self.count["a"]:
                self.link += len(data)

    def marked(self) -> list[bool]:
        """Whether each named container, or one around it, says boilerplate."""
        out = []
        for mark, parent in enumerate(self.mark_parents):
            out.append(not self.void[mark] or parent >= 0 and out[parent])
        return out


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / weight


def threshold(values: np.ndarray) -> float:
    """Half-way between the means of two clusters; below all of them if there is one."""
    low, high = values.min(), values.max()
    if high - low < 1e-9:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        new = values[values < cut].mean(), values[values >= cut].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(lines: list[Line], own: list[int]) -> list[int]:
    """Lines of own in the upper cluster of the page's smoothed ratios; if it has none of them, in that of theirs."""
    ratios = np.array([(len(x.text) - x.link) / max(1, x.tags) for x in lines], float)
    level = smoothed(np.log1p(np.maximum(ratios, 0)))
    over = level >= threshold(level)
    found = [i for i in own if over[i]]
    if not found:
        level = level[own]
        over = level >= threshold(level)
        found = [i for i, high in zip(own, over) if high]
    return found


def regions_of(page: Lines, content: list[int]) -> tuple[list[int], bool]:
    """The region that holds nearly all of the content's text, with those beside it that count as well; whether it is an article or main element."""
    kinds, parents, lines = page.kinds, page.parents, page.lines
    weight = [0] * len(kinds)
    for i in content:
        weight[lines[i].region] += max(1, len(lines[i].text) - lines[i].link)
    for region in range(len(weight) - 1, 0, -1):  # a region holds what its inner regions hold
        weight[parents[region]] += weight[region]
    best = max(r for r, w in enumerate(weight) if w >= NEARLY_ALL * weight[0])  # inner regions have higher numbers
    at = best
    while at > 0 and kinds[at] not in ("article", "main"):
        at = parents[at]
    if at <= 0:
        return [best], False
    return [r for r, kind in enumerate(kinds) if r == at or kind == "article" == kinds[at] and parents[r] == parents[at]], True


def with_content(lines: list[Line], candidates: list[int], content: set[int], whole: bool) -> list[int]:
    """Of the candidates, in page order: content lines, and the lines between or next to them that are not mostly links.

    whole: they are of an article or main element; its text starts with the first
    heading that stands beside the first content line.
    """
    places = [k for k, i in enumerate(candidates) if i in content]
    if not places:
        return []
    first, last = places[0] - REACH, places[-1] + REACH
    if whole:
        beside = lines[candidates[places[0]]].region
        first = min([first, *(k for k, i in enumerate(candidates[: places[0]]) if lines[i].block in HEADINGS and lines[i].region == beside)])
    return [i for k, i in enumerate(candidates) if i in content or first <= k <= last and lines[i].link <= MOST_LINK * len(lines[i].text)]


def main_text(html: str) -> str:
    page = Lines()
    page.feed(html)
    HTMLParser.close(page)
    page.flush()
    lines = page.lines
    marked = page.marked()
    own = [i for i, x in enumerate(lines) if not x.hard and not (x.mark >= 0 and marked[x.mark])]
    content = content_lines(lines, own) if own else []
    if not content:
        return ""
    kinds, parents = page.kinds, page.parents
    semantic = [k in ("article", "main") for k in kinds]
    for r in range(1, len(kinds)):
        semantic[r] = semantic[r] or semantic[parents[r]]
    content = [i for i in content if semantic[lines[i].region]] or content
    chosen, whole = regions_of(page, content)
    inside, held = [r in chosen for r in range(len(kinds))], [False] * len(kinds)
    for i in content:
        held[lines[i].region] = True
    for r in range(1, len(kinds)):
        inside[r] = inside[r] or inside[parents[r]]
    for r in range(len(kinds) - 1, 0, -1):  # up to the parts of the region, not to the region itself
        if parents[r] not in chosen:
            held[parents[r]] = held[parents[r]] or held[r]
    for r in range(1, len(kinds)):
        held[r] = held[r] or held[parents[r]] and parents[r] not in chosen
    first, last, out = content[0], content[-1], []
    for i in own:
        x = lines[i]
        if not inside[x.region]:
            continue
        few_links = x.link <= MOST_LINK * len(x.text)
        if whole or first <= i <= last or x.region not in chosen and held[x.region] or few_links and x.region in chosen:
            out.append(i)
    out = with_content(lines, out, set(content), whole)
    if not out:
        return ""
    own_at = {i: k for k, i in enumerate(own)}
    at = own_at[out[0]] - 1
    before = []
    while at >= 0 and not whole and lines[own[at]].block in HEADINGS and own[at] == (before[-1] if before else out[0]) - 1:
        before.append(own[at])
        at -= 1
    return " ".join(lines[i].text for i in [*reversed(before), *out])


def main_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars: one row per page, from its whole html."""
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html).mapInArrow(run, schema)
