"""Main-text extraction from HTML.

The standard library's parser streams events; block boundaries cut the page into lines. A line's ratio is the
logarithm of its letters and digits over its tags, where those in links, and in menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, count for nothing. Ratios are smoothed by a Gaussian, within runs of
lines that stand in such parts or outside them, and a threshold between the two clusters of smoothed ratios selects
lines; a ratio of 0 is always among the values. Regions are the articles of a page, all together, and outside them the
largest containers in which every line counts, else the containers that hold the lines. A region is content when
selected lines hold enough of its characters, or more than any other region's. All lines of content regions are kept in page order, with the headings right before them, but for those
in the parts named above.

Nulls and edge cases: null or empty HTML gives an empty text, as does a page without selected lines; broken
and cut-off markup is read as far as it goes; pages are read whole, in time that grows with their length alone;
character references are decoded; ties: of regions with equally many selected characters the first counts as the
largest; repeated rows give repeated results; an empty table gives an empty result. Only the named columns are read,
and other columns may have any name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start or end also ends a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is no text of the page.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas math audio video button select textarea input option datalist map".split())
#: Elements whose text is never main text.
DROPPED = UNSEEN | frozenset("nav aside footer form search menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or an id that mark a part outside the main text.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promoted promotion banner sidebar sidebars rail "
    "comment comments commentlist disqus respond replies reply discussion menu menus submenu navbar nav navigation breadcrumb breadcrumbs crumbs footer "
    "masthead topbar header social share sharing sharebar related recommended recommendations newsletter subscribe subscription signup login popup modal "
    "overlay pagination pager toolbar skip notice notices alert alerts cookie cookies consent gdpr disclaimer widget widgets search".split()
)
#: Words that say the mark is about a wrapper, not about the part itself.
WRAPPING = frozenset("has no with without wrapper layout page main content".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Start tags that close an open paragraph.
CLOSES_P = BLOCK - {"body", "html", "head", "title", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
#: An open element of the key is closed by a start tag of its values.
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
SCOPE = frozenset("html body table td th ul ol dl div section article main".split())
BOUNDARY = frozenset("table article main body".split())
REGION = frozenset("html body div section main article td center".split())
#: Region number of the articles of a page; other containers have their own.
ARTICLES = -1
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
OTHER = re.compile(r"[\W_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Line:
    text: str
    tags: int
    counted: int  # letters and digits outside links and outside marked parts
    marked: bool  # in a menu, an advert or the like
    heading: bool
    region: int


@dataclass
class Open:
    tag: str
    hides: bool
    marks: bool
    region: bool


@dataclass(frozen=True)
class Config:
    sigma: float = 1.0
    radius: int = 2
    share: float = 0.3  # of a region's characters that selected lines hold


class Events(HTMLParser):
    """Lines of a page, from parser events; text that a page does not show never becomes a line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # tag -> places of its open elements
        self.blocks: list[int] = []  # places of open block elements
        self.scopes: list[int] = []
        self.forms: list[Open] = []  # open ones that mark
        self.regions, self.parents = [0], [0]  # of a container, the number of the one around it; 0 of body
        self.hiding = self.marking = self.within = self.headings = 0
        self.parts, self.tags, self.link, self.links = [], 0, 0, 0

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                counted = 0 if self.marking else max(0, len(OTHER.sub("", text)) - self.links)
                self.lines.append(Line(text, self.tags, counted, self.marking > 0, self.headings > 0, self.regions[-1]))
                self.tags = self.links = 0
            self.parts = []

    def is_outside(self, tag: str, attrs: list) -> bool:
        within = self.within > 0
        if tag in DROPPED:
            return True
        if tag == "header":
            return not within
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" and tag not in ("html", "body"):
                return True
            if not value:
                continue
            if name == "style" and HIDDEN.search(value):
                return True
            if name == "role" and value.strip().lower() in ROLES:
                return not (within and value.strip().lower() == "banner")
            if name in ("class", "id") and tag not in ("html", "body", "main", "h1"):
                for mark in value.split():
                    words = {w.lower() for w in WORD.findall(mark)}
                    found = words & OUTSIDE
                    if tag == "article":
                        found &= {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo", "related", "recommended"}
                    if within:
                        found -= {"header", "main"}
                    if found and not words & WRAPPING:
                        return True
        return False

    def push(self, tag: str, hides: bool, marks: bool):
        at, cur = len(self.open), self.regions[-1]
        region = tag in REGION
        if region:
            if tag == "article" or cur == ARTICLES:
                cur = ARTICLES
            elif tag not in ("html", "body"):
                self.parents.append(cur)
                cur = len(self.parents) - 1
            self.regions.append(cur)
        self.open.append(Open(tag, hides, marks, region))
        self.places[tag].append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in SCOPE:
            self.scopes.append(at)
        if tag == "form" and marks:
            self.forms.append(self.open[-1])
        self.hiding += hides
        self.marking += marks
        self.within += tag in ("article", "main")
        self.headings += tag in HEADINGS

    def pop(self):
        o = self.open.pop()
        self.places[o.tag].pop()
        if o.tag in BLOCK:
            self.blocks.pop()
        if o.tag in SCOPE:
            self.scopes.pop()
        if o.region:
            self.regions.pop()
        if self.forms and self.forms[-1] is o:
            self.forms.pop()
        self.hiding -= o.hides
        self.marking -= o.marks
        self.within -= o.tag in ("article", "main")
        self.headings -= o.tag in HEADINGS

    def last(self, tags) -> int:
        """Place of the innermost open element of `tags`, -1 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close_until(self, tag: str, stop: int) -> None:
        """Close the innermost open `tag`, and all in it, unless the place `stop` lies between."""
        at = self.last((tag,))
        if at >= 0 and at > stop:
            while len(self.open) > at:
                self.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self.close_until("p", self.scopes[-1] if self.scopes else -1)
            for old, by in SIBLING.items():
                if tag in by and self.places.get(old):
                    self.close_until(old, self.last(SCOPE - {"td", "th"} - {old}) if old in ("tr", "td", "th") else self.scopes[-1] if self.scopes else -1)
            if tag in ("article", "main"):
                self.lift_forms()
        elif tag == "br":
            self.parts.append("\n")
        if tag == "a":
            self.link += 1
        self.tags += 1
        if tag in VOID:
            return
        outside = self.is_outside(tag, attrs)
        # An inline part inside a block is cut out of its line; a block is a line of its own that counts for nothing.
        hides = outside and (tag in UNSEEN or tag not in BLOCK)
        if hides and not self.hiding and tag not in BLOCK:
            self.parts.append(" ")
        self.push(tag, hides, outside and not hides)

    def lift_forms(self):
        """A form around the main text wraps the page; it marks nothing."""
        for o in self.forms:
            o.marks = False
            self.marking -= 1
        self.forms = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in DROPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag == "a" and self.link:
            self.link -= 1
        if tag in VOID or not self.places.get(tag):
            return
        if tag in ("html", "body", "article", "main", "div", "section", "table"):
            stop = -1
        elif tag in BLOCK:
            stop = self.last(BOUNDARY)
        else:
            stop = self.blocks[-1] if self.blocks else -1
        self.close_until(tag, stop)

    def handle_data(self, data):
        if not self.hiding:
            self.parts.append(data)
            if self.link:
                self.links += len(OTHER.sub("", data))


def smoothed(lines: list[Line], cfg: Config) -> list[float]:
    """Gaussian means of the lines' ratios; a mean never reaches over the edge of a marked part."""
    kernel = [math.exp(-(d * d) / (2 * cfg.sigma**2)) for d in range(cfg.radius + 1)]
    raw, out, n = [math.log1p(x.counted / max(1, x.tags)) for x in lines], [], len(lines)
    for i, line in enumerate(lines):
        total, weight = raw[i], 1.0
        for step in (-1, 1):
            j = i
            for d in range(1, cfg.radius + 1):
                j += step
                if not 0 <= j < n or lines[j].marked != line.marked:
                    break
                total += kernel[d] * raw[j]
                weight += kernel[d]
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The midpoint of the two cluster means, by 2-means on the line."""
    ordered = sorted(values)
    sums = [0.0]
    for v in ordered:
        sums.append(sums[-1] + v)
    low, high, n = ordered[0], ordered[-1], len(ordered)
    for _ in range(50):
        at = bisect_right(ordered, (low + high) / 2)
        if not 0 < at < n:
            break
        new = sums[at] / at, (sums[n] - sums[at]) / (n - at)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def select(lines: list[Line], cfg: Config = Config()) -> list[bool]:
    """Which lines are in the cluster of high smoothed ratios; one that counts for nothing is not lifted by its neighbours."""
    ratio = smoothed(lines, cfg)
    edge = threshold([0.0, *ratio])
    return [x.counted > 0 and r >= edge for x, r in zip(lines, ratio)]


def content_regions(lines: list[Line], selected: list[bool], cfg: Config = Config()) -> set[int]:
    own, chosen = defaultdict(int), defaultdict(int)
    for x, s in zip(lines, selected):
        own[x.region] += len(x.text) * (not x.marked)
        chosen[x.region] += len(x.text) * s
    most = max(chosen.values(), default=0)
    if not most:
        return set()
    return {r for r, n in chosen.items() if n and n >= cfg.share * own[r]} | {next(r for r, n in chosen.items() if n == most)}


def main_lines(lines: list[Line], cfg: Config = Config(), choose=select) -> list[Line]:
    """The lines of the content regions; `choose` selects lines."""
    selected = choose(lines, cfg)
    regions, out, after = content_regions(lines, selected, cfg), [], False
    for x, s in zip(reversed(lines), reversed(selected)):
        if x.marked and not s:
            after = False
            continue
        # A heading belongs to the region that it stands right before.
        after = x.region in regions or x.heading and after
        if after:
            out.append(x)
    return out[::-1]


def lines_of(html: str | None) -> list[Line]:
    events = Events()
    events.feed(html or "")
    events.close()
    events.flush()
    # A container is part of the one around it where every line in that one counts.
    parents = events.parents
    whole = [r > 0 for r in range(len(parents))]
    for x in events.lines:
        if not x.counted and x.region != ARTICLES:
            whole[x.region] = False
    for r in range(len(parents) - 1, 0, -1):
        if not whole[r]:
            whole[parents[r]] = False
    top = list(range(len(parents)))
    for r in range(1, len(parents)):
        if whole[parents[r]]:
            top[r] = top[parents[r]]
    for x in events.lines:
        if x.region != ARTICLES:
            x.region = top[x.region]
    return events.lines


def extract(html: str | None, cfg: Config = Config()) -> str:
    return "\n".join(x.text for x in main_lines(lines_of(html), cfg))


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (), cfg: Config = Config()) -> DataFrame:
    """(id, *keep, text): the main text of each page."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = pa.array([extract(h, cfg) for h in part.column(0).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], texts], [*part.schema.names[1:], "main_text_"])

    columns = [id_col, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    got = df.select(F.col(html_col).alias("html_"), *columns).mapInArrow(run, f"{schema}, main_text_ string")
    return got.withColumnRenamed("main_text_", "text")
