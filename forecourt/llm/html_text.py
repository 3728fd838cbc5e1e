"""Main text of a web page by line-block distribution.

Markup is stripped into blocks, one per line, without what lies in menus, headers, footers, sidebars, notices, adverts,
forms and comments: these may interrupt a text and are no gap in the distribution.  Text lengths are summed over
windows of `WINDOW_LINES` lines.  A text is what lies between two dives of the sum to nothing, if it surges over the
threshold there; every line of it is kept, short ones too.

Tag names, roles and class words are evidence about an element, and what the distribution says of the whole page is
weighed against it.  Only some of them settle the matter (a comment section, a closed `nav`, a class that is exactly
"sidebar").  A `form`, a compound class such as "with-sidebar" or an element that is never closed may as well be the
wrapper of the page: it counts as one if it holds the page's `article` or `main`, or surges and has `WRAPPER_SHARE` times
the text of all that is left without it.

If the page marks its text (`article` or `main`), lines inside count, unless the distribution finds `WRAPPER_SHARE` times
as much text beside them (a teaser in a marker).  A window without text outside links is a dive there too: such runs of
links are left out.  On other pages every region is kept in which text outside links is a fair share of all text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.frames import col, text_of

WINDOW_LINES = 3
# Without a marked text: least sum of a window that begins a region, and least share of text outside links in a region.
SURGE_CHARS = 80
TEXT_DENSITY = 0.5
# So many times the text of the rest makes a doubtful element the page's wrapper, or unmarked text the main text.
WRAPPER_SHARE = 3

# Element names of the HTML standard, by the part they play here.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset(
    "head nav footer aside form menu dialog template noscript button select option datalist svg math canvas object "
    "video audio map".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
# Tags that are boilerplate only if they are closed; an open one is more likely forgotten than to hold all that follows.
CLOSED_ONLY = frozenset("nav footer aside header menu".split())
# Class and id words that name boilerplate.
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|nav|navbar|navigation|menu|menus|sidebar|"
    r"sidebars|breadcrumbs?|footer|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|"
    r"recommendations|pagination|pager|widgets?|searchform|toolbar|masthead)(?:$|[\s_-])",
    re.I,
)
# Of these, the ones that are boilerplate in any compound; the others may name the page's layout.
SETTLED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:footer|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|newsletter|subscribe|"
    r"subscription|share|sharing|social|related|recommended|recommendations|pagination|pager|searchform|popup|modal)(?:$|[\s_-])",
    re.I,
)
HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|banner)(?:$|[\s_-])", re.I)
NEVER_BY_NAME = frozenset("html body main h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Suspect:
    """An element that looks like boilerplate; `settled` if nothing speaks for it, `marked` if it holds marked text."""

    settled: bool
    marked: bool = False


@dataclass
class Line:
    """A block of text, and the suspects it lies in, the outermost first."""

    text: str
    linked: int
    suspects: tuple[Suspect, ...]
    inside: frozenset[str]
    heading: bool

    @property
    def weight(self) -> int:
        """Characters outside links."""
        return max(0, len(self.text) - self.linked)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _suspect(name: str, source: str, in_text: bool) -> Suspect | None:
    if name in DROPPED or name == "header" and not in_text:
        return Suspect(settled=name != "form" and name not in CLOSED_ONLY)
    if not source or source.isspace():
        return None
    given = _attributes(source)
    if "hidden" in given or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return Suspect(settled=True)
    role = given.get("role", "").strip().lower()
    if role in DROPPED_ROLES and not (role == "banner" and in_text):
        return Suspect(settled=role != "form")
    names = given.get("class", "") + " " + given.get("id", "")
    if name in NEVER_BY_NAME or names.isspace():
        return None
    if not (DROPPED_NAMES.search(names) or not in_text and HEADER_NAME.search(names)):
        return None
    exact = any(DROPPED_NAMES.fullmatch(n) or HEADER_NAME.fullmatch(n) for n in names.split())
    return Suspect(settled=exact or bool(SETTLED_NAMES.search(names)))


class _Page:
    """Reads markup once and gathers lines."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        # Open elements with their suspect, if they are one.  Counts tell in constant time whether a name is open.
        self.open: list[tuple[str, Suspect | None]] = []
        self.count: dict[str, int] = {}
        self.suspects: tuple[Suspect, ...] = ()

    def is_open(self, name: str) -> bool:
        return self.count.get(name, 0) > 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            inside = frozenset(n for n in ("article", "main") if self.is_open(n))
            heading = any(self.is_open(f"h{i}") for i in range(1, 7))
            self.lines.append(Line(text, self.linked, self.suspects, inside, heading))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            decoded = html.unescape(raw)
            self.parts.append(decoded)
            if self.is_open("a"):
                self.linked += len(decoded)

    def begin(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.end_line()
            if self.is_open("p"):
                self._close_paragraph()
        elif name == "br":
            self.parts.append(" ")
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS:
            return
        bad = _suspect(name, attributes, self.is_open("article") or self.is_open("main"))
        if bad:
            self.end_line()
            self.suspects += (bad,)
        elif name in ("article", "main"):
            for outer in self.suspects:
                outer.marked = True
        self.open.append((name, bad))
        self.count[name] = self.count.get(name, 0) + 1

    def _close_paragraph(self) -> None:
        """A block closes an open paragraph and the inline elements left open in it."""
        for name, _ in reversed(self.open):
            if name == "p":
                self.end("p")
                return
            if name in BLOCKS:
                return

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.end_line()
        if not self.is_open(name):
            return
        while True:
            top, bad = self.open.pop()
            if bad:
                self.end_line()
                self.suspects = self.suspects[:-1]
                bad.settled |= top == name and top in CLOSED_ONLY
            self.count[top] -= 1
            if top == name:
                return


def lines_of(page: str) -> list[Line]:
    out = _Page()
    at = 0
    while match := _TAG.search(page, at):
        out.text(page[at : match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        if match["close"]:
            out.end(name)
        elif name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = closing.end() if closing else len(page)
        else:
            out.begin(name, match["attributes"])
    out.text(page[at:])
    out.end_line()
    return out.lines


def regions(weights: list[int], threshold: int, window: int) -> list[tuple[int, int]]:
    """Surge and dive points: from the first line of a window over `threshold` to where a whole window is empty."""
    n = len(weights)
    sums, running = [0] * n, 0
    for i in range(n - 1, -1, -1):
        running += weights[i] - (weights[i + window] if i + window < n else 0)
        sums[i] = running
    found, i = [], 0
    while i < n:
        if weights[i] and sums[i] > threshold:
            end = last = i
            while end < n and sums[end]:
                if weights[end]:
                    last = end
                end += 1
            found.append((i, last + 1))
            i = end
        else:
            i += 1
    return found


def _surges(lines: list[Line], window: int, surge: int) -> bool:
    return bool(regions([x.weight for x in lines], surge, window))


def without_boilerplate(lines: list[Line], window: int, surge: int) -> list[Line]:
    """The lines outside suspects, after suspects that turn out to be wrappers of the page are cleared of it."""
    cleared: set[int] = set()
    while True:
        first = [next((s for s in x.suspects if id(s) not in cleared), None) for x in lines]
        left = [x for x, s in zip(lines, first) if s is None]
        marked = any(x.inside for x in left)
        weight = sum(x.weight for x in left)
        held: dict[int, list[Line]] = {}
        doubtful = {}
        for x, s in zip(lines, first):
            if s is not None and not s.settled:
                doubtful[id(s)] = s
                # What lies in further suspects says nothing for this one, unless they are doubtful themselves.
                if not any(other.settled for other in x.suspects):
                    held.setdefault(id(s), []).append(x)
        wrappers = [k for k, s in doubtful.items() if s.marked and not marked]
        if not wrappers and held:
            largest = max(held, key=lambda k: sum(x.weight for x in held[k]))
            if sum(x.weight for x in held[largest]) >= WRAPPER_SHARE * weight and _surges(held[largest], window, surge):
                wrappers = [largest]
        if not wrappers:
            return left
        cleared.update(wrappers)


def _outside_link_runs(lines: list[Line], window: int) -> list[Line]:
    """All lines but those in a window without text outside links; all lines if that is everything."""
    kept, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and not lines[j].weight:
            j += 1
        if j - i < window:
            kept += lines[i:j]
        kept += lines[j : j + 1]
        i = j + 1
    return kept or lines


def main_text(page: str, window: int = WINDOW_LINES, surge: int = SURGE_CHARS, density: float = TEXT_DENSITY) -> str:
    """The kept blocks in page order, joined by an empty line; empty if there is no text."""
    lines = without_boilerplate(lines_of(page), window, surge)
    if any(x.inside for x in lines):
        articles = any("article" in x.inside for x in lines)
        marked = [x for x in lines if "article" in x.inside or x.inside and not (articles and x.linked >= len(x.text))]
        beside = [x for x in lines if not x.inside]
        if sum(x.weight for x in beside) < WRAPPER_SHARE * sum(x.weight for x in marked) or not _surges(beside, window, surge):
            return "\n\n".join(x.text for x in _outside_link_runs(marked, window))
    weights = [x.weight for x in lines]
    # Short lines right before a surge belong to its text.
    starts = [i for i, _ in regions(weights, surge, window)]
    whole = regions(weights, 0, window)
    kept = [(i, j) for i, j in whole if bisect_left(starts, i) < bisect_left(starts, j)] or whole
    dense = [(i, j) for i, j in kept if sum(weights[i:j]) >= density * sum(len(x.text) for x in lines[i:j])]
    # A heading right before a region belongs to it.
    kept = [(i - 1 if i and lines[i - 1].heading else i, j) for i, j in dense or kept]
    # A page of nothing but links has these as its text.
    return "\n\n".join(x.text for i, j in kept or [(0, len(lines))] for x in lines[i:j])


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of `pages`.

    NULL or empty html, and pages without text, give an empty text.  Whole pages are read, broken markup included:
    an unclosed comment, script or quote reaches to the end of the page.  Repeated rows give equal rows, an empty table
    none; other columns are not read.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([main_text(s) for s in sources], dtype=object)

    rows = pages.select(
        col(id_col).alias("page_id"), col(url_col).alias("url"), extract(text_of(html_col)).alias("text")
    )
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
