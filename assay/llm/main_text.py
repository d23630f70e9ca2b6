"""Main text of HTML pages.

The standard library's parser streams events; text between block-level tags makes a
line, which knows its number of tags. The ratio of text to tags of the lines outside
menus, adverts and the like is smoothed with a Gaussian, and a threshold splits content
lines from the rest. No content line is lost: if the article and main elements hold almost
all content, they are the region, and content outside them stays with the element around
it; otherwise the region is the innermost element that holds all content lines. All of a
region's text is kept, short paragraphs too.

Defined cases: null or empty html gives an empty text; markup that is cut off, unclosed
or nested wrongly is read as browsers do for paragraphs and list items; a page without
any article element takes the innermost element that holds all content; pages with
nothing but menus, scripts or adverts give an empty text; a class or id that marks an
advert, menu or the like drops its element only by the text and links it holds, so a
layout's wrapper doesn't take the article with it, and a form is judged the same way (labels
and fields go in any case); before the first and after the last other line, outside article
and main, lines that are nearly all links (two links or more in a run) and notices of rights
go, unless the page has no other line; a comment without an end is text; repeated rows give
repeated results; a page of any length and depth is read whole, in memory and time in
proportion to it.
"""

from __future__ import annotations

import re
from array import array
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.batches import map_chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that do not end a line.
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt "
                    "rp s samp small span strike strong sub sup time tt u var wbr").split())
#: Elements whose text is never part of an article.
DROPPED = frozenset(("script style noscript template head title nav footer aside iframe object svg canvas menu "
                     "button select textarea option label legend datalist dialog audio video").split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id names that mark adverts, notices, menus and reader comments.
MARKS = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
                   "cookies consent gdpr notice notices newsletter subscribe subscription sidebar sidebars nav navbar "
                   "navigation menu menus breadcrumb breadcrumbs footer masthead comment comments disqus respond share "
                   "sharing social related recommended popup modal login signup paywall").split())
#: Marks in words written together.
COMPOUND = re.compile(r"comment(?!ar|at)\w*|(?:advert|sponsor|breadcrumb|newsletter|disqus|navbar|sidebar)\w*|"
                      r"\w*(?:comments|sidebar|navbar|footer|masthead|breadcrumbs?)|(?:google)?ads?(?:by\w+|slots?|box(?:es)?|"
                      r"units?|banners?|containers?|wrappers?)|(?:top|bottom|main|sub|site)(?:bar|nav|menu)")
#: A name with a word of each of these sets tells readers' comments.
READERS = frozenset("reader readers user users visitor visitors guest guests".split())
ANSWERS = frozenset("response responses reply replies review reviews discussion feedback remarks opinions letters".split())
#: Line of a notice of rights.
RIGHTS = re.compile(r"\W*(?:(?:copyright\s*)?(?:©|\(c\))|copyright\s*(?=(?:19|20)\d\d\b)).{0,160}|.{0,160}\ball rights reserved\W{0,3}", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Names of an article or main that is a reader's comment.
COMMENT = re.compile(r"comment(s|list|body|text)?(?![a-z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a paragraph, not a region.
LEAVES = INLINE | HEADINGS | frozenset("p li dt dd pre blockquote figcaption td th tr caption summary".split())
REGIONS = frozenset("article main".split())
#: A class name with one of these words tells a state or a layout (has-sidebar, comments-open), not what the element is.
STATES = frozenset(("has have no not non with without open opened close closed free on off enabled disabled active inactive "
                    "hidden visible collapsed expanded").split())
#: A new block of these kinds ends an open paragraph.
ENDS_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul").split())
SIBLINGS = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))),
            "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))),
            "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))),
            "option": ("option", frozenset(("select",)))}

#: What happens to text: it stays, goes, or goes with the header of an article, whose headings stay.
KEPT, GONE, HEADER = 0, 1, 2

#: Width of the smoothing in lines, and the share of content that articles must hold to be the region.
SIGMA, HELD = 1.0, 0.9


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, innermost open element, characters of links, links).

    Elements are numbered from 1 in page order, 0 is the page; ``names``, ``above`` (the
    element around) and ``fate`` (KEPT, GONE or HEADER) are indexed by number.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}  # of the open elements of a tag
        self.blocks: list[int] = []  # places of the open elements that are not inline
        self.names: list[str] = [""]
        self.above = array("q", [0])
        self.fate = bytearray([KEPT])
        self.marks: dict[int, bool] = {}  # elements whose class or id is a mark; true: of a state only
        self.words: list[str] = []
        self.anchors = self.linked = self.links = 0
        self.regions = 0  # open article and main elements that are kept
        self.tags = 0
        self.endless = False

    def parse_comment(self, i, report=1):
        """A comment without an end shows that no later one has any: they aren't searched."""
        k = -1 if self.endless else super().parse_comment(i, report)
        self.endless = k < 0
        return k

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, self.tags, self.inner(), min(self.linked, len(text)), self.links))
        if text or self.words:
            self.words = []
        self.tags = self.linked = 0
        self.links = int(self.anchors > 0)

    def inner(self) -> int:
        """The innermost open element."""
        return self.open[-1] if self.open else 0

    def close_to(self, place: int):
        """End the open elements from ``place`` on; dropped text and kept text don't mix."""
        if any(self.names[e] not in INLINE or self.fate[e] or e in self.marks for e in self.open[place:]):
            self.flush()
        for e in reversed(self.open[place:]):
            tag = self.names[e]
            self.places[tag].pop()
            self.anchors -= tag == "a"
            self.regions -= tag in REGIONS and not self.fate[e]
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()
        del self.open[place:]

    def last(self, tags) -> int:
        """Place of the innermost open element of one of the tags, -1 without any."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in ENDS_P:
            if self.blocks and self.names[self.open[self.blocks[-1]]] == "p":
                self.close_to(self.blocks[-1])
        elif tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            place = self.last(ends.split())
            if place > self.last(within):
                self.close_to(place)
        if tag not in INLINE:
            self.flush()
            self.tags = 1
        if tag in VOID:
            if tag == "img":
                return
            self.words.append(" ")
            return
        above = self.fate[self.inner()]
        attrs = dict(attrs)
        own = self.drops(tag, attrs)
        mark = None if own else False if tag == "form" else self.marked(tag, attrs)
        if (own or mark is not None) and not above:
            self.flush()
        number = len(self.names)
        self.names.append(tag)
        self.above.append(self.inner())
        if mark is not None:
            self.marks[number] = mark
        if tag == "a":
            self.anchors += 1
            self.links += 1
        if above == GONE or (own and (tag != "header" or (not above and not self.regions))):
            drops = GONE
        elif own or (above == HEADER and tag not in HEADINGS):
            drops = HEADER
        else:
            drops = KEPT
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.regions += tag in REGIONS and not drops
        self.fate.append(drops)
        self.open.append(number)

    def drops(self, tag: str, attrs: dict) -> bool:
        if tag in DROPPED or tag == "header" or "hidden" in attrs:
            return True
        if tag in ("html", "body") or not attrs:
            return False
        return (attrs.get("role") or "").lower() in ROLES or (attrs.get("aria-hidden") or "").lower() == "true"

    def marked(self, tag: str, attrs: dict) -> bool | None:
        """Whether class or id is a mark: None if not, true if only names of states are."""
        if tag in ("html", "body") or not attrs:
            return None
        states = None
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            words = re.split(r"[^a-z0-9]+", f"{name} {CAMEL.sub('-', name)}".lower())
            if (COMMENT.search(name.lower()) is not None) if tag in REGIONS else (
                    not MARKS.isdisjoint(words) or any(COMPOUND.fullmatch(w) for w in words)
                    or (not ANSWERS.isdisjoint(words) and not READERS.isdisjoint(words)) or name.lower() in ("responses", "replies")):
                states = not STATES.isdisjoint(words) and states is not False
        return states

    def handle_endtag(self, tag):
        self.tags += 1
        if self.places.get(tag):
            self.close_to(self.places[tag][-1])
        elif tag not in INLINE:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        self.words.append(data)
        if self.anchors > 0:
            self.linked += len(data)

    def unwanted(self) -> set[int]:
        """The marked elements and forms that go, decided from the text and links each of them holds.

        A mark of a state goes if its text is mostly links. Any other mark goes unless the
        element holds an article (text of an article or main that is mostly no links; one
        inside another article is a comment or a card), or there is no article outside it
        and it holds most of the page's text, mostly no links, in at least two lines.
        """
        if not self.marks:
            return set()
        n = len(self.names)
        size, linked, rows, stories = [0] * n, [0] * n, [0] * n, [0] * n
        for text, _, e, chars, _ in self.lines:
            if not self.fate[e]:
                size[e] += len(text)
                linked[e] += chars
                rows[e] += 1
        within = [False] * n  # an article
        for e in range(1, n):
            up = self.above[e]
            within[e] = within[up] or self.names[up] == "article"

        def plain(e: int) -> bool:
            return size[e] > 0 and 2 * linked[e] <= size[e]

        total = sum(size)
        gone, most = set(), []
        for e in range(n - 1, 0, -1):  # inner elements first
            state = self.marks.get(e)
            if state:
                goes = not plain(e)
            elif state is False:
                goes = not stories[e] or within[e]
            else:
                goes = False
            up = self.above[e]
            if goes:
                gone.add(e)
                if state or not plain(e) or rows[e] < 2 or 2 * size[e] <= total:
                    continue
                most.append(e)
                stories[e] = 0
            elif self.names[e] in REGIONS and plain(e):
                stories[e] += 1
            size[up] += size[e]
            linked[up] += linked[e]
            rows[up] += rows[e]
            stories[up] += stories[e]
        if not stories[0]:
            gone.difference_update(most)
        return gone

    def held(self, elements) -> bytearray:
        """Of each element whether it is one of ``elements`` or within one."""
        out = bytearray(e in elements for e in range(len(self.names)))
        for e in range(1, len(out)):  # outer elements first
            out[e] = out[e] or out[self.above[e]]
        return out


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over the lines, ends repeated."""
    r = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str) -> str:
    """The article of one page, its blocks joined by one space."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    names, above = parser.names, parser.above
    gone = parser.held(parser.unwanted())
    lines = _without_ends([x for x in parser.lines if not parser.fate[x[2]] and not gone[x[2]]], parser)
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    ratio = smooth(size / np.maximum(1, [x[1] for x in lines]))
    content = (ratio >= min(ratio.std(), ratio.mean())).tolist()
    holds = [0.0] * len(names)  # characters of content
    for x, n, ok in zip(lines, size.tolist(), content, strict=True):
        holds[x[2]] += n * ok
    for e in range(len(names) - 1, 0, -1):
        holds[above[e]] += holds[e]
    regions = {e for e, tag in enumerate(names) if tag in REGIONS and holds[e]}
    in_region = parser.held(regions)
    of_content = [(x[2], n) for x, n, ok in zip(lines, size.tolist(), content, strict=True) if ok]
    if regions and sum(n for e, n in of_content if in_region[e]) >= HELD * holds[0]:
        chosen = regions | _beside(parser, {e for e, _ in of_content if not in_region[e]}, regions)
    else:
        chosen = {max((e for e in range(1, len(names)) if holds[e] == holds[0] and names[e] not in LEAVES), default=0)}
    inside = parser.held(chosen)
    return " ".join(x[0] for x, ok in zip(lines, content, strict=True) if ok or inside[x[2]])


def _without_ends(lines: list[tuple], parser: _Lines) -> list[tuple]:
    """Lines without the menus and notices of rights at the page's ends, outside article and main."""
    told = parser.held({e for e, tag in enumerate(parser.names) if tag in REGIONS | HEADINGS})

    def run(some) -> int:
        """Lines at the start of ``some`` that go."""
        k = links = n = 0
        for text, _, e, chars, count in some:
            if told[e]:
                break
            if 10 * chars >= 9 * len(text):
                links += count
            elif not RIGHTS.fullmatch(text):
                break
            else:
                k = n + 1
            n += 1
        return n if links >= 2 else k if not links else 0

    first, last = run(lines), run(reversed(lines))
    return lines[first:len(lines) - last] if first + last < len(lines) else lines


def _beside(parser: _Lines, places: set[int], regions: set[int]) -> set[int]:
    """Of each of the places outside the regions the innermost element that is no paragraph,
    if it doesn't hold a region."""
    around = {0}
    for e in regions:
        while e not in around:
            around.add(e)
            e = parser.above[e]
    block = [0] * len(parser.names)
    for e in range(1, len(block)):
        block[e] = block[parser.above[e]] if parser.names[e] in LEAVES else e
    return {block[e] for e in places} - around


def extract_main_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text("" if h is None else h.decode("utf-8", "replace")) for h in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [id_col, url_col, "text", "n_chars"])

    only = df.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`").cast("binary").alias("text"))
    return map_chunks(only, run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint", "text")
