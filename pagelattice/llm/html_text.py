"""HTML extraction (7): line-block distribution.

Markup is stripped into lines, one for each block of text. What is not content by its element or name (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, comments) is stripped as markup is and leaves empty lines; so does markup between two
texts, a line for each pair of block tags beyond those that end one block and begin the next.

A line's length is that of its text outside of links. Lengths are summed over sliding windows of ``window`` lines
to each side. The page sets the threshold itself: ``share`` of the length that the line of a random character has (sum of squares over sum). Text
surges at a line whose window reaches the threshold after one that did not, and dives where the windows fall below it again. Between
the two points all text is kept, links and short lines too. A window reaches beyond the text that fills it, so both points move inwards to
the nearest paragraph or line that reaches the threshold by itself, and from there outwards again over text of the sections around it (the
nearest ``div``, ``section`` or the like; items of lists only where other text of the section lies beyond them) and over headings right before.

Lines of an ``article`` or ``main`` reach the threshold by themselves: what a page declares as its article surges at its first line and
dives at its last, however short. Then nothing outside is kept that the windows do not find.

An element is left out by name if a whole class or id is a name of such content, alone or with words of place and shape
(``cookie-notice``, ``sidebar-left``; not ``with-sidebar``, ``no-comments``). Where no ``article`` or ``main`` stands
outside such elements, one is a wrapper and stays if it holds ``main``, or an ``article`` and half of the unlinked text, or
the share ``spared`` of that text, counted against what would stay without it. Comments, adverts, consent texts and the
like stay only around ``main``; an ``article`` in them is a teaser or a comment.

A page takes time in proportion to its length, however its tags are nested, closed or left open (and once more for each
wrapper that is found).

Defined edge cases: null or empty html gives an empty text; a page without any block of text gives
an empty text; unclosed and stray tags are tolerated; repeated rows are rows of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import slices

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")

# Element and naming conventions of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
CELLS = frozenset(("td", "th"))
DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas dialog menu head title button select textarea input datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    alert sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments disqus reply replies share sharing social
    related recommended newsletter subscribe subscription popup modal overlay widget login signup toolbar pagination pager skip copyright""".split()
)
#: Words that may stand in a name beside one of the above.
PLACES = frozenset(
    """site page main top bottom left right primary secondary global container wrapper wrap box bar area list block section posts post links link items item
    buttons button form slot unit inner outer panel module group column col row strip title heading article entry""".split()
)
HEADERS = frozenset("header site page main top global".split())
#: Never the wrapper of an article, however much text they hold.
NEVER_WRAPPERS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr comment comments disqus
    reply replies related recommended newsletter subscribe subscription login signup copyright""".split()
)
ARTICLES = frozenset(("article", "main"))
LISTS = frozenset("table ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("div section body html".split()) | LISTS | ARTICLES
NEVER_BY_NAME = frozenset(("html", "body"))
DROPPED_ARTICLES = frozenset("comment comments reply replies related ad ads advert promo sponsored".split())


class Line:
    """A block of text, or an empty line (``text`` is ""). ``article`` and ``section`` number the outermost article
    and the nearest section around it, lists and tables aside; 0 is none and the body. ``kind`` is "item", "heading", "paragraph" or "text"."""

    __slots__ = ("article", "kind", "linked", "section", "text")

    def __init__(self, text: str = "", article: int = 0, linked: int = 0, section: int = 0, kind: str = "text"):
        self.text, self.article, self.linked, self.section, self.kind = text, article, linked, section, kind


KEPT, NAMED, LEFT_OUT = 0, 1, 2
#: Empty lines that markup leaves between two texts, at most; any number beyond the window is alike.
MOST_EMPTY = 8
#: Sections around a line that are looked at.
DEEP = 16


class Named:
    """What an element left out by name holds."""

    __slots__ = ("article", "main", "size", "wrapper")

    def __init__(self, wrapper: bool):
        self.wrapper, self.size, self.article, self.main = wrapper, 0, False, False


def _boilerplate_names(names: str, in_article: bool, words: frozenset[str] = DROPPED_NAMES) -> set[str]:
    """The words for which a class or id attribute names content to leave out."""
    found = set()
    for whole in names.split():
        parts = {x for x in re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", whole).lower()) if len(x) > 1}
        if parts <= words | PLACES:
            found |= parts & words
        elif not in_article and "header" in parts and parts <= HEADERS:
            found.add("header")
    return found


def _is_boilerplate(name: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """Whether an element is left out, by its name or otherwise; and whether one left out by name may be a wrapper."""
    if name in DROPPED or (name == "header" and not in_article):
        return LEFT_OUT, False
    if not attrs or name in NEVER_BY_NAME:
        return KEPT, False
    found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return LEFT_OUT, False
    if found.get("role", "").lower() in DROPPED_ROLES:
        return LEFT_OUT, False
    article = name in ARTICLES
    names = _boilerplate_names(found.get("class", "") + " " + found.get("id", ""), in_article or article, DROPPED_ARTICLES if article else DROPPED_NAMES)
    return (NAMED, not names & NEVER_WRAPPERS) if names else (KEPT, False)


class Element:
    """An open block element: how it is left out, the article, section and element left out by name around
    it, and the inline elements open in it, with how many of each name."""

    __slots__ = ("article", "counts", "inline", "name", "named", "out", "section")

    def __init__(self, name: str, out: int = KEPT, article: int = 0, section: int = 0, named: int = 0):
        self.name, self.out, self.article, self.section, self.named = name, out, article, section, named
        self.inline: list[tuple[str, int, int]] = []  # name, how left out, element left out by name
        self.counts: dict[str, int] = {}

    def state(self) -> tuple[int, int]:
        """How text at this point is left out, and by which named element."""
        return self.inline[-1][1:] if self.inline else (self.out, self.named)


class Parser:
    """Lines of a page, and what the elements left out by name hold, by their number; those of ``kept`` are not left out."""

    def __init__(self, kept: frozenset[int]):
        self.kept = kept
        self.tags, self.stripped = 0, False  # block tags since the last text, and whether text was left out since
        self.lines: list[Line] = []
        self.above: dict[int, int] = {}
        self.named: dict[int, Named] = {}
        self.stack = [Element("")]
        self.open: dict[str, int] = {}  # block elements by name
        self.text: list[str] = []
        self.linked = self.links = self.n = self.items = 0

    def flush(self) -> None:
        if self.text:
            block = SPACE.sub(" ", html.unescape("".join(self.text))).strip()
            if block:
                top = self.stack[-1]
                empty = max(int(self.stripped), self.tags // 2 - 1)
                self.lines += [Line() for _ in range(min(empty, MOST_EMPTY))]
                self.tags, self.stripped = 0, False
                kind = "heading" if top.name in HEADINGS else "item" if self.items else "paragraph" if top.name == "p" else "text"
                self.lines.append(Line(block, top.article, min(self.linked, len(block)), top.section, kind))
            self.text.clear()
        self.linked = 0

    def pop(self, name: str) -> None:
        """Closes block elements up to the nearest one of that name, which is open."""
        while True:
            gone = self.stack.pop()
            self.open[gone.name] -= 1
            self.items -= gone.name in LISTS
            if gone.name == name:
                return

    def take(self, piece: str) -> None:
        out, named = self.stack[-1].state()
        if not out:
            self.text.append(piece)
            if self.links:
                self.linked += len(piece)
            return
        size = len(SPACE.sub(" ", piece).strip())
        self.stripped |= size > 0
        if out == NAMED and not self.links:
            self.named[named].size += size

    def close(self, name: str) -> None:
        if name in INLINE:
            top = self.stack[-1]
            if top.counts.get(name):
                while True:
                    gone = top.inline.pop()[0]
                    top.counts[gone] -= 1
                    if gone == name:
                        break
            self.links -= name == "a" and self.links > 0
        elif self.open.get(name):
            if name in CELLS:
                self.text.append(" ")
            else:
                self.flush()
                self.tags += self.stack[-1].out == KEPT
            self.links = 0
            self.pop(name)

    def start(self, name: str, attrs: str) -> None:
        """An element that is not void."""
        block = name not in INLINE
        if block and name not in CELLS:
            self.flush()
            self.links = 0
            # An open paragraph ends where a block begins, an item where the next one does.
            above = self.stack[-1].name
            if above == "p" or (above == name and name in ("li", "dt", "dd", "option", "tr")):
                self.pop(above)
        top = self.stack[-1]
        above_out, above_named = top.state()
        self.n += 1
        out, wrapper = (LEFT_OUT, False) if above_out == LEFT_OUT else _is_boilerplate(name, attrs, top.article > 0)
        if out == NAMED and self.n in self.kept:
            out = KEPT
        if out and not block and not above_out and name in ("a", "b", "i", "em", "strong"):
            out = KEPT
        if above_out == NAMED:
            if name in ARTICLES and not out:
                self.named[above_named].article = True
            if name == "main" and out != LEFT_OUT:
                self.named[above_named].main = True
            out = max(out, NAMED)
        elif out == NAMED:
            self.named[self.n] = Named(wrapper)
            self.named[self.n].main = name == "main"
        named = above_named or (self.n if out == NAMED else 0)
        self.links += name == "a"
        if not block:
            top.inline.append((name, out, named))
            top.counts[name] = top.counts.get(name, 0) + 1
            return
        self.tags += out == KEPT and name not in CELLS
        section = self.n if name in SECTIONS - LISTS - NEVER_BY_NAME else top.section
        if section == self.n:
            self.above[section] = top.section
        made = Element(name, out, top.article or (self.n if name in ARTICLES else 0), section, named)
        self.items += name in LISTS
        self.stack.append(made)
        self.open[name] = self.open.get(name, 0) + 1

    def feed(self, page: str) -> None:
        at = 0
        while at < len(page):
            tag = TAG.search(page, at)
            if piece := page[at : tag.start() if tag else len(page)]:
                self.take(piece)
            if not tag:
                break
            at = tag.end()
            name = (tag["name"] or tag["name2"] or "").lower()
            attrs = tag["attrs"] or tag["attrs2"] or ""
            if not name:
                continue
            if tag["close"] or tag["close2"]:
                self.close(name)
            elif name in VOID:
                if name == "br":
                    self.text.append(" ")
                elif name == "hr":
                    self.flush()
            elif not (attrs.endswith("/") and name not in RAW | SECTIONS | DROPPED):
                self.start(name, attrs)
                if name in RAW:
                    end = RAW_END[name].search(page, at)
                    self.take(page[at : end.start() if end else len(page)])
                    at = end.end() if end else len(page)
                    self.pop(name)
        self.flush()


RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


def page_lines(page: str, spared: float = 0.75) -> tuple[list[Line], dict[int, int]]:
    """The lines of a page, empty ones where markup or what is left out lay; and for each section the one around it."""
    kept: frozenset[int] = frozenset()
    while True:
        parser = Parser(kept)
        parser.feed(page)
        lines, named = parser.lines, parser.named
        if any(x.article for x in lines):
            return lines, parser.above
        rest = sum(max(0, len(x.text) - x.linked) for x in lines)
        mains = [n for n, x in named.items() if x.main]
        articles = [n for n, x in named.items() if x.wrapper and x.article and x.size >= rest]
        large = [max((n for n, x in named.items() if x.wrapper), key=lambda n: named[n].size, default=0)]
        if not mains and not articles and (not large[0] or named[large[0]].size <= spared * (rest + named[large[0]].size)):
            return lines, parser.above
        kept |= frozenset(mains or articles or large)


def line_sizes(lines: list[Line], share: float) -> tuple[list[int], float]:
    """The length of each line and the page's threshold; lines of an article have at least the threshold's."""
    plain = [len(x.text) - x.linked for x in lines]
    if not any(plain):
        plain = [len(x.text) for x in lines]  # nothing but links
    total = sum(plain)
    least = max(1.0, share * sum(n * n for n in plain) / total) if total else 1.0
    return [max(n, math.ceil(least)) if x.article and x.text else n for n, x in zip(plain, lines, strict=True)], least


def surges(sizes: list[int], least: float, window: int) -> list[tuple[int, int]]:
    """First and last line of each run of lines whose windows, ``window`` lines to each side, hold at least ``least`` characters."""
    sums, runs, start = [0, *itertools.accumulate(sizes)], [], None
    for k in range(len(sizes)):
        high = sums[min(len(sizes), k + window + 1)] - sums[max(0, k - window)] >= least
        if high and start is None:
            start = k
        elif not high and start is not None:
            runs.append((start, k - 1))
            start = None
    return [*runs, (start, len(sizes) - 1)] if start is not None else runs


def moved(lines: list[Line], above: dict[int, int], begin: int, end: int, window: int) -> tuple[int, int]:
    """A run's points moved outwards from its own lines over text of the sections around them, and over headings right before.

    At most ``window`` lines of other sections may lie in between; items at the rim of a section are taken only if other text of
    it goes on beyond them.
    """
    points = []
    for step, edge in ((-1, begin), (1, end)):
        around, section = {lines[edge].section}, lines[edge].section
        while section and len(around) < DEEP:
            section = above[section]
            around.add(section)
        at, held, others = edge + step, edge, 0
        while 0 <= at < len(lines) and others <= window:
            if lines[at].text:
                if lines[at].section not in around:
                    others += 1
                elif lines[at].kind != "item":
                    held, others = at, 0
            at += step
        points.append(held)
    begin, end = points
    while begin and lines[begin - 1].kind == "heading" and lines[begin - 1].text:
        begin -= 1
    return begin, end


def article_lines(lines: list[Line], above: dict[int, int], window: int = 2, share: float = 0.5) -> list[str]:
    """The texts between surge and dive points; ``above`` has for each section the one around it."""
    sizes, least = line_sizes(lines, share)
    out: dict[int, None] = {}
    for first, last in surges(sizes, least, window):
        core = [k for k in range(first, last + 1) if sizes[k] >= least or (sizes[k] and lines[k].kind == "paragraph")]
        if core:
            begin, end = moved(lines, above, core[0], core[-1], window)
            out.update(dict.fromkeys(k for k in range(begin, end + 1) if lines[k].text))
    return [lines[k].text for k in sorted(out)]


def main_text(page: str | None, window: int = 2, share: float = 0.5) -> str:
    """The article's blocks joined by two newlines."""
    return "\n\n".join(article_lines(*page_lines(page), window, share)) if page else ""


def extract(pages: DataFrame, window: int = 2, share: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x, window, share) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
