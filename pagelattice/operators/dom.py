"""Element tables of HTML pages: one row an element, in pre-order.

A page is parsed inside the task that holds it (stdlib tokenizer, a stack of open elements). Recovery is a
declared subset of browser rules: void elements, implied html, head and body, and the usual automatic ends
of p, li, dt, dd, tr, td, th and option.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice import constants as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link base script style noscript template".split())
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS = frozenset("table ul ol dl select div form section td th".split())  # automatic ends do not reach beyond these
KEPT = ("id", "src", "href", "action", "class", "alt", "title", "rel", "type")
#: Word groups that elements are searched for, by the name of their flag.
WORD_GROUPS = {"has_credential": C.CREDENTIAL_WORDS, "has_urgency": C.URGENCY_WORDS, "has_brand": C.BRAND_WORDS, "has_action": C.ACTION_WORDS}
SCHEMA = (
    "page_id long, seq int, parent int, depth int, tag string, "
    + ", ".join(f"{k} string" for k in KEPT)
    + ", has_event_handler boolean, own_text string, "
    + ", ".join(f"{k} boolean" for k in WORD_GROUPS)
    + ", spaced_text string"
)


class Tree(HTMLParser):
    """Collects elements and the page's text (stripped pieces put together) with each element's part of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack, self.pieces, self.at = [], [], [], 0
        self.seen_body = False

    def open(self, tag, attrs=()):
        values = dict.fromkeys(KEPT)
        handler = False
        for name, value in attrs:
            handler = handler or name.startswith("on")
            if name in values and values[name] is None:
                values[name] = " ".join(value.split()) if name == "class" and value else (value or "")
        row = {"seq": len(self.rows), "parent": self.stack[-1]["seq"] if self.stack else None, "depth": len(self.stack), "tag": tag, **values, "has_event_handler": handler, "own": [], "text_start": self.at, "text_end": self.at}
        self.rows.append(row)
        self.stack.append(row)

    def close_to(self, depth):
        while len(self.stack) > depth:
            self.stack.pop()["text_end"] = self.at

    def settle(self, in_head):
        """Opens html, head or body where the next node implies them."""
        if not self.stack:
            self.open("html")
        if self.stack[-1]["tag"] in ("html", "head") and len(self.stack) <= 2:
            if in_head and not self.seen_body:
                if self.stack[-1]["tag"] == "html":
                    self.open("head")
            else:
                self.close_to(1)
                self.seen_body = True
                self.open("body")

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            if tag == "html" and not self.stack:
                self.open("html", attrs)
            elif tag == "head" and not self.seen_body and not any(r["tag"] == "head" for r in self.rows):
                self.settle(True) if not self.stack else None
                if self.stack[-1]["tag"] == "html":
                    self.open("head", attrs)
            elif tag == "body" and not self.seen_body:
                if not self.stack:
                    self.open("html")
                self.close_to(1)
                self.seen_body = True
                self.open("body", attrs)
            return
        self.settle(tag in HEAD)
        ended = ENDED_BY.get(tag, ()) + (("p",) if tag in ENDS_P else ())
        last = None
        for depth in range(len(self.stack) - 1, 1, -1):
            name = self.stack[depth]["tag"]
            if name in ended:
                last = depth
            elif name in KEEPS:
                break
        if last is not None:
            self.close_to(last)
        self.open(tag, attrs)
        if tag in VOID:
            self.close_to(len(self.stack) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1]["tag"] == tag and tag not in ("html", "head", "body"):
            self.close_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth]["tag"] == tag:
                self.close_to(depth)
                break

    def handle_data(self, data):
        if self.stack and self.stack[-1]["tag"] in ("script", "style"):
            self.stack[-1]["own"].append(data)
            return
        piece = data.strip()
        if piece:
            self.settle(False)
            self.pieces.append(piece)
            self.at += len(piece)


def parse(page: str) -> tuple[list[dict], list[str]]:
    tree = Tree()
    tree.feed(page)
    tree.close()
    tree.close_to(0)
    return tree.rows, tree.pieces


class WordGroup:
    """Whether parts of a text hold a word of a group: one scan of the text, then a search for each part."""

    def __init__(self, words):
        by_length = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (len(w), w)))
        self.starts_with = re.compile(f"(?=({by_length}))")  # at each place the shortest word

    def scan(self, text: str):
        """A test for parts (start, end): of the hits at or after the start, one ends by the end."""
        starts, ends = [], []
        for hit in self.starts_with.finditer(text):
            starts.append(hit.start())
            ends.append(hit.end(1))
        for k in range(len(ends) - 2, -1, -1):
            ends[k] = min(ends[k], ends[k + 1])

        def holds(start: int, end: int) -> bool:
            k = bisect_left(starts, start)
            return k < len(ends) and ends[k] <= end

        return holds


def dom_nodes(pages: DataFrame) -> DataFrame:
    """Elements of each page with html; ``spaced_text`` (lower case) on the root row.

    The flags of ``WORD_GROUPS`` tell whether an element's part of the page's text (stripped pieces put together, lower case)
    holds a word of the group. ``own_text`` is the raw text of scripts and styles, which counts in no other element.
    """
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[f.split(" ")[1]] for f in SCHEMA.split(", ")]

    def scan(batches):
        groups = {name: WordGroup(words) for name, words in WORD_GROUPS.items()}
        columns = {name: [] for name in names}

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in zip(names, types, strict=True)], names)
            for values in columns.values():
                values.clear()
            return batch

        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                rows, pieces = parse(html)
                text = "".join(pieces)
                lower = text.lower()
                if len(lower) != len(text):  # a letter whose lower case is longer would move what follows
                    lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
                holds = {name: group.scan(lower) for name, group in groups.items()}
                for row in rows:
                    own = "".join(row["own"]) or None
                    raw = row["tag"] in ("script", "style")
                    for name in names:
                        if name in groups:
                            value = bool(own and groups[name].starts_with.search(own.lower())) or (not raw and holds[name](row["text_start"], row["text_end"]))
                        elif name == "own_text":
                            value = own
                        elif name == "spaced_text":
                            value = " ".join(pieces).lower() if row["seq"] == 0 else None
                        else:
                            value = page_id if name == "page_id" else row[name]
                        columns[name].append(value)
                if len(columns["seq"]) > 5000:
                    yield made()
        yield made()

    return pages.where(F.coalesce("html", F.lit("")) != "").select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(scan, SCHEMA)
