"""Elements of fetched pages from one pass with a stack, for markup that nests or leaves elements open; fields are columns over them.

A tree is the page's text once and its elements in the order of their start tags. Texts and markup of elements are offsets, so a
tree grows with the page however deep it nests; the elements inside the k-th one are those up to its `last`.
"""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions.text import normalize_whitespace

ELEMENT = "tag string, cls string, id string, href string, parent int, last int, t0 int, t1 int, h0 int, h1 int"
TREE = f"text string, elements array<struct<{', '.join(f.replace(' ', ': ') for f in ELEMENT.split(', '))}>>"

# Fixed values of HTML: elements without content, and what a start tag ends (open elements that are nearer than the bounds).
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {k: (a.split(), b.split()) for k, (a, b) in ENDS.items()} | {b: (["p"], ["button", "td", "th", "table"]) for b in BLOCKS}


class _Pass(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0, *accumulate(len(x) + 1 for x in page.split("\n"))]
        self.found, self.open, self.at, self.parts, self.size = [], [], {}, [], 0
        self.feed(page)
        self.close()
        self.end_down_to(0, len(page))

    def here(self) -> int:
        line, offset = self.getpos()
        return self.lines[line - 1] + offset

    def write(self, data: str) -> None:
        self.parts.append(data)
        self.size += len(data)

    def end_down_to(self, depth: int, where: int) -> None:
        while len(self.open) > depth:
            e = self.found[self.open.pop()]
            self.at[e["tag"]].pop()
            e.update(last=len(self.found) - 1, t1=self.size, h1=where)

    def nearest(self, tags: list[str]) -> int:
        """Place in the stack of the innermost open element of these tags; -1 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        where = self.here()
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            place = self.nearest(ended)
            if place > self.nearest(bounds):
                self.end_down_to(place, where)
        self.write(" ")
        a, inside = dict(reversed(attrs)), where + len(self.get_starttag_text())  # of two attributes of one name the first counts
        k = len(self.found)
        self.found.append({"tag": tag, "cls": a.get("class"), "id": a.get("id"), "href": a.get("href"), "parent": self.open[-1] if self.open else -1, "last": k, "t0": self.size, "t1": self.size, "h0": inside, "h1": inside})
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash ends void elements only

    def handle_endtag(self, tag):
        place = self.nearest([tag])
        if place >= 0:
            self.end_down_to(place, self.here())
        self.write(" ")

    def handle_data(self, data):
        if not (self.open and self.found[self.open[-1]]["tag"] in ("script", "style")):
            self.write(data)


def tree(html: Column) -> Column:
    """struct<text, elements>. Each element: tag (lower case), cls, id, href (null without), parent (-1: none) and last, places in
    `elements` from 0; t0 and t1, its part of `text`; h0 and h1, its inner part of the page, all in code points.

    An end tag ends the innermost open element of its name and what is open inside; without one it is nothing. Items, cells,
    terms and paragraphs end where the next one starts; the page's end ends all. Comments, scripts and styles have no text; each
    tag is white space. Null or empty: no text, no elements.
    """

    @F.pandas_udf(TREE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        passes = [_Pass(p or "") for p in pages]
        return pd.DataFrame({"text": ["".join(p.parts) for p in passes], "elements": [p.found for p in passes]})

    return parse(html)


def text(tree: Column, e: Column) -> Column:
    """White space of an element's text as one space, trimmed; null for no element."""
    return normalize_whitespace(F.substring(tree["text"], e["t0"] + 1, e["t1"] - e["t0"]))


def inner(html: Column, e: Column) -> Column:
    return F.substring(html, e["h0"] + 1, e["h1"] - e["h0"])


def _wanted(x: Column, tags: tuple, cls: str | None) -> Column:
    ok = x["tag"].isin(*tags)
    return ok if cls is None else ok & F.array_contains(F.split(F.coalesce(x["cls"], F.lit("")), r"\s+"), cls)


def elements(tree: Column, *tags: str, cls: str | None = None) -> Column:
    """All elements of some tags, nested ones too, that have a class word."""
    return F.filter(tree["elements"], lambda x: _wanted(x, tags, cls))


def inside(tree: Column, e: Column, *tags: str, cls: str | None = None) -> Column:
    """Those inside an element; the element lies before its first child, so places come from its text and markup."""
    return F.filter(tree["elements"], lambda x: (x["h0"] > e["h0"]) & (x["h0"] <= e["h1"]) & _wanted(x, tags, cls))


def breadcrumbs(tree: Column, cls: str = "breadcrumb") -> Column:
    """array<struct<href, text>>: anchors of the first list with the class, else of the first nav, else none."""
    top = F.coalesce(F.try_element_at(elements(tree, "ol", "ul", cls=cls), F.lit(1)), F.try_element_at(elements(tree, "nav"), F.lit(1)))
    found = F.filter(inside(tree, top, "a"), lambda a: a["href"].isNotNull())
    return F.coalesce(F.transform(found, lambda a: F.struct(a["href"].alias("href"), text(tree, a).alias("text"))), F.array())


def text_blocks(tree: Column, tag: str = "p", main: str = "c2", person: str = "/narrator/") -> Column:
    """array<struct<full_text, matn, narrators>> of blocks: their spans of class `main`, and links to persons."""

    def one(b: Column) -> Column:
        people = F.filter(inside(tree, b, "a"), lambda a: a["href"].contains(person))
        return F.struct(
            text(tree, b).alias("full_text"), F.array_join(F.transform(inside(tree, b, "span", cls=main), lambda s: text(tree, s)), " ").alias("matn"),
            F.transform(people, lambda a: F.struct(F.regexp_extract(a["href"], rf"{person}(\d+)", 1).alias("id"), text(tree, a).alias("name"), a["href"].alias("url"))).alias("narrators"),
        )

    return F.transform(elements(tree, tag), one)


def labelled_fields(tree: Column) -> Column:
    """map<label, value>: terms and header cells with the definition or cell that comes next; the first value of a label stays."""
    cells = elements(tree, "dt", "dd", "th", "td")
    pairs = F.filter(F.arrays_zip(cells.alias("a"), F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))).alias("b")), lambda p: p["b"].isNotNull() & (((p["a"]["tag"] == "dt") & (p["b"]["tag"] == "dd")) | ((p["a"]["tag"] == "th") & (p["b"]["tag"] == "td"))))
    named = F.transform(pairs, lambda p: F.struct(F.regexp_replace(text(tree, p["a"]), r"[:：]\s*$", "").alias("k"), text(tree, p["b"]).alias("v")))
    return F.map_from_entries(F.filter(named, lambda x, i: F.array_position(F.transform(named, lambda y: y["k"]), x["k"]) == i + 1))
