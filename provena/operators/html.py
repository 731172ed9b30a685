"""Fields of fetched pages, read with regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_whitespace


def strip_tags(html: Column) -> Column:
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return normalize_whitespace(x)


def hidden_number(html: Column, name: str) -> Column:
    """The value of a hidden input; null without."""
    tag = F.regexp_extract(html, rf'(?is)<input[^>]*name="{name}"[^>]*>', 0)
    return F.nullif(F.regexp_extract(tag, r'(?i)value="(\d+)"', 1), F.lit("")).try_cast("int")


def elements(html: Column, tag: str, attributes: str = "") -> Column:
    """Inner HTML of every element of a tag (not nested), with a pattern that its attributes hold."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*{attributes}[^>]*>(.*?)</{tag}>"), F.lit(1))


def links(html: Column) -> Column:
    """array<struct<href, text>> of all anchors."""
    tags = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r'(?is)href="([^"]*)"', 1).alias("href"), strip_tags(t).alias("text")))


def breadcrumbs(html: Column, cls: str = "breadcrumb") -> Column:
    """Anchors of the breadcrumb list, else of the first nav."""
    marked = F.try_element_at(elements(html, "ol", f'class="[^"]*{cls}'), F.lit(1))
    return links(F.coalesce(marked, F.try_element_at(elements(html, "nav"), F.lit(1)), F.lit("")))


def text_blocks(html: Column, tag: str = "p", main: str = "c2", person: str = "/narrator/") -> Column:
    """array<struct<full_text, matn, narrators>>: blocks, their span of class `main`, and person links."""

    def one(b: Column) -> Column:
        people = F.filter(links(b), lambda x: x["href"].contains(person))
        return F.struct(
            strip_tags(b).alias("full_text"), F.array_join(F.transform(elements(b, "span", f'class="{main}"'), strip_tags), " ").alias("matn"),
            F.transform(people, lambda x: F.struct(F.regexp_extract(x["href"], rf"{person}(\d+)", 1).alias("id"), x["text"].alias("name"), x["href"].alias("url"))).alias("narrators"),
        )

    return F.transform(elements(html, tag), one)


def labelled_fields(html: Column) -> Column:
    """map<label, value> of definition lists and two-cell rows; the first value of a label stays."""
    rows = F.concat(F.regexp_extract_all(html, F.lit(r"(?is)<dt\b[^>]*>.*?</dt>\s*<dd\b[^>]*>.*?</dd>"), F.lit(0)), F.regexp_extract_all(html, F.lit(r"(?is)<th\b[^>]*>.*?</th>\s*<td\b[^>]*>.*?</td>"), F.lit(0)))
    pair = F.transform(rows, lambda r: F.struct(F.regexp_replace(strip_tags(F.regexp_extract(r, r"(?is)^(.*?)</(?:dt|th)>", 1)), r"[:：]\s*$", "").alias("k"), strip_tags(F.regexp_extract(r, r"(?is)</(?:dt|th)>(.*)$", 1)).alias("v")))
    first = F.filter(pair, lambda x, i: F.array_position(F.transform(pair, lambda y: y["k"]), x["k"]) == i + 1)
    return F.map_from_entries(first)


def sections(html: Column, level: str = "h2") -> Column:
    """array<struct<heading, items>>: each heading with the list items and paragraphs up to the next."""
    parts = F.slice(F.split(html, rf"(?i)<{level}\b[^>]*>"), 2, 1 << 20)
    return F.transform(parts, lambda p: F.struct(strip_tags(F.regexp_extract(p, rf"(?is)^(.*?)</{level}>", 1)).alias("heading"), F.transform(F.regexp_extract_all(F.regexp_extract(p, rf"(?is)</{level}>(.*)$", 1), F.lit(r"(?is)<(?:li|p)\b[^>]*>(.*?)</(?:li|p)>"), F.lit(1)), strip_tags).alias("items")))


def person_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds name (first h1), fields, sections, hrefs of a person page."""
    h = F.coalesce(F.col(html), F.lit(""))
    return pages.withColumns({"name": strip_tags(F.coalesce(F.try_element_at(elements(h, "h1"), F.lit(1)), F.lit(""))), "fields": labelled_fields(h), "sections": sections(h), "hrefs": F.array_distinct(F.transform(links(h), lambda x: x["href"]))})
