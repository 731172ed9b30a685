r"""HTML main text by nearest-URL page differencing.

Every page is read into blocks (the lines of its text), each with the page's own marks: inside an article, or inside a part
that is no main text by its element, role or class. Every page is paired with the page of its host that shares the longest start
of the path and has other lines (copies of a page are one place in the order); their lines are aligned by a longest common
subsequence, and shared lines are deleted. What the alignment shares inside an article element (or main) may be a paragraph of
two articles ("The.", a quotation, a reprint): there only template goes, which is what most of the host's articles share with
their nearest page. An article of which half or more is shared is a reprint and doesn't count in that, and copies of an article
count once. What is left then passes the page's marks: the lines of article elements, or else of main, or else all, without parts
that are no main text. So a promoted article that stands on every page goes as a whole, and a page of nothing else is read from
its other parts.

An article element goes before main; an article inside a menu, header, footer or aside that has an end tag of its own is a teaser
there; inside an article only whole class names mark a part as no text, and ids of headings, paragraphs and the like never do.

Neighbours come from a range-partitioned order of small rows (host, path, line hashes), whose runs of equal pages are numbered
across partitions, so that a host with very many pages is spread over tasks like any other.

Defined cases: null pages are empty; null URLs have no host and no neighbour; a page alone on its host, or there only with copies
of itself, keeps what its marks leave; unclosed elements end with their parent, an unclosed script, style or comment with the page,
a part left open before an article (no end tag of its own further on) with the article's start; repeated rows each give a row.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import Steps, packed, prepare, table, unpacked

#: Elements by what they do to lines, and words of class, id and role that mark what is no main text.
RAW = {"script", "style", "textarea", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "title", "object", "canvas", "audio", "video"}
NO_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "discussion"}
NO_TEXT = COMMENTS | {"ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "sidebar", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "footer", "masthead", "copyright", "toolbar", "search", "skip", "hidden"}
#: Words that may stand beside one of these in the class of a part inside an article.
HOLDERS = {"area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "group", "item", "items", "link", "links", "list", "panel", "post", "posts", "articles", "section", "slot", "thread", "unit", "wrap", "wrapper"}
#: Elements whose id names what they say, not what they are.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption"}
CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "header", "footer", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "fieldset", "hr", "address", "details"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_UNENDED = re.compile(r"<[!?]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)")
#: Lists of up to so many shared lines are aligned with all bit rows in memory; it changes no result.
ALIGN = 4096
#: A shared line inside articles is the host's template if so many articles share it at least, and more than half of them.
TEMPLATE_ARTICLES = 3


def _marked(name: str, attributes: str, in_article: bool) -> bool:
    """The element holds no main text."""
    if not attributes.strip():
        return False
    found = {}
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), a or b or c)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in NO_TEXT_ROLES and name not in ("article", "main", "body", "html"):
        return True
    if in_article and name not in ("article", "main", "body", "html"):
        # in an article a whole name has to say so: share, ad-slot, related-posts, but not share-price or notice-board
        names = found.get("class", "").split() + ([] if name in TEXT_BLOCKS else found.get("id", "").split())
        parts = ({w.lower() for w in _WORDS.findall(x)} - {""} for x in names)
        return any(x & (NO_TEXT - {"header"}) and x <= NO_TEXT | HOLDERS for x in parts)
    words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(found.get(k, ""))}
    if name in ("article", "main", "body", "html"):
        return name == "article" and bool(words & COMMENTS)
    return bool(words & NO_TEXT)


def _ends(page: str, name: str):
    """Whether a part of that name that is open at a place has an end tag of its own further on: more of them than new parts to end."""
    opens, closes = [], []
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", page, re.I):
        (closes if m[1] else opens).append(m.start())
    return lambda at: len(closes) - bisect_left(closes, at) > len(opens) - bisect_left(opens, at)


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """Lines of a page: text, where it stands (2: in an article element, 1: in main, 0: elsewhere), inside a part that is no main text."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # name, article, no text
    ended: dict = {}
    parts: list[str] = []
    open_: Counter = Counter()  # of the names on the stack: a page of very many unclosed elements is searched only for those that are there
    article, outside = 0, False
    at, n, ends = 0, len(page), page.rfind(">")

    def flush():
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                out.append((line, article, outside))
            parts.clear()

    def pop_to(k: int):
        nonlocal article, outside
        if any(x[0] not in INLINE for x in stack[k:]):
            flush()
        open_.subtract(x[0] for x in stack[k:])
        del stack[k:]
        article, outside = (stack[-1][1], stack[-1][2]) if stack else (0, False)

    while at < n:
        if at > ends:  # no tag ends here any more; what opens none is text
            rest = _UNENDED.split(page[at:], maxsplit=1)[0]
            parts.append(rest)
            break
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "br":
                parts.append(" ")
            elif name == "p" and not open_["p"]:
                flush()
            elif open_[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop_to(k)
                        break
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else n
            if name not in INLINE:
                flush()
            continue
        if name in CLOSES_P and open_["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in SIBLINGS and any(open_[x] for x in SIBLINGS[name][0]):
            same, limits = SIBLINGS[name]
            k = len(stack) - 1
            last = None
            while k >= 0 and stack[k][0] not in limits:
                if stack[k][0] in same:
                    last = k
                k -= 1
            if last is not None:
                pop_to(last)
        if name == "article" and outside:  # a menu, header or notice that was left open ends here; reader comments don't
            k = next(i for i, x in enumerate(stack) if x[2])
            part = stack[k][0]
            if part in ("nav", "header", "footer", "aside", "head", "title"):
                if part not in ended:
                    ended[part] = _ends(page, part)
                if part in ("head", "title") or not ended[part](at):  # one with its own end further on holds teasers
                    pop_to(k)
        if name == "br" or name in ("img", "wbr", "input"):
            parts.append(" " if name != "wbr" else "")
            continue
        if name not in INLINE:
            flush()
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        no_text = name in OUTSIDE or (name == "header" and not article) or _marked(name, attributes, article)
        if name in ("article", "main") and not no_text and not outside:
            article = max(article, 2 if name == "article" else 1)
        outside = outside or no_text
        stack.append((name, article, outside))
        open_[name] += 1
    flush()
    return out


def common_subsequence(a: list[int], b: list[int]) -> list[bool]:
    """For each of a whether a longest common subsequence with b has it. Bit rows, of which every step-th is kept; the others are made again."""
    kept, short = [False] * len(a), min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)  # equal ends are always part of one
    tail = next((i for i in range(short - head) if a[-1 - i] != b[-1 - i]), short - head)
    kept[:head], kept[len(a) - tail :] = [True] * head, [True] * tail
    shared = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    own = [i for i in range(head, len(a) - tail) if a[i] in shared]
    other = [x for x in b[head : len(b) - tail] if x in shared]
    at: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        at.setdefault(x, []).append(j)
    full, size = (1 << len(other)) - 1, len(other) // 8 + 1
    held: dict[int, int] = {}

    def places(x: int) -> int:
        if x in held:
            return held[x]
        bits = bytearray(size)
        for j in at[x]:
            bits[j >> 3] |= 1 << (j & 7)
        out = int.from_bytes(bits, "little")
        if len(other) <= ALIGN or len(at[x]) > 64:  # of long lists only the few lines that stand in many places
            held[x] = out
        return out

    def rows(v: int, part: list[int]) -> Iterator[int]:
        for i in part:  # a zero bit j of v: the common length grows at j
            u = v & places(a[i])
            v = ((v + u) | (v - u)) & full
            yield v

    step = max(1, len(own) if len(own) <= ALIGN else math.isqrt(len(own)))
    starts = [full]  # the row before own[0], own[step], ...
    for k, last in enumerate(rows(full, own[: (len(own) - 1) // step * step]), 1):
        if k % step == 0:
            starts.append(last)
    j = len(other)
    for c in range(len(starts) - 1, -1, -1):
        part = own[c * step : (c + 1) * step]
        made = [starts[c], *rows(starts[c], part)]
        for k in range(len(part), 0, -1):
            mask = (1 << j) - 1
            if (~made[k] & mask).bit_count() > (~made[k - 1] & mask).bit_count():
                kept[part[k - 1]] = True
                j = (~made[k] & mask).bit_length() - 1  # the last place where the length grows
    return kept


def _hashes(lines) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x[0].encode()) >> 1 for x in lines]


def _digest(hashes: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little") for x in hashes)) >> 1


def _level(lines: list[tuple[str, int, bool]]) -> int:
    return max((article for _, article, outside in lines if not outside), default=0)


def article_lines(lines: list[tuple[str, int, bool]]) -> list[str] | None:
    """The lines in article elements, or else in main; None where a page marks neither."""
    level = _level(lines)
    return [t for t, article, outside in lines if article == level and not outside] if level else None


def _address(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2] or "/") if m else ("", url or "")


def neighbours(pages: DataFrame, steps: Steps) -> DataFrame:
    """Pages with line hashes (lines), the lengths of those in their article (inside; 0 for others) and a hash of the article, beside the
    line hashes of the nearest page by path on the host that has other lines (near, null if there is none). pages: uid, url, html."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [_address(u) for u in batch.column("url").to_pylist()]
            hashes, inside, page, article = [], [], [], []
            for h in batch.column("html").to_pylist():
                found = blocks(h or "")
                level, own = _level(found), _hashes(found)
                hashes.append(own)
                inside.append([len(t) if level and at == level and not outside else 0 for t, at, outside in found])
                page.append(_digest(own))
                article.append(_digest([x for x, n in zip(own, inside[-1]) if n]) if level else None)
            columns = [pa.array([w[0] for w in where], pa.string()), pa.array([w[1] for w in where], pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(inside, pa.list_(pa.int32())), pa.array(page, pa.int64()), pa.array(article, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), *columns], names=["uid", "host", "path", "lines", "inside", "page", "article"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal pages of this partition, their first and last rows. A batch waits for the next one's first row."""
        from pyspark import TaskContext

        part, run, before, waiting = TaskContext.get().partitionId(), -1, None, None

        def done(ends: bool) -> pa.RecordBatch:
            batch, runs, first = waiting
            last = [*first[1:], ends]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(first, pa.bool_()), pa.array(last, pa.bool_())], names=[*batch.schema.names, "part", "run", "first", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            runs, first = [], []
            for key in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist()):
                first.append(key != before)
                run += key != before
                runs.append(run)
                before = key
            if waiting:
                yield done(first[0])
            waiting = batch, runs, first
        if waiting:
            yield done(True)

    schema = "uid binary, host string, path string, lines array<bigint>, inside array<int>, page bigint, article bigint"
    rows = steps.write(pages.mapInArrow(lines, schema).where("host <> '' AND size(lines) > 0").dropDuplicates(["uid"]), "page-lines")
    ordered = rows.repartitionByRange("host", "path", "uid").sortWithinPartitions("host", "path", "uid")
    ordered = steps.write(ordered.mapInArrow(numbered, f"{schema}, part int, run bigint, first boolean, last boolean"), "page-order")
    # a run may go on in the next partitions: their first runs are no new ones
    key, by = F.struct("host", "page"), Window.orderBy("part")
    parts = ordered.where("first").groupBy("part").agg((F.max("run") + 1).alias("runs"), F.min_by(key, "run").alias("head"), F.max_by(key, "run").alias("tail"))
    parts = parts.select("part", "runs", F.col("head").eqNullSafe(F.lag("tail").over(by)).alias("goes_on"), F.col("tail").eqNullSafe(F.lead("head").over(by)).alias("stays"))
    new = F.col("runs") - F.col("goes_on").cast("int")
    parts = parts.withColumn("b", F.coalesce(F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("goes_on").cast("int"))
    first = F.col("first") & ~(F.col("goes_on") & (F.col("run") == 0))
    last = F.col("last") & ~(F.col("stays") & (F.col("run") == F.col("runs") - 1))
    row = ordered.join(parts, "part").select("uid", "host", "path", "lines", "inside", "article", (F.col("run") + F.col("b")).alias("g"), first.alias("first"), last.alias("last"))

    def beside(end: str, step: int, prefix: str) -> DataFrame:
        return row.where(end).select((F.col("g") + step).alias("g"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("host", "path", "lines")])

    both = row.join(beside("last", 1, "a"), "g", "left").join(beside("first", -1, "b"), "g", "left")

    def start(other: str):  # length of the common start of two paths, -1 on another host
        k = F.least(F.length("path"), F.length(other))
        same = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, i: F.when(s["on"] & (i <= k) & (F.substring(F.col("path"), i, F.lit(1)) == F.substring(F.col(other), i, F.lit(1))), F.struct(F.lit(True).alias("on"), i.alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), s["n"].alias("n"))))
        return F.when(F.col(other.replace("path", "host")) == F.col("host"), same["n"]).otherwise(-1)

    a, b = start("a_path"), start("b_path")
    return both.select("uid", "host", "lines", "inside", "article", F.when((a >= b) & (a >= 0), F.col("a_lines")).when(b >= 0, F.col("b_lines")).alias("near"))


def differences(pages: DataFrame) -> DataFrame:
    """uid, the places of the lines that a page shares with its nearest one (gone), and the hashes of those in its article that are the
    host's template (template, null if none), of the pages that have a neighbour. pages: uid, url, html."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, shared, votes = [], [], []
            for own, inside, article, near in zip(*(batch.column(c).to_pylist() for c in ("lines", "inside", "article", "near"))):
                at = [i for i, both in enumerate(common_subsequence(own, near)) if both]
                gone.append(at)
                shared.append(sorted({own[i] for i in at if inside[i]}))
                votes.append(article if 2 * sum(inside[i] for i in at) < sum(inside) else None)  # else a reprint
            columns = [pa.array(gone, pa.list_(pa.int32())), pa.array(shared, pa.list_(pa.int64())), pa.array(votes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("host"), *columns], names=["uid", "host", "gone", "shared", "article"])

    steps = Steps(pages.sparkSession)
    near = neighbours(pages, steps).where("near IS NOT NULL")
    done = steps.write(near.mapInArrow(aligned, "uid binary, host string, gone array<int>, shared array<bigint>, article bigint"), "page-shared")
    steps.drop("page-lines", "page-order")
    votes = done.where("article IS NOT NULL")
    articles = votes.groupBy("host").agg(F.countDistinct("article").alias("n"))
    lines = votes.select("host", "article", F.explode("shared").alias("line")).groupBy("host", "line").agg(F.countDistinct("article").alias("k"))
    template = lines.where(F.col("k") >= TEMPLATE_ARTICLES).join(articles, "host").where("2 * k > n").select("host", "line")
    own = done.select("uid", "host", F.explode("shared").alias("line")).join(template, ["host", "line"]).groupBy("uid").agg(F.collect_list("line").alias("template"))
    return done.select("uid", "gone").join(own, "uid", "left")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every row."""
    prepare(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("d"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = own.withColumn("uid", F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))))))
    found = differences(own.select("uid", "url", "html")).withColumnRenamed("uid", "n_uid")
    joined = packed(own, "html").join(found, F.col("uid") == F.col("n_uid"), "left").select("d", "url", "z", "gone", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, gone, template in zip(*(batch.column(c).to_pylist() for c in ("z", "gone", "template"))):
                lines, gone = blocks(unpacked(page).decode()), set(gone or ())
                if template:
                    hashes, template = _hashes(lines), set(template)
                    kept = article_lines([x for i, x in enumerate(lines) if i not in gone or hashes[i] not in template])
                else:
                    kept = article_lines(lines)
                if kept is None:
                    kept = [t for i, (t, _, outside) in enumerate(lines) if not outside and i not in gone]
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("url"), pa.array(texts, pa.string())], names=["d", "url", "text"])

    return joined.mapInArrow(run, f"d {kind}, url string, text string").select(F.col("d").alias(id_col), F.col("url").alias(url_col), "text")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
