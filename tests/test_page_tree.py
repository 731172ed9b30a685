"""Elements by a stack against trees that are built first and written as markup, and literals for markup left open."""

import random

from provena.operators import page_tree
from pyspark.sql import functions as F


def build(rng, depth):
    """(markup, text) of a random tree, and what it should give: (tag, text words, inner markup) by start tag."""
    parts, words, found = [], [], []
    for _ in range(rng.randrange(1, 4)):
        if depth and rng.random() < 0.7:
            tag, k = rng.choice(["div", "span", "section", "b"]), len(found)
            found.append(None)
            markup, inner, below = build(rng, depth - 1)
            found[k] = (tag, " ".join(inner), markup)
            found += below
            parts.append(f'<{tag} class="x {tag}">{markup}</{tag}>')
            words += inner
        else:
            w = rng.choice(["ä", "𝒳y", "one", "two\nthree"])
            parts.append(f" {w} ")
            words += w.split()
    return "".join(parts), words, found


def test_nested_trees(spark):
    cases = [build(random.Random(k), 5) for k in range(60)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, html string").withColumn("t", page_tree.tree(F.col("html")))
    e = F.transform("t.elements", lambda x: F.struct(x["tag"], page_tree.text(F.col("t"), x), page_tree.inner(F.col("html"), x)))
    for r in df.select("k", e.alias("e"), "t").collect():
        assert [tuple(x) for x in r["e"]] == cases[r["k"]][2]
        assert all(x["parent"] < i <= x["last"] and (x["parent"] < 0 or r["t"]["elements"][x["parent"]]["last"] >= x["last"]) for i, x in enumerate(r["t"]["elements"]))


def shape(spark, page):
    t = spark.createDataFrame([(page,)], "html string").withColumn("t", page_tree.tree(F.col("html")))
    return [tuple(x) for x in t.select(F.transform("t.elements", lambda x: F.struct(x["tag"], x["parent"], page_tree.text(F.col("t"), x))).alias("e")).first()["e"]]


def test_open_and_stray_tags(spark):
    assert shape(spark, "<div><div>a</div>b</div>") == [("div", -1, "a b"), ("div", 0, "a")]
    assert shape(spark, "<p>a<p>b<div>c</p>d") == [("p", -1, "a"), ("p", -1, "b"), ("div", -1, "c d")]
    assert shape(spark, "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e") == [("ul", -1, "a b c d"), ("li", 0, "a b c"), ("ul", 1, "b c"), ("li", 2, "b"), ("li", 2, "c"), ("li", 0, "d")]
    assert shape(spark, "<table><tr><td>1<td>2<tr><th>3</table>") == [("table", -1, "1 2 3"), ("tr", 0, "1 2"), ("td", 1, "1"), ("td", 1, "2"), ("tr", 0, "3"), ("th", 4, "3")]
    assert shape(spark, "</b><b>x<br/>y<script>if (a<b) '</p>'</script><!-- <i>n</i> -->&amp;z") == [("b", -1, "x y &z"), ("br", 0, ""), ("script", 0, "")]
    assert shape(spark, None) == shape(spark, "") == [] and shape(spark, "<i") == []
    assert len(shape(spark, "<div>" * 20000 + "</p>" * 20000)) == 20000


def test_fields(spark):
    page = '<nav><a href="/x">X</a></nav><ol class="a breadcrumb"><li><a href="/">H</a><li><a>none</a><li><a href="/b"><b>B</b>1</a></ol><p>x <span class="c2">m <span class="c2">n</span></span> <a href="/narrator/5"><i>P</i></a><p>y<dl><dt>Name:<dd><div>N<div>M</div></div><dt>Name<dd>O</dl><table><tr><th>Age<td>7</table>'
    df = spark.createDataFrame([(page,), (None,), ("<nav><a href='/x'>X</a></nav><dt>only",)], "html string").withColumn("t", page_tree.tree(F.col("html")))
    t = F.col("t")
    a, b, c = df.select(page_tree.breadcrumbs(t).alias("b"), page_tree.text_blocks(t).alias("p"), page_tree.labelled_fields(t).alias("f")).collect()
    assert [tuple(x) for x in a["b"]] == [("/", "H"), ("/b", "B 1")] and a["f"] == {"Name": "N M", "Age": "7"}
    assert [(x["full_text"], x["matn"], [tuple(n) for n in x["narrators"]]) for x in a["p"]] == [("x m n P", "m n n", [("5", "P", "/narrator/5")]), ("y", "", [])]
    assert (b["b"], b["p"], b["f"]) == ([], [], {}) and [tuple(x) for x in c["b"]] == [("/x", "X")] and c["f"] == {}
