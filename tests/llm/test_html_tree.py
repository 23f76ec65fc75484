"""Main text of pages: the given pages, and layouts that they lack."""

import html
import re

import pytest
from pyspark.sql import functions as F

from stateweave.llm import html_tree as h

FOLDER = "/root/testdata/sf0.001"
P = "The quick brown fox jumps over the lazy dog and goes home to sleep in the forest."


@pytest.fixture(scope="module")
def potentials(spark):
    return h.fit(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_given_pages(spark, potentials):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").withColumn("text", F.lit("clash"))
    for r in h.extract(pages, potentials).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{P}</p><div class='notice'><p>{P}</p></div><p>{P}</p><aside><p>{P}</p></aside><form><label>Mail</label></form><section class=comments><h2>C</h2><p>{P}</p><p>{P}</p></section></article><footer><p>{P}</p></footer>", f"T\n{P}\n{P}"),
        (f"<div id=menu><a href=x>Home</a></div><div class=content><h1>T</h1><p>{P}</p><ul><li>one<li>two</ul><p>x</p></div><div class='reader-comments'><p>{P}</p></div>", f"T\n{P}\none\ntwo\nx"),
        ("<article><p>a<b>b</b> c&nbsp; d<br>e &lt;&amp;</article>", "ab c d e <&"),
        ("<article><p>x<script>var a='</p>';</script>y<style>p{}</style><!-- no --></p><p>z <a hre", "xy\nz"),
        ("plain text only", "plain text only"),
        # A form, a layout class, a category or an anchor that shares a word with boilerplate.
        (f"<body><form id=aspnetForm><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{P}</p></article><footer>f</footer></form>", f"T\n{P}"),
        (f"<body><form id=aspnetForm><nav><a href=x>Home</a></nav><h1>How the fox got home</h1><p>{P}</p><p>{P}</p></form>", f"How the fox got home\n{P}\n{P}"),
        (f"<body><h1>How the fox got home</h1>" + f"<p>{P}</p>" * 30, "\n".join(["How the fox got home"] + [P] * 30)),
        (f"<body><div class='has-sidebar'><article><h1>T</h1><p>{P}</p></article><div class=sidebar><p>s</p></div></div>", f"T\n{P}"),
        (f"<body><div class='sidebar layout'><article><h1>T</h1><p>{P}</p></article><div class=sidebar><p>s</p></div></div>", f"T\n{P}"),
        (f"<body><article class='post tag-search'><h1>T</h1><p>{P}</p></article><div class=related><article><p>{P[:20]}</p></article></div>", f"T\n{P}"),
        (f"<article><p>{P}</p><h2 id='discussion'>D</h2><p id='social-history'>{P}</p><section id='related-work'><h2>R</h2><p>{P}</p></section></article>", f"{P}\nD\n{P}\nR\n{P}"),
        (f"<article><p>{P}</p><section aria-label='Search trees'><p>{P}</p></section><p class=advert>buy</p></article>", f"{P}\n{P}"),
        # Comments: as articles of their own, and headed but unnamed.
        (f"<article><h1>T</h1><p>{P}</p><ol><li><article class=comment><p>{P}</p><p>{P}</p></article></ol></article>", f"T\n{P}"),
        (f"<article><h1>T</h1><p>{P}</p>" + f"<section><h2>3 <b>Comments</b></h2>{f'<p>{P}</p>' * 30}</section></article>", f"T\n{P}"),
        (None, ""),
        ("", ""),
        ("<nav><a href=x>only</a></nav>", ""),
    ],
)
def test_layouts(potentials, page, text):
    assert h.main_text(page or "", potentials) == text


@pytest.mark.parametrize("tag", ["button", "select", "svg", "canvas", "object", "template", "noscript"])
def test_controls_end_at_their_own_end_tag(potentials, tag):
    closed = f"<{tag}>c</{tag}>"
    for before, inside in ((f"<{tag}>", ""), ("", f"<{tag}>"), (closed, closed), (f"<{tag}>", closed), (f"<{tag}><script>'</{tag}>'</script>", "")):
        assert h.main_text(f"<body>{before}<article><p>{P}</p>{inside}<p>{P}</p></article></body>", potentials) == f"{P}\n{P}"
    assert h.main_text(f"<article><p>x<{tag}>a<{tag}>b</{tag}>c</{tag}>y</p></article>", potentials) == "xy"


def test_math_is_text(potentials):
    assert h.main_text("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p></article>", potentials) == "if x=2 then"


def test_messages_equal_enumeration(potentials):
    """Sum-product marginals are those of summing over all labellings of a small tree."""
    import itertools
    import math

    nodes, _ = h.parse("<div><p>some text here</p><ul><li><a href=x>link</a></li></ul></div>")
    own = [h.evidence(n, potentials) for n in nodes]
    total, content = 0.0, [0.0] * len(nodes)
    for states in itertools.product(range(3), repeat=len(nodes)):
        w = sum(own[i][s] for i, s in enumerate(states))
        w += sum(potentials[h._edge(states[n.parent], h.features(n)[0])][states[i]] for i, n in enumerate(nodes) if n.parent >= 0)
        total += math.exp(w)
        for i, s in enumerate(states):
            content[i] += math.exp(w) * (s == h.CONTENT)
    assert h.marginals(nodes, potentials) == pytest.approx([c / total for c in content], abs=1e-9)


def test_deep_and_empty(spark, potentials):
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    df = spark.createDataFrame([(1, deep), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in h.extract(df, potentials).collect()} == {1: "text", 2: ""}
    assert h.extract(df.limit(0), potentials).collect() == []
    assert h.fit(df.limit(0))["parent=0,boiler"]
