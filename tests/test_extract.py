import random

import pytest
from pyspark.sql import functions as F

from brute import outline, walk
from conftest import SF
from sitegrain.operators.extract import extract
from sitegrain.operators.outline import structure_outline
from sitegrain.operators.tokens import tokens
from sitegrain.sources.fixtures import pages_aug


def texts(rows, field="text"):
    return [r[field] for r in rows]


def test_awkward_page(page):
    html = """<!DOCTYPE html>
<html lang="en-GB"><head><title>  Nuts &amp;
 Bolts </title><meta name="Description" content="Say &quot;hi&quot;.">
<link rel="x canonical" href="/home"><style>h1 { color: red }</style>
<script type="application/ld+json"> {"@type":"Thing","n":"<h1>"} </script></head><body>
<h1>Big <em>news</em></h1><h2><a href="/p">Parts</a></h2><h4/>
<img src="a.png" alt="x > y"><img src=b.webp alt><noscript>gone <img src=n.gif></noscript>
<picture><source srcset="d.avif"><img data-src="d.png" alt=""></picture>
<p>one<p>two <a href="https://e.example/x?">Ext</a> 1 < 2<div>three</div>
<a href="#s">skip</a><a href=/about rel=nofollow>About <b>us</b></a>
<script>var x = "<h1>no</h1>";</script></body></html>"""
    (r,) = page(html, url="https://acme.test/dir/page?q=1#f")
    assert r.title == "Nuts & Bolts"
    assert r.lang == "en-GB"
    assert (r.canonical.raw, r.canonical.resolved) == ("/home", "https://acme.test/home")
    assert [(h.level, h.text) for h in r.headings] == [(1, "Big news"), (2, "Parts"), (4, "")]
    assert [(b.tag, b.text) for b in r.blocks] == [
        ("h1", "Big news"), ("h2", "Parts"), ("p", "one"), ("p", "two Ext 1 < 2"),
    ]
    assert [m.src.rsplit("/", 1)[-1] for m in r.images] == ["a.png", "b.webp", "n.gif", "d.png"]
    assert [m.alt for m in r.images] == ["x > y", None, None, ""]
    assert [a.href for a in r.links] == ["https://acme.test/p", "https://e.example/x", "https://acme.test/about"]
    assert texts(r.links) == ["Parts", "Ext", "About us"]
    assert r.jsonld == ['{"@type":"Thing","n":"<h1>"}']
    assert r.picture_sources == ["d.avif"]
    assert r.headings[0].line == 6


@pytest.mark.parametrize(
    "html, headings, blocks",
    [
        ("", [], []),
        ("only text", [], []),
        ("<h1>a</h2></div></h1>", ["a"], ["a"]),
        ("<h1>open", [], []),
        ("<p>open", [], ["open"]),
        # The heading is replaced by the paragraph inside it.
        ("<h1>a<p>b</p></h1>", [], ["b"]),
        # An end tag pairs with the next of its kind, although a link is open.
        ("<h1>x <a href='/y'>z</h1>", ["x z"], ["x z"]),
        ("<h2></h2><h3> &nbsp; </h3>", ["", ""], []),
        ("<template><h2>t</h2></template>", [""], []),
    ],
)
def test_blocks(page, html, headings, blocks):
    (r,) = page(html, parts=["headings", "blocks"])
    assert texts(r.headings) == headings
    assert texts(r.blocks) == blocks


def test_links_nested_and_unclosed(page):
    (r,) = page("<a href=/1>a<a href=/2>b</a></a><a href=/3>c", parts=["links"])
    assert [(a.href, a.text) for a in r.links] == [("https://acme.test/2", "b")]


def test_character_references(page):
    (r,) = page("<title>&lt;&#65;&#x42;&#128;&#0;&#xD800;&copy;&copyx&notit;&eacute;&CounterClockwiseContourIntegral;&am&</title>", parts=["title"])
    assert r.title == "<AB€��©©x¬it;é∳&am&"


def test_last_attribute_and_title_win(page):
    (r,) = page("<title>a</title><svg><title>b</title></svg><img alt=1 alt=2>", parts=["title", "images"])
    assert r.title == "b"
    assert r.images[0].alt == "2"


def test_quoted_attributes_without_end(page):
    many = " ".join(f'a{i}="<{i}>"' for i in range(2000))
    (r,) = page(f"<div {many}><p>after</p>", parts=["blocks"])
    assert texts(r.blocks)[-1].endswith("after")


def test_as_the_standard_parser_reads_it(spark):
    """Visible characters and outline of every page, against a plain walk."""
    pages = pages_aug(spark, SF).select("page_id", "url", "html")
    got = structure_outline(extract(pages, ["text_length", "nodes"]), 40, 4).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(html) == 50
    for r in got:
        w = walk(html[r.page_id])
        assert r.text_length == w.chars
        assert [(n.parent, n.depth, n.tag, n.line) for n in r.nodes] == w.nodes
        kept, deep, many = outline(w.nodes, 40, 4)
        assert [n.ord for n in r.outline.rows] == kept
        assert (r.outline.truncated_by_depth, r.outline.truncated_by_count) == (deep, many)
        assert len(kept) + deep + many == r.outline.total_nodes


def test_outline_on_broken_markup(spark):
    rnd = random.Random(7)
    tags = ["div", "p", "ul", "li", "h2", "section", "img", "b", "table", "hr"]
    htmls = []
    for _ in range(60):
        picks = [rnd.choice(tags) for _ in range(rnd.randint(0, 40))]
        htmls.append("".join(f"<{'/' if rnd.random() < 0.4 else ''}{t}>" for t in picks))
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string").withColumn("url", F.lit("https://a.test/"))
    for cap, depth in ((400, 8), (5, 2)):
        for r in structure_outline(extract(df, ["nodes"]), cap, depth).collect():
            w = walk(htmls[r.page_id])
            assert [(n.parent, n.depth, n.tag) for n in r.nodes] == [n[:3] for n in w.nodes], htmls[r.page_id]
            parents = [0, *(n.parent for n in r.nodes)]
            for n in r.nodes:  # intervals hold exactly the descendants
                above = lambda k: {k} | (above(parents[k]) if k else set())
                inside = [m.ord for m in r.nodes if n.ord in above(m.ord)]
                assert inside == list(range(n.ord, n.last + 1)) and n.children == parents.count(n.ord) - (n.ord == 0)
            kept, deep, many = outline(w.nodes, cap, depth)
            assert [n.ord for n in r.outline.rows] == kept
            assert (r.outline.truncated_by_depth, r.outline.truncated_by_count) == (deep, many)


def test_tokens_lose_nothing(spark):
    pages = pages_aug(spark, SF)
    joined = (
        tokens(pages).groupBy("page_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "").alias("back"))
    )
    assert joined.join(pages, "page_id").filter("back <> html").count() == 0
    assert joined.count() == pages.count()


def test_tokens_as_the_plain_pattern_gives_them(spark):
    """The marks that carry lines and stop hopeless searches change no token."""
    import re

    from sitegrain.operators.tokens import token_pattern

    rnd = random.Random(11)
    bits = [
        "<!--", "-->", "<script>", "</script >", "<style a='", "</STYLE>", "<", ">", '"', "'", "\n", "text ", "<p>",
        "</p>", "<a href=x", "<!doctype>", "/>", "\x01", "\x05a", "\x02\x04", "\x03e\x05", "<?x", "--", "&amp;",
    ]
    htmls = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string")
    got = {}
    for r in tokens(df).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.token, r.line))
    pattern = re.compile(token_pattern())
    for i, html in enumerate(htmls):
        want = [(m.group(), html.count("\n", 0, m.start()) + 1) for m in pattern.finditer(html)]
        assert [t for t, _ in got.get(i, [])] == [t for t, _ in want], html
        for (t, line), (_, at) in zip(got.get(i, []), want):
            assert line == (at if t.startswith("<") else None)


def test_large_broken_pages_finish(page):
    """Each of these was quadratic in an earlier form."""
    many = 3000
    rows = page(
        "<script>" * many + "<!--" * many,
        "<noscript>a</noscript>" * many + "<h1>b</h1>",
        "<a <b " * many,
        "<div><p>x" * many,
        parts=["text_length", "headings", "blocks", "nodes"],
    )
    assert [h.text for h in rows[1].headings] == ["b"]
    assert rows[1].text_length == 1
    assert len(rows[3].nodes) == 2 * many


def test_extraction_is_one_narrow_stage(spark):
    """No shuffle, no Python, and only the columns that are read."""
    plan = extract(spark.read.parquet(f"{SF}/pages.parquet"), ["title", "links"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_outline_rows_carry_no_node_array(spark):
    from sitegrain.plans.q_audit import _outlined
    from sitegrain.operators.outline import outline_rows

    plan = outline_rows(_outlined(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Generate")[1]  # what is exploded into outline rows
    assert "nodes#" not in top and "nodes#" not in plan.split("Generate")[0]


def test_a_pages_own_control_characters_stay(spark):
    html = "<html lang='\x01'><title>\x01a\x02 \x05b \x05\x03\x04</title><p>x\x05e&amp;\x01</p><a href='/\x04'>\x02</a><!-- \x01 -->"
    df = spark.createDataFrame([(1, "https://a.test/", html)], "page_id bigint, url string, html string")
    assert "".join(r.token for r in tokens(df).orderBy("pos").collect()) == html
    r = extract(df, ["title", "lang", "blocks", "links"]).first()
    assert (r.title, r.lang, r.blocks[0].text, r.links[0].text, r.links[0].href) == ("\x01a\x02 \x05b \x05\x03\x04", "\x01", "x\x05e&\x01", "\x02", "https://a.test/\x04")


def test_every_reference_decodes_like_the_standard_library(spark):
    from html import unescape as plain
    from html.entities import html5

    from sitegrain.functions.text import unescape

    texts = [f"a&{n}b" for n in html5] + [f"&{n}x;" for n in html5] + [f"&{n[:-1]}" for n in html5] + ["&", "&&amp;", "&nope;", "&notit;", "&" + "a" * 40 + ";"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.u for r in df.select("t", unescape(F.col("t")).alias("u")).collect()}
    assert [(t, got[t], plain(t)) for t in texts if got[t] != plain(t)] == []


def test_a_rare_reference_costs_no_more_than_a_common_one(spark):
    import time

    from sitegrain.functions.text import unescape

    def seconds(reference):
        df = spark.createDataFrame([(reference * 4000,)] * 16, "t string").repartition(4)
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            df.select(F.length(unescape(F.col("t")))).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    common, rare = seconds("&quot; "), seconds("&zwnj; ")
    assert rare < 3 * common + 0.3  # a search of the whole table took over 20 times as long
