import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.columns import staged
from sitegrain.functions.sizes import human_size
from sitegrain.operators import textgen as T
from sitegrain.operators.inventory import existing_types
from sitegrain.operators.suggest import breadcrumbs
from sitegrain.sources.responses import decode_responses, load_responses

BASES = ["https://a.test", "https://a.test/x/y?q=1#f", "http://a.test/x//y/", "https://a.test:8080/é/ü"]
REFS = [
    "", "#z", "?a=b", "?", "b", "./b", "../b", "../../../b", "/b/./c/../d", "b/..", "..", ".", "//c.test/x/../y",
    "http://c.test/a/../b", "HTTPS://C.test/", "mailto:x@y", "b//c///d", "/b//c", "b?x=/../y", "b#", "b?#f", " b", "b\nc", "./", "a/b/../../c/",
]


def test_resolution_like_the_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(rows, "b string, r string")
    df = staged(df, ["b", "r"], urls.base_parts(F.col("b")))
    for row in df.select("b", "r", urls.resolve(F.col("r"), urls.base()).alias("u")).collect():
        assert row.u == urljoin(row.b, row.r), (row.b, row.r)


def test_extension_and_short_name(spark):
    df = spark.createDataFrame([("https://a.test/b/c.tar.GZ?x.y",), ("https://a.test/.png",), ("https://a.test/",), ("https://a.test/" + "n" * 90,)], "u string")
    got = df.select(urls.extension(F.col("u")).alias("e"), urls.short_name(F.col("u")).alias("s")).collect()
    assert [r.e for r in got] == [".gz", "", "", ""]
    assert got[0].s == "c.tar.GZ" and got[2].s == "https://a.test/"
    assert len(got[3].s) == 80 and got[3].s.endswith("…")


def test_sizes_round_halves_to_even(spark):
    df = spark.createDataFrame([(None,), (0,), (1023,), (2560,), (1536,), (2621440,), (1179648,)], "n bigint")
    assert [r.s for r in df.select(human_size(F.col("n")).alias("s")).collect()] == [
        "unknown", "0 B", "1023 B", "2 KB", "2 KB", "2.50 MB", "1.12 MB",
    ]


def test_decoding(spark):
    import gzip
    import zlib

    raw = zlib.compressobj(wbits=-15)
    cases = [
        ("é".encode(), "text/html", None, "é"),
        ("é".encode("cp1252"), "", None, "é"),
        ("é".encode("latin-1"), "text/html; charset=iso-8859-1", None, "é"),
        (b'<meta charset="windows-1251">' + "Ж".encode("cp1251"), "", None, '<meta charset="windows-1251">Ж'),
        (gzip.compress("é".encode()), "", "gzip", "é"),
        (zlib.compress("é".encode()), "", "Deflate", "é"),
        (raw.compress("é".encode()) + raw.flush(), "", "deflate", "é"),
        (b"plain", "", "gzip", "plain"),
        (b"ok", "text/html; charset=no-such", None, "ok"),
        (b"\x81\xff", "text/html; charset=utf-8", None, "��"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(
        [(i, bytearray(b) if b is not None else None, c, e) for i, (b, c, e, _) in enumerate(cases)],
        "page_id bigint, body binary, content_type string, content_encoding string",
    )
    got = {r.page_id: r.html for r in decode_responses(df).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def make(spark, text, kind="auto"):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, content string")
    (r,) = T.generate(df, kind).collect()
    return r, json.loads(r.json_ld) if r.json_ld else {}


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Q one?\nA.\nQ two?\nB.", "FAQPage"),
        ("Tea\n1. Boil\n• Pour", "HowTo"),
        ("Name: W\nPrice: 3", "Product"),
        ("Name: F\nStart: 2026-01-01", "Event"),
        ("Name: S\nZip: 1", "LocalBusiness"),
        ("Title: T\nAuthor: A", "Article"),
        ("word " * 121, "Article"),
        ("word " * 120, "WebPage"),
        ("<h2>A?</h2><p>x</p><h2>B?</h2><p>y</p>", "FAQPage"),
    ],
)
def test_detection(spark, text, kind):
    r, _ = make(spark, text)
    assert r.schema_type == kind
    assert r.notes[0] == f"Detected {kind}."


def test_article(spark):
    r, j = make(spark, "Headline here\nFirst. Second.\nDate: 2026-01-01", "Article")
    assert j == {
        "@context": "https://schema.org", "@type": "Article", "headline": "Headline here", "description": "First.",
        "articleBody": "First. Second.", "datePublished": "2026-01-01",
    }
    assert r.notes == ["No author given."]


def test_html_article_uses_heading_and_title(spark):
    _, j = make(spark, "<h1>Head</h1><p>Body one.</p>", "Article")
    assert (j["headline"], j["articleBody"]) == ("Head", "Body one.")
    _, j = make(spark, "<title>T</title><h1>Head</h1><p>Body one.</p>", "Article")
    assert (j["headline"], j["articleBody"]) == ("T", "Head Body one.")


def test_warnings_leave_no_markup(spark):
    for kind, text in [("FAQPage", "no"), ("HowTo", "no"), ("Event", "Name: x"), ("LocalBusiness", "Name: x"), ("BreadcrumbList", "Home"), ("Organization", "a: b"), ("auto", "  \n"), ("Recipe", "x")]:
        r, j = make(spark, text, kind)
        assert r.warnings and not j, kind


def test_product_offer_and_address_order(spark):
    _, j = make(spark, "Name: W\nPrice: £1,200.50\nStock: In Stock", "Product")
    assert j["offers"] == {"@type": "Offer", "price": "1200.50", "priceCurrency": "GBP", "availability": "https://schema.org/InStock"}
    _, j = make(spark, "Name: S\nAddress: last\nStreet: first\nPhone: 1\nTelephone: 2", "LocalBusiness")
    assert j["address"] == {"@type": "PostalAddress", "streetAddress": "last"}
    assert j["telephone"] == "2"


def test_breadcrumb_trail(spark):
    _, j = make(spark, "Home > Web & Co › X\nURL: https://x.test/", "BreadcrumbList")
    assert [i["item"] for i in j["itemListElement"]] == ["https://x.test/", "https://x.test/web-co", "https://x.test/x"]


def test_breadcrumbs_from_path(spark):
    df = spark.createDataFrame([("https://a.test/our-work/x2y_page.html?q",), ("https://a.test/",)], "u string")
    a, b = (r.b for r in df.select(breadcrumbs(F.col("u")).alias("b")).collect())
    assert [x.name for x in a] == ["Home", "Our Work", "X2Y Page"]
    assert a[2]["item"] == "https://a.test/our-work/x2y_page.html"
    assert b is None


def test_types_at_any_depth(spark):
    df = spark.createDataFrame([(['{"@type":"A","x":[{"y":{"@type":["B","A"]}}],"s":"\\"@type\\": \\"no\\""}', "{bad"],)], "j array<string>")
    assert df.select(existing_types(F.col("j")).alias("t")).first().t == ["A", "B", "(unparseable)"]


def test_types_of_real_json(spark):
    shapes = {
        '{"mainEntity":{"@type":"Thing"},"@type":"WebPage"}': ["WebPage", "Thing"],
        '{"@type":"A"} trailing': ["(unparseable)"],
        '{"@type":"A","@type":"B"}': ["B"],
        '{"x":NaN,"@type":"N"}': ["N"],
        '{"@type":"Caf\\u00e9"}': ["Café"],
        '{"@type":["A",5]}': ["A", "5"],
        '{"@type":NaN}': [],
        '[{"@type":"L"},{"@graph":[{"@type":"G"},{"@type":"L"}]}]': ["L", "G"],
        '{"@type":"\\ud800"}': ["?"],
        "": ["(unparseable)"],
        ' {"@type" :\t["A", true, null, -1.5e3, NaN, {"@type":"In"}] } \n': ["A", "True", "None", "-1.5e3", "nan", "In"],
        '{"x":{"@type":"Old","y":[{"@type":"Older"}]},"y":{"@type":"Y"},"x":{"@type":"New"}}': ["Y", "New"],
        '{"@type":"A","@type":["B","C"],"@type":"D","z":1}': ["D"],
        '{"\\u0040type":"Q\\n\\"R\\""}': ['Q\n"R"'],
        '{"a":"@type","b":{"c":"@type"},"@type":{"@type":"T"}}': ["T"],
        '"@type"': [], "[]": [], "{}": [], "3": [], "-Infinity": [],
        **{bad: ["(unparseable)"] for bad in ('{"a":1,}', "[1,]", '{"a" 1}', "{a:1}", "[1 2]", "01", "1.", "-", '"a', "'a'", "{]", "[}", "}", "[", ",", "nul", '{"a":}', '"\t"', '"\\x"', "[]]", '{"a":1 "b":2}', "+1", "\ufeff{}")},
    }
    df = spark.createDataFrame([(k, [k]) for k in shapes], "k string, j array<string>")
    got = {r.k: r.t for r in df.select("k", existing_types(F.col("j")).alias("t")).collect()}
    assert got == shapes
    assert "Python" not in df.select(existing_types(F.col("j")))._jdf.queryExecution().toString()
    none = spark.createDataFrame([([],), (None,)], "j array<string>")
    assert [r.t for r in none.select(existing_types(F.col("j")).alias("t")).collect()] == [[], None]


def test_types_of_random_json_equal_the_standard_reader(spark):
    import json
    import random

    rng = random.Random(7)

    def value(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            return rng.choice(["s", 'q"\\/\u2028é', 1, -2.5, True, None])
        if kind < 0.6:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        keys = rng.sample(["@type", "a", "b", "@graph", "c"], rng.randint(0, 4))
        return {k: rng.choice(["T1", "T2", ["T3", "T4"], "T5"]) if k == "@type" and rng.random() < 0.8 else value(depth + 1) for k in keys}

    def types(v):
        if isinstance(v, list):
            return [t for x in v for t in types(x)]
        if not isinstance(v, dict):
            return []
        own = v.get("@type")
        own = [own] if isinstance(own, str) else [str(x) for x in own if not isinstance(x, list | dict)] if isinstance(own, list) else []
        return own + [t for x in v.values() for t in types(x)]

    texts = [json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(300)]
    broken = [t[: rng.randint(0, len(t))] + rng.choice(["", ",", "}", '"', "x"]) + t[rng.randint(0, len(t)) :] for t in texts]

    def expected(t):
        try:
            return list(dict.fromkeys(types(json.loads(t))))
        except ValueError:
            return ["(unparseable)"]

    rows = texts + broken
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(rows)], "i long, j array<string>")
    got = {r.i: r.t for r in df.select("i", existing_types(F.col("j")).alias("t")).collect()}
    assert [(t, got[i]) for i, t in enumerate(rows) if got[i] != expected(t)] == []


def test_headers_in_any_case(spark):
    df = spark.sql("SELECT map('Content-Type', 'Text/HTML', 'X-Robots-Tag', 'none', 'content-TYPE', 'text/html; charset=x') AS headers")
    r = load_responses(df).first()
    assert (r.content_type, r.x_robots_tag, r.is_html) == ("text/html; charset=x", "none", True)
    assert sorted(r.headers) == ["content-type", "x-robots-tag"]


def test_references_resolve_like_the_standard_join(spark):
    import random
    from urllib.parse import urljoin

    rng = random.Random(11)
    bits = ["a", "b.html", ";", ";p=1", "/", "//", "///", "..", ".", "../", "./", "?", "?q=1", "#", "#f", "=", "é", "http:", "HTTPS:", "mailto:", "//h.test", "https://o.test", " ", "\t", ":", "1"]
    refs = ["", " ", "a;", "///a", "..;#;", "#//b=1#", "?", "#", ";", "/.//b", "/a//.", "../../..", "//", "?#", "a?b?c#d#e", "/;x", "http:;"]
    refs += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    bases = ["https://x.test", "https://x.test/", "http://x.test/a/b;p/c;q?r=1#s", "https://x.test/a//b/?", "https://x.test:8/d/e.html"]
    rows = [(b, r) for r in refs for b in [rng.choice(bases)]] + [(b, r) for b in bases for r in refs[:17]]
    df = staged(spark.createDataFrame(rows, "b string, r string"), ["b", "r"], urls.base_parts(F.col("b")))
    got = df.select("b", "r", urls.resolve(F.col("r"), urls.base()).alias("u")).collect()
    assert [(x.b, x.r, x.u, urljoin(x.b, x.r)) for x in got if x.u != urljoin(x.b, x.r)] == []
