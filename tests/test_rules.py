import json

import pytest
from pyspark.sql import functions as F

from sitegrain.operators import probes as P
from sitegrain.operators import rules as R
from sitegrain.operators import scoring as C

URL = "https://acme.test/"
GOOD = """<html lang=en><head><title>A title of a good length</title>
<meta name=description content="{d}"><meta name=viewport content=w>
<meta property=og:title content=a><meta property=og:description content=b><meta property=og:image content=c>
<meta name=twitter:card content=summary><link rel=canonical href=/>
<script type="application/ld+json">{{"@type":"Organization"}}</script></head><body>
<h1>Top</h1><h2>Sub</h2><p>{p}</p><img src=a.webp alt="A red gear" width=1 height=1>
<a href=/x>All our products</a></body></html>""".format(d="d" * 80, p="copy " * 80)


def audit(spark, *htmls, url=URL, status=200, ctype="text/html"):
    rows = [(i, url, status, ctype, h) for i, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, status int, content_type string, html string")
    out = C.audit_markup(df).withColumn("score", C.overall(F.col("packs")))
    return out.withColumn("f", C.sorted_findings(C.all_findings(F.col("packs")))).orderBy("page_id").collect()


def test_good_page_has_no_findings(spark):
    (r,) = audit(spark, GOOD)
    assert r.f == []
    assert r.score == 100.0
    assert [p.module for p in r.packs] == ["seo", "images"]


def test_bad_page(spark):
    html = f"""<html><head><title>Hm</title><meta name=robots content="noindex,nofollow"></head><body>
<h2>S</h2><h5>D</h5><h2></h2><img src=1.png><img src=2.png alt=image><img src=3.png alt="">
<img src=4.png alt="{'z' * 150}"><img src=1.png><a href=/x>click here</a><a href="http://x.example/y">Read more.</a></body></html>"""
    (r,) = audit(spark, html)
    assert {p.module: p.score for p in r.packs} == {"seo": 0.0, "images": 62.0}
    assert r.score == 31.0
    assert len(r.f) == 24
    assert [f.severity for f in r.f][0] == "critical"
    vague = next(f for f in r.f if f.rule == "seo.non-descriptive-link-text")
    assert vague["items"] == 2


def test_short_circuit(spark):
    (r,) = audit(spark, GOOD, status=404)
    assert [(f.rule, r.score) for f in r.f] == [("http.error-status", 0.0)]
    (r,) = audit(spark, GOOD, ctype="application/pdf")
    assert [f.rule for f in r.f] == ["http.not-html"]
    assert r.score == 0.0
    (r,) = audit(spark, GOOD, status=500, ctype="application/pdf")
    assert [f.rule for f in r.f] == ["http.error-status"]


def _title(n):
    return GOOD.replace("A title of a good length", "t" * n)


def _desc(n):
    return GOOD.replace("d" * 80, "d" * n)


BOUNDARIES = {
    "seo.missing-title": (_title(0), _title(15)),
    "seo.title-too-short": (_title(14), _title(15)),
    "seo.title-too-long": (_title(61), _title(60)),
    "seo.missing-meta-description": (GOOD.replace("name=description", "name=other"), GOOD),
    "seo.empty-meta-description": (_desc(0), _desc(1)),
    "seo.meta-description-too-short": (_desc(49), _desc(50)),
    "seo.meta-description-too-long": (_desc(161), _desc(160)),
    "seo.noindex": (GOOD.replace("</head>", "<meta name=ROBOTS content=NOINDEX></head>"), GOOD.replace("</head>", "<meta name=googlebot content=noindex></head>")),
    "seo.nofollow-page": (GOOD.replace("</head>", "<meta name=robots content=nofollow></head>"), GOOD),
    "seo.missing-canonical": (GOOD.replace("rel=canonical", "rel=icon"), GOOD),
    "seo.missing-h1": (GOOD.replace("h1", "h2"), GOOD),
    "seo.multiple-h1": (GOOD.replace("h2", "h1"), GOOD),
    "seo.heading-level-skip": (GOOD.replace("h2", "h3"), GOOD.replace("<h2>", "<h2>a</h2><h1>b</h1><h2>")),
    "seo.empty-heading": (GOOD.replace("Sub", " &nbsp;"), GOOD),
    "seo.missing-lang": (GOOD.replace("lang=en", "lang"), GOOD),
    "seo.missing-viewport": (GOOD.replace("content=w", "content"), GOOD),
    "seo.missing-open-graph": (GOOD.replace("og:image", "og:x"), GOOD),
    "seo.missing-twitter-card": (GOOD.replace("twitter:card", "t"), GOOD.replace("name=twitter", "property=twitter")),
    "seo.no-structured-data": (GOOD.replace("ld+json", "json"), GOOD),
    "seo.thin-content": (GOOD.replace("copy " * 80, ""), GOOD),
    "seo.non-descriptive-link-text": (GOOD.replace("All our products", " HERE!. "), GOOD),
    "image.missing-alt": (GOOD.replace('alt="A red gear"', "alt"), GOOD.replace('alt="A red gear"', 'alt=""')),
    "image.empty-alt": (GOOD.replace("A red gear", ""), GOOD.replace("A red gear", " ")),
    "image.generic-alt": (GOOD.replace("A red gear", " Logo "), GOOD),
    "image.alt-too-long": (GOOD.replace("A red gear", "x" * 126), GOOD.replace("A red gear", "x" * 125)),
    "image.missing-src": (GOOD.replace("src=a.webp", "src"), GOOD.replace("src=a.webp", "data-src=a.webp")),
    "image.no-dimensions": (GOOD.replace("height=1", ""), GOOD),
    "image.legacy-format": (GOOD.replace("a.webp", "a.JPG?x"), GOOD.replace("a.webp", "a.png srcset=b")),
    "image.no-lazy-loading": (GOOD.replace("<a ", "<img src=b.webp><img src=c.webp><a "), GOOD.replace("<a ", "<img src=b.webp><img src=c.webp loading=LAZY><a ")),
    "image.duplicate-src": (GOOD.replace("<a ", "<img src=/a.webp><a "), GOOD.replace("<a ", "<img><img><a ")),
    "link.mixed-content-image": (GOOD.replace("a.webp", "http://x.test/a.webp"), GOOD),
    "link.insecure-http": (GOOD.replace("href=/x", "href=http://x.test/"), GOOD.replace("href=/x", "href=//x.test/")),
}


@pytest.fixture(scope="module")
def boundary_hits(spark):
    rows = [(2 * i + j, URL, h) for i, pair in enumerate(BOUNDARIES.values()) for j, h in enumerate(pair)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = R.finding_rows(R.evaluated(df, {"found": list(BOUNDARIES)}), "found")
    return {(r.page_id, r.rule) for r in found.select("page_id", "rule").collect()}


@pytest.mark.parametrize("rule", BOUNDARIES)
def test_rule_boundary(boundary_hits, rule):
    i = list(BOUNDARIES).index(rule)
    assert (2 * i, rule) in boundary_hits
    assert (2 * i + 1, rule) not in boundary_hits


def test_all_rules_present():
    assert {m: len(r) for m, r in R.PACKS.items()} == {"seo": 21, "images": 9, "links": 4, "assets": 2, "http": 2}


@pytest.mark.parametrize(("limit", "kept", "left", "silent"), [(None, 45, 0, 42), (40, 40, 5, 37)])
def test_links_are_distinct_capped_and_counted(spark, limit, kept, left, silent):
    html = "".join(f"<a href=/{i % 45}>t{i}</a>" for i in range(90)) + "<a href=ftp://x>f</a>"
    df = spark.createDataFrame([(1, URL, html), (2, URL, "none")], "page_id bigint, url string, html string")
    from sitegrain.operators.extract import extract

    status = spark.createDataFrame([(URL + "0", 404), (URL + "1", 500), (URL + "2", 200)], "url string, status int")
    rows = P.probe_findings(P.checked_links(extract(df, ["links"]), status, limit), P.LINK_PROBE_RULES)
    one, two = rows.orderBy("page_id").collect()
    assert (len(one.found), one.not_checked) == (kept, left)
    broken = [f for f in one.probe_findings if f.rule == "link.broken"]
    assert [(f.severity, f.element, f.detail) for f in broken] == [
        ("medium", URL + "1", "t46"), ("high", URL + "0", "t45"),
    ]
    found = next(f for f in one.probe_findings if f.rule == "link.unreachable")
    assert found["items"] == silent
    assert json.loads(found.meta["urls"]) == [URL + str(i) for i in range(3, 3 + silent)]
    assert (two.found, two.probe_findings, two.not_checked) == ([], [], 0)


def test_asset_limit_is_exclusive(spark):
    from sitegrain.operators.extract import extract

    html = "<img src=/1><img src=/2><img src=/3><img src=/2><img>"
    df = spark.createDataFrame([(1, URL, html)], "page_id bigint, url string, html string")
    sizes = spark.createDataFrame(
        [(URL + "1", 2621440, "", None, False), (URL + "2", 2621441, "", None, True), (URL + "3", None, "", "HTTP 404", False)],
        "src string, byte_size bigint, content_type string, error string, at_least boolean",
    )
    probed = P.probe_findings(P.measured_assets(extract(df, ["images"]), sizes), P.ASSET_RULES)
    (r,) = probed.collect()
    assert [(f.rule, f.element) for f in r.probe_findings] == [("image.oversized", ">2.50 MB"), ("image.unreachable", "")]
    assert [(x.src, x.heaviest) for x in P.asset_report(probed).orderBy("rank").collect()] == [
        (URL + "2", True), (URL + "1", False), (URL + "3", False),
    ]
