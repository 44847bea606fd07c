"""Input tables derived from the given ones, in SQL both engines read alike.

``pages`` holds no images, canonicals, descriptions, status codes or headers,
so rules over them would be tested on nothing.  ``PAGES_AUG`` adds them by
``page_id % k`` with plain concat / replace / CASE; every page is kept whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitegrain.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_HEAD = """concat(
 CASE page_id % 5
  WHEN 0 THEN ''
  WHEN 1 THEN '<meta name="description" content="">'
  WHEN 2 THEN '<meta name="Description" content="Short page summary.">'
  WHEN 3 THEN concat('<meta name="description" content="', repeat('Useful words &amp; more ', 5), '">')
  ELSE concat('<meta content="', repeat('Useful words &amp; more ', 10), '" name=description>') END,
 CASE page_id % 6
  WHEN 1 THEN '<meta name="robots" content="noindex">'
  WHEN 2 THEN '<meta name="robots" content="nofollow">'
  WHEN 3 THEN '<meta name="robots" content="none">'
  WHEN 4 THEN '<meta name="ROBOTS" content="NOINDEX, nofollow">'
  ELSE '' END,
 CASE WHEN page_id % 10 = 7 THEN '<meta name="googlebot" content="noindex , noarchive">' ELSE '' END,
 CASE WHEN page_id % 8 = 0 THEN '<meta name="viewport" content="">'
  WHEN page_id % 4 = 0 THEN ''
  ELSE '<meta name="viewport" content="width=device-width"/>' END,
 CASE page_id % 3
  WHEN 0 THEN ''
  WHEN 1 THEN '<meta property="og:title" content="T"><meta property="og:description" content="D &quot;q&quot;"><meta property="og:image" content="https://cdn.example.com/og.png">'
  ELSE '<meta property="og:title" content="T"><meta property="og:image" content="">' END,
 CASE WHEN page_id % 9 = 1 THEN '<meta property="og:site_name" content="The Site">' ELSE '' END,
 CASE page_id % 4
  WHEN 1 THEN '<meta name="twitter:card" content="summary">'
  WHEN 2 THEN '<meta property="twitter:card" content="summary">'
  ELSE '' END,
 CASE page_id % 6
  WHEN 1 THEN concat('<link rel="canonical" href="', url, '">')
  WHEN 2 THEN '<link rel="canonical" href="https://other.example.com/a"><link rel="icon" href="/i.ico">'
  WHEN 3 THEN '<link rel="Canonical nofollow" href="/home?x=1">'
  WHEN 4 THEN concat('<link rel=canonical href="', url, '/">')
  WHEN 5 THEN '<link href="../up/./page" rel="canonical"><link rel="canonical">'
  ELSE '' END,
 CASE page_id % 5
  WHEN 1 THEN '<script type="application/ld+json"> {"@context":"https://schema.org","@type":"Organization","name":"<b>"} </script>'
  WHEN 2 THEN '<script type="application/ld+json">{"@type": oops</script>'
  WHEN 3 THEN '<script type="application/LD+JSON">{"@graph":[{"@type":"WebPage","mainEntity":{"@type":"Thing"}},{"@type":["Article","WebPage"]}]}</script><script type="application/ld+json">{"@type":"Person"}</script>'
  WHEN 4 THEN '<script type="application/json">{"@type":"Nothing"}</script>'
  ELSE '' END,
 CASE WHEN page_id % 11 = 0 THEN '<meta http-equiv="refresh" content="5"><meta itemprop="name" content=" "><meta content="lonely" data-k="v"><meta>' ELSE '' END,
 CASE WHEN page_id % 17 = 3 THEN '<title></title>' ELSE '' END,
 CASE WHEN page_id % 7 = 3 THEN '<noscript><img src="/px.gif" alt="">hidden words <h6>quiet</h6></noscript>' ELSE '' END)"""

_BODY = """concat(chr(10),
 CASE WHEN page_id % 6 >= 1 THEN concat('<img src="/img/hero-', CAST(page_id % 13 AS STRING), '.png" alt="Hero picture" width="10" height="10">') ELSE '' END,
 CASE WHEN page_id % 6 >= 2 THEN concat('<img src="pics/photo.webp">', chr(10)) ELSE '' END,
 CASE WHEN page_id % 6 >= 3 THEN '<img data-src="http://cdn.example.com/a/b/logo.jpg" alt="" loading="Lazy">' ELSE '' END,
 CASE WHEN page_id % 6 >= 4 THEN concat('<img src="/img/hero-', CAST(page_id % 13 AS STRING), '.png" alt=" Image " srcset="x.webp 2x">') ELSE '' END,
 CASE WHEN page_id % 6 >= 5 THEN concat('<img alt="', repeat('long words ', 12), '" width="1"/>') ELSE '' END,
 CASE WHEN page_id % 12 = 5 THEN concat('<img src="../i/', repeat('verylongname', 8), '.jpeg" alt="  " alt=second>') ELSE '' END,
 CASE WHEN page_id % 10 = 4 THEN '<picture><source srcset="z.avif"><source src="y.webp"></picture>' ELSE '' END,
 CASE page_id % 5
  WHEN 1 THEN concat('<h2>Part ', CAST(page_id AS STRING), '</h2>')
  WHEN 2 THEN '<h2 id="s" class="a b  c d">Sub</h2><h4>Deep <i>er</i></h4><h5></h5>'
  WHEN 3 THEN '<h1>Second &quot;title&quot;</h1>'
  WHEN 4 THEN '<h2>What is it?</h2><p>It is a thing.</p><h3>Why so?</h3><div>x</div><p>Because <b>so</b>.'
  ELSE '<h3/>' END,
 CASE WHEN page_id % 13 = 6 THEN '<h3>broken <a href="/b">x</h3> tail</a>' ELSE '' END,
 CASE WHEN page_id % 3 = 0 THEN concat(chr(10), '<a href="/x', CAST(page_id % 7 AS STRING), '">Click here!</a>') ELSE '' END,
 CASE WHEN page_id % 6 = 0 THEN '<a href="/x1" rel="nofollow" target="_blank"><b>More</b></a>' ELSE '' END,
 CASE WHEN page_id % 4 = 1 THEN concat('<a href="http://plain.example.org/p', CAST(page_id % 17 AS STRING), '">plain</a>') ELSE '' END,
 CASE WHEN page_id % 8 = 2 THEN '<a href="#top">up</a><a href="mailto:a@b.c">mail</a><a name="n">anchor</a><a href="?q=1">query</a><a href="//cdn.example.com/x?">cdn</a><a href="HTTP://UP.example.com/A">up</a><a href="">none</a>' ELSE '' END,
 CASE WHEN page_id % 16 = 9 THEN concat('<ul>', repeat('<li><a href="/many">same</a>', 3), '<a href="/m1">1</a><a href="/m2">2</a><a href="/m3">3</a><a href="/m4">4</a><a href="./m5">5</a><a href="m6/">6</a><a href="/m7/../m8">7</a><a href="/m9">9</a><a href="/m10">10</a><a href="/m11">11</a><a href="/m12">12</a><a href="/m13">13</a><a href="/m14">14</a><a href="/m15">15</a><a href="/m16">16</a><a href="/m17">17</a><a href="/m18">18</a><a href="/m19">19</a><a href="/m20">20</a><a href="/m21">21</a><a href="/m22">22</a><a href="/m23">23</a><a href="/m24">24</a><a href="/m25">25</a><a href="/m26">26</a><a href="/m27">27</a><a href="/m28">28</a><a href="/m29">29</a><a href="/m30">30</a><a href="/m31">31</a><a href="/m32">32</a><a href="/m33">33</a><a href="/m34">34</a><a href="/m35">35</a><a href="/m36">36</a><a href="/m37">37</a><a href="/m38">38</a><a href="/m39">39</a></ul>') ELSE '' END,
 CASE WHEN page_id % 19 = 4 THEN '<template><p>never shown</p></template><table><tr><td>1 < 2</td></tr></table>' ELSE '' END)"""

PAGES_AUG = f"""SELECT page_id,
 CASE WHEN page_id % 7 = 0 THEN concat(url, '-old') WHEN page_id % 7 = 1 THEN concat(url, '/') ELSE url END AS requested_url,
 url,
 CAST(CASE page_id % 29 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS INT) AS status,
 CASE WHEN page_id % 31 = 0 THEN 'application/json' WHEN page_id % 31 = 1 THEN 'Text/HTML' ELSE 'text/html; charset=utf-8' END AS content_type,
 CASE WHEN page_id % 15 = 4 THEN 'noindex' WHEN page_id % 15 = 5 THEN 'max-snippet:5' ELSE NULL END AS x_robots_tag,
 concat('2026-01-', CAST(10 + page_id % 20 AS STRING), 'T00:00:00+00:00') AS fetched_at,
 CAST(50 + page_id % 400 AS INT) AS elapsed_ms,
 CAST(length(html) AS BIGINT) AS byte_size,
 replace(replace(replace(replace(replace(html,
  '<h1>', CASE WHEN page_id % 23 = 5 THEN '<h0>' ELSE '<h1>' END),
  '<html lang=', CASE WHEN page_id % 21 = 2 THEN '<html data-lang=' ELSE '<html lang=' END),
  '<title>', CASE WHEN page_id % 22 = 8 THEN '<title>A headline that goes on and on before it comes to its point: ' ELSE '<title>' END),
  '</head>', concat({_HEAD}, '</head>')), '</article>', concat({_BODY}, '</article>')) AS html
FROM pages"""

# A site whose pages link to each other as a binary tree, five hosts.
_K = "CAST((page_id - page_id % 5) / 5 AS BIGINT)"
SITE_PAGES = f"""SELECT page_id,
 concat('https://site', CAST(page_id % 5 AS STRING), '.example.net/p', CAST({_K} AS STRING)) AS url,
 replace(html, '</article>', concat(
  CASE WHEN page_id % 11 = 7 THEN '' ELSE concat('<a href="/p', CAST({_K} * 2 + 1 AS STRING), '#s">left</a>') END,
  '<a href="/p', CAST({_K} * 2 + 2 AS STRING), '">right</a><a href="/p0">home</a>',
  CASE WHEN page_id % 11 = 3 THEN '<a href="/p1">one</a>' ELSE '' END, '</article>')) AS html
FROM pages"""

# Measurements and probes that a fetcher would have written, keyed by URL.
LINK_STATUS_EXPR = """CAST(CASE length(url) % 11 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN NULL WHEN 3 THEN 301 ELSE 200 END AS INT)"""
PROBE_HEAD_EXPR = """CAST(CASE length(url) % 7 WHEN 0 THEN 405 WHEN 1 THEN 501 WHEN 2 THEN NULL WHEN 3 THEN 404 ELSE 200 END AS INT)"""
PROBE_GET_EXPR = """CAST(CASE WHEN length(url) % 7 = 1 THEN 405 WHEN length(url) % 7 = 0 AND length(url) % 2 = 0 THEN 403 WHEN length(url) % 7 = 0 THEN 200 ELSE NULL END AS INT)"""
ASSET_EXPRS = {
    "byte_size": "CAST(CASE length(src) % 5 WHEN 0 THEN 3000000 + length(src) WHEN 1 THEN NULL WHEN 2 THEN 2621440 WHEN 3 THEN 2621441 ELSE 500 + length(src) END AS BIGINT)",
    "content_type": "CASE WHEN length(src) % 5 = 1 THEN '' ELSE 'image/png' END",
    "error": "CASE WHEN length(src) % 5 = 1 THEN 'HTTP 404' ELSE NULL END",
    "at_least": "length(src) % 5 = 3",
}

# Text inputs of every kind the generator reads, each over the whole document.
DOCS_AUG = """SELECT doc_id, CASE doc_id % 12
 WHEN 0 THEN concat('Title: Report ', CAST(doc_id AS STRING), chr(10), 'Author: A. Writer', chr(10), 'Date: 2026-01-02', chr(10), 'Publisher: Big "Press"', chr(10), text)
 WHEN 1 THEN concat('What is it?', chr(10), 'A thing.', chr(10), 'Why?', chr(10), 'Really why?', chr(10), 'Because.', chr(10), text)
 WHEN 2 THEN concat('Making tea', chr(10), '1. Boil water', chr(10), '2) Add leaves', chr(10), '- Wait', chr(10), 'Time: PT5M', chr(10), text)
 WHEN 3 THEN concat('Name: Widget', chr(10), 'Price: GBP 12.50', chr(10), 'SKU: W-1', chr(10), 'Brand: Acme', chr(10), 'Availability: In Stock', chr(10), text)
 WHEN 4 THEN concat('Event: Fair', chr(10), 'Start: 2026-09-01T19:00', chr(10), 'Venue: Hall', chr(10), 'Host: Club', chr(10), text)
 WHEN 5 THEN concat('Name: Shop', chr(10), 'Street: 1 Road', chr(10), 'Address: 2 Lane', chr(10), 'City: Leeds', chr(10), 'Phone: 123', chr(10), 'Social: a.example , b.example,', chr(10), text)
 WHEN 6 THEN concat('Home > Services | Web Design', chr(10), 'URL: https://x.example/', chr(10), text)
 WHEN 7 THEN concat('Title: Plain page', chr(10), 'Language: en', chr(10), 'Note that this colon: is prose because key is long', chr(10), text)
 WHEN 8 THEN concat('Price: 10', chr(10), 'Currency: EUR', chr(10), 'Name: Thing', chr(10), 'Url: https://x.example/t', chr(10), text)
 WHEN 9 THEN concat('Ends with colon:', chr(10), '  ', chr(10), text)
 WHEN 10 THEN ''
 ELSE text END AS content
FROM documents"""

# A scan log from the event stream: one audit finding per event, one scan per
# site and day.
SCAN_LOG = """SELECT event_id, ts,
 CAST(user_id % 20 AS BIGINT) AS site_id,
 concat('https://site', CAST(user_id % 20 AS STRING), '.example.net/') AS url,
 CAST(ts AS DATE) AS scan_day,
 CASE event_type WHEN 'click' THEN 'seo' WHEN 'view' THEN 'images' WHEN 'error' THEN 'links' ELSE 'assets' END AS module,
 concat(event_type, '.rule-', CAST(event_id % 7 AS STRING)) AS rule,
 CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
 CAST(event_id % 9 AS BIGINT) AS page_no
FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_from(source: DataFrame, sql: str, name: str) -> DataFrame:
    """``sql`` with its ``FROM name`` bound to ``source``."""
    # A private view, gone as soon as the statement is resolved.
    spark = source.sparkSession
    view = f"sitegrain_{name}_{uuid.uuid4().hex}"
    source.createOrReplaceTempView(view)
    try:
        return spark.sql(sql.replace(f"FROM {name}", f"FROM {view}"))
    finally:
        spark.catalog.dropTempView(view)


def _derived(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    source = table(spark, sf_dir, name)
    if name in ("pages", "documents"):
        source = spread(source, source.columns[0])
    return derived_from(source, sql, name)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages_aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, PAGES_AUG, "pages")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, SITE_PAGES, "pages")


def docs_aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, DOCS_AUG, "documents")


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, SCAN_LOG, "events")
