"""Queries over sources, extracts and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.text import unescape
from sitegrain.operators import rules as R
from sitegrain.operators.extract import extract, meta_value
from sitegrain.operators.tokens import tokens
from sitegrain.plans import oracle_base as O
from sitegrain.plans.oracle_base import with_extracts
from sitegrain.plans.oracle_rules import rule_sql
from sitegrain.plans.registry import query
from sitegrain.sources import fixtures as X
from sitegrain.sources import responses as S


def audit_pages(spark, sf):
    return S.auditable_pages(X.pages_aug(spark, sf))


# --- sources ----------------------------------------------------------------


@query("load_responses", f"""SELECT page_id, url, status, content_type, contains(lower(content_type), 'html') AS is_html, x_robots_tag, 2 + CASE WHEN x_robots_tag IS NULL THEN 0 ELSE 1 END AS n_headers FROM ({X.PAGES_AUG})""")
def _(spark, sf):
    aug = X.pages_aug(spark, sf)
    raw = aug.select(
        "page_id", "url", "status",
        F.map_filter(
            F.create_map(
                F.lit("Content-Type"), F.col("content_type"), F.lit("SERVER"), F.lit("x"),
                F.lit("X-Robots-Tag"), F.col("x_robots_tag"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
    )
    return S.load_responses(raw).select(
        "page_id", "url", "status", "content_type", "is_html", "x_robots_tag",
        F.size("headers").alias("n_headers"),
    )


@query("decode_responses", "SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages")
def _(spark, sf):
    html = F.col("html")
    kind = F.col("page_id") % 4
    raw = X.pages(spark, sf).select(
        "page_id",
        F.when(kind == 1, F.encode(html, "UTF-16LE")).when(kind == 2, F.encode(html, "UTF-16BE"))
        .otherwise(F.encode(html, "UTF-8")).alias("body"),
        F.when(kind == 1, F.lit("text/html; Charset=utf-16le"))
        .when(kind == 2, F.lit("text/html; charset=UTF-16BE"))
        .when(kind == 3, F.lit("text/html; charset=utf-8")).alias("content_type"),
        # A label the body does not bear out must not lose the page.
        F.when(kind == 0, F.lit("GZIP")).alias("content_encoding"),
    )
    return S.decode_responses(raw).select(
        "page_id", F.length("html").alias("n_chars"), F.md5(F.encode("html", "UTF-8")).alias("digest")
    )


_FRONTIER = r"""SELECT page_id, CASE page_id % 12
 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN concat('  ', url, ' ') WHEN 2 THEN 'javascript:alert(1)'
 WHEN 3 THEN 'ssh://host.example/x' WHEN 4 THEN 'example.com:8080/p' WHEN 5 THEN '   ' WHEN 6 THEN concat(url, repeat('x', 2048))
 WHEN 7 THEN 'https:///nohost' WHEN 8 THEN replace(replace(url, 'https:', 'HTTPS:'), 'http:', 'HTTP:') WHEN 9 THEN 'FTP://x.example/' WHEN 10 THEN 'https:x' ELSE url END AS url FROM pages"""


@query("normalise_url", f"SELECT page_id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE concat('https://', url) END AS url FROM ({_FRONTIER})")
def _(spark, sf):
    df = X._derived(spark, sf, _FRONTIER, "pages")
    return df.select("page_id", S.normalise_url(F.col("url")).alias("url"))


@query("validate_urls", rf"""WITH c AS (SELECT page_id, {O.strip('url')} AS c FROM ({_FRONTIER})),
 d AS (SELECT *, lower(regexp_extract(c, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) AS s, CASE WHEN regexp_matches(c, '(?i)^https?://') THEN c ELSE concat('https://', c) END AS fu FROM c),
 e AS (SELECT *, CASE WHEN c = '' THEN 'empty' WHEN length(c) > 2048 THEN 'too long'
  WHEN s NOT IN ('', 'http', 'https') AND (regexp_matches(c, '^[a-zA-Z][a-zA-Z0-9+.\-]*://') OR s IN {O.inlist(S.BLOCKED_SCHEMES)}) THEN concat('scheme not allowed: ', s)
  WHEN {O.authority('fu')} = '' THEN 'no host' END AS error FROM d)
 SELECT page_id, CASE WHEN error IS NULL THEN fu END AS valid_url, error FROM e""")
def _(spark, sf):
    df = X._derived(spark, sf, _FRONTIER, "pages")
    return S.validate_urls(df).select("page_id", "valid_url", "error")


# --- markup -----------------------------------------------------------------


@query("tokens", with_extracts("SELECT page_id, CAST(pos AS INT) AS pos, kind, CASE WHEN kind IN ('start', 'end', 'raw') THEN tag END AS tag, CASE WHEN starts_with(tok, '<') THEN line END AS line, length(tok) AS n_chars, md5(tok) AS digest FROM tok", []))
def _(spark, sf):
    return tokens(audit_pages(spark, sf)).select(
        "page_id", "pos", "kind", "tag", "line", F.length("token").alias("n_chars"),
        F.md5(F.encode("token", "UTF-8")).alias("digest"),
    )


def _extract(name, part, select, sql, parts):
    @query(name, with_extracts(sql, parts))
    def _(spark, sf):
        return select(extract(audit_pages(spark, sf), part))


def _rows(column, *fields):
    def select(df):
        return df.select("page_id", F.inline(column)).select("page_id", *fields)

    return select


_extract("page_title", ["title"], lambda d: d.select("page_id", "title"),
         "SELECT page_id, title FROM src LEFT JOIN title USING (page_id)", ["title"])
_extract("page_lang", ["lang"], lambda d: d.select("page_id", "lang"),
         "SELECT page_id, lang FROM src LEFT JOIN lang USING (page_id)", ["lang"])
_extract("canonical_url", ["canonical"],
         lambda d: d.select("page_id", F.col("canonical.raw").alias("raw"), F.col("canonical.resolved").alias("canonical")),
         "SELECT page_id, canonical.h AS raw, abs AS canonical FROM src LEFT JOIN canonical USING (page_id)", ["canonical"])
_extract("headings", ["headings"], _rows("headings", "ord", "level", "text", "line"),
         "SELECT page_id, ord, level, text, line FROM heading", ["block"])
_extract("blocks", ["blocks"], _rows("blocks", "ord", "tag", "text", "line", "words"),
         "SELECT page_id, ord, tag, text, line, words FROM block", ["block"])
_IMG = ["ord", "src", "raw_src", "alt", "width", "height", "loading", "srcset", "line"]
_extract("images", ["images"], _rows("images", *_IMG), f"SELECT page_id, {', '.join(_IMG)} FROM image", ["image"])
_extract("picture_sources", ["picture_sources"],
         lambda d: d.select("page_id", F.posexplode("picture_sources").alias("p", "srcset")).select("page_id", (F.col("p") + 1).alias("ord"), "srcset"),
         "SELECT page_id, ord, srcset FROM picsrc", ["picsrc"])
_LNK = ["ord", "href", "text", "rel", "target", "line"]
_extract("links", ["links"], _rows("links", *_LNK), f"SELECT page_id, {', '.join(_LNK)} FROM link", ["link"])
_extract("jsonld_blocks", ["jsonld"],
         lambda d: d.select("page_id", F.posexplode("jsonld").alias("p", "body")).select("page_id", (F.col("p") + 1).alias("ord"), "body"),
         "SELECT page_id, ord, body FROM jsonld", ["jsonld"])
_extract("text_length", ["text_length"], lambda d: d.select("page_id", "text_length"),
         "SELECT page_id, text_length FROM textlen", ["textlen"])
_extract("meta_rows", ["metas"],
         lambda d: d.select("page_id", F.inline("metas")).select(
             "page_id", "ord", F.size("attrs").alias("n_attrs"),
             *[F.get(F.filter("attrs", (lambda n: lambda a: a["name"] == n)(n)), F.lit(0))["value"].alias(n) for n in ("name", "property", "content", "charset")]),
         "SELECT page_id, ord, CAST(len(attrs) AS INT) AS n_attrs, a_name AS name, a_property AS property, a_content AS content, a_charset AS charset FROM meta", ["meta"])

_LOOKUPS = [("name", "description"), ("name", "robots"), ("name", "viewport"), ("property", "og:title"), ("property", "og:image"), ("property", "twitter:card")]
_extract("meta_lookup", ["metas"],
         lambda d: d.select("page_id", *[meta_value(F.col("metas"), k, n).alias(n.replace(":", "_")) for k, n in _LOOKUPS]),
         "SELECT src.page_id, " + ", ".join(f"(SELECT v FROM metav m WHERE m.page_id = src.page_id AND m.key = '{k}' AND m.nm = '{n}') AS {n.replace(':', '_')}" for k, n in _LOOKUPS) + " FROM src", ["meta"])

_REFS = """SELECT page_id, url, CASE page_id % 14 WHEN 0 THEN '' WHEN 1 THEN '#x' WHEN 2 THEN '?a=b#c' WHEN 3 THEN '//cdn.example.com/a/../b' WHEN 4 THEN '/a/./b/../c/..' WHEN 5 THEN '../../../x' WHEN 6 THEN 'y/z?' WHEN 7 THEN './/d//e/' WHEN 8 THEN 'mailto:a@b' WHEN 9 THEN 'HTTPS://Up.example/Q?#f' WHEN 10 THEN ' /sp ace' WHEN 11 THEN '..' WHEN 12 THEN '/a?x=/../y#' ELSE '/été/..' END AS h FROM pages"""


@query("resolve_url", f"WITH r0 AS ({_REFS}),{O.resolved('r1', 'r0')}\nSELECT page_id, h AS href, abs AS resolved FROM r1")
def _(spark, sf):
    from sitegrain.functions.columns import staged

    df = X._derived(spark, sf, _REFS, "pages")
    df = staged(df, df.columns, urls.base_parts(F.col("url")))
    return df.select("page_id", F.col("h").alias("href"), urls.resolve(F.col("h"), urls.base()).alias("resolved"))


_extract("link_scope", ["links"],
         lambda d: d.select("page_id", "base_host", F.inline("links")).select("page_id", "ord", "href", urls.link_scope(F.col("href"), F.col("base_host")).alias("scope")),
         f"SELECT page_id, ord, href, CASE WHEN {O.authority('href')} = {O.authority('url')} THEN 'internal' WHEN {O.authority('href')} <> '' THEN 'external' ELSE 'other' END AS scope FROM link", ["link"])


@query("unescape_text", f"SELECT page_id, md5({O.dec('html')}) AS digest, length({O.dec('html')}) AS n_chars FROM pages")
def _(spark, sf):
    from sitegrain.functions.columns import staged

    df = staged(X.pages(spark, sf), ["page_id"], {"t": unescape(F.col("html"))})
    return df.select("page_id", F.md5(F.encode("t", "UTF-8")).alias("digest"), F.length("t").alias("n_chars"))


# --- one query per rule -----------------------------------------------------

RULE_KEYS = {
    "seo_missing_title": "seo.missing-title", "seo_title_too_short": "seo.title-too-short",
    "seo_title_too_long": "seo.title-too-long", "seo_missing_description": "seo.missing-meta-description",
    "seo_empty_description": "seo.empty-meta-description",
    "seo_description_too_short": "seo.meta-description-too-short",
    "seo_description_too_long": "seo.meta-description-too-long", "seo_noindex": "seo.noindex",
    "seo_nofollow_page": "seo.nofollow-page", "seo_missing_canonical": "seo.missing-canonical",
    "seo_missing_h1": "seo.missing-h1", "seo_multiple_h1": "seo.multiple-h1",
    "seo_heading_skip": "seo.heading-level-skip", "seo_empty_heading": "seo.empty-heading",
    "seo_missing_lang": "seo.missing-lang", "seo_missing_viewport": "seo.missing-viewport",
    "seo_missing_open_graph": "seo.missing-open-graph", "seo_missing_twitter_card": "seo.missing-twitter-card",
    "seo_no_structured_data": "seo.no-structured-data", "seo_thin_content": "seo.thin-content",
    "seo_vague_link_text": "seo.non-descriptive-link-text",
    "img_missing_alt": "image.missing-alt", "img_empty_alt": "image.empty-alt",
    "img_generic_alt": "image.generic-alt", "img_alt_too_long": "image.alt-too-long",
    "img_missing_src": "image.missing-src", "img_no_dimensions": "image.no-dimensions",
    "img_legacy_format": "image.legacy-format", "img_no_lazy": "image.no-lazy-loading",
    "img_duplicate_src": "image.duplicate-src",
    "link_mixed_content": "link.mixed-content-image", "link_insecure_http": "link.insecure-http",
}


def _rule_query(key, rule_id):
    @query(key, rule_sql(rule_id))
    def _(spark, sf):
        return R.flat(R.rule_rows(audit_pages(spark, sf), rule_id))


for _key, _id in RULE_KEYS.items():
    _rule_query(_key, _id)
