"""Queries across pages, over the scan store, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions import urls
from sitegrain.functions.sizes import human_size
from sitegrain.operators import history as H
from sitegrain.operators import scoring as C
from sitegrain.operators import site as N
from sitegrain.operators.extract import extract
from sitegrain.plans import oracle_base as O
from sitegrain.plans.oracle_base import with_extracts
from sitegrain.operators.outline import node_selector
from sitegrain.plans.q_audit import INVENTORY, META_INVENTORY, NODES, _ds, _hs, full_audit, over_findings
from sitegrain.plans.q_text import GRAPH_CTES, GRAPH_PARTS, GRAPH_SELECT
from sitegrain.plans.registry import query
from sitegrain.session import materialised, shared_dir
from sitegrain.sources import fixtures as X
from sitegrain.sources import sinks
from sitegrain.streaming import stream as T

# --- dashboard --------------------------------------------------------------

_DASH = f"""SELECT aug.page_id, aug.url, ov.score, CASE WHEN score >= 90 THEN 'good' WHEN score >= 70 THEN 'warn' ELSE 'bad' END AS band,
 CAST((SELECT count(*) FROM fa WHERE fa.page_id = aug.page_id) AS INT) AS findings,
 CAST((SELECT count(*) FROM fa WHERE fa.page_id = aug.page_id AND severity IN ('critical', 'high')) AS INT) AS serious,
 CAST((SELECT count(*) FROM image i WHERE i.page_id = aug.page_id) AS INT) AS images,
 CAST((SELECT count(*) FROM image i WHERE i.page_id = aug.page_id AND (alt IS NULL OR {O.strip('alt')} = '')) AS INT) AS missing_alt,
 CASE WHEN fs.n > 0 THEN {_hs('fs.total')} ELSE concat(CAST(CAST(round_even(aug.byte_size / 1024.0, 0) AS BIGINT) AS VARCHAR), ' KB') END AS weight,
 CASE WHEN aug.page_id NOT IN (SELECT page_id FROM src) THEN NULL ELSE concat(CASE WHEN regexp_matches(rb, '(^|,)(noindex|none)(,|$)') THEN 'noindex' ELSE 'index' END, ', ', CASE WHEN regexp_matches(rb, '(^|,)(nofollow|none)(,|$)') THEN 'nofollow' ELSE 'follow' END) END AS indexable,
 c.abs IS NOT NULL AS canonical, rtrim(aug.url, '/') <> rtrim(requested_url, '/') AS redirected
 FROM aug JOIN ov USING (page_id) LEFT JOIN (SELECT page_id, abs FROM canonical) c USING (page_id)
 LEFT JOIN (SELECT page_id, count(*) AS n, CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS total FROM found_asset GROUP BY 1) fs USING (page_id)
 LEFT JOIN (SELECT src.page_id, regexp_replace(lower(concat_ws(',', nullif(r.v, ''), nullif(g.v, ''), nullif(x_robots_tag, ''))), '\\s', '', 'g') AS rb FROM src LEFT JOIN metav r ON r.page_id = src.page_id AND r.key = 'name' AND r.nm = 'robots' LEFT JOIN metav g ON g.page_id = src.page_id AND g.key = 'name' AND g.nm = 'googlebot') rr USING (page_id)"""


def page_dashboard(audited):
    """One row per response: scores, counts and the facts shown on top (see ``RESULTS["dashboard"]``)."""
    f = C.all_findings(F.col("packs"))
    score = C.overall(F.col("packs"))
    none = F.lit(0)
    measured = F.col("images_measured") + F.col("size_unknown") > 0
    html_kb = F.concat(F.bround(F.col("byte_size") / 1024, 0).cast("bigint").cast("string"), F.lit(" KB"))
    return audited.select(
        "page_id", "url", score.alias("score"), C.score_band(score).alias("band"), F.size(f).alias("findings"),
        F.size(F.filter(f, lambda x: x["severity"].isin("critical", "high"))).alias("serious"),
        F.coalesce("n_images", none).alias("images"), F.coalesce(F.col("alt.missing") + F.col("alt.empty"), none).alias("missing_alt"),
        F.when(measured, human_size(F.col("total_bytes"))).otherwise(html_kb).alias("weight"),
        F.col("index.summary").alias("indexable"), F.coalesce("has_canonical", F.lit(False)).alias("canonical"),
        (F.rtrim("url", F.lit("/")) != F.rtrim("requested_url", F.lit("/"))).alias("redirected"),
    )


@query("page_dashboard", over_findings(_DASH))
def _(spark, sf):
    return page_dashboard(full_audit(spark, sf, "dashboard"))


def report_sections(audited):
    """(page_id, section, badge, hot) for every section a page's report has (see ``RESULTS["sections"]``)."""
    n_of = lambda m: F.aggregate(
        F.filter("packs", lambda p: p["module"] == m), F.lit(0), lambda acc, p: acc + F.size(p["findings"])
    )
    has = lambda m: F.exists("packs", lambda p: p["module"] == m)
    text = lambda n: F.when(n > 0, n.cast("string")).otherwise(F.lit(""))
    alt, can, idx = F.col("alt"), F.col("canonical_info"), F.col("index")
    can_ok = can["present"] & can["self_referencing"]
    blocked = ~(idx["indexable"] & idx["followable"])
    ok, no, over = F.col("ok"), F.lit(False), F.col("over_limit")

    def section(name, when, badge, hot):
        return F.when(when, F.struct(F.lit(name).alias("section"), badge.alias("badge"), hot.alias("hot")))

    rows = [
        section("overview", F.lit(True), F.lit(""), no),
        section("http", has("http"), F.lit("!"), F.lit(True)),
        *[section(m, has(m), text(n_of(m)), n_of(m) > 0) for m in ("seo", "images", "links")],
        section("headings", ok, F.col("n_headings").cast("string"), no),
        section("meta", ok, F.col("n_metas").cast("string"), no),
        section("canonical", ok, F.when(can_ok, F.lit("ok")).otherwise(F.lit("check")), ~can_ok),
        section("alt", ok, (alt["missing"] + alt["empty"]).cast("string"), alt["missing"] > 0),
        # On every page: "off" where no image sizes were asked for.
        section("image size", F.lit(True), F.coalesce(over.cast("string"), F.lit("off")), F.coalesce(over > 0, no)),
        section("robots", ok, F.when(blocked, F.lit("blocked")).otherwise(F.lit("ok")), blocked),
        section("schema", ok, F.col("n_suggested").cast("string"), no),
        section("image weight", n_of("assets") > 0, n_of("assets").cast("string"), F.lit(True)),
        section("structure", ok, F.col("n_nodes").cast("string"), no),
    ]
    return audited.select("page_id", F.inline(F.array_compact(F.array(*rows))))


def _n(module):
    return f"(SELECT CAST(count(*) AS INT) FROM fa WHERE fa.page_id = s.page_id AND module = '{module}')"


_SECTIONS = " UNION ALL ".join([
    "SELECT page_id, 'overview' AS section, '' AS badge, false AS hot FROM aug",
    f"SELECT page_id, 'http', '!', true FROM aug WHERE NOT ({O.OK_FILTER})",
    *[f"SELECT page_id, '{m}', CASE WHEN n > 0 THEN CAST(n AS VARCHAR) ELSE '' END, n > 0 FROM (SELECT page_id, {_n(m)} AS n FROM src s)" for m in ("seo", "images", "links")],
    "SELECT page_id, 'headings', CAST((SELECT count(*) FROM heading h WHERE h.page_id = s.page_id) AS VARCHAR), false FROM src s",
    "SELECT page_id, 'meta', CAST((SELECT count(*) FROM meta h WHERE h.page_id = s.page_id) AS VARCHAR), false FROM src s",
    "SELECT src.page_id, 'canonical', CASE WHEN coalesce(rtrim(abs, '/') = rtrim(src.url, '/'), false) THEN 'ok' ELSE 'check' END, NOT coalesce(rtrim(abs, '/') = rtrim(src.url, '/'), false) FROM src LEFT JOIN (SELECT page_id, abs FROM canonical) c USING (page_id)",
    f"SELECT page_id, 'alt', CAST((SELECT count(*) FROM image i WHERE i.page_id = s.page_id AND (alt IS NULL OR {O.strip('alt')} = '')) AS VARCHAR), EXISTS (SELECT 1 FROM image i WHERE i.page_id = s.page_id AND alt IS NULL) FROM src s",
    "SELECT page_id, 'image size', 'off', false FROM aug WHERE page_id NOT IN (SELECT page_id FROM src)",
    "SELECT page_id, 'schema', CAST(n_suggested AS VARCHAR), false FROM (" + GRAPH_SELECT + ")",
    "SELECT src.page_id, 'structure', CAST((SELECT count(*) FROM nd WHERE nd.page_id = src.page_id) AS VARCHAR), false FROM src",
    "SELECT page_id, 'image size', CAST(n AS VARCHAR), n > 0 FROM (SELECT page_id, (SELECT count(*) FROM found_asset a WHERE a.page_id = s.page_id AND byte_size > 2621440) AS n FROM src s)",
    "SELECT page_id, 'robots', CASE WHEN b THEN 'blocked' ELSE 'ok' END, b FROM (SELECT src.page_id, regexp_matches(regexp_replace(lower(concat_ws(',', nullif(r.v, ''), nullif(g.v, ''), nullif(x_robots_tag, ''))), '\\s', '', 'g'), '(^|,)(noindex|nofollow|none)(,|$)') AS b FROM src LEFT JOIN metav r ON r.page_id = src.page_id AND r.key = 'name' AND r.nm = 'robots' LEFT JOIN metav g ON g.page_id = src.page_id AND g.key = 'name' AND g.nm = 'googlebot')",
    f"SELECT page_id, 'image weight', CAST(n AS VARCHAR), true FROM (SELECT page_id, {_n('assets')} AS n FROM src s) WHERE n > 0",
])


_RICH = f"{NODES}, {GRAPH_CTES}"


@query("report_sections", over_findings(_SECTIONS, GRAPH_PARTS, _RICH).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    return report_sections(full_audit(spark, sf, "sections"))


# --- cross-page -------------------------------------------------------------


def _titles(spark, sf):
    df = extract(X.pages(spark, sf), ["title"]).filter("title <> ''")
    return df.select("page_id", F.col("base_host").alias("host"), "title")


def _tops(spark, sf):
    df = extract(X.pages(spark, sf), ["headings"])
    tops = F.array_distinct(F.transform(F.filter("headings", lambda h: (h["level"] == 1) & (h["text"] != "")), lambda h: h["text"]))
    return df.select("page_id", F.col("base_host").alias("host"), F.explode(tops).alias("h1"))


def _paragraphs(spark, sf):
    blocks = extract(X.pages(spark, sf), ["blocks"]).select(
        F.concat(F.lit("page:"), "page_id").alias("source"),
        F.transform(F.filter("blocks", lambda b: b["tag"] == "p"), lambda b: b["text"]).alias("parts"),
    )
    docs = X.documents(spark, sf).select(
        F.concat(F.lit("doc:"), "doc_id").alias("source"), F.split("text", "\n").alias("parts")
    )
    return blocks.unionByName(docs)


_LB = O.lit("\n")
_TITLED = f"SELECT page_id, {O.authority('url')} AS host, title FROM src JOIN title USING (page_id) WHERE title <> ''"
_TOPPED = f"SELECT DISTINCT page_id, {O.authority('url')} AS host, text AS h1 FROM heading JOIN src USING (page_id) WHERE level = 1 AND text <> ''"
_DIGESTS = f"""SELECT DISTINCT concat('page:', page_id) AS source, sha256(lower(text)) AS digest FROM block WHERE tag = 'p'
 UNION SELECT concat('doc:', doc_id), sha256(lower(t)) FROM (SELECT doc_id, {O.collapse('t')} AS t FROM (SELECT doc_id, unnest(string_split(text, {_LB})) AS t FROM documents)) WHERE t <> ''"""


def _grouped(rows, keys, n="n_pages", first="page_id"):
    return f"SELECT {keys}, count(*) AS {n}, min({first}) AS first_{first.split('_')[0]} FROM ({rows}) GROUP BY ALL HAVING count(*) > 1"


def _members(rows, keys, n="n_pages", member="page_id"):
    return f"SELECT {member}, {keys}, {n} FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS {n} FROM ({rows})) WHERE {n} > 1"


@query("duplicate_titles", with_extracts(_grouped(_TITLED, "host, title"), ["title"], "pages"))
def _(spark, sf):
    return N.duplicate_values(_titles(spark, sf), "title")


@query("duplicate_title_pages", with_extracts(_members(_TITLED, "host, title"), ["title"], "pages"))
def _(spark, sf):
    rows = materialised(_titles(spark, sf))
    return N.members(rows, N.duplicate_values(rows, "title"), ["host", "title"], "page_id")


@query("duplicate_h1", with_extracts(_grouped(_TOPPED, "host, h1"), ["block"], "pages"))
def _(spark, sf):
    return N.duplicate_values(_tops(spark, sf), "h1")


@query("duplicate_h1_pages", with_extracts(_members(_TOPPED, "host, h1"), ["block"], "pages"))
def _(spark, sf):
    rows = materialised(_tops(spark, sf))
    return N.members(rows, N.duplicate_values(rows, "h1"), ["host", "h1"], "page_id")


@query("duplicate_content", with_extracts(_grouped(_DIGESTS, "digest", "n_sources", "source"), ["block"], "pages"))
def _(spark, sf):
    return N.duplicate_content(_paragraphs(spark, sf))


@query("duplicate_content_sources", with_extracts(_members(_DIGESTS, "digest", "n_sources", "source"), ["block"], "pages"))
def _(spark, sf):
    texts = materialised(_paragraphs(spark, sf))
    return N.members(N.content_hashes(texts), N.duplicate_content(texts), ["digest"], "source")


def _site(spark, sf):
    # Two branches read it, so the extraction is written once.
    df = extract(X.site_pages(spark, sf), ["links"])
    return materialised(df.select("page_id", "url", "base_url", "base_host", "links"))


_EDGES = f"""
ed AS (SELECT DISTINCT page_id, regexp_extract(url, '^[^#]*') AS src, regexp_extract(href, '^[^#]*') AS dst FROM link WHERE {O.authority('href')} = {O.authority('url')}),
ed2 AS (SELECT * FROM ed WHERE ed.src <> dst)"""


@query("link_edges", with_extracts("SELECT ed2.page_id, s.page_id AS target_page_id FROM ed2 JOIN src s ON s.url = ed2.dst", ["link"], "site", _EDGES))
def _(spark, sf):
    return N.link_edges(_site(spark, sf))


@query("link_graph", with_extracts("SELECT s.page_id, s.url, CAST((SELECT count(*) FROM ed2 WHERE ed2.page_id = s.page_id) AS INT) AS out_degree, (SELECT count(*) FROM ed2 WHERE dst = s.url) AS in_degree, NOT EXISTS (SELECT 1 FROM ed2 WHERE dst = s.url) AS is_orphan FROM src s", ["link"], "site", _EDGES))
def _(spark, sf):
    return N.link_degrees(_site(spark, sf))


@query("orphan_pages", with_extracts("SELECT page_id, url AS dst FROM src WHERE url NOT IN (SELECT dst FROM ed2)", ["link"], "site", _EDGES))
def _(spark, sf):
    return N.orphan_pages(_site(spark, sf))


@query("page_depth", with_extracts("SELECT s.page_id, s.url, CAST(d.depth AS INT) AS depth FROM src s LEFT JOIN (SELECT dst, min(depth) AS depth FROM dp GROUP BY 1) d ON d.dst = s.url", ["link"], "site",
       _EDGES + ", e3 AS MATERIALIZED (SELECT DISTINCT ed2.src, dst FROM ed2), dp AS (SELECT * FROM dpr)").replace("WITH ", "WITH RECURSIVE ", 1).replace("dp AS (SELECT * FROM dpr)", "dp AS (SELECT url AS dst, 0 AS depth FROM src WHERE ends_with(url, '/p0') UNION SELECT e3.dst, dp.depth + 1 FROM dp JOIN e3 ON e3.src = dp.dst WHERE dp.depth < 12)"))
def _(spark, sf):
    pages = _site(spark, sf)
    edges = N.internal_edges(pages)
    depth = N.page_depth(edges, pages.filter(F.col("url").endswith("/p0")).select("url"))
    return pages.select("page_id", "url").join(depth, "url", "left")


# The sitemap knows no addresses with a query, and still lists old ones.
_SITEMAP = "SELECT url FROM pages WHERE NOT contains(url, '?') UNION ALL SELECT concat(url, '-gone') FROM pages WHERE contains(url, '.html')"


@query("sitemap_coverage", f"WITH s AS (SELECT DISTINCT url FROM ({_SITEMAP})), p AS (SELECT DISTINCT url FROM pages) SELECT coalesce(p.url, s.url) AS url, CASE WHEN s.url IS NULL THEN 'not in sitemap' WHEN p.url IS NULL THEN 'not crawled' ELSE 'both' END AS state FROM p FULL JOIN s ON p.url = s.url")
def _(spark, sf):
    return N.sitemap_coverage(X.pages(spark, sf), X._derived(spark, sf, _SITEMAP, "pages"))


_RULES = [("disallow", "/en"), ("allow", "/en/4"), ("disallow", "/fr/1"), ("disallow", "/de/9"), ("allow", "/de/9"), ("disallow", ""), ("disallow", "/es/1?p"), ("allow", "/x")]


@query("robots_blocked", f"""WITH r AS (SELECT DISTINCT {O.authority('url')} AS host, k.kind, k.prefix FROM pages, (VALUES {', '.join(f"('{k}', '{p}')" for k, p in _RULES)}) k(kind, prefix) WHERE k.prefix <> ''),
 p AS (SELECT page_id, {O.authority('url')} AS host, concat({O.path('url')}, {O.query('url')}) AS t FROM pages),
 m AS (SELECT p.page_id, r.prefix, r.kind, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.prefix) DESC NULLS LAST, r.kind) AS n FROM p LEFT JOIN r ON r.host = p.host AND starts_with(CASE WHEN t = '' THEN '/' ELSE t END, r.prefix))
 SELECT page_id, prefix AS rule, coalesce(kind = 'disallow', false) AS blocked FROM m WHERE n = 1""")
def _(spark, sf):
    pages = X.pages(spark, sf)
    hosts = pages.select(N.host_of(F.col("url")).alias("host")).distinct()
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("prefix")) for k, p in _RULES])
    return N.robots_blocked(pages, hosts.select("host", F.inline(every)))


def _fails(rules):
    return f"NOT EXISTS (SELECT 1 FROM fa WHERE fa.page_id = src.page_id AND rule IN {O.inlist(rules)})"


_ITEMS = {i: _fails(r) for i, r in N.ITEM_RULES.items()} | {
    "h2": "EXISTS (SELECT 1 FROM heading h WHERE h.page_id = src.page_id AND level = 2)",
    "sitemap": f"src.url IN (SELECT url FROM ({_SITEMAP}))",
}


@query("qa_checklist", over_findings(f"SELECT *, CAST(round_even(({' + '.join(f'CAST({i} AS INT)' for i in K.CHECKLIST_ITEMS)}) / 12.0 * 100, 1) AS DOUBLE) AS score FROM (SELECT page_id, {', '.join(f'{_ITEMS[i]} AS {i}' for i in K.CHECKLIST_ITEMS)} FROM src)"))
def _(spark, sf):
    audited = full_audit(spark, sf, "checklist").filter("ok")
    return N.qa_checklist(audited, C.all_findings(F.col("packs")), X._derived(spark, sf, _SITEMAP, "pages"))


_AXE = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'color-contrast' WHEN 1 THEN 'label' WHEN 2 THEN 'region' ELSE 'tabindex' END AS rule,
 CASE page_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' WHEN 3 THEN 'minor' ELSE 'unknown' END AS impact,
 concat('main > div:nth-child(', CAST(page_id % 6 AS STRING), ')') AS selector FROM pages UNION ALL
 SELECT page_id, 'label', 'serious', 'form' FROM pages UNION ALL SELECT page_id, 'label', 'serious', 'form' FROM pages"""


@query("axe_findings", f"SELECT rule, impact, selector, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page, CASE impact WHEN 'critical' THEN 'critical' WHEN 'serious' THEN 'high' WHEN 'moderate' THEN 'medium' WHEN 'minor' THEN 'low' END AS severity FROM ({_AXE}) GROUP BY 1, 2, 3")
def _(spark, sf):
    return N.axe_findings(X._derived(spark, sf, _AXE, "pages"))


@query("axe_pages", f"SELECT page_id, rule, impact, selector, count(*) OVER (PARTITION BY rule, impact, selector) AS n_pages FROM (SELECT DISTINCT page_id, rule, impact, selector FROM ({_AXE}))")
def _(spark, sf):
    return N.axe_pages(X._derived(spark, sf, _AXE, "pages"))


_NORM = O.collapse("lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))").replace("\\p{Z}", "\\p{{Z}}")
# A brief made from the page: some paragraphs left out, some worded otherwise,
# one the page does not have.
_BRIEF_TEXT = "CASE WHEN (ord + page_id) % 5 = 1 THEN concat(text, ' in other words') WHEN (ord + page_id) % 7 = 2 THEN 'Something else altogether' ELSE concat('* ', text, ' !') END"


# Paragraphs of the page and of its brief, what equal ones leave, and the pairs
# that share half of their words, ranked; a walk down the ranks takes a pair
# unless one of its sides is taken.
_MATCH = f"""
pp AS (SELECT page_id, t, min(ord) AS ord FROM (SELECT page_id, ord, {_NORM.format('text')} AS t FROM block WHERE tag = 'p') WHERE t <> '' GROUP BY 1, 2),
bb AS (SELECT page_id, t, min(ord) AS ord FROM (SELECT page_id, ord, {_NORM.format(_BRIEF_TEXT)} AS t FROM block WHERE tag = 'p' AND (ord + page_id) % 5 <> 0 UNION ALL SELECT page_id, 1000000, {_NORM.format("concat('Warranty for page ', page_id)")} FROM src) WHERE t <> '' GROUP BY 1, 2),
lb AS (SELECT *, list_distinct(string_split(t, ' ')) AS w FROM bb WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.page_id = bb.page_id AND pp.t = bb.t)),
lp AS (SELECT *, list_distinct(string_split(t, ' ')) AS w FROM pp WHERE NOT EXISTS (SELECT 1 FROM bb WHERE pp.page_id = bb.page_id AND pp.t = bb.t)),
sh AS (SELECT lb.page_id, lb.t AS b, lp.t AS p, lb.ord AS bo, lp.ord AS po, CAST(len(list_intersect(lb.w, lp.w)) AS DOUBLE) / len(list_distinct(list_concat(lb.w, lp.w))) AS share FROM lb JOIN lp USING (page_id)),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY share DESC, bo, po) AS k FROM sh WHERE share >= 0.5),
wk(page_id, k, tb, tp, hit) AS (SELECT page_id, 1, [b], [p], true FROM rk WHERE k = 1
 UNION ALL SELECT wk.page_id, wk.k + 1, CASE WHEN list_contains(tb, b) OR list_contains(tp, p) THEN tb ELSE list_append(tb, b) END, CASE WHEN list_contains(tb, b) OR list_contains(tp, p) THEN tp ELSE list_append(tp, p) END, NOT (list_contains(tb, b) OR list_contains(tp, p)) FROM wk JOIN rk ON rk.page_id = wk.page_id AND rk.k = wk.k + 1),
ch AS (SELECT page_id, b AS brief_text, p AS page_text, share FROM rk JOIN wk USING (page_id, k) WHERE hit)"""


def _match_sql(select: str) -> str:
    return with_extracts(select, ["block"], "pages", _MATCH).replace("WITH ", "WITH RECURSIVE ", 1)


def _page_and_brief(spark, sf):
    df = extract(X.pages(spark, sf), ["blocks"])
    paras = F.filter("blocks", lambda b: b["tag"] == "p")
    pages = df.select("page_id", F.transform(paras, lambda b: b["text"]).alias("texts"))
    key = lambda b: b["ord"] + F.col("page_id")
    brief = F.transform(
        F.filter(paras, lambda b: key(b) % 5 != 0),
        lambda b: F.when(key(b) % 5 == 1, F.concat(b["text"], F.lit(" in other words")))
        .when(key(b) % 7 == 2, F.lit("Something else altogether"))
        .otherwise(F.concat(F.lit("* "), b["text"], F.lit(" !"))),
    )
    own = F.array(F.concat(F.lit("Warranty for page "), F.col("page_id").cast("string")))
    return pages, df.select("page_id", F.concat(brief, own).alias("texts"))


@query("content_match", _match_sql("""SELECT *, CAST(CASE WHEN n_brief = 0 THEN 100.0 ELSE round_even(CAST(matched AS DOUBLE) / n_brief * 100, 1) END AS DOUBLE) AS match_pct FROM (
 SELECT page_id, n_brief, matched, changed, CAST(nb - changed AS INT) AS missing, CAST(np - changed AS INT) AS extra FROM (
 SELECT s.page_id, CAST((SELECT count(*) FROM bb WHERE bb.page_id = s.page_id) AS INT) AS n_brief, CAST((SELECT count(*) FROM bb JOIN pp USING (page_id, t) WHERE bb.page_id = s.page_id) AS INT) AS matched,
 CAST((SELECT count(*) FROM ch WHERE ch.page_id = s.page_id) AS INT) AS changed, (SELECT count(*) FROM lb WHERE lb.page_id = s.page_id) AS nb, (SELECT count(*) FROM lp WHERE lp.page_id = s.page_id) AS np FROM src s))"""))
def _(spark, sf):
    return N.content_match(*_page_and_brief(spark, sf))


@query("changed_paragraphs", _match_sql("SELECT * FROM ch"))
def _(spark, sf):
    return N.changed_paragraphs(*_page_and_brief(spark, sf))


# --- scan store -------------------------------------------------------------

_LOG = f"WITH lg AS (SELECT *, site_id * 100000 + date_diff('day', DATE '2000-01-01', scan_day) AS scan_id FROM ({X.SCAN_LOG})) "
_SC = "sc AS (SELECT site_id, url, scan_day, scan_id, min(ts) AS created_at, count(*) AS n_findings FROM lg GROUP BY ALL)"
_W = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 12 WHEN 'medium' THEN 6 WHEN 'low' THEN 2 ELSE 0 END"
_MS = f"ms AS (SELECT site_id, scan_day, scan_id, module, CAST(greatest(0, 100 - sum({_W})) AS DOUBLE) AS score FROM lg GROUP BY ALL)"


@query("list_scans", _LOG + f", {_SC} SELECT scan_id, url, created_at, n_findings FROM sc ORDER BY created_at DESC, scan_id LIMIT 25 OFFSET 5")
def _(spark, sf):
    return H.list_scans(H.scans(X.scan_log(spark, sf)), 25, 5).select("scan_id", "url", "created_at", "n_findings")


@query("scan_summary", _LOG + "SELECT scan_id, count(*) AS total_findings, " + ", ".join(f"count_if(severity = '{s}') AS {s}" for s in K.SEVERITIES) + ", count(DISTINCT page_no) AS pages_crawled FROM lg GROUP BY 1")
def _(spark, sf):
    return H.scan_summary(X.scan_log(spark, sf))


@query("list_findings", _LOG + "SELECT event_id, scan_id, severity, rule FROM lg WHERE module = 'seo' AND scan_id = (SELECT scan_id FROM lg GROUP BY 1 ORDER BY count(*) DESC, scan_id LIMIT 1) ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, rule, event_id LIMIT 200 OFFSET 1")
def _(spark, sf):
    log = X.scan_log(spark, sf).withColumn("scan_id", H.scan_id(F.col("site_id"), F.col("scan_day")))
    return H.list_findings(log, module="seo", limit=200, offset=1, scans=log.groupBy("scan_id").count().orderBy(F.desc("count"), "scan_id").limit(1)).select("event_id", "scan_id", "severity", "rule")


@query("scan_scores", _LOG + f", {_MS} SELECT scan_id, string_agg(concat(module, '=', CAST(score AS INT)), ',' ORDER BY module) AS scores, CAST(round_even(avg(score), 1) AS DOUBLE) AS overall_score FROM ms GROUP BY 1")
def _(spark, sf):
    df = H.scan_scores(H.module_scores(X.scan_log(spark, sf)))
    shown = F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string")))
    return df.select("scan_id", F.array_join(shown, ",").alias("scores"), "overall_score")


@query("scan_history", _LOG + f", {_MS} SELECT site_id, module, scan_day, score, lag(score) OVER w AS previous, score - lag(score) OVER w AS change, CAST(round_even(avg(score) OVER (PARTITION BY site_id, module ORDER BY scan_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS DOUBLE) AS moving_mean FROM ms WINDOW w AS (PARTITION BY site_id, module ORDER BY scan_day)")
def _(spark, sf):
    return H.scan_history(H.module_scores(X.scan_log(spark, sf)))


@query("scan_compare", _LOG + """, days AS (SELECT DISTINCT site_id, scan_day FROM lg), nw AS (SELECT site_id, max(scan_day) AS now_day FROM days GROUP BY 1),
 pr AS (SELECT nw.site_id, p.period, now_day, (SELECT max(scan_day) FROM days d WHERE d.site_id = nw.site_id AND d.scan_day <= CAST(now_day - to_days(p.n) AS DATE)) AS then_day FROM nw, (VALUES ('yesterday', 1), ('last week', 7), ('last month', 30)) p(period, n)),
 a AS (SELECT DISTINCT pr.site_id, period, page_no, rule FROM pr JOIN lg ON lg.site_id = pr.site_id AND scan_day = now_day),
 b AS (SELECT DISTINCT pr.site_id, period, page_no, rule FROM pr JOIN lg ON lg.site_id = pr.site_id AND scan_day = then_day)
 SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(a.period, b.period) AS period, count_if(b.rule IS NULL) AS new, count_if(a.rule IS NULL) AS fixed, count_if(a.rule IS NOT NULL AND b.rule IS NOT NULL) AS persisting
 FROM a FULL JOIN b ON a.site_id = b.site_id AND a.period = b.period AND a.page_no = b.page_no AND a.rule = b.rule GROUP BY 1, 2""")
def _(spark, sf):
    return H.scan_compare(X.scan_log(spark, sf))


@query("site_rollup", over_findings(f"SELECT host, module, severity, CAST(grouping(host, module, severity) AS INT) AS level, count(*) AS n_findings FROM (SELECT {O.authority('aug.url')} AS host, module, severity FROM fa JOIN aug USING (page_id)) GROUP BY ROLLUP (host, module, severity)"))
def _(spark, sf):
    df = full_audit(spark, sf, "hosts").withColumn("host", urls.authority(F.col("url")))
    return H.site_rollup(C.findings_table(df, "host"))


@query("top_rules", over_findings("SELECT rule, severity, count(*) AS n_findings, CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INT) AS rank FROM fa GROUP BY 1, 2"))
def _(spark, sf):
    return H.top_rules(C.findings_table(full_audit(spark, sf)))


@query("worst_pages", over_findings("SELECT page_id, score FROM ov ORDER BY score, page_id LIMIT 20"))
def _(spark, sf):
    return H.worst_pages(full_audit(spark, sf).select("page_id", C.overall(F.col("packs")).alias("score")))


# --- sinks ------------------------------------------------------------------


def _fresh(spark, name):
    return f"{shared_dir(spark)}/sitegrain-{name}-{uuid.uuid4().hex}"


_JSON = f"""SELECT aug.page_id, requested_url AS url, aug.url AS final_url, status, fetched_at, elapsed_ms, aug.byte_size, coalesce(nullif(title.title, ''), '(no title)') AS page_title, ov.score AS overall_score,
 {', '.join(f"CAST((SELECT count(*) FROM fa WHERE fa.page_id = aug.page_id AND severity = '{v}') AS INT) AS {v}" for v in K.SEVERITIES)},
 (SELECT string_agg(concat(module, '=', CAST(score AS INT), ':', n_findings), ',' ORDER BY module) FROM ps WHERE ps.page_id = aug.page_id) AS packs,
 coalesce((SELECT string_agg(rule, ',' ORDER BY rule) FROM fa WHERE fa.page_id = aug.page_id), '') AS rules,
 inv.heads, inv.kept, inv.suggested_types, inv.metas, inv.follow,
 CASE WHEN aug.page_id IN (SELECT page_id FROM src) THEN CAST(coalesce((SELECT sum(f.byte_size) FROM found_asset f WHERE f.page_id = aug.page_id), 0) AS BIGINT) END AS total_bytes,
 CASE WHEN aug.page_id IN (SELECT page_id FROM src) THEN coalesce((SELECT string_agg(concat(f.src, ' ', {_ds('f.byte_size', 'f.at_least')}, ' ', CASE WHEN f.byte_size > 2621440 THEN 'over' ELSE 'fits' END, CASE WHEN f.error IS NULL THEN '' ELSE concat(' ', f.error) END), '|' ORDER BY coalesce(nullif(f.byte_size, 0), -1) DESC, f.ord) FROM found_asset f WHERE f.page_id = aug.page_id), '') END AS images
 FROM aug JOIN ov USING (page_id) LEFT JOIN title USING (page_id) LEFT JOIN ({INVENTORY}) inv ON inv.page_id = aug.page_id"""


@query("findings_json", over_findings(_JSON, GRAPH_PARTS, _RICH + f", mi AS ({META_INVENTORY})").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    path = _fresh(spark, "json")
    sinks.result_json(full_audit(spark, sf, "json")).select("result", "page_id").write.json(path)
    back = spark.read.schema("result string, page_id bigint").json(path)
    counts = ", ".join(f"{v}: int" for v in K.SEVERITIES)
    shape = (
        f"url string, final_url string, status int, fetched_at string, elapsed_ms int, byte_size bigint, page_title string, overall_score double, counts struct<{counts}>, "
        "packs array<struct<module: string, score: double, findings: array<struct<rule: string>>>>, "
        "inventory struct<content: struct<blocks: array<struct<tag: string, text: string>>>, outline: struct<rows: array<struct<tag: string, element_id: string, classes: array<string>>>>, "
        "schema: struct<suggested_types: array<string>>, meta_tags: array<struct<kind: string, key: string, content: string>>, index_follow: struct<summary: string>>, "
        "image_sizes struct<total_bytes: bigint, images: array<struct<src: string, size: string, over_limit: boolean, error: string>>>"
    )
    back = back.select("page_id", F.from_json("result", shape).alias("r")).select("page_id", "r.*")
    inv = F.col("inventory")
    told = lambda array, one, by: F.array_join(F.transform(array, one), by)
    packs = F.array_sort(F.transform("packs", lambda p: F.concat(p["module"], F.lit("="), p["score"].cast("int").cast("string"), F.lit(":"), F.size(p["findings"]).cast("string"))))
    rules = F.array_sort(F.flatten(F.transform("packs", lambda p: F.transform(p["findings"], lambda f: f["rule"]))))
    image = lambda i: F.concat_ws(" ", i["src"], i["size"], F.when(i["over_limit"], F.lit("over")).otherwise(F.lit("fits")), i["error"])
    return back.select(
        "page_id", "url", "final_url", "status", "fetched_at", "elapsed_ms", "byte_size", "page_title", "overall_score", "counts.*",
        F.array_join(packs, ",").alias("packs"), F.array_join(rules, ",").alias("rules"),
        told(inv["content"]["blocks"], lambda b: F.concat_ws(" ", b["tag"], b["text"]), "|").alias("heads"),
        told(inv["outline"]["rows"], lambda n: node_selector(n["tag"], n["element_id"], n["classes"]), " ").alias("kept"),
        F.array_join(inv["schema"]["suggested_types"], ",").alias("suggested_types"),
        told(inv["meta_tags"], lambda m: F.concat_ws(" ", m["kind"], m["key"], m["content"]), "|").alias("metas"),
        inv["index_follow"]["summary"].alias("follow"), F.col("image_sizes.total_bytes").alias("total_bytes"),
        told(F.col("image_sizes.images"), image, "|").alias("images"),
    )


_FOUND = "SELECT page_id, module, rule, severity, coalesce(CAST(line AS VARCHAR), '') AS line, element, detail, items FROM fa"


@query("findings_export", over_findings(f"SELECT 'csv' AS format, * FROM ({_FOUND}) UNION ALL SELECT 'json', * FROM ({_FOUND}) UNION ALL SELECT 'markdown', page_id, module, rule, severity, line, NULL, NULL, NULL FROM ({_FOUND})"))
def _(spark, sf):
    found = materialised(C.findings_table(full_audit(spark, sf)))
    base = _fresh(spark, "export")
    for fmt in sinks.FORMATS:
        sinks.export_findings(found, f"{base}/{fmt}", fmt, "completed")
    columns = ["page_id", "module", "rule", "severity", "line", "element", "detail", "items"]
    shape = "page_id bigint, rule string, severity string, line int, element string, detail string, items int, module string"
    # An empty text and none are one in a CSV file, unless empty ones are quoted.
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{base}/csv")
    rows = [csv.select(F.lit("csv").alias("format"), *[F.coalesce(F.col(c), F.lit("")).cast(t).alias(c) if c in ("line", "element", "detail") else F.col(c).cast(t).alias(c) for c, t in [(c, "bigint" if c == "page_id" else "int" if c == "items" else "string") for c in columns]])]
    js = spark.read.schema(shape).json(f"{base}/json")
    rows.append(js.select(F.lit("json").alias("format"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c == "line" else F.col(c) for c in columns]))
    md = spark.read.text(f"{base}/markdown").filter(F.col("value").startswith("- **"))
    cut = lambda pattern: F.regexp_extract("value", pattern, 1)
    none = F.lit(None).cast("string")
    rows.append(md.select(
        F.lit("markdown").alias("format"), cut(r"page (\d+)").cast("bigint").alias("page_id"), "module", cut(r"`([^`]+)`").alias("rule"), cut(r"^- \*\*(\w+)").alias("severity"),
        cut(r"^[^:]*\(line (\d+)\):").alias("line"), none.alias("element"), none.alias("detail"), F.lit(None).cast("int").alias("items"),
    ))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# The store is laid out by scan; here a scan is one day's run over all sites.
@query("write_scan", f"""WITH l AS (SELECT *, CAST(date_diff('day', DATE '2000-01-01', scan_day) AS BIGINT) AS scan_id FROM ({X.SCAN_LOG}))
 SELECT scan_id, site_id, page_no, module, rule, severity, count(*) AS n, (SELECT min(ts) FROM l s WHERE s.scan_id = l.scan_id) AS created_at, (SELECT count(*) FROM (SELECT DISTINCT site_id, page_no FROM l p WHERE p.scan_id = l.scan_id)) AS n_pages FROM l GROUP BY ALL""")
def _(spark, sf):
    day = F.datediff("scan_day", F.lit("2000-01-01").cast("date")).cast("bigint")
    log = X.scan_log(spark, sf).withColumn("scan_id", day)
    path = _fresh(spark, "store")
    tables = {
        "scans": log.groupBy("scan_id").agg(F.min("ts").alias("created_at")),
        "pages": log.select("scan_id", "site_id", "page_no").distinct(),
        "findings": log.select("scan_id", "site_id", "page_no", "module", "rule", "severity"),
    }
    sinks.write_scan(tables, path)
    # Writing the newest scan again replaces it and leaves the others alone.
    newest = log.agg(F.max("scan_id").alias("scan_id"))
    sinks.write_scan({"findings": tables["findings"].join(newest, "scan_id", "left_semi")}, path)
    back = {n: spark.read.parquet(f"{path}/{n}").withColumn("scan_id", F.col("scan_id").cast("bigint")) for n in tables}
    found = back["findings"].groupBy("scan_id", "site_id", "page_no", "module", "rule", "severity").agg(F.count("*").alias("n"))
    pages = back["pages"].groupBy("scan_id").agg(F.count("*").alias("n_pages"))
    return found.join(back["scans"], "scan_id").join(pages, "scan_id")


# --- streams ----------------------------------------------------------------


def _stream(spark, sf, name):
    schema = X.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("stream_audit", over_findings("SELECT page_id, m.module, CASE WHEN m.module = 'http' THEN 0.0 ELSE ps.score END AS score, ps.n_findings FROM ps JOIN (VALUES ('seo'), ('images'), ('http')) m(module) USING (module)"))
def _(spark, sf):
    responses = X.derived_from(_stream(spark, sf, "pages"), X.PAGES_AUG, "pages")
    return C.pack_rows(T.run_append(T.stream_audit(responses), "audit")).drop("label")


def _paced_log(spark, sf, *columns, replay=False):
    """The scan log as it came in, in eight micro-batches; then its first eighth again, far too late; then a row that closes all."""
    log = X.scan_log(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), *columns)
    log = materialised(log)
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    end = log.limit(1).select((F.lit(last) + F.expr("INTERVAL 2 DAYS")).alias("ts"), *[F.lit(None).cast(log.schema[c].dataType).alias(c) for c in columns])
    late = log.filter(F.col("ts") < F.lit(first + (last - first) / 8))
    return T.paced(log, 8, *([late] if replay else []), end)


@query("stream_dedup", f"SELECT url, page_no, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY url, page_no ORDER BY ts) AS before FROM ({X.SCAN_LOG})) WHERE before IS NULL OR ts >= before + INTERVAL 12 HOUR")
def _(spark, sf):
    runs = T.stream_dedup(_paced_log(spark, sf, "url", "page_no"), ["url", "page_no"], "12 hours")
    return T.run_append(runs, "dedup").filter("url IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Windows are closed by the watermark; what is replayed after that changes nothing.
@query("stream_severity_closed", f"SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') + INTERVAL 6 HOUR AS end, severity, count(*) AS n FROM ({X.SCAN_LOG}) GROUP BY ALL")
def _(spark, sf):
    counts = T.stream_severity_counts(_paced_log(spark, sf, "severity", replay=True), "6 hours")
    df = T.run_append(counts, "closed").filter("severity IS NOT NULL")
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "severity", "n")


def _windows(name, slide, starts):
    @query(name, f"SELECT w AS start, w + INTERVAL 6 HOUR AS end, severity, count(*) AS n FROM (SELECT severity, unnest({starts}) AS w FROM ({X.SCAN_LOG})) GROUP BY ALL")
    def _(spark, sf):
        log = X.derived_from(_stream(spark, sf, "events"), X.SCAN_LOG, "events")
        log = log.withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "severity")
        counts = T.stream_severity_counts(log, "6 hours", slide)
        return T.run_update(counts, "counts", ["start", "end", "severity"], "n").select(
            F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "severity", "n"
        )


_windows("stream_severity_counts", None, "[time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')]")
_windows("stream_severity_sliding", "3 hours", "[time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 3 HOUR]")
