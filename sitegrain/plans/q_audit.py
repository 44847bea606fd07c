"""Queries over packs, probes, scores and the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions import urls
from sitegrain.functions.sizes import display_size, human_size
from sitegrain.operators import inventory as I
from sitegrain.operators import outline as T
from sitegrain.operators import probes as P
from sitegrain.operators import rules as R
from sitegrain.operators import results as S
from sitegrain.operators import scoring as C
from sitegrain.operators import suggest as G
from sitegrain.operators.extract import extract
from sitegrain.plans import oracle_base as O
from sitegrain.plans import q_text as Q
from sitegrain.plans.oracle_base import with_extracts
from sitegrain.plans.oracle_rules import SELECTS, pack_ctes
from sitegrain.plans.q_extract import audit_pages
from sitegrain.plans.registry import query
from sitegrain.session import materialised
from sitegrain.sources import fixtures as X

# --- side tables, derived from the URLs the pages use -----------------------


def link_status(links_of):
    hrefs = links_of.select(F.explode("links.href").alias("url")).filter(urls.is_web(F.col("url"))).distinct()
    return hrefs.selectExpr("url", f"{X.LINK_STATUS_EXPR} AS status")


def asset_sizes(images_of):
    srcs = images_of.select(F.explode("images.src").alias("src")).distinct()
    return srcs.selectExpr("src", *[f"{e} AS {n}" for n, e in X.ASSET_EXPRS.items()])


_WEB = f"{O.scheme('{}')} IN ('http', 'https')"
LINK_CTES = f"""
link_status AS (SELECT url, {X.LINK_STATUS_EXPR} AS status FROM (SELECT DISTINCT href AS url FROM link WHERE {_WEB.format('href')})),
lt0 AS (SELECT page_id, href AS url, min(ord) AS ord, max_by(text, ord) AS last_text FROM link WHERE {_WEB.format('href')} GROUP BY 1, 2),
lt AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM lt0),
found_link AS (SELECT lt.*, status FROM lt LEFT JOIN link_status USING (url))"""
ASSET_CTES = f"""
asset_sizes AS (SELECT src, {', '.join(f'{e} AS {n}' for n, e in X.ASSET_EXPRS.items())} FROM (SELECT DISTINCT src FROM image)),
at0 AS (SELECT page_id, src, min(ord) AS ord, arg_min(line, ord) AS line FROM image WHERE raw_src <> '' AND (starts_with(src, 'http://') OR starts_with(src, 'https://')) GROUP BY 1, 2),
at_ AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM at0),
found_asset AS (SELECT at_.*, byte_size, content_type, error, at_least FROM at_ LEFT JOIN asset_sizes USING (src))"""


def _hs(n):
    return f"CASE WHEN {n} IS NULL THEN 'unknown' WHEN {n} >= 1048576 THEN format('{{:.2f}} MB', CAST({n} / 1048576.0 AS DOUBLE)) WHEN {n} >= 1024 THEN concat(CAST(CAST(round_even({n} / 1024.0, 0) AS BIGINT) AS VARCHAR), ' KB') ELSE concat(CAST({n} AS VARCHAR), ' B') END"


def _ds(n="byte_size", f="at_least"):
    return f"concat(CASE WHEN {n} IS NOT NULL AND {f} THEN '>' ELSE '' END, {_hs(n)})"


_C8 = "page_id, '{}' AS rule, '{}' AS module, {} AS severity, {} AS line, {} AS items, {} AS element, {} AS detail, {} AS meta"
_NOLINE = "CAST(NULL AS INT)"
BROKEN = "SELECT " + _C8.format("link.broken", "links", "CASE WHEN status = 404 THEN 'high' ELSE 'medium' END", _NOLINE, "CAST(1 AS INT)", "url", "CASE WHEN coalesce(last_text, '') = '' THEN url ELSE last_text END", "concat('status=', status, '|url=', url)") + " FROM found_link WHERE status >= 400"
UNREACHABLE = "SELECT " + _C8.format("link.unreachable", "links", "'medium'", _NOLINE, "CAST(count(*) AS INT)", "''", "array_to_string(list_slice(list(url ORDER BY ord), 1, 5), '; ')", "concat('urls=', CAST(to_json(list(url ORDER BY ord)) AS VARCHAR))") + " FROM found_link WHERE status IS NULL GROUP BY page_id"
OVERSIZED = "SELECT " + _C8.format("image.oversized", "assets", "'high'", "line", "CAST(1 AS INT)", _ds(), f"concat('over by ', {_hs('(byte_size - 2621440)')})", "concat('src=', src, '|bytes=', byte_size, '|limit_bytes=2621440|content_type=', content_type)") + " FROM found_asset WHERE byte_size > 2621440"
UNFETCHED = "SELECT " + _C8.format("image.unreachable", "assets", "'medium'", _NOLINE, "CAST(count(*) AS INT)", "''", "array_to_string(list_slice(list(concat(src, ' (', error, ')') ORDER BY ord), 1, 5), '; ')", "concat('sources=', CAST(to_json(list(src ORDER BY ord)) AS VARCHAR))") + " FROM found_asset WHERE coalesce(error, '') <> '' GROUP BY page_id"


# --- HTTP -------------------------------------------------------------------

_HTTP = f"WITH aug AS ({X.PAGES_AUG}) "


def _http(key, rule_id, sql):
    @query(key, sql)
    def _(spark, sf):
        r = R.RULES[rule_id]
        df = X.pages_aug(spark, sf).withColumn("found", r.find(r))
        return R.flat(R.finding_rows(df, "found"))


_http("http_error_status", "http.error-status", _HTTP + "SELECT " + _C8.format("http.error-status", "http", "'critical'", _NOLINE, "CAST(1 AS INT)", "''", "url", "concat('status=', status)") + " FROM aug WHERE status >= 400")
_http("http_not_html", "http.not-html", _HTTP + "SELECT " + _C8.format("http.not-html", "http", "'critical'", _NOLINE, "CAST(1 AS INT)", "''", "content_type", "''") + " FROM aug WHERE status < 400 AND NOT contains(lower(content_type), 'html')")


@query("auditable_pages", _HTTP + f"SELECT page_id, url, length(html) AS n_chars FROM aug WHERE {O.OK_FILTER}")
def _(spark, sf):
    return audit_pages(spark, sf).select("page_id", "url", F.length("html").alias("n_chars"))


# --- statistics of the packs ------------------------------------------------


def _count(table, where="true"):
    return f"CAST((SELECT count(*) FROM {table} x WHERE x.page_id = src.page_id AND {where}) AS INT)"


_HOSTOF = O.authority("href")
_PAGEHOST = O.authority("src.url")


@query("seo_stats", with_extracts(f"""SELECT src.page_id, CAST(coalesce(length(title), 0) AS INT) AS title_length,
 CAST(coalesce((SELECT length(v) FROM metav m WHERE m.page_id = src.page_id AND key = 'name' AND nm = 'description'), 0) AS INT) AS description_length,
 {_count('heading', 'level = 1')} AS h1_count, {_count('heading')} AS heading_count,
 {_count('link', f'{_HOSTOF} = {_PAGEHOST}')} AS internal_links, {_count('link', f"{_HOSTOF} <> '' AND {_HOSTOF} <> {_PAGEHOST}")} AS external_links,
 {_count('jsonld')} AS structured_data_blocks, text_length
 FROM src LEFT JOIN title USING (page_id) LEFT JOIN textlen USING (page_id)""", ["title", "meta", "block", "link", "jsonld", "textlen"]))
def _(spark, sf):
    from sitegrain.operators.extract import meta_value

    df = extract(audit_pages(spark, sf), ["title", "metas", "headings", "links", "jsonld", "text_length"])
    scope = lambda s: F.size(F.filter("links", lambda a: urls.link_scope(a["href"], F.col("base_host")) == s))
    return df.select(
        "page_id", F.coalesce(F.length("title"), F.lit(0)).alias("title_length"),
        F.coalesce(F.length(meta_value(F.col("metas"), "name", "description")), F.lit(0)).alias("description_length"),
        F.size(F.filter("headings", lambda h: h["level"] == 1)).alias("h1_count"),
        F.size("headings").alias("heading_count"),
        scope("internal").alias("internal_links"), scope("external").alias("external_links"),
        F.size("jsonld").alias("structured_data_blocks"), "text_length",
    )


@query("img_stats", with_extracts(f"""SELECT src.page_id, {_count('image')} AS total_images, {_count('image', 'alt IS NULL')} AS missing_alt,
 {_count('image', "alt = ''")} AS empty_alt, {_count('image', f"lower({O.strip('alt')}) IN {O.inlist(K.GENERIC_ALT)}")} AS generic_alt,
 {_count('image', f"{O.extension('src')} IN {O.inlist(K.MODERN_EXTENSIONS)}")} AS modern_format,
 {_count('image', "lower(coalesce(loading, '')) = 'lazy'")} AS lazy_loaded,
 {_count('image', "coalesce(width, '') <> '' AND coalesce(height, '') <> ''")} AS with_dimensions FROM src""", ["image"]))
def _(spark, sf):
    from sitegrain.functions.columns import blank
    from sitegrain.functions.text import strip

    n = lambda p: F.size(F.filter("images", p))
    return extract(audit_pages(spark, sf), ["images"]).select(
        "page_id", F.size("images").alias("total_images"),
        n(lambda m: m["alt"].isNull()).alias("missing_alt"), n(lambda m: m["alt"] == "").alias("empty_alt"),
        n(lambda m: F.lower(strip(m["alt"])).isin(K.GENERIC_ALT)).alias("generic_alt"),
        n(lambda m: urls.extension(m["src"]).isin(K.MODERN_EXTENSIONS)).alias("modern_format"),
        n(lambda m: F.lower(m["loading"]) == "lazy").alias("lazy_loaded"),
        n(lambda m: ~blank(m["width"]) & ~blank(m["height"])).alias("with_dimensions"),
    )


def _image_column(key, column, expr, sql):
    @query(key, with_extracts(f"SELECT page_id, ord, {sql} AS {column} FROM image", ["image"]))
    def _(spark, sf):
        df = extract(audit_pages(spark, sf), ["images"]).select("page_id", F.inline("images"))
        return df.select("page_id", "ord", expr(F.col("src")).alias(column))


_image_column("img_extension", "extension", urls.extension, O.extension("src"))
_image_column("img_short_name", "short_name", urls.short_name, O.short_name("src"))


# --- assets -----------------------------------------------------------------


def _assets(spark, sf):
    images = materialised(extract(audit_pages(spark, sf), ["images"]).select("page_id", "images"))
    return P.measured_assets(images, asset_sizes(images))


@query("asset_targets", with_extracts("SELECT page_id, CAST(n AS INT) AS n, src, line FROM at_ WHERE n <= 60", ["image"], extra=ASSET_CTES))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["images"])
    t = df.select("page_id", P.asset_targets(F.col("images"), K.MAX_IMAGES)["targets"].alias("t"))
    return t.select("page_id", F.posexplode("t").alias("p", "x")).select(
        "page_id", (F.col("p") + 1).alias("n"), F.col("x.url").alias("src"), F.col("x.line").alias("line")
    )


def _probe_rule(key, of, rule_id, sql, parts, extra):
    @query(key, with_extracts(sql, parts, extra=extra))
    def _(spark, sf):
        df = P.probe_findings(of(spark, sf), [rule_id])
        return R.flat(R.finding_rows(df, "probe_findings"))


_probe_rule("asset_oversized", _assets, "image.oversized", OVERSIZED, ["image"], ASSET_CTES)
_probe_rule("asset_unreachable", _assets, "image.unreachable", UNFETCHED, ["image"], ASSET_CTES)


@query("asset_stats", with_extracts("""SELECT src.page_id, CAST(count(f.byte_size) AS INT) AS images_measured, CAST(count(f.src) - count(f.byte_size) AS INT) AS size_unknown,
 CAST(0 AS INT) AS not_checked, CAST(count(*) FILTER (WHERE f.byte_size > 2621440) AS INT) AS over_limit, CAST(coalesce(sum(f.byte_size), 0) AS BIGINT) AS total_bytes
 FROM src LEFT JOIN found_asset f ON f.page_id = src.page_id GROUP BY src.page_id""", ["image"], extra=ASSET_CTES))
def _(spark, sf):
    return P.asset_stats(_assets(spark, sf))


@query("asset_report", with_extracts(f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY coalesce(nullif(byte_size, 0), -1) DESC, ord) AS INT) AS rank, src, byte_size AS bytes, {_ds()} AS size, content_type, line, error, coalesce(byte_size > 2621440, false) AS over_limit,
 row_number() OVER (PARTITION BY page_id ORDER BY coalesce(nullif(byte_size, 0), -1) DESC, ord) = 1 AND byte_size IS NOT NULL AS heaviest FROM found_asset""", ["image"], extra=ASSET_CTES))
def _(spark, sf):
    return P.asset_report(_assets(spark, sf))


_SIZES = "SELECT page_id, CAST(CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 9 = 1 THEN length(html) WHEN page_id % 9 = 2 THEN page_id ELSE (page_id * page_id * 997 + length(html)) * 512 END AS BIGINT) AS n, page_id % 2 = 0 AS f FROM pages"


@query("human_size", f"SELECT page_id, {_hs('n')} AS size, {_ds('n', 'f')} AS shown FROM ({_SIZES})")
def _(spark, sf):
    df = X._derived(spark, sf, _SIZES, "pages")
    return df.select("page_id", human_size(F.col("n")).alias("size"), display_size(F.col("n"), F.col("f")).alias("shown"))


# --- links ------------------------------------------------------------------


def _links(spark, sf):
    links = materialised(extract(audit_pages(spark, sf), ["links"]).select("page_id", "links"))
    return P.checked_links(links, link_status(links))


@query("link_targets", with_extracts("SELECT page_id, CAST(n AS INT) AS n, url, last_text, CAST(greatest((SELECT count(*) FROM lt0 WHERE lt0.page_id = lt.page_id) - 40, 0) AS INT) AS not_checked FROM lt WHERE n <= 40", ["link"], extra=LINK_CTES))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["links"])
    t = df.select("page_id", P.link_targets(F.col("links"), K.MAX_LINKS).alias("t"))
    t = t.select("page_id", F.col("t.not_checked").alias("not_checked"), F.posexplode("t.targets").alias("p", "x"))
    return t.select("page_id", (F.col("p") + 1).alias("n"), F.col("x.url").alias("url"), F.col("x.last_text").alias("last_text"), "not_checked")


_probe_rule("link_broken", _links, "link.broken", BROKEN, ["link"], LINK_CTES)
_probe_rule("link_unreachable", _links, "link.unreachable", UNREACHABLE, ["link"], LINK_CTES)


@query("link_stats", with_extracts(f"""SELECT src.page_id, {_count('link')} AS links_found, CAST(count(f.url) AS INT) AS unique_checked,
 CAST(0 AS INT) AS not_checked,
 CAST(count_if(f.status >= 400) AS INT) AS broken, CAST(count_if(f.url IS NOT NULL AND f.status IS NULL) AS INT) AS unreachable, CAST(count_if(f.status < 400) AS INT) AS ok
 FROM src LEFT JOIN found_link f ON f.page_id = src.page_id GROUP BY src.page_id""", ["link"], extra=LINK_CTES))
def _(spark, sf):
    links = materialised(extract(audit_pages(spark, sf), ["links"]).select("page_id", "links"))
    stats = P.link_stats(P.checked_links(links, link_status(links)))
    return links.select("page_id", F.size("links").alias("links_found")).join(stats, "page_id")


_PROBES = f"SELECT url, 'HEAD' AS method, {X.PROBE_HEAD_EXPR} AS code FROM pages UNION ALL SELECT url, 'GET', {X.PROBE_GET_EXPR} FROM pages"


@query("link_status_resolve", f"""WITH p AS ({_PROBES}), q AS (SELECT url, max(CASE WHEN method = 'HEAD' THEN code END) AS h, max(CASE WHEN method = 'GET' THEN code END) AS g FROM p GROUP BY 1)
SELECT url, CAST(CASE WHEN h NOT IN (405, 501) THEN h WHEN h IN (405, 501) AND g NOT IN (405, 501) THEN g END AS INT) AS status FROM q""")
def _(spark, sf):
    return P.resolve_status(X._derived(spark, sf, _PROBES, "pages"))


# --- scores -----------------------------------------------------------------


def full_audit(spark, sf, *results):
    """One row per response with all its packs, and the facts of the results asked for."""
    names = list(results) or ["packs"]
    audited = materialised(S.audited_rows(X.pages_aug(spark, sf), names))
    ok = audited.filter("ok")
    measured = S.needs_of_results(names)[2]
    links = P.probe_findings(P.checked_links(ok, link_status(ok)), P.LINK_PROBE_RULES)
    assets = P.measured_assets(ok, asset_sizes(ok))
    assets = P.probe_findings(assets, P.ASSET_RULES).withColumns({k: c for k, c in P.asset_stat_columns().items() if k in measured})
    return C.with_probes(audited, links, assets, tuple(measured))


_MARKUP = [i for i in SELECTS]
_PARTS, _F = pack_ctes(_MARKUP)
_ALL = f"""{LINK_CTES},{ASSET_CTES},
{_F},
fa AS (SELECT * FROM f UNION ALL {BROKEN} UNION ALL {UNREACHABLE} UNION ALL {OVERSIZED} UNION ALL {UNFETCHED}
 UNION ALL SELECT {_C8.format("http.error-status", "http", "'critical'", _NOLINE, "1", "''", "url", "''")} FROM aug WHERE status >= 400
 UNION ALL SELECT {_C8.format("http.not-html", "http", "'critical'", _NOLINE, "1", "''", "content_type", "''")} FROM aug WHERE status < 400 AND NOT contains(lower(content_type), 'html')),
wt(severity, w, rk) AS (VALUES ('critical', 25, 0), ('high', 12, 1), ('medium', 6, 2), ('low', 2, 3), ('info', 0, 4)),
pk AS (SELECT page_id, m.module FROM src, (VALUES ('seo'), ('images'), ('assets'), ('links')) m(module) UNION ALL SELECT page_id, 'http' FROM aug WHERE NOT ({O.OK_FILTER})),
ps AS (SELECT pk.page_id, pk.module, CASE WHEN pk.module = 'http' THEN 0.0 ELSE CAST(greatest(0, 100 - coalesce(sum(w), 0)) AS DOUBLE) END AS score, CAST(count(fa.rule) AS INT) AS n_findings FROM pk LEFT JOIN fa USING (page_id, module) LEFT JOIN wt USING (severity) GROUP BY 1, 2),
ov AS (SELECT page_id, CAST(round_even(avg(score), 1) AS DOUBLE) AS score FROM ps GROUP BY 1)"""


def over_findings(select: str, parts=(), extra="") -> str:
    more = [p for p in parts if p not in _PARTS]
    return with_extracts(select, [*_PARTS, *more], extra=_ALL + ("," + extra if extra else ""))


@query("pack_scores", over_findings("SELECT page_id, module, score, n_findings FROM ps"))
def _(spark, sf):
    return C.pack_rows(full_audit(spark, sf)).drop("label")


@query("overall_score", over_findings("SELECT page_id, score FROM ov"))
def _(spark, sf):
    return full_audit(spark, sf).select("page_id", C.overall(F.col("packs")).alias("score"))


@query("score_band", over_findings("SELECT page_id, score, CASE WHEN score >= 90 THEN 'good' WHEN score >= 70 THEN 'warn' ELSE 'bad' END AS band FROM ov"))
def _(spark, sf):
    df = full_audit(spark, sf).select("page_id", C.overall(F.col("packs")).alias("score"))
    return df.withColumn("band", C.score_band(F.col("score")))


# Position within a page is compared for severity and rule; among equal ones
# emission order decides, which the per-rule queries cover.
@query("sorted_findings", over_findings("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rk, rule) AS INT) AS position, severity, rule FROM fa JOIN wt USING (severity)"))
def _(spark, sf):
    found = C.sorted_findings(C.all_findings(F.col("packs")))
    df = full_audit(spark, sf).select("page_id", F.posexplode(found).alias("p", "x"))
    return df.select("page_id", (F.col("p") + 1).alias("position"), F.col("x.severity").alias("severity"), F.col("x.rule").alias("rule"))


@query("severity_counts", over_findings("SELECT module, " + ", ".join(f"count_if(severity = '{s}') AS {s}" for s in K.SEVERITIES) + " FROM fa GROUP BY 1"))
def _(spark, sf):
    return C.severity_counts(C.findings_table(full_audit(spark, sf)), "module")


@query("serious_count", over_findings("SELECT aug.page_id, CAST(count(*) FILTER (WHERE severity IN ('critical', 'high')) AS INT) AS serious FROM aug LEFT JOIN fa USING (page_id) GROUP BY 1"))
def _(spark, sf):
    f = C.all_findings(F.col("packs"))
    return full_audit(spark, sf).select("page_id", F.size(F.filter(f, lambda x: x["severity"].isin("critical", "high"))).alias("serious"))


def fail_gate(audited, threshold: str):
    """Pages with a finding at least as severe as the threshold."""
    rank = K.SEVERITIES.index(threshold)
    return audited.filter(
        F.exists(C.all_findings(F.col("packs")), lambda x: C.severity_rank(x["severity"]) <= rank)
    )


@query("fail_gate", over_findings("SELECT DISTINCT page_id FROM fa WHERE severity IN ('critical', 'high')"))
def _(spark, sf):
    return fail_gate(full_audit(spark, sf), "high").select("page_id")


@query("redirected_pages", _HTTP + "SELECT page_id, requested_url, url FROM aug WHERE rtrim(url, '/') <> rtrim(requested_url, '/')")
def _(spark, sf):
    df = X.pages_aug(spark, sf).select("page_id", "requested_url", "url")
    return df.filter(F.rtrim("url", F.lit("/")) != F.rtrim("requested_url", F.lit("/")))


# --- inventory --------------------------------------------------------------


@query("content_inventory", with_extracts("SELECT src.page_id, " + ", ".join(f"{_count('block', f'''tag = '{t}' ''')} AS n_{t}" for t in K.HEADING_TAGS) + ", CAST(coalesce((SELECT sum(words) FROM block b WHERE b.page_id = src.page_id AND tag <> 'p'), 0) AS INT) AS total_words FROM src", ["block"]))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["blocks"])
    return df.select("page_id", *I.content_counts(F.col("blocks"), K.HEADING_TAGS))


_STATE = f"CASE WHEN alt IS NULL THEN 'missing' WHEN {O.strip('alt')} = '' THEN 'empty' ELSE 'present' END"


@query("alt_inventory", with_extracts(f"SELECT page_id, ord, src, alt, {_STATE} AS alt_state FROM image", ["image"]))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["images"]).select("page_id", F.inline("images"))
    return df.select("page_id", "ord", "src", "alt", I.alt_state(F.col("alt")).alias("alt_state"))


@query("alt_coverage", with_extracts(f"SELECT src.page_id, CAST(count(ord) AS INT) AS total, CAST(CASE WHEN count(ord) = 0 THEN 100.0 ELSE round_even(CAST(count_if({_STATE} = 'present' AND ord IS NOT NULL) AS DOUBLE) / count(ord) * 100, 1) END AS DOUBLE) AS coverage FROM src LEFT JOIN image USING (page_id) GROUP BY 1".replace("FROM src LEFT JOIN image USING (page_id)", "FROM src LEFT JOIN (SELECT page_id, ord, alt FROM image) i USING (page_id)").replace("GROUP BY 1", "GROUP BY src.page_id"), ["image"]))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["images"]).select("page_id", I.alt_summary(F.col("images")).alias("s"))
    return df.select("page_id", "s.total", "s.coverage")


META_INVENTORY = """SELECT page_id, ord,
 CASE WHEN coalesce(a_name, '') <> '' THEN 'name' WHEN coalesce(a_property, '') <> '' THEN 'property' WHEN coalesce(a_equiv, '') <> '' THEN 'http-equiv' WHEN coalesce(a_itemprop, '') <> '' THEN 'itemprop' WHEN a_charset IS NOT NULL THEN 'charset' ELSE 'other' END AS kind,
 coalesce(nullif(a_name, ''), nullif(a_property, ''), nullif(a_equiv, ''), nullif(a_itemprop, ''), CASE WHEN a_charset IS NOT NULL THEN 'charset' ELSE '(no name/property)' END) AS key,
 CASE WHEN coalesce(nullif(a_name, ''), nullif(a_property, ''), nullif(a_equiv, ''), nullif(a_itemprop, '')) IS NOT NULL THEN coalesce(a_content, '') WHEN a_charset IS NOT NULL THEN a_charset WHEN len(attrs) = 0 THEN '(empty tag)' ELSE replace(array_to_string(attrs, ', '), '"', '') END AS content FROM meta"""


@query("meta_inventory", with_extracts(META_INVENTORY, ["meta"]))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["metas"])
    return df.select("page_id", F.inline(I.meta_inventory(F.col("metas"))))


@query("canonical_info", with_extracts("""SELECT src.page_id, h AS declared, src.url AS page_url, abs AS resolved, h IS NOT NULL AS present, coalesce(rtrim(abs, '/') = rtrim(src.url, '/'), false) AS self_referencing,
 coalesce(starts_with(h, 'http://') OR starts_with(h, 'https://'), false) AS is_absolute, coalesce(rtrim(abs, '/') = rtrim(src.url, '/') AND abs <> src.url, false) AS trailing_slash_only
 FROM src LEFT JOIN (SELECT page_id, abs, h FROM canonical) c ON c.page_id = src.page_id""", ["canonical"]))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["canonical"])
    return df.select("page_id", I.canonical_info(F.col("canonical"), F.col("url")).alias("c")).select("page_id", "c.*")


@query("index_follow", with_extracts(f"""SELECT page_id, robots_meta, googlebot_meta, x_robots_tag, array_to_string(d, ',') AS directives, NOT list_contains(d, 'noindex') AND NOT list_contains(d, 'none') AS indexable, NOT list_contains(d, 'nofollow') AND NOT list_contains(d, 'none') AS followable,
 concat(CASE WHEN list_contains(d, 'noindex') OR list_contains(d, 'none') THEN 'noindex' ELSE 'index' END, ', ', CASE WHEN list_contains(d, 'nofollow') OR list_contains(d, 'none') THEN 'nofollow' ELSE 'follow' END) AS summary, len(d) = 0 AS is_default
 FROM (SELECT src.page_id, r.v AS robots_meta, g.v AS googlebot_meta, x_robots_tag, list_filter(list_transform(string_split(concat_ws(',', nullif(r.v, ''), nullif(g.v, ''), nullif(x_robots_tag, '')), ','), lambda w: lower({O.strip('w')})), lambda w: w <> '') AS d
 FROM src LEFT JOIN metav r ON r.page_id = src.page_id AND r.key = 'name' AND r.nm = 'robots' LEFT JOIN metav g ON g.page_id = src.page_id AND g.key = 'name' AND g.nm = 'googlebot')""", ["meta"]))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["metas"])
    df = df.select("page_id", I.index_follow(F.col("metas"), F.col("x_robots_tag")).alias("x")).select("page_id", "x.*")
    return df.withColumn("directives", F.array_join("directives", ","))


@query("existing_schema_types", with_extracts("SELECT src.page_id, coalesce(array_to_string(types, ','), '') AS types FROM src LEFT JOIN declared USING (page_id)", ["jsonld"], extra=O.SCHEMA_TYPES))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["jsonld"])
    return df.select("page_id", F.array_join(I.existing_types(F.col("jsonld")), ",").alias("types"))


# --- outline ----------------------------------------------------------------


def _outlined(spark, sf):
    from sitegrain.functions.columns import staged

    df = extract(audit_pages(spark, sf), ["nodes"]).select("page_id", "nodes")
    df = T.structure_outline(df)
    return staged(df, ["page_id"], {"outline": F.col("outline")})


# The stack machine as a walk over the events, one per step; the intervals by
# comparing nodes, not from the stack.
_TURN = sorted({*K.STRUCTURAL_TAGS, *K.CLOSES_PARAGRAPH})
NODES = f"""
turn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS i, {O._ATTRS} AS attrs FROM ev WHERE kind <> 'raw' AND tag IN {O.inlist(_TURN)}),
wk(page_id, i, n, block, st, opens, parent, depth) AS (SELECT page_id, CAST(0 AS BIGINT), 0, '', CAST([] AS STRUCT(ord INT, tag VARCHAR)[]), false, 0, 0 FROM src
 UNION ALL SELECT page_id, i, CASE WHEN opens THEN n + 1 ELSE n END, CASE WHEN kind = 'start' AND tag IN {O.inlist(['p', *K.HEADING_TAGS])} THEN tag WHEN implied OR (kind = 'end' AND block = tag) THEN '' ELSE block END,
  CASE WHEN opens AND tag NOT IN {O.inlist(K.VOID_TAGS)} THEN list_append(cut, struct_pack(ord := n + 1, tag := tag)) ELSE cut END, opens, coalesce(cut[-1].ord, 0), CAST(len(cut) AS INT)
 FROM (SELECT *, CASE WHEN found > 0 THEN st[1:found - 1] ELSE st END AS cut FROM (SELECT *, coalesce(list_max(list_filter(range(1, len(st) + 1), lambda j: st[j].tag = down)), 0) AS found FROM (
  SELECT *, CASE WHEN implied THEN 'p' WHEN kind = 'end' THEN tag END AS down FROM (
  SELECT turn.page_id, turn.i, turn.kind, turn.tag, wk.n, wk.block, wk.st, turn.kind = 'start' AND turn.tag IN {O.inlist(K.STRUCTURAL_TAGS)} AS opens, turn.kind = 'start' AND wk.block = 'p' AND turn.tag IN {O.inlist(K.CLOSES_PARAGRAPH)} AS implied
  FROM wk JOIN turn ON turn.page_id = wk.page_id AND turn.i = wk.i + 1))))),
nd0 AS MATERIALIZED (SELECT wk.page_id, wk.n AS ord, wk.parent, wk.depth, turn.tag, {O.attr('id')} AS element_id, list_filter(string_split({O.collapse(f"coalesce({O.attr('class')}, '')")}, ' '), lambda c: c <> '') AS cl, turn.line FROM wk JOIN turn USING (page_id, i) WHERE wk.opens),
nd AS MATERIALIZED (SELECT *, CAST(coalesce((SELECT min(m.ord) FROM nd0 m WHERE m.page_id = a.page_id AND m.ord > a.ord AND m.depth <= a.depth), (SELECT max(ord) + 1 FROM nd0 m WHERE m.page_id = a.page_id)) - 1 AS INT) AS last,
 CAST((SELECT count(*) FROM nd0 m WHERE m.page_id = a.page_id AND m.parent = a.ord) AS INT) AS children FROM nd0 a),
sha AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS INT) AS p FROM nd WHERE depth <= {K.OUTLINE_MAX_DEPTH}),
kep AS (SELECT * FROM sha WHERE p <= {K.OUTLINE_MAX_NODES}),
stp AS (SELECT src.page_id, coalesce(min(ord), 2147483647) AS stop FROM src LEFT JOIN (SELECT * FROM sha WHERE p > {K.OUTLINE_MAX_NODES}) s ON s.page_id = src.page_id GROUP BY 1)"""
_SELECTOR = "concat(tag, CASE WHEN coalesce(element_id, '') <> '' THEN concat('#', element_id) ELSE '' END, CASE WHEN len(cl) > 0 THEN concat('.', array_to_string(cl[1:3], '.')) ELSE '' END)"


def _over_nodes(select: str) -> str:
    return with_extracts(select, [], extra=NODES).replace("WITH ", "WITH RECURSIVE ", 1)


@query("structure_nodes", _over_nodes("SELECT page_id, ord, parent, depth, last, children, tag, element_id, array_to_string(cl, ' ') AS classes, line FROM nd"))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["nodes"]).select("page_id", F.inline("nodes"))
    return df.withColumn("classes", F.array_join("classes", " "))


@query("structure_outline", _over_nodes(f"SELECT page_id, p AS ord, depth, tag, {_SELECTOR} AS selector, line, children FROM kep"))
def _(spark, sf):
    return T.outline_rows(_outlined(spark, sf))


@query("outline_summary", _over_nodes(f"""SELECT page_id, CAST(t AS INT) AS total_nodes, CAST(coalesce(m, 0) AS INT) AS max_depth, CAST(d AS INT) AS truncated_by_depth, CAST(t - k - d AS INT) AS truncated_by_count FROM (
 SELECT src.page_id, (SELECT count(*) FROM nd WHERE nd.page_id = src.page_id) AS t, (SELECT max(depth) FROM nd WHERE nd.page_id = src.page_id) AS m, (SELECT count(*) FROM kep WHERE kep.page_id = src.page_id) AS k,
 (SELECT count(*) FROM nd WHERE nd.page_id = src.page_id AND depth > {K.OUTLINE_MAX_DEPTH} AND nd.ord < stop) AS d FROM src JOIN stp USING (page_id))"""))
def _(spark, sf):
    return _outlined(spark, sf).select("page_id", "outline.total_nodes", "outline.max_depth", "outline.truncated_by_depth", "outline.truncated_by_count")


@query("outline_tag_counts", _over_nodes("SELECT page_id, tag, count(*) AS n FROM kep GROUP BY 1, 2"))
def _(spark, sf):
    return T.outline_tag_counts(_outlined(spark, sf))


_SEL = f"""SELECT page_id, k, tag, {O.attr('id')} AS eid, list_filter(string_split({O.collapse(f"coalesce({O.attr('class')}, '')")}, ' '), lambda c: c <> '') AS cl FROM (SELECT *, {O._ATTRS} AS attrs FROM ev WHERE kind = 'start' AND tag IN {O.inlist(K.STRUCTURAL_TAGS)})"""


@query("node_selector", with_extracts(f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS ord, concat(tag, CASE WHEN coalesce(eid, '') <> '' THEN concat('#', eid) ELSE '' END, CASE WHEN len(cl) > 0 THEN concat('.', array_to_string(cl[1:3], '.')) ELSE '' END) AS selector FROM ({_SEL})", []))
def _(spark, sf):
    df = extract(audit_pages(spark, sf), ["nodes"]).select("page_id", F.inline("nodes"))
    return df.select("page_id", "ord", T.node_selector(F.col("tag"), F.col("element_id"), F.col("classes")).alias("selector"))


# Every part of the nested row, as columns.
INVENTORY = f"""SELECT page_id, heads, words, total_nodes, max_depth, kept, images, alt_missing, alt_empty, coverage, existing_types, suggested_types, notes, json_ld, metas, declared, resolved, self_referencing, robots_meta, googlebot_meta, x_robots_tag, follow FROM (
 SELECT src.page_id, src.x_robots_tag,
 coalesce((SELECT string_agg(concat(tag, ' ', text), '|' ORDER BY ord) FROM block b WHERE b.page_id = src.page_id AND tag <> 'p'), '') AS heads,
 CAST(coalesce((SELECT sum(words) FROM block b WHERE b.page_id = src.page_id AND tag <> 'p'), 0) AS INT) AS words,
 CAST((SELECT count(*) FROM nd WHERE nd.page_id = src.page_id) AS INT) AS total_nodes, CAST(coalesce((SELECT max(depth) FROM nd WHERE nd.page_id = src.page_id), 0) AS INT) AS max_depth,
 coalesce((SELECT string_agg({_SELECTOR}, ' ' ORDER BY p) FROM kep WHERE kep.page_id = src.page_id), '') AS kept,
 coalesce((SELECT string_agg(concat(ord, ' ', src, ' ', {_STATE}), '|' ORDER BY ord) FROM image i WHERE i.page_id = src.page_id), '') AS images,
 {_count('image', 'alt IS NULL')} AS alt_missing, {_count('image', f"{O.strip('alt')} = ''")} AS alt_empty,
 CAST(coalesce((SELECT round_even(count_if({_STATE} = 'present') * 100.0 / nullif(count(*), 0), 1) FROM image i WHERE i.page_id = src.page_id), 100.0) AS DOUBLE) AS coverage,
 coalesce((SELECT string_agg(concat(kind, ' ', key, ' ', content), '|' ORDER BY ord) FROM mi WHERE mi.page_id = src.page_id), '') AS metas,
 c.h AS declared, c.abs AS resolved, coalesce(rtrim(c.abs, '/') = rtrim(src.url, '/'), false) AS self_referencing, r.v AS robots_meta, g.v AS googlebot_meta,
 concat(CASE WHEN regexp_matches(rb, '(^|,)(noindex|none)(,|$)') THEN 'noindex' ELSE 'index' END, ', ', CASE WHEN regexp_matches(rb, '(^|,)(nofollow|none)(,|$)') THEN 'nofollow' ELSE 'follow' END) AS follow
 FROM (SELECT src.*, regexp_replace(lower(concat_ws(',', nullif(r.v, ''), nullif(g.v, ''), nullif(x_robots_tag, ''))), '\\s', '', 'g') AS rb FROM src LEFT JOIN metav r ON r.page_id = src.page_id AND r.key = 'name' AND r.nm = 'robots' LEFT JOIN metav g ON g.page_id = src.page_id AND g.key = 'name' AND g.nm = 'googlebot') src
 LEFT JOIN (SELECT page_id, abs, h FROM canonical) c ON c.page_id = src.page_id LEFT JOIN metav r ON r.page_id = src.page_id AND r.key = 'name' AND r.nm = 'robots' LEFT JOIN metav g ON g.page_id = src.page_id AND g.key = 'name' AND g.nm = 'googlebot') JOIN ({Q.GRAPH_SELECT}) USING (page_id)"""


def inventory_sql(select: str) -> str:
    return with_extracts(select, Q.GRAPH_PARTS, extra=f"{NODES}, mi AS ({META_INVENTORY}), {Q.GRAPH_CTES}").replace("WITH ", "WITH RECURSIVE ", 1)


@query("page_inventory", inventory_sql(INVENTORY))
def _(spark, sf):
    df = G.with_suggestion(extract(audit_pages(spark, sf), ["nodes", *G.PARTS]))
    df = I.page_inventory(T.structure_outline(df)).select("page_id", "inventory.*")
    told = lambda array, *fields: F.array_join(F.transform(array, lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])), "|")
    chosen = F.transform("outline.rows", lambda n: T.node_selector(n["tag"], n["element_id"], n["classes"]))
    return df.select(
        "page_id", told("content.blocks", "tag", "text").alias("heads"), F.col("content.total_words").alias("words"),
        "outline.total_nodes", "outline.max_depth", F.array_join(chosen, " ").alias("kept"), told("images.images", "index", "src", "alt_state").alias("images"),
        F.col("images.summary.missing").alias("alt_missing"), F.col("images.summary.empty").alias("alt_empty"), "images.summary.coverage",
        F.array_join("schema.existing_types", ",").alias("existing_types"), F.array_join("schema.suggested_types", ",").alias("suggested_types"),
        F.array_join("schema.notes", " ").alias("notes"), "schema.json_ld", told("meta_tags", "kind", "key", "content").alias("metas"),
        "canonical.declared", "canonical.resolved", "canonical.self_referencing",
        "index_follow.robots_meta", "index_follow.googlebot_meta", "index_follow.x_robots_tag", F.col("index_follow.summary").alias("follow"),
    )
