"""Queries that make schema.org markup, from pages and from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegrain.constants import ADDRESS_FIELDS
from sitegrain.functions.columns import staged
from sitegrain.functions.jsonld import script_block
from sitegrain.operators import suggest as G
from sitegrain.operators import textgen as T
from sitegrain.plans import oracle_base as O
from sitegrain.plans.oracle_base import lit, strip, with_extracts
from sitegrain.plans.q_extract import audit_pages
from sitegrain.plans.registry import query
from sitegrain.sources import fixtures as X

# --- JSON text in SQL -------------------------------------------------------


def js(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def obj(*members: tuple[str, str]) -> str:
    """JSON object text; members whose SQL is NULL vanish."""
    parts = ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN concat({lit(chr(34) + k + chr(34) + ':')}, {v}) END" for k, v in members)
    return f"concat('{{', array_to_string(list_filter([{parts}], lambda z: z IS NOT NULL), ','), '}}')"


def typed(kind: str, *members: tuple[str, str], context: bool = False) -> str:
    head = [("@context", lit('"https://schema.org"'))] if context else []
    return obj(*head, ("@type", lit(f'"{kind}"')), *members)


def when_(value: str, sql: str) -> str:
    return f"CASE WHEN ({value}) IS NOT NULL THEN {sql} END"


def jsn(x: str) -> str:
    return when_(x, js(x))


# --- page suggestions -------------------------------------------------------

_PARTS = ["title", "lang", "meta", "canonical", "block", "image", "textlen"]


def _mv(key, name):
    return f"(SELECT v FROM metav m WHERE m.page_id = s.page_id AND m.key = '{key}' AND m.nm = '{name}')"


_TITLE_PARTS = f"list_filter(list_transform(string_split_regex(title, {lit(G.TITLE_SEPARATOR)}), lambda z: {strip('z')}), lambda z: z <> '')"
_VALUES = f"""
pv0 AS (SELECT s.page_id, s.url, coalesce(c.abs, s.url) AS page_url, concat({O.scheme('s.url')}, '://', {O.authority('s.url')}) AS origin, title, lang,
 nullif({_mv('property', 'og:site_name')}, '') AS og_site, coalesce(nullif({_mv('name', 'description')}, ''), nullif({_mv('property', 'og:description')}, '')) AS description, nullif({_mv('property', 'og:image')}, '') AS og_image,
 (SELECT arg_min(src, ord) FROM image i WHERE i.page_id = s.page_id AND contains(lower(concat(src, ' ', coalesce(alt, ''))), 'logo')) AS logo,
 (SELECT arg_min(text, ord) FROM heading h WHERE h.page_id = s.page_id AND level = 1) AS h1, text_length,
 EXISTS (SELECT 1 FROM ev WHERE ev.page_id = s.page_id AND kind = 'start' AND tag = 'article') AS has_article
 FROM src s LEFT JOIN title USING (page_id) LEFT JOIN lang USING (page_id) LEFT JOIN textlen USING (page_id) LEFT JOIN (SELECT page_id, abs FROM canonical) c USING (page_id)),
pv AS (SELECT *, coalesce(og_site, CASE WHEN len({_TITLE_PARTS}) > 1 THEN {_TITLE_PARTS}[-1] END, regexp_replace({O.authority('url')}, '^www\\.', '')) AS site FROM pv0),
fq0 AS (SELECT page_id, ord, tag, text, first_value(CASE WHEN tag = 'p' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer FROM block),
fq AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS INT) AS n, text AS question, answer FROM fq0 WHERE tag <> 'p' AND ends_with(text, '?') AND answer IS NOT NULL),
sg AS (SELECT page_id, list_filter(string_split({O.path('page_url')}, '/'), lambda z: z <> '') AS segs, concat({O.scheme('page_url')}, '://', {O.authority('page_url')}) AS o FROM pv),
bc AS (SELECT page_id, 1 AS position, 'Home' AS name, concat(o, '/') AS item FROM sg WHERE len(segs) > 0
 UNION ALL SELECT page_id, i + 1, array_to_string(list_transform(regexp_extract_all({strip("regexp_replace(regexp_replace(seg, '[.][\\p{L}\\p{N}_]+$', ''), '[-_]+', ' ', 'g')")}, '\\p{{L}}+|\\P{{L}}+'), lambda r: concat(upper(left(r, 1)), lower(substr(r, 2)))), ''), concat(o, '/', array_to_string(segs[1:i], '/')) FROM (SELECT *, unnest(segs) AS seg, CAST(unnest(range(1, len(segs) + 1)) AS INT) AS i FROM sg))"""


def _page_sql(select: str) -> str:
    return with_extracts(select, _PARTS, extra=_VALUES.strip())


def _values(spark, sf):
    return G.page_values(audit_pages(spark, sf))


@query("site_name", _page_sql("SELECT page_id, site FROM pv"))
def _(spark, sf):
    return _values(spark, sf).select("page_id", "site")


@query("find_logo", _page_sql("SELECT page_id, logo FROM pv"))
def _(spark, sf):
    return _values(spark, sf).select("page_id", "logo")


@query("breadcrumbs", _page_sql("SELECT page_id, position, name, item FROM bc"))
def _(spark, sf):
    df = _values(spark, sf).select("page_id", F.explode(G.breadcrumbs(F.col("page_url"))).alias("b"))
    return df.select("page_id", "b.position", "b.name", "b.item")


@query("faq_pairs", _page_sql("SELECT page_id, n, question, answer FROM fq QUALIFY count(*) OVER (PARTITION BY page_id) >= 2"))
def _(spark, sf):
    df = _values(spark, sf).filter(F.size("faq") >= 2).select("page_id", F.posexplode("faq").alias("p", "q"))
    return df.select("page_id", (F.col("p") + 1).alias("n"), F.col("q.name").alias("question"), F.col("q.answer").alias("answer"))


_ORG = typed("Organization", ("@id", js("concat(origin, '/#organization')")), ("name", js("site")), ("url", js("concat(origin, '/')")),
             ("logo", when_("logo", typed("ImageObject", ("url", js("logo"))))))
_WEB = typed("WebPage", ("@id", js("concat(page_url, '#webpage')")), ("url", js("page_url")), ("name", js("coalesce(nullif(title, ''), site)")),
             ("isPartOf", obj(("@id", js("concat(origin, '/#organization')")))), ("description", jsn("description")),
             ("inLanguage", jsn("nullif(lang, '')")), ("primaryImageOfPage", when_("og_image", typed("ImageObject", ("url", js("og_image"))))))
_ART = typed("Article", ("headline", js("h1")), ("mainEntityOfPage", obj(("@id", js("concat(page_url, '#webpage')")))),
             ("publisher", obj(("@id", js("concat(origin, '/#organization')")))), ("description", jsn("description")), ("image", jsn("og_image")))


def _suggest(key, column, sql):
    @query(key, _page_sql(sql))
    def _(spark, sf):
        df = staged(_values(spark, sf), ["page_id"], {"json_ld": F.to_json(column())})
        return df.filter(F.col("json_ld").isNotNull())


_suggest("suggest_organization", G.organization, f"SELECT page_id, {_ORG} AS json_ld FROM pv")
_suggest("suggest_webpage", G.web_page, f"SELECT page_id, {_WEB} AS json_ld FROM pv")
_suggest("suggest_article", G.article, f"SELECT page_id, {_ART} AS json_ld FROM pv WHERE h1 IS NOT NULL AND (has_article OR text_length > 1500)")


_LI = obj(("@type", lit('"ListItem"')), ("position", "CAST(position AS VARCHAR)"), ("name", js("name")), ("item", js("item")))
_BC = typed("BreadcrumbList", ("itemListElement", f"concat('[', string_agg({_LI}, ',' ORDER BY position), ']')"), ("@id", js("concat(any_value(page_url), '#breadcrumb')")))
_QN = typed("Question", ("name", js("question")), ("acceptedAnswer", typed("Answer", ("text", js("answer")))))
_FQ = typed("FAQPage", ("mainEntity", f"concat('[', string_agg({_QN}, ',' ORDER BY n), ']')"))
_TYPES = ["Organization", "WebPage", "BreadcrumbList", "Article", "FAQPage"]
_GRAPH = f"""
bj AS (SELECT page_id, {_BC} AS j FROM bc JOIN pv USING (page_id) GROUP BY 1),
fj AS (SELECT page_id, {_FQ} AS j FROM fq GROUP BY 1 HAVING count(*) >= 2),
g0 AS (SELECT pv.page_id, logo, description, {_ORG} AS j0, {_WEB} AS j1, bj.j AS j2, CASE WHEN h1 IS NOT NULL AND (has_article OR text_length > 1500) THEN {_ART} END AS j3, fj.j AS j4,
 coalesce(types, CAST([] AS VARCHAR[])) AS ex
 FROM pv LEFT JOIN bj USING (page_id) LEFT JOIN fj USING (page_id) LEFT JOIN declared USING (page_id)),
g AS (SELECT *, list_filter([{', '.join(f"CASE WHEN j{i} IS NOT NULL THEN '{t}' END" for i, t in enumerate(_TYPES))}], lambda z: z IS NOT NULL) AS sg FROM g0),
gg AS (SELECT *, list_sort(list_intersect(ex, sg)) AS both_ FROM g)"""
_NOTES = ", ".join([
    "CASE WHEN logo IS NULL THEN 'No logo found; add one to the organization.' END",
    "CASE WHEN description IS NULL THEN 'No description on the page; left out.' END",
    "CASE WHEN j2 IS NOT NULL THEN 'Breadcrumb names come from the path; check them.' END",
    "CASE WHEN j3 IS NOT NULL THEN 'Article needs an author and a date.' END",
    "CASE WHEN len(both_) > 0 THEN concat('Already declared: ', array_to_string(both_, ', '), '; merge, do not repeat.') END",
])


GRAPH_PARTS = [*_PARTS, "jsonld"]
GRAPH_CTES = O.SCHEMA_TYPES.strip() + "," + _VALUES.strip() + "," + _GRAPH
GRAPH_SELECT = f"""SELECT page_id, array_to_string(ex, ',') AS existing_types, array_to_string(sg, ',') AS suggested_types, len(sg) AS n_suggested,
 array_to_string(list_filter([{_NOTES}], lambda z: z IS NOT NULL), ' ') AS notes,
 concat('{{"@context":"https://schema.org","@graph":[', array_to_string(list_filter([j0, j1, j2, j3, j4], lambda z: z IS NOT NULL), ','), ']}}') AS json_ld FROM gg"""


@query("suggest_graph", with_extracts(f"SELECT * EXCLUDE (n_suggested) FROM ({GRAPH_SELECT})", GRAPH_PARTS, extra=GRAPH_CTES))
def _(spark, sf):
    return G.suggest_graph(_values(spark, sf))


# --- texts ------------------------------------------------------------------

_F1, _F2 = (f"regexp_extract(x, {lit(T.FIELD_LINE)}, {i})" for i in (1, 2))
_ISF = f"regexp_matches(x, {lit(T.FIELD_LINE)}) AND len(string_split({O.collapse(_F1)}, ' ')) <= 3 AND NOT ends_with(x, ':')"
_STEP = f"regexp_matches(x, {lit(T.STEP_LINE)})"
_DOCS = f"""WITH docs AS ({X.DOCS_AUG}),
ln0 AS (SELECT doc_id, unnest(t) AS raw, unnest(range(len(t))) AS i FROM (SELECT doc_id, string_split_regex(content, {lit(T.LINE_BREAK)}) AS t FROM docs)),
ln AS (SELECT doc_id, i, x, {_ISF} AS isf FROM (SELECT doc_id, i, {strip('raw')} AS x FROM ln0) WHERE x <> ''),
fld AS (SELECT doc_id, replace(lower({strip(_F1)}), ' ', '') AS k, arg_max({strip(_F2)}, i) AS v FROM ln WHERE isf GROUP BY 1, 2),
fm AS (SELECT doc_id, map(list(k), list(v)) AS m FROM fld GROUP BY 1),
pr AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS px FROM ln WHERE NOT isf),
pl AS (SELECT doc_id, list(x ORDER BY n) AS prose, count_if(ends_with(x, '?')) AS nq, count_if({_STEP}) AS ns, sum(len(string_split({O.collapse('x')}, ' '))) AS nw FROM pr GROUP BY 1),
d AS (SELECT docs.doc_id, {strip('content')} = '' AS empty_input, m, prose, {strip("array_to_string(prose[2:], ' ')")} AS rest, coalesce(nq, 0) AS nq, coalesce(ns, 0) AS ns, coalesce(nw, 0) AS nw FROM docs LEFT JOIN fm USING (doc_id) LEFT JOIN pl USING (doc_id)),
qa AS (SELECT doc_id, list({typed('Question', ('name', js('px')), ('acceptedAnswer', typed('Answer', ('text', js('x')))))} ORDER BY n) AS pairs FROM pr WHERE ends_with(px, '?') AND NOT ends_with(x, '?') GROUP BY 1),
st0 AS (SELECT doc_id, {strip(f"regexp_extract(x, {lit(T.STEP_LINE)}, 1)")} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS p, n FROM pr WHERE {_STEP}),
st AS (SELECT doc_id, list({typed('HowToStep', ('position', 'CAST(p AS VARCHAR)'), ('text', js('s')))} ORDER BY n) AS steps FROM st0 GROUP BY 1),
ns AS (SELECT doc_id, arg_min(x, n) AS lead_line FROM pr WHERE NOT {_STEP} GROUP BY 1)
"""


def fv(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(m[{lit(k)}], '')" for k in keys) + ", NULL)"


def _sentence(x):
    return f"left({strip(f'''coalesce(nullif(regexp_extract({strip(x)}, {lit(T.SENTENCE)}, 1), ''), {strip(x)})''')}, 300)"


_P1 = "prose[1]"
_DESC = f"coalesce({fv('description')}, nullif(rest, ''))"
_BODY = f"CASE WHEN {fv('headline', 'title', 'name')} IS NULL THEN rest ELSE {strip(chr(97) + 'rray_to_string(prose, ' + lit(' ') + ')')} END"


def _addr():
    props: dict[str, list[str]] = {}
    for k, p in ADDRESS_FIELDS:
        props.setdefault(p, []).insert(0, k)
    every = fv(*[k for ks in props.values() for k in ks])
    return when_(every, typed("PostalAddress", *[(p, jsn(fv(*ks))) for p, ks in props.items()]))


def _org(kind):
    name = f"coalesce({fv('name', 'organization', 'business', 'company')}, {_P1})"
    social = fv("sameas", "social", "profiles")
    same = f"CAST(to_json(list_filter(list_transform(string_split({social}, ','), lambda z: {strip('z')}), lambda z: z <> '')) AS VARCHAR)"
    need = f"({name}) IS NOT NULL" + (f" AND ({_addr()}) IS NOT NULL" if kind == "LocalBusiness" else "")
    return need, typed(
        kind, ("name", js(name)), ("url", jsn(fv("url"))), ("logo", jsn(fv("logo"))), ("email", jsn(fv("email"))),
        ("telephone", jsn(fv("telephone", "phone"))), ("priceRange", jsn(fv("pricerange"))), ("address", _addr()),
        ("description", jsn(_DESC)), ("sameAs", when_(social, same)), context=True)


def _build():
    art = f"coalesce({fv('headline', 'title', 'name')}, {_P1})"
    pers = fv("author", "by", "writer")
    pub = fv("publisher")
    yield "Article", f"({art}) IS NOT NULL", typed(
        "Article", ("headline", js(art)), ("description", jsn(f"coalesce({fv('description', 'summary')}, CASE WHEN ({_BODY}) <> '' THEN {_sentence(_BODY)} END)")),
        ("articleBody", jsn(f"nullif({_BODY}, '')")), ("author", when_(pers, typed("Person", ("name", js(pers))))),
        ("datePublished", jsn(fv("datepublished", "published", "date"))), ("image", jsn(fv("image"))), ("url", jsn(fv("url"))),
        ("publisher", when_(pub, typed("Organization", ("name", js(pub))))), context=True)
    yield "FAQPage", "pairs IS NOT NULL", typed("FAQPage", ("mainEntity", "concat('[', array_to_string(pairs, ','), ']')"), context=True)
    yield "HowTo", "steps IS NOT NULL", typed(
        "HowTo", ("name", js(f"coalesce({fv('name', 'title')}, lead_line, 'How to')")), ("step", "concat('[', array_to_string(steps, ','), ']')"),
        ("totalTime", jsn(fv("totaltime", "time", "duration"))), context=True)
    yield ("Organization", *_org("Organization"))
    yield ("LocalBusiness", *_org("LocalBusiness"))
    name = f"coalesce({fv('name', 'product', 'title')}, {_P1})"
    price, cur, stock, brand = fv("price", "cost"), fv("currency", "pricecurrency"), fv("availability", "stock"), fv("brand", "manufacturer")
    offer = typed(
        "Offer", ("price", js(f"coalesce(nullif(regexp_replace({price}, '[^\\p{{Nd}}.]', '', 'g'), ''), {price})")), ("priceCurrency", js(f"coalesce({cur}, 'GBP')")),
        ("availability", when_(stock, js(f"concat('https://schema.org/', replace({stock}, ' ', ''))"))), ("url", jsn(fv("url"))))
    yield "Product", f"({name}) IS NOT NULL", typed(
        "Product", ("name", js(name)), ("description", jsn(_DESC)), ("sku", jsn(fv("sku"))), ("mpn", jsn(fv("mpn"))), ("image", jsn(fv("image"))),
        ("brand", when_(brand, typed("Brand", ("name", js(brand))))), ("offers", when_(price, offer)), context=True)
    name = f"coalesce({fv('name', 'event', 'title')}, {_P1})"
    start, place, org = fv("startdate", "start", "date", "when"), fv("location", "venue", "where"), fv("organizer", "organiser", "host")
    yield "Event", f"({name}) IS NOT NULL AND ({start}) IS NOT NULL", typed(
        "Event", ("name", js(name)), ("startDate", js(start)), ("endDate", jsn(fv("enddate", "end"))), ("location", when_(place, typed("Place", ("name", js(place))))),
        ("description", jsn(_DESC)), ("url", jsn(fv("url"))), ("image", jsn(fv("image"))), ("organizer", when_(org, typed("Organization", ("name", js(org))))), context=True)
    crumbs = f"list_filter(list_transform(string_split_regex(coalesce({fv('breadcrumb', 'trail', 'path')}, {_P1}, ''), {lit(T.TRAIL_BREAK)}), lambda z: {strip('z')}), lambda z: z <> '')"
    base = f"rtrim(coalesce({fv('url', 'baseurl')}, ''), '/')"
    slug = "trim(regexp_replace(lower(z), '[^a-z0-9]+', '-', 'g'), '-')"
    item = obj(("@type", "'\"ListItem\"'"), ("position", "CAST(i AS VARCHAR)"), ("name", js("z")), ("item", f"CASE WHEN {base} <> '' THEN {js(f'''concat({base}, '/', CASE WHEN i = 1 THEN '' ELSE {slug} END)''')} END"))
    yield "BreadcrumbList", f"len({crumbs}) >= 2", typed("BreadcrumbList", ("itemListElement", f"concat('[', array_to_string(list_transform({crumbs}, lambda z, i: {item}), ','), ']')"), context=True)
    name = f"coalesce({fv('name', 'title')}, {_P1})"
    yield "WebPage", f"({name}) IS NOT NULL", typed(
        "WebPage", ("name", js(name)), ("description", jsn(f"coalesce({fv('description')}, CASE WHEN len(prose) > 1 THEN nullif({_sentence('rest')}, '') END)")),
        ("url", jsn(fv("url"))), ("inLanguage", jsn(fv("lang", "language"))), context=True)


_BUILT = {k: (need, js_) for k, need, js_ in _build()}
_JOINED = "FROM d LEFT JOIN qa USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN ns USING (doc_id)"
_TYPE_SQL = (
    f"CASE WHEN nq >= 2 THEN 'FAQPage' WHEN d.ns >= 2 THEN 'HowTo' WHEN {fv('price', 'sku')} IS NOT NULL THEN 'Product' WHEN {fv('startdate', 'start')} IS NOT NULL THEN 'Event' "
    f"WHEN {fv(*[k for k, _ in ADDRESS_FIELDS])} IS NOT NULL THEN 'LocalBusiness' WHEN {fv('author', 'datepublished', 'published')} IS NOT NULL THEN 'Article' WHEN nw > 120 THEN 'Article' ELSE 'WebPage' END"
)


@query("looks_like_html", r"SELECT doc_id AS id, regexp_matches(text, '<\s*[a-zA-Z!/]') AS is_html FROM documents UNION ALL SELECT page_id, regexp_matches(html, '<\s*[a-zA-Z!/]') FROM pages")
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    both = docs.unionByName(X.pages(spark, sf).select(F.col("page_id").alias("id"), F.col("html").alias("t")))
    return both.select("id", T.looks_like_html(F.col("t")).alias("is_html"))


@query("split_fields", _DOCS + "SELECT d.doc_id, coalesce((SELECT string_agg(concat(k, '=', v), '|' ORDER BY k) FROM fld WHERE fld.doc_id = d.doc_id), '') AS fields, CAST(coalesce(len(prose), 0) AS INT) AS n_prose, md5(coalesce(array_to_string(prose, '|'), '')) AS prose FROM d")
def _(spark, sf):
    df = T.prepared(X.docs_aug(spark, sf), html=False)
    keys = F.array_sort(F.array_distinct(F.transform("fields", lambda f: f["key"])))
    shown = F.transform(
        keys,
        lambda k: F.concat(k, F.lit("="), F.try_element_at(F.filter("fields", lambda f: f["key"] == k), F.lit(-1))["value"]),
    )
    return df.select(
        "doc_id", F.array_join(shown, "|").alias("fields"), F.size("prose").alias("n_prose"),
        F.md5(F.encode(F.array_join("prose", "|"), "UTF-8")).alias("prose"),
    )


@query("detect_type", _DOCS + f"SELECT d.doc_id, {_TYPE_SQL} AS schema_type FROM d")
def _(spark, sf):
    return T.prepared(X.docs_aug(spark, sf), html=False).select("doc_id", T.detect_type().alias("schema_type"))


def _generator(key, kind):
    need, json = _BUILT[kind]

    @query(key, _DOCS + f"SELECT d.doc_id, CASE WHEN NOT empty_input AND {need} THEN {json} ELSE '' END AS json_ld {_JOINED}")
    def _(spark, sf):
        return T.generate(X.docs_aug(spark, sf), kind, html=False).select("doc_id", "json_ld")


for _k, _t in {
    "gen_article": "Article", "gen_faq": "FAQPage", "gen_howto": "HowTo", "gen_organization": "Organization",
    "gen_local_business": "LocalBusiness", "gen_product": "Product", "gen_event": "Event",
    "gen_breadcrumbs": "BreadcrumbList", "gen_webpage": "WebPage",
}.items():
    _generator(_k, _t)


_CHOSEN = "CASE " + " ".join(f"WHEN kind = '{k}' AND {need} THEN {json}" for k, (need, json) in _BUILT.items()) + " ELSE '' END"


@query("gen_documents", _DOCS + f"SELECT doc_id, schema_type, json_ld FROM (SELECT doc_id, CASE WHEN empty_input THEN 'auto' ELSE kind END AS schema_type, CASE WHEN empty_input THEN '' ELSE {_CHOSEN} END AS json_ld FROM (SELECT *, {_TYPE_SQL} AS kind {_JOINED}))")
def _(spark, sf):
    return T.generate(X.docs_aug(spark, sf), html=False).select("doc_id", "schema_type", "json_ld")


# Texts of both kinds: the documents, and the pages as pasted HTML. In SQL the
# blocks of what is markup stand in for the lines of plain text, and its title for the fields.
_HTML = f"regexp_matches({strip('content')}, '<\\s*[a-zA-Z!/]')"


def _swapped(sql: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        assert sql.count(old) == 1, old
        sql = sql.replace(old, new)
    return sql


_MIXED = _swapped(
    _DOCS,
    (f"WITH docs AS ({X.DOCS_AUG}),", f"""WITH aug AS ({X.PAGES_AUG}), docs0 AS ({X.DOCS_AUG}), docs AS (SELECT * FROM docs0 WHERE NOT {_HTML}),
src AS (SELECT -page_id - 1 AS page_id, url, html FROM aug UNION ALL SELECT doc_id, 'https://example.invalid/', content FROM docs0 WHERE {_HTML}),{O.TOKENS},{O.TITLE},{O.BLOCKS},
every AS (SELECT doc_id, content FROM docs UNION ALL SELECT page_id, html FROM src),
pg AS (SELECT page_id AS doc_id, arg_min(text, ord) FILTER (tag <> 'p') AS head, list(text ORDER BY ord) FILTER (tag = 'p') AS bodies, list(text ORDER BY ord) AS texts FROM block GROUP BY 1),"""),
    (" AS v FROM ln WHERE isf GROUP BY 1, 2),", f" AS v FROM ln WHERE isf GROUP BY 1, 2 UNION ALL SELECT page_id, 'title', title FROM title WHERE {strip('title')} <> ''),"),
    ("AS px FROM ln WHERE NOT isf)", "AS px FROM (SELECT doc_id, i, x FROM ln WHERE NOT isf UNION ALL SELECT page_id, ord, text FROM block))"),
    ("FROM docs LEFT JOIN fm", "FROM every docs LEFT JOIN fm"),
    ("qa AS (SELECT doc_id", "ql AS (SELECT doc_id"),
) + f""",
fq0 AS (SELECT page_id, ord, tag, text, first_value(CASE WHEN tag = 'p' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer FROM block),
qb AS (SELECT page_id AS doc_id, list({typed('Question', ('name', js('text')), ('acceptedAnswer', typed('Answer', ('text', js('answer')))))} ORDER BY ord) AS pairs FROM fq0 WHERE tag <> 'p' AND ends_with(text, '?') AND answer IS NOT NULL GROUP BY 1),
qa AS (SELECT doc_id, coalesce(qb.pairs, ql.pairs) AS pairs FROM ql FULL JOIN qb USING (doc_id))
"""
# An article without a title takes its first heading, and the paragraphs as its text.
_ARTICLE = "kind = 'Article' AND head IS NOT NULL AND " + fv("headline", "title", "name") + " IS NULL"
_WARN = {
    "Article": [(f"coalesce({fv('headline', 'title', 'name')}, {_P1}, '') = ''", "A headline is needed.")],
    "FAQPage": [("pairs IS NULL", "No question and answer found.")],
    "HowTo": [("steps IS NULL", "No steps found.")],
    "LocalBusiness": [(f"coalesce({fv('name', 'organization', 'business', 'company')}, {_P1}) IS NULL", "A name is needed.")],
    "Product": [(f"coalesce({fv('name', 'product', 'title')}, {_P1}) IS NULL", "A product name is needed.")],
    "Event": [(f"coalesce({fv('name', 'event', 'title')}, {_P1}) IS NULL", "An event name is needed.")],
    "WebPage": [(f"coalesce({fv('name', 'title')}, {_P1}) IS NULL", "A page title is needed.")],
}
_SAY = {
    "Article": [(f"{fv('author', 'by', 'writer')} IS NULL", "No author given."), (f"{fv('datepublished', 'published', 'date')} IS NULL", "No publication date given.")],
    "FAQPage": [("len(pairs) = 1", "Only one pair found.")],
    "HowTo": [(f"{fv('totaltime', 'time', 'duration')} IS NULL", "No duration given.")],
    "LocalBusiness": [(f"coalesce({fv('name', 'organization', 'business', 'company')}, {_P1}) IS NOT NULL AND {fv('openinghours', 'hours')} IS NULL", "No opening times given.")],
    "Product": [(f"{fv('price', 'cost')} IS NULL", "No price given."), (f"{fv('price', 'cost')} IS NOT NULL AND {fv('currency', 'pricecurrency')} IS NULL", "No currency given; GBP was assumed.")],
    "Event": [(f"{fv('location', 'venue', 'where')} IS NULL", "No location given.")],
}


def _said(messages, first="NULL"):
    said = [f"CASE WHEN kind = '{k}' AND {c} THEN {lit(t)} END" for k, ms in messages.items() for c, t in ms]
    return f"array_to_string(list_filter([{', '.join([first, *said])}], lambda z: z IS NOT NULL), ' ')"


@query("gen_all", _MIXED + f"""SELECT doc_id, CASE WHEN empty_input THEN 'auto' ELSE kind END AS schema_type, CASE WHEN empty_input THEN '' ELSE {_CHOSEN} END AS json_ld,
 CASE WHEN empty_input THEN 'Nothing to work with.' ELSE {_said(_WARN)} END AS warnings, CASE WHEN empty_input THEN '' ELSE {_said(_SAY, "concat('Detected ', kind, '.')")} END AS notes
 FROM (SELECT * REPLACE (CASE WHEN {_ARTICLE} THEN list_concat([head], coalesce(bodies, texts)) ELSE prose END AS prose, CASE WHEN {_ARTICLE} THEN {strip("array_to_string(coalesce(bodies, texts), ' ')")} ELSE rest END AS rest)
 FROM (SELECT *, {_TYPE_SQL} AS kind {_JOINED} LEFT JOIN pg USING (doc_id)))""")
def _(spark, sf):
    pages = X.pages_aug(spark, sf).select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("content"))
    df = T.generate(X.docs_aug(spark, sf).unionByName(pages))
    return df.select(
        "doc_id", "schema_type", "json_ld", F.array_join("warnings", " ").alias("warnings"),
        F.array_join("notes", " ").alias("notes"),
    )


@query("jsonld_script_block", _page_sql(f"SELECT page_id, concat('<script type=\"application/ld+json\">', chr(10), {_ORG}, chr(10), '</script>') AS block FROM pv"))
def _(spark, sf):
    df = staged(_values(spark, sf), ["page_id"], {"j": F.to_json(G.organization())})
    return df.select("page_id", script_block(F.col("j")).alias("block"))
