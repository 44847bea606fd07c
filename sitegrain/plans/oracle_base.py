"""DuckDB side of the check: the same extracts by joins and windows over tokens.

Written independently of the Spark plan (which works on arrays per page): here
every token is a row, lines are running sums, pairing is a windowed minimum.
"""

from __future__ import annotations

from sitegrain import constants as K
from sitegrain.functions.text import SPACE_CLASS, SPACES
from sitegrain.operators.tokens import ATTRIBUTE, token_pattern
from sitegrain.sources.fixtures import PAGES_AUG, SITE_PAGES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def dec(x: str) -> str:
    """The character references the data holds."""
    return (
        f"regexp_replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), "
        f"'&quot;', '\"'), '&amp;?', '&', 'g')"
    )


def strip(x: str) -> str:
    return f"trim({x}, {lit(SPACES)})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(SPACE_CLASS + '+')}, ' ', 'g'), ' ')"


def attr(name: str, attrs: str = "attrs") -> str:
    a = (
        f"list_filter({attrs}, lambda z: lower(regexp_extract(z, '^[^\\s/>][^\\s/=>]*')) = {lit(name)})[-1]"
    )
    raw = f"regexp_extract({a}, '(?s)^[^\\s/>][^\\s/=>]*\\s*=+\\s*(.*)$', 1)"
    bare = f"CASE WHEN regexp_matches({raw}, '^[\"'']') THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    return f"CASE WHEN contains({a}, '=') THEN {dec(bare)} END"


_H = inlist(K.HEADING_TAGS)
_HP = inlist(["p", *K.HEADING_TAGS])
_SCHEME = r"'^([a-zA-Z][a-zA-Z0-9+.\-]*):'"
_PRE = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def scheme(u):
    return f"lower(regexp_extract({u}, {_SCHEME}, 1))"


def authority(u):
    return f"regexp_extract({u}, '{_PRE}//([^/?#]*)', 1)"


def path(u):
    return f"regexp_extract({u}, '{_PRE}(?://[^/?#]*)?([^?#]*)', 1)"


def query(u):
    return rf"regexp_extract({u}, '^[^?#]*(\?[^#]*)', 1)"


def short_name(u):
    n = f"regexp_extract({path(u)}, '[^/]*$')"
    n = f"CASE WHEN {n} = '' THEN {u} ELSE {n} END"
    return f"CASE WHEN length({n}) <= 80 THEN {n} ELSE concat(substr({n}, 1, 79), '…') END"


def extension(u):
    return rf"lower(regexp_extract(regexp_extract({path(u)}, '[^/]*$'), '[^.].*?(\.[^.]*)$', 1))"


def resolved(name: str, source: str, h: str = "h") -> str:
    """CTEs that add ``abs`` to ``source`` (which has url and the raw reference h)."""
    tidy = r"CASE WHEN regexp_matches(a0, '[?#]$|\?#') THEN regexp_replace(regexp_replace(replace(a0, '?#', '#'), '#$', ''), '\?$', '') ELSE a0 END"
    return f"""
{name}_a AS (SELECT *, ltrim(translate({h}, chr(9)||chr(10)||chr(13), '')) AS hh, {scheme('url')} AS bs, concat({scheme('url')}, '://', {authority('url')}) AS bo, {path('url')} AS bp, {query('url')} AS bq FROM {source}),
{name}_b AS (SELECT *, {scheme('hh')} AS own FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN own <> '' THEN substr(hh, length(own) + 2) ELSE hh END AS rel FROM {name}_b),
{name}_d AS (SELECT *, regexp_extract(rel, '^[^?#]*') AS p, substr(rel, length(regexp_extract(rel, '^[^?#]*')) + 1) AS tail FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE regexp_replace(concat(CASE WHEN bp = '' THEN '/' ELSE regexp_extract(bp, '^.*/') END, p), '/{{2,}}', '/', 'g') END AS tgt FROM {name}_d),
{name}_f AS (SELECT *, list_reduce(string_split(tgt, '/'), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN s = '.' THEN acc ELSE concat(acc, '/', s) END, '') AS w FROM {name}_e),
{name}_g AS (SELECT *, CASE WHEN NOT contains(tgt, '/.') THEN tgt ELSE regexp_replace(concat(w, CASE WHEN regexp_matches(tgt, '/\\.\\.?$') AND NOT ends_with(w, '/') THEN '/' ELSE '' END), '^/+', '/') END AS dots FROM {name}_f),
{name}_h AS (SELECT *, CASE WHEN starts_with(rel, '//') THEN concat(bs, ':', rel) WHEN p = '' THEN concat(bo, bp, CASE WHEN regexp_matches(tail, '^\\?[^#]') THEN tail ELSE concat(bq, regexp_replace(tail, '^\\?', '')) END) ELSE concat(bo, dots, tail) END AS a0 FROM {name}_g),
{name} AS (SELECT * EXCLUDE (hh, bs, bo, bp, bq, own, rel, p, tail, tgt, w, dots, a0), CASE WHEN hh = '' THEN url WHEN own <> '' AND own <> bs THEN {h} ELSE {tidy} END AS abs FROM {name}_h)"""


TOKENS = f"""
tok0 AS (SELECT page_id, url, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, {lit(token_pattern(many="*"))}) AS t FROM src)),
tok AS (SELECT *, CAST(1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS line,
 CASE WHEN NOT starts_with(tok, '<') OR tok = '<' THEN 'text' WHEN regexp_matches(tok, '^</\\s*[a-zA-Z]') THEN 'end' WHEN NOT regexp_matches(tok, '^<[a-zA-Z]') THEN 'other' WHEN regexp_matches(tok, '(?is)</(?:script|style)\\s*>$') THEN 'raw' ELSE 'start' END AS kind,
 lower(regexp_extract(tok, '^</?\\s*([a-zA-Z][^\\s/>]*)', 1)) AS tag FROM tok0),
ev0 AS (SELECT page_id, url, pos * 2 AS k, pos, kind, tag, line, tok FROM tok
 UNION ALL SELECT page_id, url, pos * 2 + 1, pos, 'end', tag, line, '' FROM tok WHERE kind = 'start' AND ends_with(tok, '/>') AND tag NOT IN {inlist(K.VOID_TAGS)} AND NOT regexp_matches(tok, '=\\s*[^\\s"''>]+/>$')),
ev1 AS (SELECT *, sum(CASE WHEN tag IN {inlist(K.QUIET_TAGS)} AND kind = 'start' THEN 1 WHEN tag IN {inlist(K.QUIET_TAGS)} AND kind = 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM ev0),
ev AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS depth FROM ev1),
vis AS (SELECT page_id, pos, {dec('tok')} AS txt FROM ev WHERE kind = 'text' AND depth = 0)"""

_ATTRS = f"regexp_extract_all(regexp_extract(tok, '(?s)^<[a-zA-Z][^\\s/>]*(.*?)>?$', 1), {lit(ATTRIBUTE)})"

TITLE = f"""
t1 AS (SELECT *, lead(kind) OVER w AS nk, lead(pos) OVER w AS np FROM ev WHERE tag = 'title' WINDOW w AS (PARTITION BY page_id ORDER BY k)),
t2 AS (SELECT page_id, max_by(pos, k) AS a, max_by(np, k) AS b FROM t1 WHERE kind = 'start' AND nk = 'end' GROUP BY 1),
title AS (SELECT t2.page_id, {collapse("coalesce(string_agg(txt, '' ORDER BY pos), '')")} AS title FROM t2 LEFT JOIN vis ON vis.page_id = t2.page_id AND vis.pos > t2.a AND vis.pos < t2.b GROUP BY 1)"""

LANG = f"""
lang AS (SELECT page_id, max_by(struct_pack(v := {attr('lang')}), k).v AS lang FROM (SELECT *, {_ATTRS} AS attrs FROM ev WHERE tag = 'html' AND kind = 'start') GROUP BY 1)"""

METAS = f"""
meta AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS ord, attrs,
 {attr('name')} AS a_name, {attr('property')} AS a_property, {attr('http-equiv')} AS a_equiv, {attr('itemprop')} AS a_itemprop, {attr('content')} AS a_content, {attr('charset')} AS a_charset,
 FROM (SELECT *, {_ATTRS} AS attrs FROM ev WHERE tag = 'meta' AND kind = 'start')),
metav AS (SELECT page_id, 'name' AS key, lower(a_name) AS nm, arg_min(struct_pack(v := coalesce(a_content, CASE WHEN len(list_filter(attrs, lambda z: starts_with(lower(z), 'content'))) > 0 THEN '' END)), ord).v AS v FROM meta WHERE a_name IS NOT NULL GROUP BY ALL
 UNION ALL SELECT page_id, 'property', lower(a_property), arg_min(struct_pack(v := coalesce(a_content, CASE WHEN len(list_filter(attrs, lambda z: starts_with(lower(z), 'content'))) > 0 THEN '' END)), ord).v FROM meta WHERE a_property IS NOT NULL GROUP BY ALL)"""

CANONICAL = (
    f"""
can0 AS (SELECT *, {attr('href')} AS h, {attr('rel')} AS rel0 FROM (SELECT *, {_ATTRS} AS attrs FROM ev WHERE tag = 'link' AND kind = 'start')),
can1 AS (SELECT page_id, max_by(url, k) AS url, max_by(h, k) AS h FROM can0 WHERE coalesce(h, '') <> '' AND list_contains(string_split({collapse("lower(coalesce(rel0, ''))")}, ' '), 'canonical') GROUP BY 1),"""
    + resolved("canonical", "can1")
)

BLOCKS = f"""
b0 AS (SELECT page_id, k, pos, kind, tag, line,
 min(CASE WHEN kind = 'end' THEN k END) OVER (PARTITION BY page_id, tag ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS own_end,
 min(CASE WHEN kind = 'start' AND tag IN {_HP} THEN k END) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_block,
 min(CASE WHEN kind = 'start' OR tag = 'p' THEN k END) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_close
 FROM ev WHERE (kind = 'start' AND tag IN {inlist(K.CLOSES_PARAGRAPH)}) OR (kind = 'end' AND tag IN {_HP})),
b1 AS (SELECT page_id, k, pos, tag, line, own_end // 2 AS stop FROM b0 WHERE kind = 'start' AND tag IN {_H} AND own_end IS NOT NULL AND (next_block IS NULL OR own_end < next_block)
 UNION ALL SELECT page_id, k, pos, tag, line, coalesce(next_close // 2, 2147483646) FROM b0 WHERE kind = 'start' AND tag = 'p'),
b2 AS (SELECT b1.page_id, b1.k, b1.tag, b1.line, {collapse("coalesce(string_agg(txt, '' ORDER BY vis.pos), '')")} AS txt FROM b1 LEFT JOIN vis ON vis.page_id = b1.page_id AND vis.pos > b1.pos AND vis.pos < b1.stop GROUP BY 1, 2, 3, 4),
heading AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS ord, CAST(substr(tag, 2, 1) AS INT) AS level, txt AS text, line FROM b2 WHERE tag <> 'p'),
block AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS ord, tag, txt AS text, line, CAST(length(txt) - length(replace(txt, ' ', '')) + 1 AS INT) AS words FROM b2 WHERE txt <> '')"""

IMAGES = (
    f"""
im0 AS (SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS ord, coalesce(nullif({attr('src')}, ''), {attr('data-src')}, '') AS h, {attr('alt')} AS alt, {attr('width')} AS width, {attr('height')} AS height, {attr('loading')} AS loading, {attr('srcset')} AS srcset, line
 FROM (SELECT *, {_ATTRS} AS attrs FROM ev WHERE tag = 'img' AND kind = 'start')),"""
    + resolved("im1", "im0")
    + """,
image AS (SELECT page_id, ord, abs AS src, h AS raw_src, alt, width, height, loading, srcset, line FROM im1)"""
)

SOURCES = f"""
picsrc AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS ord, srcset FROM (SELECT page_id, k, coalesce(nullif({attr('srcset')}, ''), {attr('src')}) AS srcset FROM (SELECT *, {_ATTRS} AS attrs FROM ev WHERE tag = 'source' AND kind = 'start')) WHERE coalesce(srcset, '') <> '')"""

LINKS = (
    f"""
a0 AS (SELECT *, CASE WHEN kind = 'start' THEN {attr('href')} END AS h FROM (SELECT *, CASE WHEN kind = 'start' THEN {_ATTRS} END AS attrs FROM ev WHERE tag = 'a')),
a1 AS (SELECT *, lead(kind) OVER w AS nk, lead(pos) OVER w AS np FROM a0 WHERE kind = 'end' OR (coalesce(h, '') <> '' AND NOT regexp_matches(h, '^(#|javascript:|mailto:|tel:)')) WINDOW w AS (PARTITION BY page_id ORDER BY k)),
a2 AS (SELECT page_id, url, k, pos, np, h, line, {attr('rel')} AS rel_, {attr('target')} AS target_ FROM a1 WHERE kind = 'start' AND nk = 'end'),
a3 AS (SELECT a2.page_id, a2.k, {collapse("coalesce(string_agg(txt, '' ORDER BY vis.pos), '')")} AS text FROM a2 LEFT JOIN vis ON vis.page_id = a2.page_id AND vis.pos > a2.pos AND vis.pos < a2.np GROUP BY 1, 2),
"""
    + resolved("a4", "a2").strip()
    + """,
link AS (SELECT a4.page_id, CAST(row_number() OVER (PARTITION BY a4.page_id ORDER BY a4.k) AS INT) AS ord, abs AS href, text, coalesce(rel_, '') AS rel, coalesce(target_, '') AS target, line, a4.url FROM a4 JOIN a3 USING (page_id, k))"""
)

JSONLD = f"""
jsonld AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS ord, {strip("regexp_extract(tok, '(?is)^<script[^>]*>(.*)</script', 1)")} AS body FROM ev WHERE kind = 'raw' AND tag = 'script' AND regexp_matches(tok, '(?i)^<script[^>]*type="application/ld.json"'))"""

TEXTLEN = f"""
textlen AS (SELECT src.page_id, CAST(coalesce(sum(length({strip('txt')})), 0) AS INT) AS text_length FROM src LEFT JOIN vis USING (page_id) GROUP BY 1)"""

# The same texts through the JSON functions: a type, or an item of a list of
# types, stands by the number of the node it belongs to.
SCHEMA_TYPES = """
jt AS (SELECT page_id, ord, t.id, t.parent, t.type, CAST(t.key AS VARCHAR) AS key, t.value ->> '$' AS v FROM (SELECT * FROM jsonld WHERE json_valid(body)) j, json_tree(j.body) t),
jx AS (SELECT page_id, ord, parent AS owner, id, v FROM jt WHERE key = '@type' AND type = 'VARCHAR'
 UNION ALL SELECT i.page_id, i.ord, l.parent, i.id, i.v FROM jt i JOIN jt l ON l.page_id = i.page_id AND l.ord = i.ord AND l.id = i.parent AND l.key = '@type' AND l.type = 'ARRAY' WHERE i.type NOT IN ('OBJECT', 'ARRAY')
 UNION ALL SELECT page_id, ord, 0, 0, '(unparseable)' FROM jsonld WHERE NOT json_valid(body)),
declared AS (SELECT page_id, list(v ORDER BY ord, owner, id) AS types FROM (SELECT * FROM jx QUALIFY row_number() OVER (PARTITION BY page_id, v ORDER BY ord, owner, id) = 1) GROUP BY 1)"""

PARTS = {
    "title": TITLE, "lang": LANG, "meta": METAS, "canonical": CANONICAL, "block": BLOCKS,
    "image": IMAGES, "picsrc": SOURCES, "link": LINKS, "jsonld": JSONLD, "textlen": TEXTLEN,
}

OK_FILTER = "status < 400 AND contains(lower(content_type), 'html')"


def with_extracts(select: str, parts: list[str], source: str = "aug", extra: str = "") -> str:
    """A full statement: source → tokens → the extracts asked for → ``select``.

    source: ``pages`` (as given), ``aug`` (auditable augmented pages) or ``site``.
    """
    src = {
        "pages": "src AS (SELECT page_id, url, html FROM pages)",
        "aug": f"aug AS ({PAGES_AUG}), src AS (SELECT * FROM aug WHERE {OK_FILTER})",
        "site": f"src AS ({SITE_PAGES})",
    }[source]
    ctes = [src, TOKENS, *[PARTS[p] for p in parts]]
    if extra:
        ctes.append(extra)
    return "WITH " + ",".join(ctes) + "\n" + select
