"""Rule packs: page row → array of findings, one projection, no shuffle.

A rule is a column over the page's extracts and facts.  A query over one rule
builds only what that rule needs; a whole pack shares one extraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions import urls
from sitegrain.functions.columns import blank, let, remembered, staged
from sitegrain.functions.text import strip
from sitegrain.operators.extract import PARTS, extract, meta_value

FINDING = (
    "array<struct<rule:string,module:string,severity:string,title:string,detail:string,"
    "element:string,recommendation:string,line:int,items:int,meta:map<string,string>>>"
)


@dataclass(frozen=True)
class Rule:
    id: str
    module: str
    severity: str
    needs: tuple[str, ...]
    title: str
    advice: str
    find: Callable[[Rule], Column]


RULES: dict[str, Rule] = {}
PACKS: dict[str, list[str]] = {}


def rule(id: str, module: str, severity: str, needs: str, title: str, advice: str):
    """Register a rule; the function gives its findings column."""

    def add(fn):
        RULES[id] = Rule(id, module, severity, tuple(needs.split()), title, advice, fn)
        PACKS.setdefault(module, []).append(id)
        return fn

    return add


def none() -> Column:
    return F.array().cast(FINDING)


def joined(values: Column) -> Column:
    return F.array_join(values, "; ")


def finding(
    r: Rule,
    items: Column | None = None,
    detail: Column | None = None,
    element: Column | None = None,
    line: Column | None = None,
    severity: Column | None = None,
    **meta: Column,
) -> Column:
    """A finding struct; the title's {} stands for the number of items."""
    items = F.lit(1) if items is None else items
    before, _, after = r.title.partition("{}")
    title = F.lit(r.title) if "{}" not in r.title else F.concat(
        F.lit(before), items.cast("string"), F.lit(after)
    )
    pairs = [c for k, v in meta.items() for c in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(r.id).alias("rule"),
        F.lit(r.module).alias("module"),
        (F.lit(r.severity) if severity is None else severity).alias("severity"),
        title.alias("title"),
        (F.lit("") if detail is None else detail).alias("detail"),
        (F.lit("") if element is None else element).alias("element"),
        F.lit(r.advice).alias("recommendation"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        items.cast("int").alias("items"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("meta"),
    )


def once(condition: Column, found: Column) -> Column:
    """One finding per page where the condition holds."""
    return F.when(condition, F.array(found).cast(FINDING)).otherwise(none())


def each(array: Column, fn) -> Column:
    """One finding per element."""
    return F.transform(array, fn).cast(FINDING)


def grouped(r: Rule, offenders: Column, example, **meta) -> Column:
    """One finding for all offenders: their number, first line, first examples."""

    def made(o: Column) -> Column:
        found = finding(
            r,
            items=F.size(o),
            detail=joined(F.transform(F.slice(o, 1, example[1]), example[0])),
            line=F.get(o, F.lit(0))["line"],
            **{k: fn(o) for k, fn in meta.items()},
        )
        return F.when(F.size(o) > 0, F.array(found).cast(FINDING)).otherwise(none())

    return let(offenders, made)


# --- facts: single values several rules read --------------------------------

FACTS: dict[str, tuple[str, Callable[[], Column]]] = {
    "description": ("metas", lambda: meta_value(F.col("metas"), "name", "description")),
    "robots": ("metas", lambda: F.lower(F.coalesce(meta_value(F.col("metas"), "name", "robots"), F.lit("")))),
    "viewport": ("metas", lambda: meta_value(F.col("metas"), "name", "viewport")),
    "open_graph": (
        "metas",
        lambda: F.array(*[meta_value(F.col("metas"), "property", p) for p in K.REQUIRED_OPEN_GRAPH]),
    ),
    "twitter_name": ("metas", lambda: meta_value(F.col("metas"), "name", "twitter:card")),
    "twitter_property": ("metas", lambda: meta_value(F.col("metas"), "property", "twitter:card")),
    "h1s": ("headings", lambda: F.filter(F.col("headings"), lambda h: h["level"] == 1)),
}


# --- SEO --------------------------------------------------------------------


@rule("seo.missing-title", "seo", "high", "title", "The page has no title",
      "Write a unique title; it heads the search result.")
def _missing_title(r):
    return once(blank(F.col("title")), finding(r))


@rule("seo.title-too-short", "seo", "medium", "title", "The title is very short",
      "Say what the page is about and name the brand.")
def _short_title(r):
    t = F.col("title")
    return once(F.length(t).between(1, K.TITLE_MIN - 1), finding(r, detail=t, element=t))


@rule("seo.title-too-long", "seo", "low", "title", "The title will be cut off",
      "Shorten it and put the important words first.")
def _long_title(r):
    t = F.col("title")
    return once(F.length(t) > K.TITLE_MAX, finding(r, detail=t, element=t))


@rule("seo.missing-meta-description", "seo", "high", "description", "No meta description",
      "Summarise the page; otherwise the snippet is picked by the search engine.")
def _no_description(r):
    return once(F.col("description").isNull(), finding(r))


@rule("seo.empty-meta-description", "seo", "high", "description", "The meta description is empty",
      "Fill it in or remove the tag.")
def _empty_description(r):
    return once(F.length("description") == 0, finding(r))


@rule("seo.meta-description-too-short", "seo", "low", "description", "The meta description is short",
      "Use the room the snippet offers.")
def _short_description(r):
    d = F.col("description")
    return once(F.length(d).between(1, K.DESCRIPTION_MIN - 1), finding(r, element=d))


@rule("seo.meta-description-too-long", "seo", "low", "description", "The meta description will be cut off",
      "Shorten it to what a snippet shows.")
def _long_description(r):
    d = F.col("description")
    return once(F.length(d) > K.DESCRIPTION_MAX, finding(r, element=d))


@rule("seo.noindex", "seo", "critical", "robots", "The page asks not to be indexed",
      "Remove noindex if the page should be found.")
def _noindex(r):
    v = F.col("robots")
    return once(F.contains(v, F.lit("noindex")), finding(r, element=v))


@rule("seo.nofollow-page", "seo", "medium", "robots", "Links on the page are not followed",
      "Remove the page-wide nofollow unless it is meant.")
def _nofollow(r):
    v = F.col("robots")
    return once(F.contains(v, F.lit("nofollow")), finding(r, element=v))


@rule("seo.missing-canonical", "seo", "medium", "canonical", "No canonical URL",
      "Name the preferred address, so variants are not indexed apart.")
def _no_canonical(r):
    return once(blank(F.col("canonical")["resolved"]), finding(r))


@rule("seo.missing-h1", "seo", "high", "h1s", "No top-level heading", "Add one h1 with the page's topic.")
def _no_h1(r):
    return once(F.size("h1s") == 0, finding(r))


@rule("seo.multiple-h1", "seo", "medium", "h1s", "{} top-level headings",
      "Keep one h1 and make the others h2.")
def _many_h1(r):
    h = F.col("h1s")
    found = finding(
        r, items=F.size(h), detail=joined(F.transform(F.slice(h, 1, K.EXAMPLES_SHOWN), lambda x: x["text"])),
        line=F.get(h, F.lit(1))["line"],
    )
    return once(F.size(h) > 1, found)


@rule("seo.heading-level-skip", "seo", "low", "headings", "A heading level is skipped",
      "Descend one level at a time.")
def _heading_skip(r):
    h = F.col("headings")
    stepped = F.transform(
        h,
        lambda x, i: F.struct(
            x["level"].alias("level"), x["text"].alias("text"), x["line"].alias("line"),
            F.get(h, i - 1)["level"].alias("before"),
        ),
    )
    skips = F.filter(stepped, lambda x: x["level"] > x["before"] + 1)
    return each(
        skips,
        lambda x: finding(
            r, detail=F.concat(F.lit("h"), x["before"].cast("string"), F.lit(" to h"), x["level"].cast("string")),
            element=x["text"], line=x["line"],
        ),
    )


@rule("seo.empty-heading", "seo", "low", "headings", "{} headings without text",
      "Remove them or give them text.")
def _empty_heading(r):
    return grouped(
        r, F.filter(F.col("headings"), lambda h: strip(h["text"]) == ""),
        (lambda h: F.concat(F.lit("h"), h["level"].cast("string")), 0),
    )


@rule("seo.missing-lang", "seo", "medium", "lang", "The page names no language",
      "Set lang on the html element.")
def _no_lang(r):
    return once(blank(F.col("lang")), finding(r))


@rule("seo.missing-viewport", "seo", "high", "viewport", "No viewport setting",
      "Set the viewport to the device width, or phones zoom out.")
def _no_viewport(r):
    return once(blank(F.col("viewport")), finding(r))


@rule("seo.missing-open-graph", "seo", "low", "open_graph", "{} Open Graph tags are missing",
      "They make the card shown when the page is shared.")
def _no_open_graph(r):
    lacking = F.filter(
        F.zip_with(
            F.array(*[F.lit(p) for p in K.REQUIRED_OPEN_GRAPH]), F.col("open_graph"),
            lambda name, value: F.when(blank(value), name),
        ),
        lambda n: n.isNotNull(),
    )
    return let(
        lacking,
        lambda n: once(F.size(n) > 0, finding(r, items=F.size(n), detail=joined(n))),
    )


@rule("seo.missing-twitter-card", "seo", "info", "twitter_name twitter_property", "No Twitter card",
      "Name a card type to control the preview.")
def _no_twitter(r):
    return once(blank(F.col("twitter_name")) & blank(F.col("twitter_property")), finding(r))


@rule("seo.no-structured-data", "seo", "low", "jsonld", "No JSON-LD on the page",
      "Describe the page in schema.org terms to be eligible for rich results.")
def _no_jsonld(r):
    return once(F.size("jsonld") == 0, finding(r))


@rule("seo.thin-content", "seo", "medium", "text_length", "Little visible text",
      "Add copy that the server sends; scripts may be hiding it.")
def _thin(r):
    n = F.col("text_length")
    return once(n < K.THIN_CONTENT_CHARS, finding(r, detail=n.cast("string"), text_length=n))


@rule("seo.non-descriptive-link-text", "seo", "low", "links", "{} links say nothing about their target",
      "Describe the destination in the link text.")
def _vague(r):
    vague = F.filter(
        F.col("links"),
        lambda a: F.rtrim(F.lower(strip(a["text"])), F.lit(".!:")).isin(K.VAGUE_LINK_TEXT),
    )
    return grouped(
        r, vague, (lambda a: F.concat(a["text"], F.lit(" -> "), a["href"]), K.EXAMPLES_SHOWN)
    )


# --- images -----------------------------------------------------------------

_NAMES = (lambda m: urls.short_name(m["src"]), K.FILES_SHOWN)


def _where(predicate) -> Column:
    return F.filter(F.col("images"), predicate)


@rule("image.missing-alt", "images", "high", "images", "An image has no alt attribute",
      'Describe its purpose, or set alt="" if it is decoration.')
def _missing_alt(r):
    return each(
        _where(lambda m: m["alt"].isNull()),
        lambda m: finding(
            r, detail=m["src"], line=m["line"], src=m["src"],
            element=F.concat(F.lit('<img src="'), urls.short_name(m["src"]), F.lit('">')),
        ),
    )


@rule("image.empty-alt", "images", "info", "images", '{} images use alt=""', "Check that all are decoration.")
def _empty_alt(r):
    return grouped(r, _where(lambda m: m["alt"] == ""), _NAMES)


@rule("image.generic-alt", "images", "medium", "images", "An alt text says nothing",
      "Say what the image shows and why.")
def _generic_alt(r):
    return each(
        _where(lambda m: F.lower(strip(m["alt"])).isin(K.GENERIC_ALT)),
        lambda m: finding(
            r, detail=m["src"], line=m["line"], src=m["src"], alt=m["alt"],
            element=F.concat(F.lit('alt="'), m["alt"], F.lit('"')),
        ),
    )


@rule("image.alt-too-long", "images", "low", "images", "{} alt texts are very long",
      "Move long explanations into a caption.")
def _long_alt(r):
    return grouped(r, _where(lambda m: F.length(m["alt"]) > K.ALT_MAX_LENGTH), _NAMES)


@rule("image.missing-src", "images", "high", "images", "{} images have no source",
      "Give them a source or remove them.")
def _missing_src(r):
    return grouped(
        r, _where(lambda m: blank(m["raw_src"])), (lambda m: m["ord"].cast("string"), 0)
    )


@rule("image.no-dimensions", "images", "low", "images", "{} images reserve no space",
      "Set width and height, so the layout does not shift.")
def _no_dimensions(r):
    return grouped(r, _where(lambda m: blank(m["width"]) | blank(m["height"])), _NAMES)


@rule("image.legacy-format", "images", "low", "images picture_sources", "{} images come as PNG or JPEG only",
      "Offer WebP or AVIF beside them.")
def _legacy(r):
    old = _where(
        lambda m: urls.extension(m["src"]).isin(K.LEGACY_EXTENSIONS)
        & blank(m["srcset"])
        & (F.size("picture_sources") == 0)
    )
    return grouped(
        r, old, _NAMES,
        candidates=lambda o: F.to_json(F.transform(o, lambda m: m["src"])),
    )


@rule("image.no-lazy-loading", "images", "low", "images", "{} images far down load at once",
      "Let them load lazily; leave the first ones eager.")
def _not_lazy(r):
    late = _where(
        lambda m: (m["ord"] > K.ABOVE_FOLD_IMAGES)
        & (F.lower(F.coalesce(m["loading"], F.lit(""))) != "lazy")
    )
    return grouped(r, late, _NAMES)


@rule("image.duplicate-src", "images", "info", "images", "{} image sources repeat",
      "Harmless when cached; may show a component rendered too often.")
def _duplicates(r):
    # Sorted by source, equal sources are neighbours; a source repeats if it
    # equals the one before, and counts once.
    srcs = F.transform(
        _where(lambda m: ~blank(m["raw_src"])),
        lambda m: F.struct(m["src"].alias("src"), m["ord"].alias("ord")),
    )

    def repeated(s: Column) -> Column:
        marked = F.transform(
            s,
            lambda x, i: F.struct(
                x["ord"].alias("ord"), x["src"].alias("src"),
                (F.coalesce(F.get(s, i - 1)["src"] != x["src"], F.lit(True))
                 & (F.get(s, i + 1)["src"] == x["src"])).alias("hit"),
            ),
        )
        return F.array_sort(F.filter(marked, lambda x: x["hit"]))

    def made(d: Column) -> Column:
        shown = F.transform(F.slice(d, 1, K.FILES_SHOWN), lambda x: urls.short_name(x["src"]))
        return once(F.size(d) > 0, finding(r, items=F.size(d), detail=joined(shown)))

    return let(let(F.array_sort(srcs), repeated), made)


# --- links that need no probe -----------------------------------------------


def _insecure(field: str, attribute: str, r: Rule) -> Column:
    hits = F.filter(
        F.col(field), lambda x: (F.col("base_scheme") == "https") & x[attribute].startswith("http://")
    )
    return grouped(r, hits, (lambda x: x[attribute], K.EXAMPLES_SHOWN))


@rule("link.mixed-content-image", "links", "medium", "images", "{} images are loaded over plain HTTP",
      "Serve them over HTTPS; browsers block mixed content.")
def _mixed(r):
    return _insecure("images", "src", r)


@rule("link.insecure-http", "links", "low", "links", "{} links point at plain HTTP",
      "Link to the HTTPS address.")
def _insecure_link(r):
    return _insecure("links", "href", r)


@remembered
def found_by(rule_id: str) -> Column:
    return RULES[rule_id].find(RULES[rule_id])


@remembered
def fact(name: str) -> Column:
    return FACTS[name][1]()


# --- evaluation -------------------------------------------------------------


def needs_of(rule_ids: Iterable[str]) -> tuple[list[str], list[str]]:
    """(extract parts, facts) the rules read."""
    named = {n for i in rule_ids for n in RULES[i].needs}
    facts = [f for f in FACTS if f in named]
    parts = {n for n in named if n not in FACTS} | {FACTS[f][0] for f in facts}
    return [p for p in PARTS if p in parts], facts


def evaluated(pages: DataFrame, packs: dict[str, list[str]], also: Iterable[str] = ()) -> DataFrame:
    """Page rows with the extracts and one findings array per pack."""
    ids = [i for rules in packs.values() for i in rules]
    parts, facts = needs_of(ids)
    parts += [p for p in also if p not in parts and p not in FACTS]
    facts += [f for f in also if f in FACTS and f not in facts]
    df = extract(pages, parts)
    if facts:
        df = staged(df, df.columns, {f: fact(f) for f in facts})
    found = {
        name: F.concat(*[found_by(i) for i in rules]) if rules else none()
        for name, rules in packs.items()
    }
    return staged(df, df.columns, found)


def finding_rows(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Explode a findings array; ``seq`` is the emission order within the page."""
    return df.select("page_id", *keep, F.posexplode(column).alias("seq", "f")).select(
        "page_id", *keep, "seq", "f.*"
    )


def rule_rows(pages: DataFrame, rule_id: str) -> DataFrame:
    """Findings of one rule, as rows."""
    return finding_rows(evaluated(pages, {"found": [rule_id]}), "found")


def meta_text(meta: Column) -> Column:
    """``k=v|k=v`` in emission order, for flat outputs."""
    return F.array_join(
        F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"
    )


def flat(findings: DataFrame) -> DataFrame:
    return findings.select(
        "page_id", "rule", "module", "severity", "line", "items", "element", "detail",
        meta_text(F.col("meta")).alias("meta"),
    )


def register_pack(name: str, weight_label: str, rules: list[Rule]) -> None:
    """Extension point: a pack of further rules, evaluated and scored like the others.

    Registered again, a pack replaces what it was.
    """
    K.PACK_LABELS[name] = weight_label
    for gone in PACKS.get(name, []):
        RULES.pop(gone, None)
    RULES.update({r.id: r for r in rules})
    PACKS[name] = [r.id for r in rules]
