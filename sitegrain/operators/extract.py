"""Page extracts: one row per page, nested arrays, built in one narrow stage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.constants import (
    CLOSES_PARAGRAPH,
    HEADING_TAGS,
    SKIPPED_HREF_PREFIXES,
    STRUCTURAL_TAGS,
)
from sitegrain.functions import urls
from sitegrain.functions.columns import blank, last, non_empty, remembered, staged
from sitegrain.functions.text import collapse, strip, word_count
from sitegrain.operators.tokens import (
    attribute,
    text_between,
    tokenised,
    visible_length,
)

# Tags each extract reads; the rest never becomes an event.
_TAGS = {
    "title": ["title"],
    "lang": ["html"],
    "metas": ["meta"],
    "canonical": ["link"],
    "headings": CLOSES_PARAGRAPH,
    "blocks": CLOSES_PARAGRAPH,
    "images": ["img"],
    "picture_sources": ["source"],
    "links": ["a"],
    "jsonld": ["script"],
    "text_length": [],
    "has_article": ["article"],
    "nodes": STRUCTURAL_TAGS,
}
_READ = ["a", "html", "img", "link", "meta", "script", "source"]
_NEED_TEXT = {"title", "headings", "blocks", "links", "text_length"}
PARTS = [p for p in _TAGS if p != "nodes"]


def _starts(events: Column, *tags: str) -> Column:
    return F.filter(events, lambda e: (e["kind"] == "start") & e["tag"].isin(*tags))


def _with_attributes(events: Column) -> Column:
    return F.transform(
        events, lambda e: F.struct(e["line"].alias("line"), e["attrs"].alias("a"))
    )


def _adjacent(seq: Column, opens, closes) -> Column:
    """Starts whose very next element in ``seq`` ends them.

    ``seq`` holds only what can end or replace the open element, so looking one
    ahead is enough and the whole pairing is linear.
    """
    paired = F.transform(
        seq,
        lambda e, i: F.struct(
            e["pos"].alias("pos"), e["kind"].alias("kind"), e["tag"].alias("tag"),
            e["line"].alias("line"), e["attrs"].alias("attrs"),
            F.get(seq, i + 1).alias("next"),
        ),
    )
    return F.filter(paired, lambda e: opens(e) & closes(e))


def _is_start(e: Column) -> Column:
    return e["kind"] == "start"


def _title(seq: Column, texts: Column) -> Column:
    pairs = _adjacent(seq, _is_start, lambda e: e["next"]["kind"] == "end")
    hit = last(pairs)
    return F.when(hit.isNotNull(), collapse(text_between(texts, hit["pos"], hit["next"]["pos"])))


def _spans_of(pairs: Column) -> Column:
    return F.transform(
        pairs,
        lambda e: F.struct(
            e["pos"].alias("pos"), e["tag"].alias("tag"), e["line"].alias("line"),
            F.coalesce(e["next"]["pos"], F.lit(2147483646)).alias("stop"),
        ),
    )


def _level_sequence(events: Column, tag: str) -> Column:
    """The starts that take over the current block, and one level's own ends."""
    return F.filter(
        events,
        lambda e: ((e["kind"] == "start") & e["tag"].isin("p", *HEADING_TAGS))
        | ((e["kind"] == "end") & (e["tag"] == tag)),
    )


def _level_spans(seq: Column, tag: str) -> Column:
    return _spans_of(
        _adjacent(
            seq,
            lambda e: (e["kind"] == "start") & (e["tag"] == tag),
            lambda e: e["next"]["kind"] == "end",
        )
    )


def _paragraph_sequence(events: Column) -> Column:
    return F.filter(
        events,
        lambda e: ((e["kind"] == "start") & e["tag"].isin(CLOSES_PARAGRAPH))
        | ((e["kind"] == "end") & (e["tag"] == "p")),
    )


def _paragraph_spans(seq: Column) -> Column:
    pairs = _adjacent(seq, lambda e: (e["kind"] == "start") & (e["tag"] == "p"), lambda e: F.lit(True))
    return _spans_of(pairs)


def _with_text(spans: Column, texts: Column) -> Column:
    return F.transform(
        F.array_sort(spans),
        lambda s: F.struct(
            s["tag"].alias("tag"),
            collapse(text_between(texts, s["pos"], s["stop"])).alias("text"),
            s["line"].alias("line"),
        ),
    )


def _headings(blocks_all: Column) -> Column:
    only = F.filter(blocks_all, lambda b: b["tag"] != "p")
    return F.transform(
        only,
        lambda b, i: F.struct(
            (i + 1).alias("ord"),
            F.substring(b["tag"], 2, 1).cast("int").alias("level"),
            b["text"].alias("text"),
            b["line"].alias("line"),
        ),
    )


def _blocks(blocks_all: Column) -> Column:
    kept = F.filter(blocks_all, lambda b: b["text"] != "")
    return F.transform(
        kept,
        lambda b, i: F.struct(
            (i + 1).alias("ord"), b["tag"].alias("tag"), b["text"].alias("text"),
            b["line"].alias("line"), word_count(b["text"]).alias("words"),
        ),
    )


def _images(events: Column, base: dict[str, Column]) -> Column:
    def one(x: Column, i: Column) -> Column:
        a = x["a"]
        raw = F.coalesce(non_empty(attribute(a, "src")), attribute(a, "data-src"), F.lit(""))
        return F.struct(
            (i + 1).alias("ord"), raw.alias("raw_src"), attribute(a, "alt").alias("alt"),
            attribute(a, "width").alias("width"), attribute(a, "height").alias("height"),
            attribute(a, "loading").alias("loading"), attribute(a, "srcset").alias("srcset"),
            x["line"].alias("line"),
        )

    found = F.transform(_with_attributes(_starts(events, "img")), one)
    return F.transform(
        found,
        lambda m: F.struct(
            m["ord"].alias("ord"), urls.resolve(m["raw_src"], base).alias("src"),
            *[m[f].alias(f) for f in ("raw_src", "alt", "width", "height", "loading", "srcset", "line")],
        ),
    )


def _picture_sources(events: Column) -> Column:
    sets = F.transform(
        _with_attributes(_starts(events, "source")),
        lambda x: F.coalesce(non_empty(attribute(x["a"], "srcset")), attribute(x["a"], "src")),
    )
    return F.filter(sets, lambda s: ~blank(s))


def _link_sequence(events: Column) -> Column:
    """Followable link starts and every link end."""
    seen = F.transform(
        F.filter(events, lambda e: e["tag"] == "a"),
        lambda e: F.struct(
            e["pos"].alias("pos"), e["kind"].alias("kind"), e["tag"].alias("tag"),
            e["line"].alias("line"), e["attrs"].alias("attrs"),
            F.when(e["kind"] == "start", attribute(e["attrs"], "href")).alias("href"),
        ),
    )

    def followable(e: Column) -> Column:
        skipped = F.lit(False)
        for prefix in SKIPPED_HREF_PREFIXES:
            skipped = skipped | e["href"].startswith(prefix)
        return (e["kind"] == "end") | (~blank(e["href"]) & ~F.coalesce(skipped, F.lit(True)))

    return F.filter(seen, followable)


def _links(seq: Column, texts: Column, base: dict[str, Column]) -> Column:
    pairs = _adjacent(seq, _is_start, lambda e: e["next"]["kind"] == "end")
    read = F.transform(
        pairs,
        lambda e, i: F.struct(
            (i + 1).alias("ord"),
            e["attrs"].alias("a"),
            collapse(text_between(texts, e["pos"], e["next"]["pos"])).alias("text"),
            e["line"].alias("line"),
        ),
    )
    return F.transform(
        read,
        lambda x: F.struct(
            x["ord"].alias("ord"),
            urls.resolve(attribute(x["a"], "href"), base).alias("href"),
            x["text"].alias("text"),
            F.coalesce(attribute(x["a"], "rel"), F.lit("")).alias("rel"),
            F.coalesce(attribute(x["a"], "target"), F.lit("")).alias("target"),
            x["line"].alias("line"),
        ),
    )


def _canonical(events: Column, base: dict[str, Column]) -> Column:
    """struct(raw, resolved) of the last canonical link, or NULL."""
    hrefs = F.transform(
        _with_attributes(_starts(events, "link")),
        lambda x: F.struct(
            attribute(x["a"], "href").alias("raw"),
            F.lower(F.coalesce(attribute(x["a"], "rel"), F.lit(""))).alias("rel"),
        ),
    )
    hit = last(
        F.filter(
            hrefs,
            lambda h: ~blank(h["raw"])
            & F.array_contains(F.split(collapse(h["rel"]), " "), "canonical"),
        )
    )
    return F.when(
        hit.isNotNull(),
        F.struct(hit["raw"].alias("raw"), urls.resolve(hit["raw"], base).alias("resolved")),
    )


def _metas(events: Column) -> Column:
    """array<struct(ord, attrs array<struct(name, value)>)>; repeated names hold the last value."""
    found = F.transform(_with_attributes(_starts(events, "meta")), lambda x: x["a"])

    def settled(a: Column) -> Column:
        names = F.array_distinct(F.transform(a, lambda p: p["name"]))
        return F.transform(
            names,
            lambda n: F.struct(
                n.alias("name"),
                F.coalesce(
                    last(F.filter(a, lambda p: p["name"] == n))["value"], F.lit("")
                ).alias("value"),
            ),
        )

    return F.transform(
        found, lambda a, i: F.struct((i + 1).alias("ord"), settled(a).alias("attrs"))
    )


def _jsonld(events: Column) -> Column:
    scripts = F.filter(
        events,
        lambda e: (e["kind"] == "raw")
        & (e["tag"] == "script")
        & (F.lower(attribute(e["attrs"], "type")) == "application/ld+json"),
    )
    return F.transform(
        scripts,
        lambda e: strip(F.regexp_extract(e["body"], r"(?is)^script\b[^>]*>(.*)</script\s*>$", 1)),
    )


@remembered
def _sequence(name: str) -> Column:
    """What pairing looks one element ahead in; computed before it is read."""
    ev = F.col("events")
    if name == "title":
        return F.filter(ev, lambda e: e["tag"] == "title")
    if name == "p":
        return _paragraph_sequence(ev)
    if name == "a":
        return _link_sequence(ev)
    return _level_sequence(ev, name)


@remembered
def _all_blocks(paragraphs: bool) -> Column:
    spans = F.flatten(F.array(*[_level_spans(F.col("seq_" + t), t) for t in HEADING_TAGS]))
    if paragraphs:
        spans = F.concat(spans, _paragraph_spans(F.col("seq_p")))
    return _with_text(spans, F.col("texts"))


@remembered
def _part(name: str) -> Column:
    """The column of one extract, over events, texts and sequences."""
    ev, texts, base = F.col("events"), F.col("texts"), urls.base()
    if name == "nodes":
        from sitegrain.operators.outline import fold_nodes

        return fold_nodes(ev)
    return {
        "title": lambda: _title(F.col("seq_title"), texts),
        "lang": lambda: attribute(last(_starts(ev, "html"))["attrs"], "lang"),
        "metas": lambda: _metas(ev),
        "canonical": lambda: _canonical(ev, base),
        "images": lambda: _images(ev, base),
        "picture_sources": lambda: _picture_sources(ev),
        "links": lambda: _links(F.col("seq_a"), texts, base),
        "jsonld": lambda: _jsonld(ev),
        "text_length": lambda: visible_length(texts),
        "has_article": lambda: F.exists(ev, lambda e: (e["tag"] == "article") & (e["kind"] == "start")),
        "headings": lambda: _headings(F.col("blocks_all")),
        "blocks": lambda: _blocks(F.col("blocks_all")),
    }[name]()


def extract(pages: DataFrame, parts: Iterable[str] | None = None) -> DataFrame:
    """pages(page_id, url, html, ...) → page rows with the extracts asked for.

    Other columns of ``pages`` are carried along.  ``url`` is the final URL.
    """
    parts = list(PARTS if parts is None else parts)
    tags = {t for p in parts for t in _TAGS[p]}
    read = (tags & set(_READ)) | (set(STRUCTURAL_TAGS) if "nodes" in parts else set())
    need_text = bool(_NEED_TEXT & set(parts))
    df = tokenised(pages, tags, texts=need_text, read=read)
    carried = [c for c in df.columns if c not in ("events", "texts")]
    late = [p for p in ("headings", "blocks") if p in parts]

    seqs = [t for p, t in (("title", "title"), ("blocks", "p"), ("links", "a")) if p in parts]
    seqs += HEADING_TAGS if late else []
    if seqs:
        kept = [*carried, "events"] + (["texts"] if need_text else [])
        df = staged(df, kept, {"seq_" + s: _sequence(s) for s in seqs})

    cols = {p: _part(p) for p in parts if p not in late}
    if late:
        cols["blocks_all"] = _all_blocks("blocks" in parts)
    df = staged(df, carried, cols)
    if late:
        df = staged(df, [c for c in df.columns if c != "blocks_all"], {p: _part(p) for p in late})
    return df


def meta_value(metas: Column, key: str, name: str) -> Column:
    """``content`` of the first meta whose ``key`` attribute is ``name``, any case.

    NULL if there is no such meta or it has no content attribute.
    """
    hit = F.try_element_at(
        F.filter(
            metas,
            lambda m: F.exists(
                m["attrs"], lambda a: (a["name"] == key) & (F.lower(a["value"]) == name.lower())
            ),
        ),
        F.lit(1),
    )
    return attribute(hit["attrs"], "content")
