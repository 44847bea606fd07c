"""Inventory: what is on a page, as opposed to what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions.columns import blank, let, non_empty
from sitegrain.functions.jsonld import declared_types
from sitegrain.functions.text import strip
from sitegrain.operators.extract import meta_value
from sitegrain.operators.tokens import attribute, has_attribute


def content_counts(blocks: Column, tags: list[str]) -> list[Column]:
    """One count per tag, zeros kept, and the words of those blocks."""
    chosen = F.filter(blocks, lambda b: b["tag"].isin(tags))
    return [
        *[F.size(F.filter(blocks, (lambda t: lambda b: b["tag"] == t)(t))).alias("n_" + t) for t in tags],
        F.aggregate(chosen, F.lit(0), lambda acc, b: acc + b["words"]).alias("total_words"),
    ]


def alt_state(alt: Column) -> Column:
    """missing, empty (blank counts) or present."""
    return (
        F.when(alt.isNull(), F.lit("missing")).when(strip(alt) == "", F.lit("empty")).otherwise(F.lit("present"))
    )


def alt_summary(images: Column) -> Column:
    """struct(total, missing, empty, present, coverage)."""
    states = F.transform(images, lambda m: alt_state(m["alt"]))

    def made(s: Column) -> Column:
        n = {k: F.size(F.filter(s, (lambda v: lambda x: x == v)(k))) for k in ("missing", "empty", "present")}
        coverage = F.when(F.size(s) == 0, F.lit(100.0)).otherwise(
            F.bround(n["present"] / F.size(s) * 100, 1)
        )
        return F.struct(
            F.size(s).alias("total"), *[c.alias(k) for k, c in n.items()], coverage.alias("coverage")
        )

    return let(states, made)


def meta_inventory(metas: Column) -> Column:
    """array<struct(ord, kind, key, content)>."""

    def one(m: Column) -> Column:
        a = m["attrs"]
        kinds = ("name", "property", "http-equiv", "itemprop")
        kind = F.coalesce(*[F.when(~blank(attribute(a, k)), F.lit(k)) for k in kinds])
        key = F.coalesce(*[non_empty(attribute(a, k)) for k in kinds])
        listing = F.array_join(F.transform(a, lambda p: F.concat(p["name"], F.lit("="), p["value"])), ", ")
        return F.struct(
            m["ord"].alias("ord"),
            F.coalesce(kind, F.when(has_attribute(a, "charset"), F.lit("charset")), F.lit("other")).alias("kind"),
            F.coalesce(
                key, F.when(has_attribute(a, "charset"), F.lit("charset")), F.lit("(no name/property)")
            ).alias("key"),
            F.when(kind.isNotNull(), F.coalesce(attribute(a, "content"), F.lit("")))
            .when(has_attribute(a, "charset"), attribute(a, "charset"))
            .when(F.size(a) == 0, F.lit("(empty tag)"))
            .otherwise(listing)
            .alias("content"),
        )

    return F.transform(metas, one)


def canonical_info(canonical: Column, url: Column) -> Column:
    """Whether a canonical is declared, absolute as written, and the page itself."""
    target = canonical["resolved"]
    same = F.rtrim(target, F.lit("/")) == F.rtrim(url, F.lit("/"))
    raw = canonical["raw"]
    return F.struct(
        raw.alias("declared"),
        url.alias("page_url"),
        target.alias("resolved"),
        canonical.isNotNull().alias("present"),
        F.coalesce(same, F.lit(False)).alias("self_referencing"),
        F.coalesce(raw.startswith("http://") | raw.startswith("https://"), F.lit(False)).alias("is_absolute"),
        F.coalesce(same & (target != url), F.lit(False)).alias("trailing_slash_only"),
    )


def index_follow(metas: Column, x_robots_tag: Column) -> Column:
    """Directives of both metas and the header, and what they amount to."""
    given = {
        "robots_meta": meta_value(metas, "name", "robots"),
        "googlebot_meta": meta_value(metas, "name", "googlebot"),
        "x_robots_tag": x_robots_tag,
    }
    parts = [non_empty(c) for c in given.values()]
    words = F.filter(
        F.transform(F.split(F.concat_ws(",", *parts), ","), lambda w: F.lower(strip(w))), lambda w: w != ""
    )

    def made(d: Column) -> Column:
        indexable = ~F.array_contains(d, "noindex") & ~F.array_contains(d, "none")
        followable = ~F.array_contains(d, "nofollow") & ~F.array_contains(d, "none")
        return F.struct(
            *[c.alias(n) for n, c in given.items()],
            d.alias("directives"), indexable.alias("indexable"), followable.alias("followable"),
            F.concat(
                F.when(indexable, F.lit("index")).otherwise(F.lit("noindex")), F.lit(", "),
                F.when(followable, F.lit("follow")).otherwise(F.lit("nofollow")),
            ).alias("summary"),
            (F.size(d) == 0).alias("is_default"),
        )

    return let(words, made)


def existing_types(jsonld: Column) -> Column:
    """Declared @type values at any depth, distinct, an outer node before those in it."""
    blocks = F.filter(jsonld, lambda b: b.isNotNull())
    return F.array_distinct(F.flatten(F.transform(blocks, declared_types)))


def inventory_column() -> Column:
    """All extracts of a page as one nested value.

    Over metas, canonical, blocks, images, the outline (see ``structure_outline``),
    the suggestion (see ``with_suggestion``), url and x_robots_tag.
    """
    heads = F.filter("blocks", lambda b: b["tag"] != "p")
    described = F.transform(
        "images",
        lambda m: F.struct(
            m["ord"].alias("index"), m["src"].alias("src"), m["alt"].alias("alt"),
            alt_state(m["alt"]).alias("alt_state"), m["line"].alias("line"),
            m["width"].alias("width"), m["height"].alias("height"), m["loading"].alias("loading"),
        ),
    )
    return F.struct(
        F.struct(heads.alias("blocks"), *content_counts(F.col("blocks"), K.HEADING_TAGS)).alias("content"),
        F.col("outline").alias("outline"),
        F.struct(alt_summary(F.col("images")).alias("summary"), described.alias("images")).alias("images"),
        F.col("suggestion").alias("schema"),
        meta_inventory(F.col("metas")).alias("meta_tags"),
        canonical_info(F.col("canonical"), F.col("url")).alias("canonical"),
        index_follow(F.col("metas"), F.col("x_robots_tag")).alias("index_follow"),
    )


def page_inventory(pages: DataFrame) -> DataFrame:
    """(page_id, inventory); see ``inventory_column`` for what ``pages`` carries."""
    return pages.select("page_id", inventory_column().alias("inventory"))
