"""schema.org markup suggested from what is on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.columns import first, last, let, non_empty, remembered, staged
from sitegrain.functions.jsonld import CONTEXT, node, node_if
from sitegrain.functions.text import strip
from sitegrain.operators.extract import extract, meta_value
from sitegrain.operators.inventory import existing_types

TITLE_SEPARATOR = r"\s+[|–—·-]\s+"
PARTS = ["title", "lang", "metas", "canonical", "headings", "blocks", "images", "jsonld", "text_length", "has_article"]


def site_name(og: Column, title: Column, host: Column) -> Column:
    parts = F.filter(F.transform(F.split(title, TITLE_SEPARATOR), strip), lambda p: p != "")
    brand = let(parts, lambda p: F.when(F.size(p) > 1, last(p)))
    return F.coalesce(non_empty(og), brand, F.regexp_replace(host, r"^www\.", ""))


def find_logo(images: Column) -> Column:
    hit = F.filter(
        images,
        lambda m: F.contains(
            F.lower(F.concat(m["src"], F.lit(" "), F.coalesce(m["alt"], F.lit("")))), F.lit("logo")
        ),
    )
    return first(hit)["src"]


def _title_case(c: Column) -> Column:
    """Every run of letters capitalised, whatever stands before it."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), ""
    )


def breadcrumbs(page_url: Column) -> Column:
    """array<ListItem> from the path, Home first; NULL at the root."""
    start = urls.origin(page_url)

    def items(s: Column) -> Column:
        home = F.struct(
            F.lit("ListItem").alias("@type"), F.lit(1).alias("position"), F.lit("Home").alias("name"),
            F.concat(start, F.lit("/")).alias("item"),
        )
        rest = F.transform(
            s,
            lambda x, i: F.struct(
                F.lit("ListItem").alias("@type"), (i + 2).alias("position"),
                _title_case(
                    strip(F.regexp_replace(F.regexp_replace(x, r"\.[\p{L}\p{N}_]+$", ""), "[-_]+", " "))
                ).alias("name"),
                F.concat(start, F.lit("/"), F.array_join(F.slice(s, F.lit(1), i + 1), "/")).alias("item"),
            ),
        )
        return F.when(F.size(s) > 0, F.concat(F.array(home), rest))

    return let(F.filter(F.split(urls.path(page_url), "/"), lambda x: x != ""), items)


def faq_pairs(blocks: Column) -> Column:
    """array<struct(name, answer)>: question headings with the next paragraph.

    Blocks are numbered, so the paragraphs before a heading are its number less
    the headings before it, and the next one is found by index.
    """
    answers = F.filter(blocks, lambda b: b["tag"] == "p")

    def paired(p: Column) -> Column:
        heads = F.filter(blocks, lambda b: b["tag"] != "p")
        asked = F.transform(
            heads,
            lambda h, k: F.struct(h["text"].alias("name"), F.get(p, h["ord"] - 1 - k)["text"].alias("answer")),
        )
        return F.filter(asked, lambda a: a["name"].endswith("?") & a["answer"].isNotNull())

    return let(answers, paired)


def question_nodes(pairs: Column) -> Column:
    return F.transform(
        pairs,
        lambda q: node("Question", q["name"].alias("name"), node("Answer", q["answer"].alias("text")).alias("acceptedAnswer")),
    )


@remembered
def _value_columns() -> dict[str, Column]:
    metas = F.col("metas")
    prop = lambda n: meta_value(metas, "property", n)
    return {
        "page_url": F.coalesce(F.col("canonical.resolved"), F.col("url")),
        "site": site_name(prop("og:site_name"), F.col("title"), F.col("base_host")),
        "logo": find_logo(F.col("images")),
        "description": F.coalesce(
            non_empty(meta_value(metas, "name", "description")), non_empty(prop("og:description"))
        ),
        "og_image": non_empty(prop("og:image")),
        "h1": first(F.filter("headings", lambda h: h["level"] == 1))["text"],
        "declared": existing_types(F.col("jsonld")),
        "faq": faq_pairs(F.col("blocks")),
    }


def page_values(pages: DataFrame) -> DataFrame:
    """The single values the builders read."""
    kept = ["page_id", "url", "base_origin", "title", "lang", "has_article", "text_length"]
    return staged(extract(pages, PARTS), kept, _value_columns())


def _id(of: Column, tail: str) -> Column:
    return F.struct(F.concat(of, F.lit(tail)).alias("@id"))


def organization() -> Column:
    return node(
        "Organization",
        F.concat("base_origin", F.lit("/#organization")).alias("@id"),
        F.col("site").alias("name"),
        F.concat("base_origin", F.lit("/")).alias("url"),
        node_if(F.col("logo"), "ImageObject", "url").alias("logo"),
    )


def web_page() -> Column:
    return node(
        "WebPage",
        F.concat("page_url", F.lit("#webpage")).alias("@id"),
        F.col("page_url").alias("url"),
        F.coalesce(non_empty(F.col("title")), F.col("site")).alias("name"),
        _id(F.col("base_origin"), "/#organization").alias("isPartOf"),
        F.col("description").alias("description"),
        non_empty(F.col("lang")).alias("inLanguage"),
        node_if(F.col("og_image"), "ImageObject", "url").alias("primaryImageOfPage"),
    )


def looks_like_article() -> Column:
    return F.col("h1").isNotNull() & (F.col("has_article") | (F.col("text_length") > 1500))


def article() -> Column:
    return F.when(
        looks_like_article(),
        node(
            "Article",
            F.col("h1").alias("headline"),
            _id(F.col("page_url"), "#webpage").alias("mainEntityOfPage"),
            _id(F.col("base_origin"), "/#organization").alias("publisher"),
            F.col("description").alias("description"),
            F.col("og_image").alias("image"),
        ),
    )


def breadcrumb_list() -> Column:
    return let(
        breadcrumbs(F.col("page_url")),
        lambda b: F.when(
            b.isNotNull(),
            node("BreadcrumbList", b.alias("itemListElement"), F.concat("page_url", F.lit("#breadcrumb")).alias("@id")),
        ),
    )


def faq_page() -> Column:
    return F.when(F.size("faq") >= 2, node("FAQPage", question_nodes(F.col("faq")).alias("mainEntity")))


def _suggested(values: DataFrame) -> DataFrame:
    """The values with ``declared``, ``suggested``, ``notes`` (arrays) and ``json_ld``."""
    parts = {
        "Organization": organization(), "WebPage": web_page(), "BreadcrumbList": breadcrumb_list(),
        "Article": article(), "FAQPage": faq_page(),
    }
    df = staged(values, values.columns, {"j_" + k: F.to_json(v) for k, v in parts.items()})
    present = [F.when(F.col("j_" + k).isNotNull(), F.lit(k)) for k in parts]
    df = staged(df, df.columns, {"suggested": F.array_compact(F.array(*present))})
    overlap = F.array_sort(F.array_intersect("declared", "suggested"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("logo").isNull(), F.lit("No logo found; add one to the organization.")),
            F.when(F.col("description").isNull(), F.lit("No description on the page; left out.")),
            F.when(F.col("j_BreadcrumbList").isNotNull(), F.lit("Breadcrumb names come from the path; check them.")),
            F.when(F.col("j_Article").isNotNull(), F.lit("Article needs an author and a date.")),
            let(
                overlap,
                lambda o: F.when(
                    F.size(o) > 0,
                    F.concat(F.lit("Already declared: "), F.array_join(o, ", "), F.lit("; merge, do not repeat.")),
                ),
            ),
        )
    )
    graph = F.concat(
        F.lit(f'{{"@context":"{CONTEXT}","@graph":['),
        F.array_join(F.array_compact(F.array(*[F.col("j_" + k) for k in parts])), ","),
        F.lit("]}"),
    )
    return df.select(*values.columns, "suggested", notes.alias("notes"), graph.alias("json_ld"))


def with_suggestion(pages: DataFrame) -> DataFrame:
    """Page rows with the extracts of ``PARTS`` → the same with ``suggestion``."""
    df = _suggested(staged(pages, pages.columns, _value_columns()))
    suggestion = F.struct(
        F.col("declared").alias("existing_types"), F.col("suggested").alias("suggested_types"), "notes", "json_ld"
    )
    return df.select(*pages.columns, suggestion.alias("suggestion"))


def suggest_graph(values: DataFrame) -> DataFrame:
    """page_id, suggested types, notes and the whole @graph as JSON."""
    return _suggested(values).select(
        "page_id", F.array_join("declared", ",").alias("existing_types"),
        F.array_join("suggested", ",").alias("suggested_types"),
        F.array_join("notes", " ").alias("notes"), "json_ld",
    )
