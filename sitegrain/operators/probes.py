"""Links and assets: what a fetcher measured, joined to the pages that use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions import urls
from sitegrain.functions.columns import blank, let, remembered
from sitegrain.functions.sizes import display_size, human_size
from sitegrain.operators.rules import each, finding, found_by, joined, once, rule

# --- targets: distinct URLs per page, page-local ----------------------------


def _distinct(array: Column, key: str, fields: list[str]) -> Column:
    """First element per key, in document order, with the last one's fields as last_*.

    Sorted by key and position, a group's first and last are next to other
    groups, so the two filtered lists line up.
    """
    keyed = F.array_sort(
        F.transform(
            array,
            lambda x: F.struct(x[key].alias("key"), x["ord"].alias("ord"), *[x[f].alias(f) for f in fields]),
        )
    )

    def paired(s: Column) -> Column:
        edged = F.transform(
            s,
            lambda x, i: F.struct(
                x.alias("x"),
                F.coalesce(F.get(s, i - 1)["key"] != x["key"], F.lit(True)).alias("first"),
                F.coalesce(F.get(s, i + 1)["key"] != x["key"], F.lit(True)).alias("last"),
            ),
        )
        return let(
            edged,
            lambda e: F.zip_with(
                F.filter(e, lambda y: y["first"]),
                F.filter(e, lambda y: y["last"]),
                lambda a, b: F.struct(
                    a["x"]["ord"].alias("ord"), a["x"]["key"].alias("url"),
                    *[a["x"][f].alias(f) for f in fields],
                    *[b["x"][f].alias("last_" + f) for f in fields],
                ),
            ),
        )

    return F.array_sort(let(keyed, paired))


def _capped(targets: Column, limit: int | None) -> Column:
    if limit is None:
        return F.struct(targets.alias("targets"), F.lit(0).alias("not_checked"))
    return let(
        targets,
        lambda t: F.struct(
            F.slice(t, 1, limit).alias("targets"),
            F.greatest(F.size(t) - limit, F.lit(0)).alias("not_checked"),
        ),
    )


def link_targets(links: Column, limit: int | None = None) -> Column:
    """struct(targets, not_checked): distinct web links, all or the first ``limit``."""
    web = F.filter(links, lambda a: urls.is_web(a["href"]))
    return _capped(_distinct(web, "href", ["text", "line"]), limit)


def asset_targets(images: Column, limit: int | None = None) -> Column:
    """struct(targets, not_checked): distinct web images, all or the first ``limit``."""
    web = F.filter(
        images,
        lambda m: (m["src"].startswith("http://") | m["src"].startswith("https://"))
        & ~blank(m["raw_src"]),
    )
    return _capped(_distinct(web, "src", ["line"]), limit)


def resolve_status(probes: DataFrame) -> DataFrame:
    """probes(url, method, code) → (url, status): HEAD, or GET where HEAD is refused."""
    head = F.max(F.when(F.col("method") == "HEAD", F.col("code")))
    get = F.max(F.when(F.col("method") == "GET", F.col("code")))
    return probes.groupBy("url").agg(head.alias("head"), get.alias("get")).select(
        "url",
        F.when(~F.col("head").isin(405, 501), F.col("head"))
        .when(~F.col("get").isin(405, 501), F.col("get"))
        .alias("status"),
    )


def _probed(pages: DataFrame, targets: Column, side: DataFrame, fields: list[str]) -> DataFrame:
    """page_id, found array<struct(ord, url, ..., fields)>, not_checked; one row per page.

    Regrouping is bounded by the page; pages without targets are kept.
    """
    t = pages.select("page_id", targets.alias("t"))
    rows = t.select("page_id", F.col("t.not_checked").alias("not_checked"), F.explode_outer("t.targets").alias("x"))
    rows = rows.select("page_id", "not_checked", "x.*")
    carried = [c for c in rows.columns if c not in ("page_id", "not_checked")]
    hit = rows.join(side, ["url"], "left")
    found = F.struct(*carried, *fields)
    return hit.groupBy("page_id").agg(
        F.first("not_checked").alias("not_checked"),
        F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), found))).alias("found"),
    )


@remembered
def _targets(column: str, limit: int | None) -> Column:
    return link_targets(F.col(column), limit) if column == "links" else asset_targets(F.col(column), limit)


def checked_links(pages: DataFrame, status: DataFrame, limit: int | None = None) -> DataFrame:
    """pages(page_id, links) ⟕ status(url, status)."""
    return _probed(pages, _targets("links", limit), status.select("url", "status"), ["status"])


def measured_assets(pages: DataFrame, sizes: DataFrame, limit: int | None = None) -> DataFrame:
    """pages(page_id, images) ⟕ sizes(src, byte_size, content_type, error, at_least)."""
    side = sizes.select(F.col("src").alias("url"), "byte_size", "content_type", "error", "at_least")
    return _probed(
        pages, _targets("images", limit), side,
        ["byte_size", "content_type", "error", "at_least"],
    )


# --- rules over ``found`` ---------------------------------------------------


@rule("link.broken", "links", "medium", "found", "A link is broken", "Correct the address or remove the link.")
def _broken(r):
    bad = F.transform(
        F.filter(F.col("found"), lambda x: x["status"] >= 400),
        lambda x: F.struct(
            (-x["status"]).alias("k"), x["ord"].alias("ord"), x["url"].alias("url"),
            x["status"].alias("status"), x["last_text"].alias("text"),
        ),
    )
    return each(
        F.array_sort(bad),
        lambda x: finding(
            r,
            severity=F.when(x["status"] == 404, F.lit("high")).otherwise(F.lit("medium")),
            detail=F.when(x["text"] == "", x["url"]).otherwise(x["text"]),
            element=x["url"], status=x["status"], url=x["url"],
        ),
    )


def _listed(o: Column, field: str) -> Column:
    return F.to_json(F.transform(o, lambda x: x[field]))


@rule("link.unreachable", "links", "medium", "found", "{} links could not be reached",
      "Check them by hand; some hosts refuse automated clients.")
def _unreachable(r):
    silent = F.filter(F.col("found"), lambda x: x["status"].isNull())
    return let(
        silent,
        lambda o: once(
            F.size(o) > 0,
            finding(
                r, items=F.size(o),
                detail=joined(F.transform(F.slice(o, 1, K.EXAMPLES_SHOWN), lambda x: x["url"])),
                urls=_listed(o, "url"),
            ),
        ),
    )


@rule("image.oversized", "assets", "high", "found", "An image is too heavy",
      "Export it at the size shown and in a modern format.")
def _oversized(r, limit: int = K.ASSET_LIMIT_BYTES):
    heavy = F.transform(
        F.filter(F.col("found"), lambda x: x["byte_size"] > limit),
        lambda x: F.struct(
            (-x["byte_size"]).alias("k"), x["ord"].alias("ord"), x["url"].alias("url"), x["line"].alias("line"),
            x["byte_size"].alias("size"), x["content_type"].alias("ctype"), x["at_least"].alias("floor"),
        ),
    )
    return each(
        F.array_sort(heavy),
        lambda x: finding(
            r, element=display_size(x["size"], x["floor"]), line=x["line"],
            detail=F.concat(F.lit("over by "), human_size(x["size"] - limit)),
            src=x["url"], bytes=x["size"], limit_bytes=F.lit(limit), content_type=x["ctype"],
        ),
    )


@rule("image.unreachable", "assets", "medium", "found", "{} images could not be fetched",
      "See whether a visitor gets them.")
def _unfetched(r):
    failed = F.filter(F.col("found"), lambda x: ~blank(x["error"]))
    shown = lambda x: F.concat(x["url"], F.lit(" ("), x["error"], F.lit(")"))
    return let(
        failed,
        lambda o: once(
            F.size(o) > 0,
            finding(
                r, items=F.size(o),
                detail=joined(F.transform(F.slice(o, 1, K.EXAMPLES_SHOWN), shown)),
                sources=_listed(o, "url"),
            ),
        ),
    )


LINK_PROBE_RULES = ["link.broken", "link.unreachable"]
ASSET_RULES = ["image.oversized", "image.unreachable"]
STATIC_LINK_RULES = ["link.mixed-content-image", "link.insecure-http"]


def probe_findings(probed: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Adds the findings array of probe rules to checked_links / measured_assets rows."""
    return probed.withColumn("probe_findings", F.concat(*[found_by(i) for i in rule_ids]))


# --- statistics -------------------------------------------------------------


def link_stats(probed: DataFrame) -> DataFrame:
    code = lambda x: x["status"]
    n = lambda p: F.size(F.filter("found", p))
    return probed.select(
        "page_id", F.size("found").alias("unique_checked"), "not_checked",
        n(lambda x: code(x) >= 400).alias("broken"), n(lambda x: code(x).isNull()).alias("unreachable"),
        n(lambda x: code(x) < 400).alias("ok"),
    )


def asset_stat_columns(limit: int = K.ASSET_LIMIT_BYTES) -> dict[str, Column]:
    n = lambda p: F.size(F.filter("found", p))
    weight = F.aggregate(
        "found", F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x["byte_size"], F.lit(0))
    )
    return {
        "images_measured": n(lambda x: x["byte_size"].isNotNull()),
        "size_unknown": n(lambda x: x["byte_size"].isNull()),
        "over_limit": n(lambda x: x["byte_size"] > limit),
        "total_bytes": weight,
    }


def asset_stats(probed: DataFrame, limit: int = K.ASSET_LIMIT_BYTES) -> DataFrame:
    stats = [c.alias(name) for name, c in asset_stat_columns(limit).items()]
    return probed.select("page_id", "not_checked", *stats)


def asset_report(probed: DataFrame, limit: int = K.ASSET_LIMIT_BYTES) -> DataFrame:
    """One row per measured image, heaviest first within the page, unknown sizes last."""
    ranked = F.array_sort(
        F.transform(
            "found",
            lambda x: F.struct(
                (-F.coalesce(F.when(x["byte_size"] != 0, x["byte_size"]), F.lit(-1))).alias("k"),
                x["ord"].alias("ord"), x.alias("x"),
            ),
        )
    )
    rows = probed.select("page_id", F.posexplode(ranked).alias("p", "r"))
    x = F.col("r.x")
    return rows.select(
        "page_id", (F.col("p") + 1).alias("rank"), x["url"].alias("src"), x["byte_size"].alias("bytes"),
        display_size(x["byte_size"], x["at_least"]).alias("size"), x["content_type"].alias("content_type"),
        x["line"].alias("line"), x["error"].alias("error"),
        F.coalesce(x["byte_size"] > limit, F.lit(False)).alias("over_limit"),
        ((F.col("p") == 0) & x["byte_size"].isNotNull()).alias("heaviest"),
    )
