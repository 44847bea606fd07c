"""What each result of an audit needs, so that a request writes that and no more.

A result names the extracts its facts are made of and the columns of the response it shows.
The extracts end with the page-local stage: only facts, packs and the targets
of probes are written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.operators import inventory as I
from sitegrain.operators import suggest as G
from sitegrain.operators.outline import structure_outline
from sitegrain.operators.scoring import audit_markup

#: What the probes and their rules read of links and images.
LINK_FIELDS = ["ord", "href", "text", "line"]
IMAGE_FIELDS = ["ord", "src", "raw_src", "line"]


@dataclass(frozen=True)
class Result:
    """Extracts and response columns needed, facts by name, and columns of the measured images."""

    extracts: tuple[str, ...] = ()
    shown: tuple[str, ...] = ()
    facts: Callable[[], dict[str, Column]] = dict
    measured: tuple[str, ...] = ()


def _alt() -> Column:
    return I.alt_summary(F.col("images"))


def _index() -> Column:
    return I.index_follow(F.col("metas"), F.col("x_robots_tag"))


RESULTS: dict[str, Result] = {
    "packs": Result(),
    "hosts": Result(shown=("url",)),
    "checklist": Result(("headings",), ("url",), lambda: {"has_h2": F.exists("headings", lambda h: h["level"] == 2)}),
    "dashboard": Result(
        ("images", "metas", "canonical"), ("url", "requested_url", "byte_size"),
        lambda: {"n_images": F.size("images"), "alt": _alt(), "index": _index(), "has_canonical": F.col("canonical").isNotNull()},
        ("images_measured", "size_unknown", "total_bytes"),
    ),
    "sections": Result(
        ("nodes", *G.PARTS), (),
        lambda: {
            "n_headings": F.size("headings"), "n_metas": F.size("metas"), "alt": _alt(), "index": _index(),
            "canonical_info": I.canonical_info(F.col("canonical"), F.col("url")),
            "n_suggested": F.size("suggestion.suggested_types"), "n_nodes": F.size("nodes"),
        },
        ("over_limit",),
    ),
    "json": Result(
        ("nodes", *G.PARTS), ("url", "requested_url", "status", "elapsed_ms", "byte_size", "fetched_at"),
        lambda: {"page_title": F.col("title"), "inventory": I.inventory_column()},
        ("found", "not_checked", "total_bytes"),
    ),
}


def needs_of_results(names: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(extracts, response columns, columns of the measured images) of all ``names``."""
    parts = zip(*[(RESULTS[n].extracts, RESULTS[n].shown, RESULTS[n].measured) for n in names], strict=True)
    return tuple([*dict.fromkeys(x for xs in p for x in xs)] for p in parts)


def _fields(names: list[str]) -> Callable[[Column], Column]:
    return lambda x: F.struct(*[x[n].alias(n) for n in names])


def audited_rows(responses: DataFrame, names: list[str], probes: bool = True) -> DataFrame:
    """One row per response: page_id, ok, packs, what the probes need, and the facts of the results asked for.

    Facts of pages that are not audited are NULL.
    """
    extracts, shown, _ = needs_of_results(names)
    targets = {"links": LINK_FIELDS, "images": IMAGE_FIELDS} if probes else {}
    df = audit_markup(responses, tuple(dict.fromkeys([*extracts, *targets])))
    # Facts of the rules may share a name with those of a result.
    kept = ["page_id", "ok", "packs", "static_links", *shown, "url", "x_robots_tag", *urls.BASE_COLUMNS, *extracts, *targets]
    df = df.select(*dict.fromkeys(c for c in kept if c in df.columns))
    if "jsonld" in extracts:
        df = G.with_suggestion(df)
    if "nodes" in extracts:
        df = structure_outline(df)
    facts = {k: c for n in names for k, c in RESULTS[n].facts().items()}
    narrow = [F.transform(c, _fields(fields)).alias(c) for c, fields in targets.items()]
    return df.select(
        "page_id", "ok", "packs", "static_links", *narrow, *shown, *[F.when(F.col("ok"), c).alias(k) for k, c in facts.items()]
    )
