"""Scores, ordering and roll-ups of findings, page-local where a page suffices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions.columns import let, staged
from sitegrain.operators.extract import extract
from sitegrain.operators.rules import (
    PACKS, Rule, fact, finding, found_by, needs_of, once, rule,
)
from sitegrain.sources.responses import is_auditable


@rule("http.error-status", "http", "critical", "response", "The page answers with an error",
      "Nothing else matters until it answers 200.")
def _error_status(r: Rule) -> Column:
    s = F.col("status")
    return once(s >= 400, finding(r, detail=F.col("url"), status=s))


@rule("http.not-html", "http", "critical", "response", "The response is not HTML",
      "Audit an HTML page.")
def _not_html(r: Rule) -> Column:
    html = F.contains(F.lower("content_type"), F.lit("html"))
    return once((F.col("status") < 400) & ~html, finding(r, detail=F.col("content_type")))


def _lookup(values: dict[str, float], key: Column) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def weight(severity: Column) -> Column:
    return _lookup(K.SEVERITY_WEIGHT, severity)


def severity_rank(severity: Column) -> Column:
    return _lookup({s: i for i, s in enumerate(K.SEVERITIES)}, severity)


def pack_score(findings: Column) -> Column:
    """100 less the weights, floored at 0, one decimal."""
    lost = F.aggregate(findings, F.lit(0.0), lambda acc, f: acc + weight(f["severity"]))
    return F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - lost), 1)


def overall(packs: Column) -> Column:
    """Mean of the pack scores, halves to even; 0 without packs."""
    total = F.aggregate(packs, F.lit(0.0), lambda acc, p: acc + p["score"])
    return F.when(F.size(packs) == 0, F.lit(0.0)).otherwise(F.bround(total / F.size(packs), 1))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 90, F.lit("good")).when(score >= 70, F.lit("warn")).otherwise(F.lit("bad"))
    )


def sorted_findings(findings: Column) -> Column:
    """Most severe first, then by rule, then in emission order."""

    def ordered(found: Column) -> Column:
        keyed = F.transform(
            found,
            lambda f, i: F.struct(
                severity_rank(f["severity"]).alias("rank"), f["rule"].alias("rule"), i.alias("i")
            ),
        )
        return F.transform(F.array_sort(keyed), lambda k: F.get(found, k["i"]))

    return let(findings, ordered)


def _pack(module: str, findings: Column, score: Column) -> Column:
    return F.struct(
        F.lit(module).alias("module"), F.lit(K.PACK_LABELS[module]).alias("label"),
        score.alias("score"), findings.alias("findings"),
    )


MARKUP_PACKS = ["seo", "images"]
#: Packs with an input of their own; every other registered pack is markup's.
OTHER_PACKS = {"http", "links", "assets"}


def markup_packs() -> list[str]:
    return MARKUP_PACKS + [p for p in PACKS if p not in OTHER_PACKS and p not in MARKUP_PACKS]


def audit_markup(responses: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Audit everything that the response alone decides, in one narrow stage.

    responses(page_id, url, status, content_type, html, ...) → one row per
    response with ``ok``, ``packs`` (http alone, or seo and images) and the
    extracts in ``also``.  Markup of pages that are not audited is not read.
    """
    rules = [i for m in markup_packs() for i in PACKS[m]]
    extra = ["link.mixed-content-image", "link.insecure-http"]
    parts, facts = needs_of([*rules, *extra])
    parts += [p for p in also if p not in parts]
    df = responses.withColumn("ok", F.coalesce(is_auditable(), F.lit(False)))
    df = extract(df.withColumn("html", F.when(F.col("ok"), F.col("html"))), parts)
    df = staged(df, df.columns, {f: fact(f) for f in facts})
    found = {"f_" + m: F.concat(*[found_by(i) for i in PACKS[m]]) for m in markup_packs()}
    found["f_http"] = F.concat(*[found_by(i) for i in PACKS["http"]])
    found["static_links"] = F.concat(*[found_by(i) for i in extra])
    df = staged(df, df.columns, found)
    # An unauditable page has one pack, fixed at 0 whatever its weights.
    http = F.array(_pack("http", F.col("f_http"), F.lit(0.0)))
    packs = F.array(*[_pack(m, F.col("f_" + m), pack_score(F.col("f_" + m))) for m in markup_packs()])
    df = df.withColumn("packs", F.when(F.col("ok"), packs).otherwise(http))
    return df.drop(*[c for c in found if c != "static_links"])


def with_probes(
    audited: DataFrame, links: DataFrame, assets: DataFrame, also: tuple[str, ...] = ()
) -> DataFrame:
    """Add the asset and link packs to audited pages.

    ``audited`` should be a table (see ``materialised``): three branches read
    it.  links / assets come from ``probe_findings`` and have a row per page;
    ``also`` names columns of assets to keep.
    """
    a = assets.select("page_id", F.col("probe_findings").alias("f_assets"), *also)
    k = links.select("page_id", F.col("probe_findings").alias("f_links"))
    df = audited.join(a, "page_id", "left").join(k, "page_id", "left")
    f_links = F.concat("static_links", F.col("f_links"))
    more = F.array(
        _pack("assets", F.col("f_assets"), pack_score(F.col("f_assets"))),
        _pack("links", f_links, pack_score(f_links)),
    )
    return df.withColumn(
        "packs", F.when(F.col("ok"), F.concat("packs", more)).otherwise(F.col("packs"))
    ).drop("f_assets", "f_links", "static_links", "links", "images")


def all_findings(packs: Column) -> Column:
    return F.flatten(F.transform(packs, lambda p: p["findings"]))


def pack_rows(audited: DataFrame) -> DataFrame:
    return audited.select("page_id", F.inline("packs")).select("page_id", "module", "label", "score", F.size("findings").alias("n_findings"))


def findings_table(audited: DataFrame, *keep: str) -> DataFrame:
    """All findings as rows; seq is the emission order within the page."""
    return audited.select(
        "page_id", *keep, F.posexplode(all_findings(F.col("packs"))).alias("seq", "f")
    ).select("page_id", *keep, "seq", "f.*")


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    """Five counts per group, zeros included; partial counts before the shuffle."""
    return findings.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITIES]
    )


def counts_of(findings: Column) -> Column:
    """struct of the five counts of one page's findings array."""
    return F.struct(
        *[F.size(F.filter(findings, (lambda s: lambda f: f["severity"] == s)(s))).alias(s) for s in K.SEVERITIES]
    )
