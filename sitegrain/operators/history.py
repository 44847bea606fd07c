"""The scan store: listing, summaries, trends and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.operators.scoring import severity_rank, weight
from sitegrain.session import materialised


def scan_id(site: Column, day: Column) -> Column:
    return site * 100000 + F.datediff(day, F.lit("2000-01-01").cast("date"))


def scans(log: DataFrame) -> DataFrame:
    """One scan per site and day."""
    return log.groupBy("site_id", "url", "scan_day").agg(
        F.min("ts").alias("created_at"), F.count("*").alias("n_findings")
    ).withColumn("scan_id", scan_id(F.col("site_id"), F.col("scan_day")))


def list_scans(all_scans: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """Newest first; limit 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    return all_scans.orderBy(F.desc("created_at"), "scan_id").offset(offset).limit(limit)


def scan_summary(log: DataFrame) -> DataFrame:
    """Counts by severity, their total and the pages crawled, per scan."""
    # One row per scan and page first: the distinct count becomes a plain one.
    per_page = log.groupBy("site_id", "scan_day", "page_no").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITIES]
    )
    return per_page.groupBy("site_id", "scan_day").agg(
        *[F.sum(s).alias(s) for s in K.SEVERITIES], F.count("*").alias("pages_crawled")
    ).select(
        scan_id(F.col("site_id"), F.col("scan_day")).alias("scan_id"),
        sum((F.col(s) for s in K.SEVERITIES[1:]), F.col(K.SEVERITIES[0])).alias("total_findings"),
        *K.SEVERITIES, "pages_crawled",
    )


def list_findings(
    findings: DataFrame, module: str | None = None, severity: str | None = None,
    limit: int = 200, offset: int = 0, scans: DataFrame | None = None,
) -> DataFrame:
    """Filtered (``scans``: the scan_ids wanted), most severe first, a page of them; limit 1 to 1000."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    if scans is not None:
        findings = findings.join(scans.select("scan_id").distinct(), "scan_id", "left_semi")
    if module is not None:
        findings = findings.filter(F.col("module") == module)
    if severity is not None:
        findings = findings.filter(F.col("severity") == severity)
    return findings.orderBy(severity_rank(F.col("severity")), "rule", "event_id").offset(offset).limit(limit)


def module_scores(log: DataFrame) -> DataFrame:
    """(site_id, scan_day, module, score)."""
    lost = F.sum(weight(F.col("severity")))
    return log.groupBy("site_id", "url", "scan_day", "module").agg(
        F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - lost), 1).alias("score")
    )


def scan_scores(scores: DataFrame) -> DataFrame:
    """Module → score map per scan and their mean."""
    entries = F.array_sort(F.collect_list(F.struct("module", "score")))
    return scores.groupBy("site_id", "scan_day").agg(
        F.map_from_entries(entries).alias("scores"), F.bround(F.avg("score"), 1).alias("overall_score")
    ).select(scan_id(F.col("site_id"), F.col("scan_day")).alias("scan_id"), "scores", "overall_score")


def scan_history(scores: DataFrame, days: int = 7) -> DataFrame:
    """Score, change and moving mean per site and module.

    The input has one row per day, so a window holds at most the days on record
    however many findings a site has.
    """
    w = W.partitionBy("site_id", "module").orderBy("scan_day")
    before = F.lag("score").over(w)
    return scores.select(
        "site_id", "module", "scan_day", "score", before.alias("previous"),
        (F.col("score") - before).alias("change"),
        F.bround(F.avg("score").over(w.rowsBetween(-(days - 1), 0)), 4).alias("moving_mean"),
    )


PERIODS = {"yesterday": 1, "last week": 7, "last month": 30}


#: Days that one word of a presence bitmap holds.
_DAYS = 63


def presence(log: DataFrame) -> DataFrame:
    """(site_id, page_no, rule, word, days): bit d of word w is set where a finding occurs on day 63 w + d since 1970.

    One aggregation of the log, combined map-side.
    """
    day = F.unix_date("scan_day")
    word = F.floor(day / _DAYS).cast("int").alias("word")
    return log.groupBy("site_id", "page_no", "rule", word).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(_DAYS)).cast("int"))).alias("days")
    )


def scan_compare(log: DataFrame) -> DataFrame:
    """Latest scan of each site against the last one a day, week and month before.

    Findings are told apart by page and rule.  The log is read once, into bitmaps of the
    days each finding occurs on; the sites' days and all periods are read from those.
    """
    seen = materialised(presence(log))
    bits = F.filter(F.sequence(F.lit(0), F.lit(_DAYS - 1)), lambda d: F.getbit("days", d) == 1)
    words = seen.groupBy("site_id", "word").agg(F.bit_or("days").alias("days"))
    days = words.select("site_id", F.transform(bits, lambda d: F.col("word") * _DAYS + d).alias("on"))
    days = days.groupBy("site_id").agg(F.flatten(F.collect_list("on")).alias("on")).withColumn("now", F.array_max("on"))
    last_by = lambda n: F.array_max(F.filter("on", lambda d: d <= F.col("now") - n))
    days = days.select("site_id", "now", *[last_by(n).alias(f"then{n}") for n in PERIODS.values()])

    def occurs(day: str) -> Column:
        here = F.col("word") == F.floor(F.col(day) / _DAYS)
        return F.coalesce(F.bool_or(here & (F.getbit("days", F.pmod(day, F.lit(_DAYS)).cast("int")) == 1)), F.lit(False)).alias(day)

    marks = ["now", *[f"then{n}" for n in PERIODS.values()]]
    per_finding = seen.join(days, "site_id").groupBy("site_id", "page_no", "rule").agg(*[occurs(d) for d in marks])

    def counted(period: str, n: int) -> Column:
        now, then = F.col("now"), F.col(f"then{n}")
        return F.struct(
            F.lit(period).alias("period"), F.count_if(now & ~then).alias("new"), F.count_if(~now & then).alias("fixed"),
            F.count_if(now & then).alias("persisting"),
        )

    rows = per_finding.groupBy("site_id").agg(F.array(*[counted(p, n) for p, n in PERIODS.items()]).alias("rows"))
    return rows.select("site_id", F.inline("rows"))


def site_rollup(findings: DataFrame) -> DataFrame:
    """Counts by host, module and severity with all subtotals."""
    return findings.rollup("host", "module", "severity").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_findings")
    )


def top_rules(findings: DataFrame) -> DataFrame:
    """Rules by number of findings; ranked over the catalogue, not the findings."""
    counts = findings.groupBy("rule", "severity").agg(F.count("*").alias("n_findings"))
    return counts.withColumn("rank", F.dense_rank().over(W.orderBy(F.desc("n_findings"))))


def worst_pages(scores: DataFrame, k: int = 20) -> DataFrame:
    """The k lowest scores, a top-k without a full sort."""
    return scores.orderBy("score", "page_id").limit(k)
