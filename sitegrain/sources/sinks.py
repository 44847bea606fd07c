"""Results written out: JSON, exports per module, the scan store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions.columns import non_empty
from sitegrain.functions.sizes import display_size, human_size
from sitegrain.operators.scoring import all_findings, counts_of, overall

FORMATS = ["csv", "json", "markdown"]


def image_sizes(found: Column, not_checked: Column, limit: int = K.ASSET_LIMIT_BYTES) -> Column:
    """The measured images as one value, heaviest first, unknown sizes last; NULL where none were asked for."""

    def image(x: Column) -> Column:
        return F.struct(
            (-F.coalesce(F.when(x["byte_size"] != 0, x["byte_size"]), F.lit(-1))).alias("k"), x["ord"].alias("ord"),
            F.struct(
                x["url"].alias("src"), x["byte_size"].alias("bytes"), display_size(x["byte_size"], x["at_least"]).alias("size"),
                x["content_type"].alias("content_type"), x["line"].alias("line"), x["error"].alias("error"),
                F.coalesce(x["byte_size"] > limit, F.lit(False)).alias("over_limit"),
            ).alias("image"),
        )

    images = F.transform(F.array_sort(F.transform(found, image)), lambda r: r["image"])
    total = F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x["byte_size"], F.lit(0)))
    return F.when(
        found.isNotNull(),
        F.struct(
            F.lit(True).alias("checked"), F.lit(limit).alias("limit_bytes"), human_size(F.lit(limit).cast("bigint")).alias("limit"),
            total.alias("total_bytes"), not_checked.alias("not_checked"), images.alias("images"),
        ),
    )


def result_json(audited: DataFrame) -> DataFrame:
    """page_id and the whole result as one JSON text (see ``RESULTS["json"]``).

    What a page does not have (an inventory where it was not audited) is left out.
    """
    found = all_findings(F.col("packs"))
    body = F.struct(
        F.col("requested_url").alias("url"), F.col("url").alias("final_url"), "status", "fetched_at", "elapsed_ms", "byte_size",
        F.coalesce(non_empty(F.col("page_title")), F.lit("(no title)")).alias("page_title"),
        overall(F.col("packs")).alias("overall_score"), counts_of(found).alias("counts"), "packs", "inventory",
        image_sizes(F.col("found"), F.col("not_checked")).alias("image_sizes"),
    )
    return audited.select("page_id", F.to_json(body).alias("result"))


def _markdown() -> Column:
    where = F.when(F.col("line").isNotNull(), F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("- **"), F.col("severity"), F.lit("** `"), F.col("rule"), F.lit("` page "),
        F.col("page_id").cast("string"), where, F.lit(": "), F.col("title"),
    )


def export_findings(findings: DataFrame, path: str, fmt: str, scan_status: str) -> None:
    """One folder per module; only a completed scan is exported."""
    if scan_status != "completed":
        raise ValueError(f"scan is {scan_status}; only a completed scan is exported")
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt == "markdown":
        findings.select("module", _markdown().alias("value")).write.partitionBy("module").text(path)
        return
    rows = findings.withColumn("meta", F.to_json("meta"))
    writer = rows.write.partitionBy("module")
    if fmt == "csv":  # texts as they are: blanks at their ends belong to them
        writer.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"')
    else:
        writer.json(path)


def write_scan(tables: dict[str, DataFrame], path: str) -> None:
    """scans, pages, findings with a scan_id column; writing a scan again replaces it.

    The rebalance brings a scan's rows together, so it has few files, and
    splits a scan that is much larger than the others.
    """
    for name, df in tables.items():
        (
            df.hint("rebalance", "scan_id").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("scan_id")
            .parquet(f"{path}/{name}")
        )
