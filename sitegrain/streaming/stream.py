"""The audit over pages as they land, and roll-ups over a stream of findings."""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.operators.scoring import audit_markup
from sitegrain.session import shared_dir


def stream_audit(responses: DataFrame) -> DataFrame:
    """The batch audit's page-local stages: they keep no state and need no shuffle."""
    return audit_markup(responses, ("title",))


def stream_dedup(rows: DataFrame, keys: list[str], horizon: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """The first of each run of repeats: (*keys, ts).

    A row is a repeat if its key was seen less than ``horizon`` before; each
    repeat keeps the run alive.  A run is given out and forgotten once the
    watermark has passed its last row by the horizon, so state holds open runs
    only; rows whose own run would have ended behind the watermark are dropped.  A key that comes again
    beyond the horizon is given out again, however the batches are cut.
    """
    run = F.session_window("ts", horizon)
    return rows.withWatermark("ts", lateness).groupBy(run, *keys).agg(F.min("ts").alias("ts")).select(*keys, "ts")


def stream_severity_counts(
    findings: DataFrame, length: str = "6 hours", slide: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """Findings per severity per tumbling or sliding window."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        findings.withWatermark("ts", lateness)
        .groupBy(span.alias("span"), "severity")
        .agg(F.count("*").alias("n"))
        .select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "severity", "n")
    )


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sitegrain-{name}-{uuid.uuid4().hex}"


def paced(rows: DataFrame, batches: int, *after: DataFrame, files: int = 1) -> DataFrame:
    """A table with ``ts`` as a stream that arrives by time: ``batches`` equal spans, then each of ``after``.

    Every span is written as its own files, one span after the other; the file
    source takes them by age, one span a micro-batch.
    """
    spark = rows.sparkSession
    path = _folder(spark, "paced")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    span = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * batches / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1))
    for k in range(batches):
        rows.filter(span == k).repartition(files).write.mode("append").parquet(path)
    for more in after:
        more.select(rows.columns).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@dataclasses.dataclass(frozen=True)
class Run:
    """A finished run: its result table, micro-batches with rows, and rows dropped as late."""

    table: DataFrame
    batches: int
    dropped: int


def run_counted(stream: DataFrame, name: str) -> Run:
    """Process what is there, in append mode, and report what the state operators dropped."""
    spark = stream.sparkSession
    out = _folder(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    progress = [json.loads(p.json) for p in q.recentProgress]
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in progress for s in p["stateOperators"])
    return Run(spark.read.schema(stream.schema).parquet(f"{out}/table"), sum(p["numInputRows"] > 0 for p in progress), dropped)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there and read the result table back."""
    return run_counted(stream, name).table


def run_update(stream: DataFrame, name: str, keys: list[str], value: str) -> DataFrame:
    """Keep every version of an updated aggregate and read the last one per key.

    State stays bounded by the watermark, and no window waits for a later row
    to be closed.
    """
    spark = stream.sparkSession
    out = _folder(spark, name)

    def write(batch: DataFrame, version: int) -> None:
        # Written again under the same version after a failure.
        batch.write.mode("overwrite").parquet(f"{out}/table/version={version}")

    q = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/table")
    return rows.groupBy(*keys).agg(F.max_by(value, "version").alias(value))
