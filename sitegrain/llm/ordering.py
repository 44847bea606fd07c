"""Running positions and sums in a total order, without a window over a whole group.

Rows are dealt by ranges of (group, order) and written once, with their place
in the partition. A partition's share of a group is one row of a small table,
whose running sum gives every share its start; only rows of one share meet in
a window. So a group that holds a third of all rows is spread like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain.session import materialised


def positions(df: DataFrame, group: list[str], order: list[str], amount: str | None = None) -> DataFrame:
    """``df`` with ``pos``, the rows of its group before it, and ``n``, all rows of it.

    ``order`` must tell any two different rows apart. With ``amount`` (a column
    of longs) also ``before``, the sum of it over the rows before. Nulls come first, strings by UTF-8 bytes. The result reads a
    written table: reading it twice gives the same numbers.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = materialised(laid.withColumn("__at", F.monotonically_increasing_id()))
    laid = laid.withColumn("__part", F.shiftright("__at", 33))
    none = F.lit(None).cast("long")
    added: Column = F.sum(amount) if amount else F.sum(none)
    shares = laid.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), added.alias("__sum"))
    past = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        F.col("__part").alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in group], "__first",
        F.sum("__n").over(Window.partitionBy(*group)).alias("n"), F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__from"), F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias("__base"),
    )
    on = F.col("__part") == F.col("__p")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    out = laid.join(shares, on).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__from"))
    if amount:
        inside = Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.coalesce(F.sum(amount).over(inside), F.lit(0)) + F.col("__base"))
    return out.select(*df.columns, "pos", "n", *(["before"] if amount else []))
