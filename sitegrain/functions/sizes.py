"""Sizes for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KB, _MB = 1024, 1048576


def human_size(n: Column) -> Column:
    """'2.50 MB', '12 KB', '7 B' or 'unknown'; halves round to even."""
    return (
        F.when(n.isNull(), F.lit("unknown"))
        .when(n >= _MB, F.format_string("%.2f MB", F.bround(n / _MB, 2)))
        .when(n >= _KB, F.concat(F.bround(n / _KB, 0).cast("bigint").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def display_size(n: Column, at_least: Column) -> Column:
    floor = F.when(n.isNotNull() & at_least, F.lit(">")).otherwise(F.lit(""))
    return F.concat(floor, human_size(n))
