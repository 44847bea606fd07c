"""Column helpers shared by the operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, keep: Sequence[str], cols: dict[str, Column]) -> DataFrame:
    """Compute ``cols`` once per row and carry ``keep`` along.

    The optimiser merges neighbouring projections and moves filters below them
    by substituting expressions.  That is right for cheap columns, but a page
    tokenisation copied into a lambda would run once per array element.  A
    one-row ``inline`` is a narrow operator that projections and filters are
    not merged across, so each stage is evaluated exactly once per page.
    """
    row = F.struct(*[c.alias(name) for name, c in cols.items()])
    return df.select(*keep, F.inline(F.array(row)))


def remembered(fn: Callable) -> Callable:
    """Keep the columns a function builds, per running JVM.

    A column names its inputs and is bound to data only when selected, so one
    built for a fixed set of input names serves every query.  Building is what
    costs: each node is a call to the JVM.
    """
    kept: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        if kept.get("gateway") is not SparkContext._gateway:  # columns of a gone JVM are of no use
            kept.clear()
            kept["gateway"] = SparkContext._gateway
        if args not in kept:
            kept[args] = fn(*args)
        return kept[args]

    return wrapper


def let(value: Column, fn) -> Column:
    """fn(value) with ``value`` evaluated once and named once.

    Column expressions are trees: a sub-expression used five times is written
    out five times, and nesting that multiplies.  A one-element transform binds
    it to a variable, inside lambdas too.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def fold_emitting(array: Column, state: dict[str, Column], step, out_type: str, chunk: int = 128) -> Column:
    """Left fold that also emits rows: struct(state fields..., out).

    ``step(acc, x)`` gives (new state fields, array of emitted rows).  Appending
    to one growing array copies it every time, which is quadratic; here rows
    gather per chunk and the chunks are joined at the end.
    """
    none = F.array().cast(out_type)

    def packed(fields: dict[str, Column], **more: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in {**fields, **more}.items()])

    def carried(acc: Column) -> dict[str, Column]:
        return {n: acc[n] for n in state}

    def inner(acc: Column, x: Column) -> Column:
        fields, emitted = step(acc, x)
        return packed(fields, out=F.concat(acc["out"], emitted).cast(out_type))

    def outer(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, packed(carried(acc), out=none), inner)
        return let(
            done, lambda d: packed(carried(d), outs=F.concat(acc["outs"], F.array(d["out"])))
        )

    def folded(a: Column) -> Column:
        starts = F.when(
            F.size(a) > 0, F.sequence(F.lit(0), ((F.size(a) - 1) / chunk).cast("int"))
        ).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice(a, i * chunk + 1, F.lit(chunk)))
        empty = packed(state, outs=F.array().cast(f"array<{out_type}>"))
        return F.aggregate(
            parts, empty, outer, lambda acc: packed(carried(acc), out=F.flatten(acc["outs"]))
        )

    return let(array, folded)


def pick(array: Column, index: Column | int) -> Column:
    """Array element by 0-based index, NULL outside the bounds."""
    return F.get(array, index if isinstance(index, Column) else F.lit(index))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def blank(c: Column) -> Column:
    """NULL or the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def non_empty(c: Column) -> Column:
    """The value, with '' as NULL."""
    return F.when(c != "", c)


def mapped(array: Column, fn) -> Column:
    return F.transform(array, fn)


def total(array: Column, fn) -> Column:
    """Sum of fn(x) over an array, as INT."""
    return F.aggregate(array, F.lit(0), lambda acc, x: acc + fn(x))


def count_where(array: Column, fn) -> Column:
    return F.size(F.filter(array, fn))
