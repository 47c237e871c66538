"""Aggregates by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorline.functions.checks import col

_BLANK = r"(?U)^\s*$"


def _text(c: Column) -> Column:
    return c.cast("string")


def _ordered(c: Column, pos: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(pos.alias("p"), _text(c).alias("v"))))), lambda x: x["v"])


def _longest(c: Column, p: Column) -> Column:
    """Of the longest values the one first in order: their places and values as structs, the smallest place of the greatest length."""
    least = F.min(F.when(c.isNotNull(), F.struct((-F.length(_text(c))).alias("n"), p.alias("p"), c.alias("v"))))
    return least.getField("v")


def _shortest(c: Column, p: Column) -> Column:
    least = F.min(F.when(c.isNotNull(), F.struct(F.length(_text(c)).alias("n"), p.alias("p"), c.alias("v"))))
    return least.getField("v")


# Each builds a Column from the input column and the row's place.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda c, p: F.coalesce(F.sum(c), F.lit(0)),
    "mean": lambda c, p: F.avg(c),
    "count": lambda c, p: F.count(c),
    "count distinct": lambda c, p: F.count_distinct(c),
    "count null": lambda c, p: F.count_if(c.isNull()),
    "count blank": lambda c, p: F.count_if(_text(c).rlike(_BLANK)),
    "count non blank": lambda c, p: F.count_if(~_text(c).rlike(_BLANK)),
    "min": lambda c, p: F.min(c),
    "max": lambda c, p: F.max(c),
    "first": lambda c, p: F.min_by(c, F.when(c.isNotNull(), p)),
    "last": lambda c, p: F.max_by(c, F.when(c.isNotNull(), p)),
    "std": lambda c, p: F.stddev_samp(c),
    "var": lambda c, p: F.var_samp(c),
    "sem": lambda c, p: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "median": lambda c, p: F.median(c),
    "prod": lambda c, p: F.coalesce(F.product(c), F.lit(1.0)),
    "size": lambda c, p: F.count(F.lit(1)),
    "concatenate": lambda c, p: F.array_join(_ordered(c, p), ","),
    "concatenate distinct": lambda c, p: F.array_join(F.array_distinct(_ordered(c, p)), ","),
    "longest": _longest,
    "shortest": _shortest,
    "mode": lambda c, p: F.mode(c, True),
    "approx count distinct": lambda c, p: F.approx_count_distinct(c),
}
#: Other names of the same.
SAME = {"avg": "mean", "average": "mean", "count_distinct": "count distinct", "nunique": "count distinct", "count_null": "count null", "count_blank": "count blank", "count_non_blank": "count non blank", "countnonblank": "count non blank",
        "concat": "concatenate", "concat_distinct": "concatenate distinct", "concatenate_distinct": "concatenate distinct", "stddev": "std", "approx_count_distinct": "approx count distinct"}
#: Those whose result depends on the order of rows.
ORDERED = {"first", "last", "concatenate", "concatenate distinct", "longest", "shortest"}


def resolve(fn: object) -> tuple[str, Callable[[Column, Column], Column], bool]:
    """(label, builder, needs order) of an aggregate given by name or as a function Column -> Column; ValueError if unknown."""
    if callable(fn):
        return getattr(fn, "__name__", "custom").strip("<>"), lambda c, p: fn(c), False
    name = str(fn).strip().lower()
    name = SAME.get(name, name)
    if name not in AGGREGATES:
        raise ValueError(f"Unknown aggregation {fn!r}; known: {sorted(AGGREGATES)}")
    return str(fn).strip(), AGGREGATES[name], name in ORDERED


def build(column: str, fn: object, pos: str | None, alias: str | None = None) -> Column:
    label, make, _ = resolve(fn)
    return make(col(column), F.col(pos) if pos else F.lit(0)).alias(alias or f"{label.capitalize()}_{column}")
