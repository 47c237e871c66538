"""Row order and dense numbers without moving all rows into one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anchorline.functions.checks import col
from anchorline.session import materialize

LOW = (1 << 33) - 1


def temp(name: str) -> str:
    """A column name that clashes with none."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def keys_of(order_by: str | list | None, ascending: bool = True) -> list[Column]:
    """Sort keys, nulls last in either direction."""
    names = [order_by] if isinstance(order_by, str | Column) else list(order_by or [])
    out = []
    for n in names:
        c = col(n) if isinstance(n, str) else n
        out.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    return out


def with_position(df: DataFrame, name: str, start: int = 0, order_by: str | list | None = None) -> DataFrame:
    """`df` with a dense number start, start + 1, ... in row order, or in the order given.

    Rows are written once (range-partitioned and sorted if an order is given), counted per partition, and each
    partition's numbers begin after those of the ones before it: no task sees all rows.
    """
    mid = temp("mid")
    if order_by is not None:
        keys = keys_of(order_by)
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = materialize(df.withColumn(mid, F.monotonically_increasing_id()), "positions")
    part = F.shiftright(mid, 33)
    sizes = sorted((r[0], r[1]) for r in laid.groupBy(part.alias("p")).count().collect())  # one row per partition
    at, starts = start, []
    for p, n in sizes:
        starts.append((p, at))
        at += n
    low = F.col(mid).bitwiseAND(F.lit(LOW))
    if len(starts) <= 1:
        return laid.withColumn(name, low + F.lit(starts[0][1] if starts else start)).drop(mid)
    offset = laid.sparkSession.createDataFrame(starts, f"{mid}p bigint, {mid}s bigint")
    out = laid.join(F.broadcast(offset), part == F.col(mid + "p"))  # one row per partition
    return out.withColumn(name, low + F.col(mid + "s")).drop(mid, mid + "p", mid + "s")


def positioned(df: DataFrame, order_by: str | list | None, name: str) -> DataFrame:
    """`df` with a column that orders its rows: a struct of the sort keys, or else the row's place in the input."""
    if order_by is None:
        return df.withColumn(name, F.monotonically_increasing_id())
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.withColumn(name, F.struct(*[x for n in names for x in (col(n).isNull().alias(f"n_{n}"), col(n).alias(f"v_{n}"))]))


def running_offsets(df: DataFrame, value: Column, part: str) -> DataFrame:
    """Sum of `value` in all partitions before each one: `part` (number), offset."""
    sums = df.groupBy(part).agg(F.sum(value).alias("s"))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return sums.select(part, F.sum("s").over(w).alias("offset"))
