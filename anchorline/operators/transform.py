"""Transform tools: aggregation, reshaping and running windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anchorline.functions import aggregates
from anchorline.functions.checks import col, columns, frame
from anchorline.functions.order import positioned, running_offsets, temp, with_position
from anchorline.functions.types import group_of, is_number
from anchorline.session import materialize


def summarize(df: DataFrame, group_by: str | list[str] | None = None, aggregations: dict[str, str | Callable | list] | None = None, drop_null_groups: bool = True, order_by: str | list[str] | None = None, sort: bool = True) -> DataFrame:
    """Aggregates per group, named `<Fn>_<column>`; without groups one row, for an empty input too.

    Rows with a null key are left out (drop_null_groups). `order_by` gives the order that first, last, concatenate, longest and shortest
    depend on (else that of the input). The result is sorted by its keys unless sort is False.
    """
    frame(df)
    if not aggregations:
        raise ValueError("summarize needs aggregations")
    groups = columns(df, group_by)
    columns(df, list(aggregations))
    wanted = [(c, fn) for c, fns in aggregations.items() for fn in (fns if isinstance(fns, list) else [fns])]
    pos = temp("pos") if any(aggregates.resolve(fn)[2] for _, fn in wanted) else None
    base = positioned(df, order_by, pos) if pos else df
    aggs = [aggregates.build(c, fn, pos) for c, fn in wanted]
    if not groups:
        return base.agg(*aggs)
    if drop_null_groups:
        for g in groups:
            base = base.filter(col(g).isNotNull())
    out = base.groupBy(*[col(g) for g in groups]).agg(*aggs)
    return out.orderBy(*[col(g) for g in groups]) if sort else out


def transpose(df: DataFrame, key_columns: str | list[str], data_columns: list[str] | None = None, var_name: str = "Name", value_name: str = "Value") -> DataFrame:
    """One row per key row and data column (by default all that are no keys). Values without a common type become text."""
    keys = columns(df, key_columns)
    data = columns(df, data_columns) if data_columns else [c for c in df.columns if c not in keys]
    kinds = {"number" if is_number(df.schema[c].dataType) else df.schema[c].dataType.simpleString() for c in data}
    if len(kinds) > 1:
        df = df.select(*[col(k) for k in keys], *[col(c).cast("string").alias(c) for c in data])
    return df.unpivot([col(k) for k in keys], [col(c) for c in data], var_name, value_name)


def cross_tab(df: DataFrame, group_by: str | list[str], pivot_col: str, value_col: str, agg: str | Callable = "sum", values: list | None = None, order_by: str | list[str] | None = None) -> DataFrame:
    """One row per group, one column per value of `pivot_col`, filled with an aggregate of `value_col`; missing numbers are 0.

    Rows with null keys are left out. Giving `values` saves the job that finds them and fixes the columns.
    """
    groups = columns(df, group_by)
    columns(df, [pivot_col, value_col])
    pos = temp("pos") if aggregates.resolve(agg)[2] else None
    base = positioned(df, order_by, pos) if pos else df
    for c in [*groups, pivot_col]:
        base = base.filter(col(c).isNotNull())
    cell = aggregates.build(value_col, agg, pos, value_col)
    out = base.groupBy(*[col(g) for g in groups]).pivot(pivot_col, sorted(values) if values else None).agg(cell)
    made = [c for c in out.columns if c not in groups]
    return out.select(*[col(g) for g in groups], *[F.coalesce(col(c), F.lit(0)).alias(c) if is_number(out.schema[c].dataType) else col(c) for c in made]).orderBy(*[col(g) for g in groups])


def running_total(df: DataFrame, column: str, group_by: str | list[str] | None = None, output_column: str | None = None, order_by: str | list[str] | None = None) -> DataFrame:
    """Running sum in row order (or that of `order_by`), per group or over all rows; null where the value or group is null.

    Over all rows it is a sum inside each partition plus the sums of the partitions before: no task holds all rows.
    """
    columns(df, column)
    name = output_column or f"RunningTotal_{column}"
    c = col(column)
    if group_by is not None:
        groups = columns(df, group_by)
        pos = temp("pos")
        w = Window.partitionBy(*[col(g) for g in groups]).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        known = c.isNotNull()
        for g in groups:
            known = known & col(g).isNotNull()
        return positioned(df, order_by, pos).withColumn(name, F.when(known, F.sum(c).over(w))).drop(pos)
    pos, part = temp("pos"), temp("part")
    if order_by is None:
        laid = df.withColumn(pos, F.monotonically_increasing_id()).withColumn(part, F.shiftright(pos, 33))
    else:
        laid = with_position(df, pos, 0, order_by)
        laid = laid.withColumn(part, F.expr(f"`{pos}` div 1000000"))
    laid = materialize(laid, "running")
    offsets = running_offsets(laid, c, part)
    w = Window.partitionBy(part).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(F.broadcast(offsets), part)  # one row per partition
    return out.withColumn(name, F.when(c.isNotNull(), F.sum(c).over(w) + F.coalesce("offset", F.lit(0)))).select(*[col(x) for x in df.columns if x != name], col(name))


def count_records(df: DataFrame, output_col: str = "Count") -> DataFrame:
    """Number of rows, as one row."""
    return frame(df).agg(F.count(F.lit(1)).alias(output_col))


def arrange(df: DataFrame, key_columns: str | list[str], output_mapping: dict[str, list[str]]) -> DataFrame:
    """Stack parallel column lists: each row gives one row per list place, sorted by the keys. An empty mapping changes nothing."""
    keys = columns(df, key_columns)
    if not output_mapping:
        return df
    if len({len(v) for v in output_mapping.values()}) > 1:
        raise ValueError("all lists of output_mapping must have the same length")
    for v in output_mapping.values():
        columns(df, v)
    kind = {}
    for out, v in output_mapping.items():
        groups = {"number" if is_number(df.schema[c].dataType) else df.schema[c].dataType.simpleString() for c in v}
        wide = "double" if any(group_of(df.schema[c].dataType) == "float" for c in v) else "bigint"
        kind[out] = "string" if len(groups) > 1 else wide if groups == {"number"} else df.schema[v[0]].dataType.simpleString()
    n = len(next(iter(output_mapping.values())))
    rows = F.array(*[F.struct(*[col(v[i]).cast(kind[out]).alias(out) for out, v in output_mapping.items()]) for i in range(n)])
    pos, item = temp("pos"), temp("item")
    stacked = df.select(*[col(k) for k in keys], F.posexplode(rows).alias(pos, item))
    return stacked.orderBy(*[col(k).asc_nulls_last() for k in keys], pos).select(*[col(k) for k in keys], *[F.col(item).getField(o).alias(o) for o in output_mapping])


def make_columns(df: DataFrame, num_columns: int, order_by: str | list[str] | None = None) -> DataFrame:
    """Row i goes to row i div k as the (i mod k + 1)-th set of columns: all _1, then all _2, ...; missing ones are null."""
    frame(df)
    if num_columns < 1:
        raise ValueError("num_columns must be at least 1")
    if num_columns == 1:
        return df
    pos, row = temp("pos"), temp("row")
    numbered = with_position(df, pos, 0, order_by)
    place = F.col(pos) % num_columns
    sets = [F.max(F.when(place == j, F.struct(*[col(c) for c in df.columns]))).alias(f"s{j}") for j in range(num_columns)]
    wide = numbered.groupBy(F.expr(f"`{pos}` div {num_columns}").alias(row)).agg(*sets).orderBy(row)
    return wide.select(*[F.col(f"s{j}").getField(c).alias(f"{c}_{j + 1}") for j in range(num_columns) for c in df.columns])


def weighted_average(df: DataFrame, value: str, weight: str, group_by: str | list[str] | None = None, output_column: str = "WeightedAverage") -> DataFrame:
    """Sum of value x weight by sum of weights (those of null values too); null if the weights sum to 0. Rows with null groups are left out."""
    columns(df, [value, weight])
    avg: Column = F.try_divide(F.coalesce(F.sum(col(value) * col(weight)), F.lit(0)).cast("double"), F.sum(col(weight)).cast("double")).alias(output_column)
    if group_by is None:
        return df.agg(avg)
    groups = columns(df, group_by)
    for g in groups:
        df = df.filter(col(g).isNotNull())
    return df.groupBy(*[col(g) for g in groups]).agg(avg).orderBy(*[col(g) for g in groups])
