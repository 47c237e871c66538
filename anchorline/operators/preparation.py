"""Preparation tools: filters, formulas, sorts, samples and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from anchorline.functions.checks import col, columns, frame, one_of
from anchorline.functions.expressions import compile_any, compile_text
from anchorline.functions.order import keys_of, positioned, temp, with_position
from anchorline.functions.text import strip
from anchorline.functions.types import group_of, is_number, is_text, spark_type
from anchorline.session import get_spark, join_small, materialize


class Split(NamedTuple):
    """Rows for which a condition holds, and all others."""

    true: DataFrame
    false: DataFrame


class Uniques(NamedTuple):
    """The first row of each key, and the rest."""

    unique: DataFrame
    duplicate: DataFrame


class Samples(NamedTuple):
    estimation: DataFrame
    validation: DataFrame
    holdout: DataFrame


def _condition(c: Column, operator: str, value: object) -> Column:
    op = str(operator).strip().lower()
    match op:
        case "=" | "==" | "equals":
            return c == F.lit(value)
        case "!=" | "does not equal":
            return ~c.eqNullSafe(F.lit(value))
        case ">":
            return c > F.lit(value)
        case ">=":
            return c >= F.lit(value)
        case "<":
            return c < F.lit(value)
        case "<=":
            return c <= F.lit(value)
        case "is null":
            return c.isNull()
        case "is not null":
            return c.isNotNull()
        case "is empty":
            return c.isNull() | (c.cast("string") == "")
        case "is not empty":
            return c.isNotNull() & (c.cast("string") != "")
        case "contains":
            return c.cast("string").contains(F.lit(str(value)))
        case "does not contain":
            return c.isNull() | ~c.cast("string").contains(F.lit(str(value)))
        case "is true":
            return c.eqNullSafe(F.lit(True))
        case "is false":
            return c.eqNullSafe(F.lit(False))
    raise ValueError(f"Unknown operator: {operator!r}")


def filter(df: DataFrame, condition: str | Column | Callable | None = None, *, column: str | None = None, operator: str | None = None, value: object = None, udf: bool = False) -> Split:
    """Split rows by a condition; every row is in exactly one of both outputs.

    `condition` is text, a Column or a function of the DataFrame; with `udf` it is a function of a pandas frame that gives a mask, applied
    batch by batch. Or give `column`, `operator`, `value`. Rows whose condition is null are false. `!=` and `does not contain` hold for null.
    """
    frame(df)
    if condition is not None and udf:
        return _masked(df, condition)
    if condition is not None:
        p = compile_any(condition, df)
    elif column is not None and operator is not None:
        columns(df, column)
        p = _condition(col(column), operator, value)
    else:
        raise ValueError("filter needs a condition, or column and operator")
    # Not coalesce(p, false): that would keep the predicate out of the scan.
    return Split(df.filter(p), df.filter(p.isNull() | ~p))


def _masked(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> Split:
    def keep(want: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                mask = fn(f).fillna(False).astype(bool)
                yield f[mask] if want else f[~mask]

        return run

    return Split(df.mapInPandas(keep(True), df.schema), df.mapInPandas(keep(False), df.schema))


def formula(df: DataFrame, column: str, expression: str | Column | Callable, udf: bool = False, returns: str | None = None) -> DataFrame:
    """`df` with `column` set to an expression: text, a Column or a function of the DataFrame that returns one.

    With `udf`, the expression is a function of a pandas frame giving a Series of type `returns`, applied batch by batch.
    """
    frame(df)
    if not udf:
        return df.withColumn(column, compile_any(expression, df))
    if returns is None:
        raise ValueError("a pandas function needs the type it returns")
    names = df.columns  # the function must not hold the frame
    return df.withColumn(column, _series(lambda *cols: expression(pd.concat(cols, axis=1, keys=names)), spark_type(returns))(*[col(c) for c in names]))


def _series(fn: Callable, returns: str) -> Callable[..., Column]:
    """A scalar pandas UDF around `fn`; `fn` is kept free of annotations."""

    def run(*cols: pd.Series) -> pd.Series:
        return fn(*cols)

    return F.pandas_udf(run, returns)


def select(df: DataFrame, columns: list[str] | None = None, renames: dict[str, str] | None = None, dtypes: dict[str, object] | None = None, on_error: str = "raise") -> DataFrame:
    """Choose columns, rename them, then change types (given by the new names). A failed change raises, or gives null with on_error="null"."""
    frame(df)
    one_of(on_error, ("raise", "null"), "on_error")
    names = _columns(df, columns) if columns is not None else df.columns
    renames, dtypes = renames or {}, dtypes or {}
    _columns(df, [c for c in renames if c not in names])
    new = {n: renames.get(n, n) for n in names}
    if unknown := [c for c in dtypes if c not in new.values()]:
        raise KeyError(f"Columns not found: {unknown}. Available columns: {list(new.values())}")
    out = []
    for old, name in new.items():
        c = col(old)
        if name in dtypes:
            t = spark_type(dtypes[name])
            c = c.try_cast(t) if on_error == "null" else c.cast(t)
        out.append(c.alias(name))
    return df.select(*out)


_columns = columns


def data_cleansing(df: DataFrame, columns: list[str] | None = None, remove_null_rows: bool = False, replace_nulls_with: object = None, strip_whitespace: bool = True,
                   remove_letters: bool = False, remove_numbers: bool = False, remove_punctuation: bool = False, modify_case: str | None = None) -> DataFrame:
    """Clean text columns (by default all): drop rows with nulls, fill nulls, strip, remove kinds of characters, change case (lower, upper, title).

    In this order. Nulls stay null; only text is changed, in other columns only nulls are filled (where the type allows it).
    """
    frame(df)
    names = _columns(df, columns) if columns is not None else [f.name for f in df.schema if is_text(f.dataType)]
    if modify_case is not None:
        one_of(modify_case, ("lower", "upper", "title"), "modify_case")
    if remove_null_rows and names:
        keep = F.lit(True)
        for n in names:
            keep = keep & col(n).isNotNull()
        df = df.filter(keep)
    out = []
    for f in df.schema:
        c = col(f.name)
        if f.name in names:
            if replace_nulls_with is not None and _fits(replace_nulls_with, f.dataType):
                c = F.coalesce(c, F.lit(replace_nulls_with).cast(f.dataType))
            if is_text(f.dataType):
                if strip_whitespace:
                    c = strip(c)
                if remove_letters:
                    c = F.regexp_replace(c, "[A-Za-z]", "")
                if remove_numbers:
                    c = F.regexp_replace(c, r"(?U)\d", "")
                if remove_punctuation:
                    c = F.regexp_replace(c, r"(?U)[^\w\s]", "")
                if modify_case == "lower":
                    c = F.lower(c)
                elif modify_case == "upper":
                    c = F.upper(c)
                elif modify_case == "title":  # every letter that follows no letter
                    parts = F.split(F.lower(c), r"(?<!\p{L})(?=\p{L})")
                    c = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 2**31 - 1))), "")
        out.append(c.alias(f.name))
    return df.select(*out)


def _fits(value: object, t: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(t, T.BooleanType)
    if isinstance(value, int):
        return is_number(t)
    if isinstance(value, float):
        return group_of(t) == "float"
    return isinstance(value, str) and is_text(t)


def sort(df: DataFrame, columns: str | list[str], ascending: bool | list[bool] = True) -> DataFrame:
    """Sort; nulls come last in both directions. Followed by a limit it is a top-k without a full sort."""
    names = _columns(df, columns)
    up = ascending if isinstance(ascending, list) else [ascending] * len(names)
    if len(up) != len(names):
        raise ValueError("ascending must be one value, or one for each column")
    return df.orderBy(*[col(n).asc_nulls_last() if a else col(n).desc_nulls_last() for n, a in zip(names, up, strict=True)])


def unique(df: DataFrame, columns: str | list[str] | None = None, ignore_case: bool = False, order_by: str | list[str] | None = None) -> Uniques:
    """The first row per key (in the order of `order_by`, else of the input) and the remaining rows. Null keys are equal.

    Keys are all columns if none are given. Without an order, the first rows follow the input's partitions and rows.
    """
    frame(df)
    names = _columns(df, columns) if columns is not None else df.columns
    text = {f.name for f in df.schema if is_text(f.dataType)}
    pos, rn = temp("pos"), temp("rn")
    keys = [F.lower(col(n)) if ignore_case and n in text else col(n) for n in names]
    w = Window.partitionBy(*keys).orderBy(pos)
    ranked = positioned(df, order_by, pos).withColumn(rn, F.row_number().over(w)).drop(pos)
    return Uniques(ranked.filter(F.col(rn) == 1).drop(rn), ranked.filter(F.col(rn) > 1).drop(rn))


def sample(df: DataFrame, n: int | None = None, pct: float | None = None, random: bool = False, position: str = "first", random_state: int | None = None, order_by: str | list[str] | None = None) -> DataFrame:
    """The first, last or random `n` rows, or `pct` (share of the rows, at least one row).

    A share is cut by dense numbers, so no task holds all rows of it; `n` rows are few and come from one.
    """
    frame(df)
    if (n is None) == (pct is None):
        raise ValueError("give either n or pct")
    one_of(position, ("first", "last"), "position")
    if pct is not None:
        return _share(df, pct, random, position, random_state, order_by)
    if random:
        key = F.rand(random_state if random_state is not None else None)
        return df.orderBy(key).limit(n)
    if order_by is not None:
        up = position == "first"
        return df.orderBy(*[k for k in (_reverse(order_by) if not up else keys_of(order_by))]).limit(n)
    if position == "first":
        return df.limit(n)
    pos = temp("pos")
    return df.withColumn(pos, F.monotonically_increasing_id()).orderBy(F.col(pos).desc()).limit(n).orderBy(pos).drop(pos)


def _share(df: DataFrame, pct: float, random: bool, position: str, random_state: int | None, order_by: str | list[str] | None) -> DataFrame:
    key, pos = temp("key"), temp("pos")
    by = key if random else order_by
    laid = materialize(with_position(df.withColumn(key, F.rand(random_state)) if random else df, pos, 0, by), "sample")
    total = laid.count()
    n = max(1, int(total * pct))
    part = laid.filter(F.col(pos) < n if random or position == "first" else F.col(pos) >= total - n)
    return part.select(*[col(c) for c in df.columns])


def _reverse(order_by: str | list[str]) -> list[Column]:
    names = [order_by] if isinstance(order_by, str) else order_by
    return [col(n).desc_nulls_first() for n in names]


def record_id(df: DataFrame, column_name: str = "RecordID", start: int = 1, order_by: str | list[str] | None = None) -> DataFrame:
    """A dense number as first column, in row order or in the order given; no task numbers all rows."""
    frame(df)
    name = temp("id")
    keep = [c for c in df.columns if c != column_name]
    return with_position(df, name, start, order_by).select(F.col(name).alias(column_name), *[col(c) for c in keep])


def generate_rows(count: int, expression: Callable | None = None, columns: list[str] | None = None, udf: bool = False, schema: str | None = None) -> DataFrame:
    """Rows 0 .. count - 1 (RowNum), or what `expression` makes of the number: a dict of Columns, or with `udf` a dict of values (needs `schema`)."""
    if count < 0:
        raise ValueError("count must not be negative")
    base = get_spark().range(count).withColumnRenamed("id", "RowNum")
    if expression is None:
        return base
    if udf:
        if schema is None:
            raise ValueError("a Python function needs a schema")

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([expression(int(i)) for i in f["RowNum"]])

        out = base.mapInPandas(make, schema)
    else:
        made = expression(F.col("RowNum"))
        out = base.select(*[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in made.items()])
    return out.select(*[col(c) for c in columns]) if columns else out


def auto_field(df: DataFrame) -> DataFrame:
    """Narrow types from one pass over the data: integers to the smallest that holds them, doubles to float where nothing is
    lost; text with distinct values in under half of its rows is marked as category in the column's metadata."""
    frame(df)
    aggs = []
    for i, f in enumerate(df.schema):
        c, kind = col(f.name), group_of(f.dataType)
        if kind == "int":
            aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
        elif isinstance(f.dataType, T.DoubleType):
            aggs.append(F.bool_and(F.isnan(c) | (c == c.cast("float").cast("double"))).alias(f"a{i}"))
        elif kind == "str":
            aggs += [F.approx_count_distinct(c).alias(f"a{i}"), F.count(c).alias(f"b{i}")]
    if not aggs:
        return df
    s = df.agg(*aggs).first()
    out = []
    for i, f in enumerate(df.schema):
        c, kind = col(f.name), group_of(f.dataType)
        if kind == "int" and s[f"a{i}"] is not None:
            lo, hi = s[f"a{i}"], s[f"b{i}"]
            t = next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << bits) <= lo and hi < 1 << bits)
            out.append(c.cast(t).alias(f.name))
        elif isinstance(f.dataType, T.DoubleType) and s[f"a{i}"]:
            out.append(c.cast("float").alias(f.name))
        elif kind == "str" and s[f"b{i}"] and s[f"a{i}"] < 0.5 * s[f"b{i}"]:
            out.append(c.alias(f.name, metadata={**f.metadata, "category": True}))
        else:
            out.append(c.alias(f.name))
    return df.select(*out)


def multi_field_formula(df: DataFrame, columns: list[str], expression: str | Callable, udf: bool = False, returns: str | None = None) -> DataFrame:
    """Apply one expression to each of several columns: text with `_CurrentField_`, a function Column -> Column, or with `udf` Series -> Series."""
    names = set(_columns(df, columns))
    out = []
    for f in df.schema:
        c = col(f.name)
        if f.name in names:
            if udf:
                c = _series(expression, spark_type(returns) if returns else f.dataType.simpleString())(c)
            elif isinstance(expression, str):
                c = compile_text(expression.replace("_CurrentField_", f"`{f.name}`"), df.columns)
            else:
                c = expression(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def multi_row_formula(df: DataFrame, column: str, expression: Callable[[Column, Column], Column], rows_back: int = 1, group_by: str | list[str] | None = None, order_by: str | list[str] | None = None) -> DataFrame:
    """Set `column` from its value and that of the row `rows_back` before (negative: after), per group; null where there is none.

    Without groups, rows are first numbered densely, and the other row is found by joining numbers, so no task holds all rows.
    """
    _columns(df, column)
    if group_by is not None:
        pos = temp("pos")
        w = Window.partitionBy(*[col(g) for g in _columns(df, group_by)]).orderBy(pos)
        prev = F.lag(col(column), rows_back).over(w)
        return positioned(df, order_by, pos).withColumn(column, expression(col(column), prev)).drop(pos)
    pos, prev = temp("pos"), temp("prev")
    numbered = materialize(with_position(df, pos, 0, order_by), "numbered")
    other = numbered.select((F.col(pos) + rows_back).alias(pos), col(column).alias(prev))
    joined = numbered.join(other, pos, "left")
    return joined.withColumn(column, expression(col(column), F.col(prev))).select(*[col(c) for c in df.columns])


def tile(df: DataFrame, column: str, n_tiles: int, method: str = "equal_records", output_column: str = "Tile") -> DataFrame:
    """Tile 1 .. n by value: `equal_records` between exact quantiles (equal values share a tile), `equal_range` between equally
    wide right-closed edges. Null gives null; edges are a few numbers, found in one aggregate."""
    _columns(df, column)
    one_of(method, ("equal_records", "equal_range"), "method")
    if n_tiles < 1:
        raise ValueError("n_tiles must be at least 1")
    c = col(column).cast("double")
    if method == "equal_records":
        row = df.select(F.percentile(c, F.array(*[F.lit(i / n_tiles) for i in range(1, n_tiles)])).alias("e")).first() if n_tiles > 1 else None
        edges = sorted(set(row["e"])) if row and row["e"] else []
        out = F.when(c.isNotNull(), F.lit(len(edges) + 1))
        for i in range(len(edges), 0, -1):
            out = F.when(c <= edges[i - 1], F.lit(i)).otherwise(out)
        return df.withColumn(output_column, F.when(c.isNotNull(), out).cast("int"))
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None or lo == hi:
        return df.withColumn(output_column, F.when(c.isNotNull(), F.lit((n_tiles + 1) // 2 if lo is not None else 1)).cast("int"))
    width = (hi - lo) / n_tiles
    return df.withColumn(output_column, F.when(c.isNotNull(), F.least(F.greatest(F.ceil((c - lo) / width), F.lit(1)), F.lit(n_tiles))).cast("int"))


def imputation(df: DataFrame, columns: str | list[str], method: str = "mean", replacement_value: object = None, add_indicator: bool = True) -> DataFrame:
    """Fill nulls by mean, median, mode (of equal counts the smallest) or a value; `<column>_WasImputed` marks filled rows.

    All statistics come from one pass. A column without values stays null.
    """
    names = _columns(df, columns)
    one_of(method, ("mean", "median", "mode", "value"), "method")
    if method == "value" and replacement_value is None:
        raise ValueError("method 'value' needs replacement_value")
    fn = {"mean": F.avg, "median": F.median, "mode": lambda c: F.mode(c, True)}.get(method)
    stats = df.agg(*[fn(col(n)).alias(n) for n in names]).first() if fn else dict.fromkeys(names, replacement_value)
    out = []
    for f in df.schema:
        c = col(f.name)
        if f.name in names and stats[f.name] is not None:
            wide = method in ("mean", "median") and is_number(f.dataType)
            c = F.coalesce(c.cast("double") if wide else c, F.lit(stats[f.name]) if wide else F.lit(stats[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    marks = [col(n).isNull().alias(f"{n}_WasImputed") for n in names] if add_indicator else []
    return df.select(*out, *marks)


def create_samples(df: DataFrame, est: float = 0.7, val: float = 0.2, hold: float = 0.1, random_state: int | None = None, exact: bool = True) -> Samples:
    """Three random samples of exactly int(n * est), int(n * val) and the remaining rows; with exact=False of about these sizes, in one pass."""
    frame(df)
    if round(est + val + hold, 5) != 1.0:
        raise ValueError("the shares must sum to 1")
    if not exact:
        return Samples(*df.randomSplit([est, val, hold], random_state))
    key, pos = temp("key"), temp("pos")
    numbered = materialize(with_position(df.withColumn(key, F.rand(random_state)), pos, 0, key).drop(key), "samples")
    n = numbered.count()
    a, b = int(n * est), int(n * val)
    p = F.col(pos)
    return Samples(numbered.filter(p < a).drop(pos), numbered.filter((p >= a) & (p < a + b)).drop(pos), numbered.filter(p >= a + b).drop(pos))


def date_filter(df: DataFrame, column: str, start: object = None, end: object = None) -> Split:
    """Rows whose date lies between `start` and `end` (both included, as instants), and all others, nulls included. Text is read as a date for the test only."""
    _columns(df, column)
    t = df.schema[column].dataType
    c = F.try_to_timestamp(col(column)) if is_text(t) else col(column)
    kind = "timestamp_ntz" if isinstance(t, T.TimestampNTZType) else "timestamp"
    p = F.lit(True)
    if start is not None:
        p = p & (c >= F.lit(str(start)).cast(kind))
    if end is not None:
        p = p & (c <= F.lit(str(end)).cast(kind))
    p = p & c.isNotNull()
    return Split(df.filter(p), df.filter(p.isNull() | ~p))


def oversample_field(df: DataFrame, column: str, value: object, target_pct: float = 0.5, random_state: int | None = None) -> DataFrame:
    """Draw rows with `value` with replacement until they make up `target_pct`; all other rows (nulls too) are kept once. The result is in random order."""
    _columns(df, column)
    if not 0 < target_pct < 1:
        raise ValueError("target_pct must lie between 0 and 1")
    hit = col(column).eqNullSafe(F.lit(value))
    pos = temp("pos")
    targets = with_position(df.filter(hit), pos)
    targets = materialize(targets, "targets")
    k, others = targets.count(), df.filter(~hit)
    want = int(others.count() * target_pct / (1 - target_pct))
    if k == 0 or want == 0:
        return df
    draws = df.sparkSession.range(want).select(F.floor(F.rand(random_state) * k).cast("bigint").alias(pos))
    drawn = join_small(draws, targets, pos, rows=k).select(*[col(c) for c in df.columns])
    out = others.unionByName(drawn)
    return out.orderBy(F.rand(random_state))


def rank(df: DataFrame, column: str, group_by: str | list[str] | None = None, ascending: bool = False, method: str = "min", output_column: str = "Rank", order_by: str | list[str] | None = None) -> DataFrame:
    """Rank per group: min, dense, first (ties by row order), max or average. A null has no rank.

    Without groups, distinct values are ranked (their number is what one task orders per range) and joined back.
    """
    _columns(df, column)
    one_of(method, ("min", "dense", "first", "max", "average"), "method")
    c = col(column)
    key = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    if group_by is None and method != "first":
        return _global_rank(df, column, ascending, method, output_column)
    if group_by is None:
        pos, rn = temp("pos"), temp("rn")
        sign = temp("key")
        placed = positioned(df, order_by, pos).withColumn(sign, c if ascending or not is_number(df.schema[column].dataType) else -c)
        if not ascending and not is_number(df.schema[column].dataType):
            raise ValueError("method 'first' in descending order without groups needs a numeric column")
        numbered = with_position(placed, rn, 1, [sign, pos]).drop(pos, sign)
        return numbered.withColumn(output_column, F.when(c.isNotNull(), F.col(rn))).drop(rn)
    groups = [col(g) for g in _columns(df, group_by)]
    w = Window.partitionBy(*groups).orderBy(key)
    same = Window.partitionBy(*groups, c)
    if method == "first":
        pos = temp("pos")
        out = positioned(df, order_by, pos)
        r = F.row_number().over(Window.partitionBy(*groups).orderBy(key, F.col(pos)))
        return out.withColumn(output_column, F.when(c.isNotNull(), r).cast("bigint")).drop(pos)
    size = F.count(F.lit(1)).over(same)
    r = {"min": F.rank().over(w), "dense": F.dense_rank().over(w), "max": F.rank().over(w) + size - 1, "average": F.rank().over(w) + (size - 1) / 2}[method]
    return df.withColumn(output_column, F.when(c.isNotNull(), r).cast("double" if method == "average" else "bigint"))


def _global_rank(df: DataFrame, column: str, ascending: bool, method: str, output_column: str) -> DataFrame:
    v, n, at, part, dense = (temp(x) for x in ("v", "n", "at", "part", "dense"))
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias(v)).agg(F.count(F.lit(1)).alias(n))
    key = F.col(v).asc() if ascending else F.col(v).desc()
    laid = counts.repartitionByRange(key).sortWithinPartitions(key).withColumn(part, F.spark_partition_id())
    laid = materialize(laid, "rank-values")
    inside = Window.partitionBy(part).orderBy(key)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sums = laid.groupBy(part).agg(F.sum(n).alias("s"), F.count(F.lit(1)).alias("d"))
    sums = sums.select(part, F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"))
    ranked = laid.withColumn(at, F.sum(n).over(inside) - F.col(n)).withColumn(dense, F.row_number().over(inside)).join(F.broadcast(sums), part)  # one row per partition
    low = F.col(at) + F.col("s0") + 1
    r = {"min": low, "dense": F.col(dense) + F.col("d0"), "max": low + F.col(n) - 1, "average": low + (F.col(n) - 1) / 2}[method]
    ranks = materialize(ranked.select(v, r.cast("double" if method == "average" else "bigint").alias(output_column)), "ranks")
    base = df.drop(output_column) if output_column in df.columns else df
    return join_small(base.withColumn(v, col(column)), ranks, v, "left").drop(v)
