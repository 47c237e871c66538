"""Developer tools: encoding, downloads, metadata, JSON and assertions."""

from __future__ import annotations

import json
import re
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.functions.checks import col, columns, frame, one_of
from anchorline.functions.order import temp, with_position
from anchorline.functions.types import group_of, is_number, is_text, spark_type
from anchorline.session import get_spark


class InsecureURLError(ValueError):
    """An address that is not https."""


class SecurityWarning(UserWarning):
    """Something is allowed that should not be."""


def base64_encode(df: DataFrame, column: str, output_column: str | None = None) -> DataFrame:
    """UTF-8 text as base64 without line breaks; null stays null."""
    columns(df, column)
    return df.withColumn(output_column or f"{column}_Base64", F.regexp_replace(F.base64(col(column).cast("string")), r"[\r\n]", ""))


def base64_decode(df: DataFrame, column: str, output_column: str | None = None) -> DataFrame:
    """Base64 as UTF-8 text; null stays null."""
    columns(df, column)
    return df.withColumn(output_column or f"{column}_Decoded", F.decode(F.unbase64(col(column)), "UTF-8"))


def download(url: str, params: dict | None = None, output_column: str = "DownloadData", max_retries: int = 3, retry_delay: float = 1.0, allow_http: bool = False, timeout: float = 30.0, opener: Callable | None = None) -> DataFrame:
    """GET an https address once, on the driver: a JSON list as rows, an object as one row, anything else as one text cell.

    Connection errors, timeouts and 5xx answers are tried again with doubling delay. Plain http raises InsecureURLError unless
    `allow_http`, which warns.
    """
    scheme = urllib.parse.urlparse(url).scheme.lower()
    if scheme == "http" and allow_http:
        warnings.warn("plain http is neither encrypted nor authenticated", SecurityWarning, stacklevel=2)
    elif scheme != "https":
        raise InsecureURLError(f"only https addresses are allowed, got {scheme or 'none'}")
    if params:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
    fetch = opener or (lambda u: urllib.request.urlopen(u, timeout=timeout, context=ssl.create_default_context() if scheme == "https" else None).read())
    for attempt in range(max_retries + 1):
        try:
            body = fetch(url)
            break
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == max_retries:
                raise
        except (urllib.error.URLError, TimeoutError, OSError):
            if attempt == max_retries:
                raise
        time.sleep(retry_delay * 2**attempt)
    text = body.decode("utf-8", errors="replace") if isinstance(body, bytes) else body
    spark = get_spark()
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    rows = data if isinstance(data, list) and data and all(isinstance(r, dict) for r in data) else [data] if isinstance(data, dict) else None
    if rows is None:
        return spark.createDataFrame([(text,)], T.StructType([T.StructField(output_column, T.StringType())]))
    cells = [json.dumps(r, default=str) for r in rows]
    schema = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(rows)))).first()[0]
    return spark.createDataFrame([("[" + ",".join(cells) + "]",)], "j string").select(F.inline(F.from_json("j", schema)))


def column_info(df: DataFrame) -> DataFrame:
    """One row per column, from one pass: Name, Type, Size (bytes of the values), NonNullCount, NullCount, UniqueCount (non-null)."""
    frame(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    fixed = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    for i, f in enumerate(df.schema):
        c = col(f.name)
        kind = f.dataType.simpleString()
        size = F.octet_length(c) if is_text(f.dataType) or kind == "binary" else F.when(c.isNotNull(), F.lit(fixed.get(kind, 8))) if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.octet_length(F.to_json(F.struct(c)))
        key = F.to_json(F.struct(c)) if isinstance(f.dataType, T.MapType) else c
        aggs += [F.count(c).alias(f"c{i}"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias(f"s{i}"), F.count_distinct(key).alias(f"u{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("Name"), F.lit(f.dataType.simpleString()).alias("Type"), F.col(f"s{i}").alias("Size"), F.col(f"c{i}").alias("NonNullCount"), (F.col("n") - F.col(f"c{i}")).alias("NullCount"), F.col(f"u{i}").alias("UniqueCount"))
        for i, f in enumerate(df.schema)
    ])
    return one.select(F.inline(rows))


def dynamic_rename(df: DataFrame, rename_df: DataFrame, key_col: str = "OldName", new_name_col: str = "NewName", mode: str = "mapping") -> DataFrame:
    """Rename columns by a lookup of old and new names, or put the lookup's first new name before or after every name. All at once: names may swap. Of several new names for one column the largest counts."""
    frame(df)
    one_of(mode, ("mapping", "prefix", "suffix"), "mode")
    if mode == "mapping":
        columns(rename_df, [key_col, new_name_col])
        # At most one row a column: of a name given several times the largest new name counts.
        named = {r[0]: r[1] for r in rename_df.filter(col(key_col).isin(*df.columns)).groupBy(col(key_col)).agg(F.max(col(new_name_col))).collect()}
        return df.toDF(*[named.get(c) or c for c in df.columns])
    columns(rename_df, new_name_col)
    first = rename_df.select(col(new_name_col)).first()
    add = str(first[0]) if first and first[0] is not None else ""
    return df.toDF(*[add + c if mode == "prefix" else c + add for c in df.columns])


def dynamic_select(df: DataFrame, dtype_include: str | list | None = None, dtype_exclude: str | list | None = None, pattern: str | None = None) -> DataFrame:
    """Columns by kind (number, string, bool, datetime, category, or a type name) and by a pattern found in their names."""
    frame(df)

    def fits(f: T.StructField, kinds: str | list) -> bool:
        for k in [kinds] if isinstance(kinds, str | type) else kinds:
            name = k.lower() if isinstance(k, str) else k
            if name == "number" and is_number(f.dataType) or name in ("string", "object") and is_text(f.dataType) or name in ("bool", "boolean") and isinstance(f.dataType, T.BooleanType):
                return True
            if name in ("datetime", "datetime64") and group_of(f.dataType) in ("datetime", "date") or name == "category" and f.metadata.get("category"):
                return True
            if name not in ("number", "string", "object", "bool", "boolean", "datetime", "datetime64", "category") and f.dataType.simpleString() == spark_type(k):
                return True
        return False

    keep = [f for f in df.schema if (dtype_include is None or fits(f, dtype_include)) and not (dtype_exclude is not None and fits(f, dtype_exclude))]
    names = [f.name for f in keep if pattern is None or re.search(pattern, f.name)]
    return df.select(*[col(n) for n in names])


def _flatten(c: Column, t: T.DataType, name: str) -> list[tuple[str, Column]]:
    if isinstance(t, T.StructType) and t.fields:
        return [x for f in t for x in _flatten(c.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name)]
    if isinstance(t, T.ArrayType | T.MapType | T.StructType):
        return [(name, F.to_json(c))]
    if isinstance(t, T.DecimalType):
        return [(name, c.cast("double" if t.scale > 0 else "bigint"))]
    return [(name, c)]


def json_parse(df: DataFrame, column: str, prefix: str | None = None, schema: str | None = None) -> DataFrame:
    """JSON objects as columns `<prefix or column>_<path>`, nested names joined by dots; what is no object goes to `..._value`. The column is dropped.

    Broken JSON gives nulls; arrays stay JSON text. The schema is merged from all rows in one pass, or given.
    """
    columns(df, column)
    before = "" if prefix == "" else f"{prefix or column}_"
    c, item = col(column).cast("string"), temp("json")
    kind = F.trim(F.regexp_replace(c, r"(?U)^\s+", ""))
    obj = F.when(kind.startswith("{"), c)
    other = F.when(~kind.startswith("{") & (kind != "null"), F.try_variant_get(F.try_parse_json(c), "$", "string"))
    if schema is None:
        row = df.agg(F.schema_of_variant_agg(F.try_parse_json(obj)).alias("s"), F.count(other).alias("o")).first()
        found = (row["s"] or "VOID").replace("OBJECT<", "STRUCT<")
        schema, others = (found if found.startswith("STRUCT<") else None), row["o"]
        if schema:
            schema = re.sub(r"\bVOID\b", "STRING", schema)
            schema = re.sub(r"\bVARIANT\b", "STRING", schema)
    else:
        others = 0
    out: list[Column] = []
    keep = [col(x) for x in df.columns if x != column]
    if schema:
        parsed = df.withColumn(item, F.from_json(obj, schema))
        t = parsed.schema[item].dataType
        out = [x.alias(before + name) for name, x in _flatten(F.col(item), t, "")]
    else:
        parsed = df
    if others:
        out.append(other.alias(f"{before}value"))
    return parsed.select(*keep, *out)


def test(df: DataFrame, condition_func: str | Column | Callable, error_msg: str = "Test failed") -> DataFrame:
    """`df` itself if the condition holds, else ValueError. The condition is an aggregate (text or Column) or a function of the DataFrame giving one or a truth value."""
    frame(df)
    result = condition_func(df) if callable(condition_func) and not isinstance(condition_func, Column) else condition_func
    if isinstance(result, str):
        result = F.expr(result)
    if isinstance(result, Column):
        result = df.agg(result.alias("ok")).first()["ok"]
    if not result:
        raise ValueError(error_msg)
    return df


def test_equal(left: DataFrame, right: DataFrame, check_order: bool = False, check_dtype: bool = True, rtol: float = 0.0, atol: float = 0.0, columns_only: list[str] | None = None) -> None:
    """AssertionError unless both frames hold the same columns, types and rows (repeated rows included), in the same order if `check_order`.

    With a tolerance rows are compared by place, so it implies `check_order`; tolerances hold for numbers.
    """
    frame(left, "left"), frame(right, "right")
    if columns_only:
        left, right = left.select(*[col(c) for c in columns_only]), right.select(*[col(c) for c in columns_only])
    if left.columns != right.columns:
        raise AssertionError(f"columns differ: {left.columns} and {right.columns}")
    if check_dtype and left.dtypes != right.dtypes:
        raise AssertionError(f"types differ: {left.dtypes} and {right.dtypes}")
    if not (check_order or rtol or atol):
        a, b = left.exceptAll(right), right.exceptAll(left)
        if (row := a.first()) is not None or (row := b.first()) is not None:
            raise AssertionError(f"rows differ, for example {row}")
        return
    pos, names = temp("pos"), left.columns
    a = with_position(left.toDF(*[f"a{i}" for i in range(len(names))]), pos)
    b = with_position(right.toDF(*[f"b{i}" for i in range(len(names))]), pos)
    differ = F.col("_a").isNull() | F.col("_b").isNull()
    for i, f in enumerate(left.schema):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        if (rtol or atol) and is_number(f.dataType):
            differ = differ | ~F.coalesce((F.abs(x - y) <= atol + rtol * F.abs(y)) | x.eqNullSafe(y), F.lit(False))
        else:
            differ = differ | ~x.eqNullSafe(y)
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), pos, "full")
    if (row := both.filter(differ).first()) is not None:
        raise AssertionError(f"rows differ at {row[pos]}: {row}")
