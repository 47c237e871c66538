"""Parse tools: dates, regular expressions, splitting and XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.checks import col, columns, one_of
from anchorline.functions.order import temp
from anchorline.functions.patterns import java_date_format, java_pattern, java_replacement, literal
from anchorline.functions.types import is_text

#: Formats tried in turn when none is given.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyyMMdd")


#: Columns that `xml_parse` makes of names it finds, at most.
MOST_FIELDS = 10_000


def date_time(df: DataFrame, column: str, input_fmt: str | None = None, output_fmt: str | None = None, errors: str = "raise") -> DataFrame:
    """Read text as a timestamp (strftime or Java format, else common formats) in place, and write it back as text if `output_fmt` is given.

    A text that cannot be read raises, or gives null with errors="null". Nulls stay null.
    """
    columns(df, column)
    one_of(errors, ("raise", "null"), "errors")
    c = col(column)
    if is_text(df.schema[column].dataType):
        if input_fmt:
            parsed = F.try_to_timestamp(c, F.lit(java_date_format(input_fmt)))
        else:
            parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS], c.try_cast("timestamp"))
        if errors == "raise":
            bad = F.raise_error(F.concat(F.lit(f"cannot read as a date in {column}: "), c))
            parsed = F.when(c.isNull() | parsed.isNotNull(), parsed).otherwise(bad.cast("timestamp"))
    else:
        parsed = c.cast("timestamp")
    if output_fmt:
        parsed = F.date_format(parsed, java_date_format(output_fmt))
    return df.withColumn(column, parsed)


def regex_match(df: DataFrame, column: str, pattern: str, output_column: str = "Match") -> DataFrame:
    """Whether the pattern occurs anywhere in the value; False for null."""
    columns(df, column)
    return df.withColumn(output_column, F.coalesce(col(column).cast("string").rlike(java_pattern(pattern)), F.lit(False)))


def regex_parse(df: DataFrame, column: str, pattern: str, output_cols: list[str] | None = None) -> DataFrame:
    """Groups of the first match as columns (Group_1, ...); null where nothing or the group does not match."""
    columns(df, column)
    n = re.compile(pattern).groups
    names = output_cols or [f"Group_{i + 1}" for i in range(n)]
    if len(names) != n:
        raise ValueError(f"the pattern has {n} groups, {len(names)} names were given")
    java, c = java_pattern(pattern), col(column).cast("string")
    hit = c.rlike(java)

    def group(i: int) -> Column:
        got = F.regexp_extract(c, java, i)
        # An unmatched optional group reads as ''; it is null unless a second look shows that it matched an empty text.
        return F.when(hit & (got != ""), got).when(hit & _may_be_empty(pattern, i), got)

    return df.select("*", *[group(i + 1).alias(name) for i, name in enumerate(names)])


def _may_be_empty(pattern: str, i: int) -> bool:
    """Whether group `i` takes part in every match, so that '' is what it matched."""
    import re._parser as parser

    def certain(items: list, found: set[int]) -> None:
        for op, arg in items:
            name = str(op)
            if name == "SUBPATTERN":
                if arg[0] is not None:
                    found.add(arg[0])
                certain(arg[3], found)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                certain(arg[2], found)

    found: set[int] = set()
    certain(list(parser.parse(pattern)), found)
    return i in found


def regex_replace(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    """Replace every match in place; \\1 and \\g<name> refer to groups. Null stays null."""
    columns(df, column)
    return df.withColumn(column, F.regexp_replace(col(column).cast("string"), java_pattern(pattern), java_replacement(replacement, pattern)))


def _spread(df: DataFrame, column: str, parts: Column, split_to: str, width: int | None) -> DataFrame:
    """An array as rows (in place), or as columns `<column>_1` ... in place of the column."""
    if split_to == "rows":
        return df.select(*[(F.explode_outer(parts).alias(c) if c == column else col(c)) for c in df.columns])
    if width is None:
        width = df.agg(F.max(F.size(parts))).first()[0] or 0
    item = temp("parts")
    keep = [c for c in df.columns if c != column]
    return df.withColumn(item, parts).select(*[col(c) for c in keep], *[F.get(F.col(item), F.lit(i)).alias(f"{column}_{i + 1}") for i in range(width)])


def regex_tokenize(df: DataFrame, column: str, pattern: str, split_to: str = "rows", num_columns: int | None = None) -> DataFrame:
    """Split at the matches of a pattern, to rows or to columns; `num_columns` saves the job that finds the widest row."""
    columns(df, column)
    one_of(split_to, ("rows", "columns"), "split_to")
    return _spread(df, column, F.split(col(column).cast("string"), java_pattern(pattern), -1), split_to, num_columns)


def text_to_columns(df: DataFrame, column: str, delimiter: str, split_to: str = "columns", num_columns: int | None = None) -> DataFrame:
    """Split at a literal delimiter, to columns (with `num_columns` at most so many, the last holding the rest) or to rows."""
    columns(df, column)
    one_of(split_to, ("rows", "columns"), "split_to")
    limit = num_columns if num_columns and split_to == "columns" else -1
    parts = F.split(col(column).cast("string"), literal(delimiter), limit)
    return _spread(df, column, parts, split_to, None if limit == -1 else _width(df, parts, num_columns))


def _width(df: DataFrame, parts: Column, most: int) -> int:
    return min(most, df.agg(F.max(F.size(parts))).first()[0] or 0)


def _element(text: object, path: str) -> ET.Element | None:
    """First match of an ElementTree path, or the root itself by its name; None for text that is no XML or declares entities."""
    if not isinstance(text, str) or re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
        return None
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return None
    if root.tag == path.strip("/"):
        return root
    try:
        return root.find(path)
    except (SyntaxError, KeyError):
        return None


def _children(el: ET.Element | None) -> dict[str, str] | None:
    if el is None:
        return None
    return {**el.attrib, **{c.tag: (c.text or "") for c in el}}


def xml_parse(df: DataFrame, column: str, xpath: str, output_column: str = "ParsedXML", return_child_values: bool = False, return_outer_xml: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Text of the first element that `xpath` finds, or its outer XML, or its attributes and children as `<output>_<name>`.

    Text that is no XML, or declares a document type or entities, gives nulls. Children's names are found in one pass over the data (more than MOST_FIELDS raise), or given as
    `fields`. Parsing runs in Arrow batches on the XML column only.
    """
    columns(df, column)
    c = col(column).cast("string")
    if not return_child_values:

        def pick(s: pd.Series) -> pd.Series:
            found = [_element(t, xpath) for t in s]
            return pd.Series([None if e is None else ET.tostring(e, encoding="unicode").strip() if return_outer_xml else e.text for e in found], dtype=object)

        pick.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return df.withColumn(output_column, F.pandas_udf(pick, "string")(c))

    def flat(s: pd.Series) -> pd.Series:
        return pd.Series([_children(_element(t, xpath)) for t in s], dtype=object)

    flat.__annotations__ = {"s": pd.Series, "return": pd.Series}
    item = temp("xml")
    parsed = df.withColumn(item, F.pandas_udf(flat, "map<string,string>")(c))
    if fields is None:
        fields = sorted(r[0] for r in parsed.select(F.explode(F.map_keys(item))).distinct().limit(MOST_FIELDS + 1).collect())
        if len(fields) > MOST_FIELDS:
            raise ValueError(f"more than {MOST_FIELDS} names of attributes and children: give the ones wanted as fields")
    return parsed.select(*[col(x) for x in df.columns], *[F.col(item).getItem(f).alias(f"{output_column}_{f}") for f in fields])


