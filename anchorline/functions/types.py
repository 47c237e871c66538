"""Names of data types as users write them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Accepted names, in lower case, and the Spark type of each.
_NAMES = {
    "tinyint": "int8 byte tinyint", "smallint": "int16 short smallint", "int": "int32 int integer", "bigint": "int64 long bigint uint8 uint16 uint32", "decimal(20,0)": "uint64",
    "float": "float16 float32 float", "double": "float64 double number", "string": "str string object text category", "boolean": "bool boolean",
    "timestamp": "datetime64[ns] datetime64[us] datetime64[ms] datetime datetime64 timestamp datetime64[ns,utc]", "timestamp_ntz": "timestamp_ntz", "date": "date", "binary": "bytes binary",
}
ALIASES = {name: spark for spark, names in _NAMES.items() for name in names.split()} | {"int": "bigint", "float": "double"}


def spark_type(name: object) -> str:
    """The Spark type for a type name, a Python type or a Spark type; ValueError for unknown ones."""
    if isinstance(name, T.DataType):
        return name.simpleString()
    text = {int: "int", float: "float", str: "str", bool: "bool", bytes: "bytes"}.get(name, name) if isinstance(name, type) else name
    if isinstance(text, str):
        key = text.strip().lower().replace(" ", "")
        if key in ALIASES:
            return ALIASES[key]
        if re.fullmatch(r"decimal\(\d+,\d+\)", key):
            return key
    raise ValueError(f"Unknown data type: {name!r}")


def group_of(t: T.DataType) -> str:
    """int, float, str, bool, datetime, date or other."""
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return "date" if isinstance(t, T.DateType) else "other"


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)
