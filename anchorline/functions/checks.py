"""Argument checks shared by the tools."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame(value: object, name: str = "df") -> DataFrame:
    """`value` if it is a DataFrame, else TypeError."""
    if not isinstance(value, DataFrame):
        raise TypeError(f"{name} must be a DataFrame, got {type(value).__name__}")
    return value


def columns(df: DataFrame, names: str | Iterable[str] | None) -> list[str]:
    """`names` as a list; KeyError listing what is missing and what there is."""
    frame(df)
    names = [names] if isinstance(names, str) else list(names or [])
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"Columns not found: {missing}. Available columns: {df.columns}")
    return names


def one_of(value: str, allowed: Iterable[str], what: str) -> str:
    if value not in (allowed := list(allowed)):
        raise ValueError(f"{what} must be one of {allowed}, got {value!r}")
    return value


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")
