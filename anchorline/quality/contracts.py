"""Schema, value, volume and freshness contracts, checked by one aggregate each."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.functions.checks import col, columns, frame
from anchorline.functions.patterns import java_pattern
from anchorline.functions.types import group_of, is_number, is_text, spark_type
from anchorline.session import get_spark

REPORT = "Suite string, Contract string, Description string, Status string, Violation_Count bigint, Violations string"


class SchemaViolationError(ValueError):
    """A frame breaks its contract; `violations` lists how."""

    def __init__(self, violations: list[str]):
        self.violations = violations
        super().__init__(f"{len(violations)} contract violation(s): " + "; ".join(violations))


class FreshnessError(ValueError):
    """The newest row is too old."""


def infer_schema(df: DataFrame) -> dict:
    """{"columns": {name: {"dtype", "nullable"}}}; nullable says whether there are nulls now (one pass)."""
    frame(df)
    row = df.agg(*[F.coalesce(F.bool_or(col(f.name).isNull()), F.lit(False)).alias(str(i)) for i, f in enumerate(df.schema)]).first() if df.columns else {}
    return {"columns": {f.name: {"dtype": f.dataType.simpleString(), "nullable": row[str(i)]} for i, f in enumerate(df.schema)}}


def _same_type(wanted: object, t: T.DataType) -> bool:
    """Whether a type fits a contract's: the same, of the same kind (int, float, str, bool, datetime, category), or any."""
    name = str(wanted).strip().lower()
    if name == "any" or name == t.simpleString():
        return True
    kinds = {"int": "int", "integer": "int", "float": "float", "number": "number", "str": "str", "string": "str", "object": "str", "text": "str", "category": "str", "bool": "bool", "boolean": "bool", "datetime": "datetime", "timestamp": "datetime", "date": "date"}
    if name in kinds:
        return is_number(t) if kinds[name] == "number" else group_of(t) == kinds[name] or (kinds[name] == "datetime" and group_of(t) == "date")
    try:
        return group_of(t) == group_of(T._parse_datatype_string(spark_type(name)))
    except Exception:
        return False


RULES = ("min_value", "max_value", "allowed_values", "value_regex", "min_length", "max_length", "unique")


def _rule(c: Column, rule: str, bound: object, t: T.DataType) -> Column:
    """True where a non-null value breaks a rule."""
    text = c.cast("string")
    match rule:
        case "min_value":
            return c < F.lit(bound)
        case "max_value":
            return c > F.lit(bound)
        case "allowed_values":
            return ~c.isin(list(bound)) if bound else c.isNotNull()
        case "value_regex":
            return ~text.rlike(java_pattern(rf"\A(?:{bound})\Z"))
        case "min_length":
            return F.length(text) < F.lit(bound)
        case "max_length":
            return F.length(text) > F.lit(bound)
    raise ValueError(f"Unknown rule {rule!r}")


def violations(df: DataFrame, schema: dict) -> list[str]:
    """How `df` breaks `schema`; all value rules and null checks together take one pass."""
    frame(df)
    wanted = schema.get("columns", schema) if isinstance(schema, dict) else {}
    if not wanted:
        warnings.warn("the contract names no columns", UserWarning, stacklevel=3)
        return []
    out = [f"missing column {n!r}" for n in sorted(n for n in wanted if n not in df.columns)]
    checks: list[tuple[str, str, str, Column, Column | None]] = []
    for i, (name, spec) in enumerate(wanted.items()):
        if name not in df.columns:
            continue
        spec = spec if isinstance(spec, dict) else {"dtype": spec}
        t, c = df.schema[name].dataType, col(name)
        if spec.get("dtype") is not None and not _same_type(spec["dtype"], t):
            out.append(f"column {name!r}: type is {t.simpleString()}, expected {spec['dtype']}")
            continue
        if spec.get("nullable") is False:
            checks.append((name, "null", "null value(s)", F.count_if(c.isNull()), None))
        for rule in RULES:
            if spec.get(rule) is None or spec.get(rule) is False:
                continue
            if rule == "unique":
                checks.append((name, rule, "repeated value(s)", F.count(c) - F.count_distinct(c), None))
                continue
            broken = F.coalesce(c.isNotNull() & _rule(c, rule, spec[rule], t), F.lit(False))
            sample = F.array_compact(F.array(F.min(F.when(broken, c.cast("string"))), F.max(F.when(broken, c.cast("string")))))
            checks.append((name, rule, f"value(s) against {rule} {spec[rule]!r}", F.count_if(broken), sample))
    if checks:
        aggs = [x for k, (_, _, _, n, s) in enumerate(checks) for x in ([n.alias(f"n{k}")] + ([s.alias(f"s{k}")] if s is not None else []))]
        row = df.agg(*aggs).first()
        for k, (name, _, what, _, s) in enumerate(checks):
            if row[f"n{k}"]:
                shown = f", for example {', '.join(map(repr, dict.fromkeys(row[f's{k}'])))}" if s is not None else ""
                out.append(f"column {name!r}: {row[f'n{k}']} {what}{shown}")
    return out


def expect_schema(df: DataFrame, schema: dict, strict: bool = True) -> DataFrame:
    """`df` if it keeps the contract; else SchemaViolationError, or a warning if not strict. Further columns are allowed."""
    found = violations(df, schema)
    if found and strict:
        raise SchemaViolationError(found)
    for v in found:
        warnings.warn(v, UserWarning, stacklevel=2)
    return df


def volume_violations(df: DataFrame, min_rows: int | None = None, max_rows: int | None = None) -> list[str]:
    frame(df)
    n = df.count()
    out = [f"{n} rows, at least {min_rows} expected"] if min_rows is not None and n < min_rows else []
    return out + ([f"{n} rows, at most {max_rows} expected"] if max_rows is not None and n > max_rows else [])


def expect_row_count(df: DataFrame, min_rows: int | None = None, max_rows: int | None = None, strict: bool = True) -> DataFrame:
    """`df` if its number of rows lies in the bounds; else SchemaViolationError or a warning."""
    found = volume_violations(df, min_rows, max_rows)
    if found and strict:
        raise SchemaViolationError(found)
    for v in found:
        warnings.warn(v, UserWarning, stacklevel=2)
    return df


def freshness_violations(df: DataFrame, column: str, max_age: timedelta, reference_time: datetime | None = None) -> list[str]:
    columns(df, column)
    c = col(column)
    ts = F.try_to_timestamp(c) if is_text(df.schema[column].dataType) else c.cast("timestamp")
    newest = df.agg(F.unix_micros(F.max(ts)).alias("t")).first()["t"]
    if newest is None:
        warnings.warn(f"{column!r} holds no valid time", UserWarning, stacklevel=3)
        return []
    now = reference_time or datetime.now(UTC)
    now = now.replace(tzinfo=UTC) if now.tzinfo is None else now
    age = now - datetime.fromtimestamp(newest / 1e6, UTC)
    return [f"{column!r}: the newest value is {age} old, at most {max_age} expected"] if age > max_age else []


def expect_freshness(df: DataFrame, column: str, max_age: timedelta, reference_time: datetime | None = None, strict: bool = True) -> DataFrame:
    """`df` if its newest time is at most `max_age` before now (UTC); else FreshnessError or a warning. No valid times: a warning."""
    found = freshness_violations(df, column, max_age, reference_time)
    if found and strict:
        raise FreshnessError(found[0])
    for v in found:
        warnings.warn(v, UserWarning, stacklevel=2)
    return df


@dataclass
class _Check:
    id: str
    target: str
    description: str
    strict: bool
    run: object


@dataclass
class ContractSuite:
    """Contracts over several frames: `run({name: frame})` gives a report with one row per check."""

    name: str
    description: str = ""
    audit: object = None
    checks: list[_Check] = field(default_factory=list)

    def add_contract(self, contract_id: str, schema: dict, description: str = "", strict: bool = True) -> ContractSuite:
        self.checks.append(_Check(contract_id, contract_id, description, strict, lambda df: violations(df, schema)))
        return self

    def add_volume_check(self, contract_id: str, min_rows: int | None = None, max_rows: int | None = None, strict: bool = True) -> ContractSuite:
        self.checks.append(_Check(f"{contract_id}:volume", contract_id, "row count", strict, lambda df: volume_violations(df, min_rows, max_rows)))
        return self

    def add_freshness_check(self, contract_id: str, column: str, max_age: timedelta, reference_time: datetime | None = None, strict: bool = True) -> ContractSuite:
        self.checks.append(_Check(f"{contract_id}:freshness", contract_id, f"freshness of {column}", strict, lambda df: freshness_violations(df, column, max_age, reference_time)))
        return self

    def __len__(self) -> int:
        return len(self.checks)

    def run(self, frames: dict[str, DataFrame], raise_on_failure: bool = False, spark: SparkSession | None = None) -> DataFrame:
        """Status is PASS, FAIL (strict), WARN (not strict), SKIPPED (no such frame) or ERROR."""
        rows = []
        for c in self.checks:
            found: list[str] = []
            if c.target not in frames:
                status = "SKIPPED"
            else:
                try:
                    found = c.run(frames[c.target])
                    status = ("FAIL" if c.strict else "WARN") if found else "PASS"
                except Exception as e:
                    status, found = "ERROR", [f"{type(e).__name__}: {e}"]
            rows.append((self.name, c.id, c.description, status, len(found), "; ".join(found)))
        if self.audit is not None:
            self.audit.log(rows, suite=self.name)
        if raise_on_failure and (bad := [f"{r[1]}: {r[5]}" for r in rows if r[3] in ("FAIL", "ERROR")]):
            raise SchemaViolationError(bad)
        return (spark or get_spark()).createDataFrame(rows, REPORT)
