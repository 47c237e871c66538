"""Per-key results when a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that the frequency sketch tracks; its error is below 4 / TRACKED of all rows.
TRACKED = 16_384


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys that may hold more than `share` of all rows: every such key, and at most 2 / share + 1 in all.

    One pass with a mergeable frequency sketch, which never misses a key above its error bound (4 / TRACKED of
    the rows); null keys are no keys. An empty table has none. Shares under 8 / TRACKED are refused.
    """
    if not 8 / TRACKED <= share <= 1:
        raise ValueError(f"share must lie between {8 / TRACKED} and 1")
    k = int(2 / share) + 1
    top = df.select(F.expr(f"approx_top_k(`{key}`, {k}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    least = (share - 4 / TRACKED) * top["n"]
    return [x["item"] for x in top["top"] or [] if x["item"] is not None and x["count"] >= least]


def salted_aggregate(df: DataFrame, keys: list[str], partial: dict[str, Column], merge: dict[str, Column], salt_on: Column, hot: Column, salts: int = 32) -> DataFrame:
    """Two-stage aggregation: (keys, salt) first, then keys.

    Rows for which `hot` holds are spread over `salts` parts by a hash of `salt_on`, all others stay in part 0, so a key with
    any share of the rows is worked on by many tasks. `partial` are the aggregates of the first stage; `merge` combines them
    (its columns refer to the names in `partial`). Rows whose `salt_on` is equal meet in one part, so distinct counts of
    `salt_on` merge by addition. Null keys form their own group; a null `hot` counts as false.
    """
    salt = F.when(hot, F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    staged = df.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return staged.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def is_in(col: Column, values: list) -> Column:
    """`col` is one of `values`; false for null and for an empty list."""
    return F.coalesce(col.isin(values), F.lit(False)) if values else F.lit(False)
