"""Totals over trailing periods from event contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_delivery(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per non-null `key`: `columns` of the row with the smallest `order`; rows with a null key stay as they are.

    `order` must be unique within a key. A key delivered very often is reduced before the shuffle, so it makes no hot task.
    """
    rest = df.filter(F.col(key).isNull()).select(key, *columns)
    # One aggregate per column: with plain types they fit a hash aggregate, a struct would need a sort.
    once = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in columns])
    return once.unionByName(rest)


def rolling_totals(df: DataFrame, entity: str, day: str, amount: str, windows: tuple[int, ...] = (7, 30), until: DataFrame | None = None) -> DataFrame:
    """Total, average and number of `amount` over the trailing `windows` (days), for every entity and day.

    Each daily amount adds at its date and subtracts `length` days later; the running sum of these deltas is the
    total, constant between two change dates, so only change dates are ordered (at most days x (windows + 1) per entity,
    whatever the number of rows) and the days in between are filled in afterwards.

    Days run from an entity's first dated row to the last date of the whole table, days without rows included. The
    average is per day of the window (total / length, days without rows count as 0). Null amounts add nothing
    but their dates count as active; rows with a null entity or day take no part; an empty table gives no rows.
    Columns: entity, day, total_w, avg_w, rows_w (rows with an amount) for each window w. `until` may give the last
    date as a one-row frame with column `last`.
    """
    rows = df.select(F.col(entity).alias("e"), F.col(day).cast("date").alias("d"), F.col(amount).alias("a")).filter("e is not null and d is not null")
    daily = rows.groupBy("e", "d").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("t"), F.count("a").alias("c"))
    last = until if until is not None else df.select(F.max(F.col(day).cast("date")).alias("last"))
    # One struct per change date and window: the daily amount comes in at its date and goes out again after the window.
    zero_t, zero_c = F.lit(0).cast(daily.schema["t"].dataType), F.lit(0).cast("bigint")

    def change(offset: int, only: int | None) -> F.Column:
        parts = []
        for w in windows:
            on = only is None or only == w
            sign = 1 if only is None else -1
            parts += [(F.col("t") * sign if on else zero_t).cast(daily.schema["t"].dataType).alias(f"t{w}"), (F.col("c") * sign if on else zero_c).cast("bigint").alias(f"c{w}")]
        return F.struct(F.date_add("d", offset).alias("at"), *parts)

    names = [f"{k}{w}" for w in windows for k in "tc"]
    deltas = daily.select("e", F.explode(F.array(change(0, None), *[change(w, w) for w in windows])).alias("x")).select("e", "x.*")
    deltas = deltas.groupBy("e", "at").agg(*[F.sum(c).alias(c) for c in names])
    w = Window.partitionBy("e").orderBy("at")
    runs = deltas.select("e", "at", *[F.sum(c).over(w).alias(c) for c in names], F.lead("at").over(w).alias("upto"))
    runs = runs.crossJoin(F.broadcast(last)).filter("at <= last")  # one row: the last date
    ends = F.least(F.coalesce(F.date_sub("upto", 1), F.col("last")), F.col("last"))
    outs = []
    for k in windows:
        outs += [F.col(f"t{k}").alias(f"total_{k}"), (F.col(f"t{k}") / F.lit(float(k))).alias(f"avg_{k}"), F.col(f"c{k}").alias(f"rows_{k}")]
    # Days are counted as integers and added to the first one.
    flat = runs.select(F.col("e").alias(entity), "at", *outs, F.sequence(F.lit(0), F.date_diff(ends, "at")).alias("_days"))
    days = flat.select("*", F.explode("_days").alias("_day"))
    return days.select(entity, F.date_add("at", F.col("_day")).alias(day), *[c for c in flat.columns if c not in (entity, "at", "_days")])
