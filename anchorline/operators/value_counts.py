"""Column profiles from maintained value counts.

A store holds one row per (table, column, load, value) with a signed number of occurrences. Each load adds a batch
of +1 counts; undoing a load adds the same batch with the sign turned. All metrics come from the summed counts, so
no metric reads the profiled table again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from anchorline.session import join_small, materialize, new_path

KEYS = ["table", "col", "load_id"]
#: Bits of the value that each radix level of `median_of_counts` looks at.
BITS = 20

#: One address: dot-separated pieces, @, two or more labels of which the last has letters only.
#: Quantifiers are possessive where they can be: a very long text needs no deep stack.
EMAIL = r"\A[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)++[A-Za-z]{2,}+\z"


def counts_of(df: DataFrame, table: str, columns: list[str] | None = None, load_col: str | None = "load_id", sign: int = 1) -> DataFrame:
    """Signed counts per (table, col, load_id, value); null values are counted under a null `value`.

    Values are kept as text (timestamps and numbers in Spark's own form). The load column itself is the load and is
    profiled only if named. Rows with a null load, and tables without one, count under a null load_id. An empty table gives no rows.
    """
    columns = columns or [c for c in df.columns if c != load_col]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"Columns not found: {missing}; available: {df.columns}")
    load = (F.col(f"`{load_col}`") if load_col else F.lit(None)).cast("bigint").alias("load_id")
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    long = df.select(load, F.explode(cells).alias("cell")).select("load_id", "cell.col", "cell.value")
    return (
        long.groupBy("col", "load_id", "value").agg((F.count(F.lit(1)) * sign).alias("n"))
        .select(F.lit(table).alias("table"), "col", "load_id", "value", "n")
    )


class ValueCounts:
    """Value counts kept as parquet under `path` (by default a new folder in the shared folder)."""

    SCHEMA = T.StructType([
        T.StructField("table", T.StringType()), T.StructField("col", T.StringType()), T.StructField("load_id", T.LongType()),
        T.StructField("value", T.StringType()), T.StructField("n", T.LongType()),
    ])

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "value-counts")

    def apply(self, df: DataFrame, table: str, columns: list[str] | None = None, load_col: str | None = "load_id", sign: int = 1) -> ValueCounts:
        """Add the counts of `df` (sign 1) or take them away again (sign -1), as one appended batch."""
        counts_of(df, table, columns, load_col, sign).write.mode("append").parquet(self.path)
        return self

    def state(self) -> DataFrame:
        """The summed counts of all batches under the path, whoever wrote them, without values whose count is back at zero."""
        kept = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return kept.groupBy("table", "col", "load_id", "value").agg(F.sum("n").alias("n")).filter("n <> 0")

    def compact(self) -> ValueCounts:
        """The same counts in one batch of a new folder."""
        path = new_path(self.spark, "value-counts")
        self.state().write.parquet(path)
        return ValueCounts(self.spark, path)


def median_of_counts(counts: DataFrame, by: list[str], value: Column, n: str = "n", lower: bool = False) -> DataFrame:
    """Exact median of integers given with counts: `by`, median.

    The mean of the two middle values (double), or with `lower` the smaller of them, a value that occurs (bigint).

    Radix selection over the range of the values: at each level only the bucket that holds the middle is refined, so no
    task orders more than 2**BITS buckets of a group. Rows with a null value take no part; a group without values gives no row.
    """
    vals = counts.select(*by, value.cast("bigint").alias("v"), F.col(n).alias("n")).filter("v is not null")
    low, high = vals.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low = high = 0
    levels = max(1, -(-(high - low).bit_length() // BITS))
    if levels > 3:  # the difference could leave the range of bigint: the sign bit is its own level
        low = 0
    shifts = [BITS * i for i in range(levels)][::-1]
    vals = vals.withColumn("v", F.col("v") - F.lit(low))
    total = vals.groupBy(*by).agg(F.sum("n").alias("total"))
    ranks = ["(total + 1) div 2"] if lower else ["(total + 1) div 2", "total div 2 + 1"]
    want = total.select(*by, F.explode(F.array_distinct(F.array(*[F.expr(r) for r in ranks]))).alias("rank"))
    want = want.withColumn("before", F.lit(0).cast("bigint")).withColumn("prefix", F.lit(None).cast("bigint"))
    for level, shift in enumerate(shifts):
        bucket = F.shiftright("v", shift)
        part = vals if level == 0 else vals.join(
            want.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("prefix").alias("_prefix")).distinct(),
            _same(by) & (F.shiftright("v", shifts[level - 1]) == F.col("_prefix")), "left_semi",
        )
        hist = part.groupBy(*by, bucket.alias("bucket"), F.shiftright("v", shifts[level - 1]).alias("up") if level else F.lit(None).cast("bigint").alias("up")).agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "up").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(w)).select(
            *[F.col(b).alias(f"_{b}") for b in by], F.col("up").alias("_up"), F.col("bucket").alias("_bucket"), F.col("n").alias("_n"), F.col("upto").alias("_upto")
        )
        want = want.join(
            hist, _same(by) & F.col("prefix").eqNullSafe(F.col("_up")) & (F.col("rank") - F.col("before") > F.col("_upto") - F.col("_n")) & (F.col("rank") - F.col("before") <= F.col("_upto"))
        ).select(*by, "rank", (F.col("before") + F.col("_upto") - F.col("_n")).alias("before"), F.col("_bucket").alias("prefix"))
    if lower:
        return want.select(*by, (F.col("prefix") + F.lit(low)).alias("median"))
    return want.groupBy(*by).agg((F.avg("prefix") + F.lit(low)).alias("median"))


def _same(by: list[str]) -> Column:
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return cond


def profile_counts(state: DataFrame, patterns: dict[tuple[str, str], str] | None = None, numeric: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """Profile per (table, col, load_id): rows, nulls, null_rate, distinct_values, min_value, max_value, entropy_bits, violations, drift.

    `patterns` maps (table, column) to a regular expression that a value must match; other columns have null violations.
    Columns in `numeric` are ranged as numbers, others as text. Entropy is over non-null values. `drift` is the total
    variation distance between the shares of the non-null values of a load and of the next smaller load; null for the first.
    A load without non-null values has entropy 0, null ranges, and drift null if the other side has none either.
    """
    bad = F.lit(None).cast("boolean")
    for (t, c), rx in (patterns or {}).items():
        bad = F.when((F.col("table") == t) & (F.col("col") == c), ~F.col("value").rlike(rx)).otherwise(bad)
    isnum = F.lit(False)
    for t, c in sorted(numeric):
        isnum = isnum | ((F.col("table") == t) & (F.col("col") == c))
    num = F.when(isnum, F.expr("try_cast(value as decimal(38, 6))"))
    has = F.col("value").isNotNull()
    n = F.col("n").cast("double")
    marked = state.withColumn("_bad", bad).withColumn("_num", num)
    agg = marked.groupBy(*KEYS).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("_min"), F.max("value").alias("_max"), F.min("_num").alias("_nmin"), F.max("_num").alias("_nmax"),
        F.sum(F.when(has, n * F.log2(n))).alias("_nlogn"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("_m"),
        F.sum(F.when(F.col("_bad"), F.col("n")).when(~F.col("_bad"), F.lit(0))).alias("violations"),
    )
    agg = agg.withColumn("_prev", F.lag("load_id").over(Window.partitionBy("table", "col").orderBy("load_id")))
    agg = agg.withColumn("_next", F.lead("load_id").over(Window.partitionBy("table", "col").orderBy("load_id")))
    # Each share is added at its own load and taken away at the next one: what is left per value is the change.
    loads = materialize(agg, "profile-loads")
    side = loads.select("table", "col", "load_id", "_m", "_next")
    shares = join_small(state.filter(has), side, KEYS).withColumn("p", F.col("n") / F.col("_m"))
    ends = F.array(F.struct(F.col("load_id").alias("at"), F.col("p").alias("d")), F.struct(F.col("_next").alias("at"), (-F.col("p")).alias("d")))
    moved = (
        shares.select("table", "col", "value", F.explode(ends).alias("e")).filter("e.at is not null")
        .groupBy("table", "col", F.col("e.at").alias("load_id"), "value").agg(F.sum("e.d").alias("d"))
        .groupBy(*KEYS).agg((F.sum(F.abs("d")) / 2).alias("drift"))
    )
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.?0+$", "")
    m = F.col("_m").cast("double")
    out = loads.join(moved, KEYS, "left")
    return out.select(
        *KEYS, "rows", "nulls", (F.col("nulls") / F.col("rows")).alias("null_rate"), "distinct_values",
        F.coalesce(text("_nmin"), F.col("_min")).alias("min_value"), F.coalesce(text("_nmax"), F.col("_max")).alias("max_value"),
        F.when(m > 0, F.log2(m) - F.col("_nlogn") / m).otherwise(0.0).alias("entropy_bits"), "violations",
        F.when(F.col("_prev").isNotNull(), F.col("drift")).alias("drift"),
    )


def odd_loads(state: DataFrame, null_points: float = 0.2, share_points: float = 0.25, factor: float = 2.0, median_columns: set[str] = frozenset(), share_columns: set[str] = frozenset()) -> DataFrame:
    """Loads in which a column is far from usual: table, col, load_id, reason (`nulls`, `median` or `share`).

    Usual is the median of a measure over all loads of the table. `nulls`: the share of nulls is off by more than
    `null_points`. `median` (integer columns in `median_columns`): the median of the non-null values is over `factor`
    times the usual or under its `factor`-th part; where the usual is negative its bounds change sides; a load without values is
    not judged. `share` (columns in `share_columns`): the share of some value among the non-null ones is off by more than
    `share_points`, with share 0 where it does not occur.
    """
    has = F.col("value").isNotNull()
    per = state.groupBy(*KEYS).agg(F.sum("n").alias("rows"), F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("nulls"))
    per = materialize(per.withColumn("m", F.col("rows") - F.col("nulls")), "load-sizes")
    usual = per.groupBy("table", "col").agg(F.median(F.col("nulls") / F.col("rows")).alias("usual"))
    out = per.join(usual, ["table", "col"]).filter(F.abs(F.col("nulls") / F.col("rows") - F.col("usual")) > null_points).select(*KEYS, F.lit("nulls").alias("reason"))
    if median_columns:
        med = materialize(median_of_counts(state.filter(F.col("col").isin(*median_columns)), KEYS, F.expr("try_cast(value as bigint)")), "medians")
        usual = med.groupBy("table", "col").agg(F.median("median").alias("usual"))
        x, u = F.col("median"), F.col("usual")
        far = (x > F.greatest(u * factor, u / factor)) | (x < F.least(u * factor, u / factor))
        out = out.unionByName(med.join(usual, ["table", "col"]).filter(far).select(*KEYS, F.lit("median").alias("reason")))
    if share_columns:
        vals = join_small(state.filter(has & F.col("col").isin(*share_columns)), per.select(*KEYS, "m"), KEYS)
        shares = vals.withColumn("share", F.col("n") / F.col("m"))
        # A share can be off by more than the limit only for a value that exceeds the limit in some load: at most 1/limit values a load.
        big = shares.filter(F.col("share") > share_points).select("table", "col", "value").distinct()
        big = materialize(big, "big-values")
        grid = big.join(per.filter("m > 0").select(*KEYS), ["table", "col"])
        grid = grid.join(join_small(shares, big, ["table", "col", "value"]).select(*KEYS, "value", "share"), [*KEYS, "value"], "left").fillna(0.0, ["share"])
        grid = materialize(grid, "shares")
        usual = grid.groupBy("table", "col", "value").agg(F.median("share").alias("usual"))
        far = grid.join(usual, ["table", "col", "value"]).filter(F.abs(F.col("share") - F.col("usual")) > share_points)
        out = out.unionByName(far.select(*KEYS, F.lit("share").alias("reason")).distinct())
    return out


def bad_cells(df: DataFrame, state: DataFrame, table: str, column: str, pattern: str, row_id: str = "row_id") -> DataFrame:
    """Ids of the rows whose non-null `column` does not match `pattern`: row_id.

    The values come from the maintained counts; rows are found by joining on them, after a row filter that only
    keeps rows the pattern refuses. A value shared by many rows is split by AQE, or broadcast if there are few bad values.
    """
    vals = state.filter((F.col("table") == table) & (F.col("col") == column) & F.col("value").isNotNull())
    bad = materialize(vals.filter(~F.col("value").rlike(pattern)).select("value").distinct(), "bad-values")
    text = F.col(f"`{column}`").cast("string")
    rows = df.filter(~text.rlike(pattern)).select(F.col(row_id).alias("row_id"), text.alias("value"))
    return join_small(rows, bad, "value", "left_semi").select("row_id")
