"""Column profiles of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anchorline.functions.checks import col, frame
from anchorline.functions.types import is_number


def profile(df: DataFrame, top_n: int = 5, sample_size: int | None = None, approx: bool = False) -> DataFrame:
    """One row per column: Column, Dtype, Row_Count, Null_Count, Null_Rate_Pct, Unique_Count, Cardinality_Pct, Min, Max, Mean, Std (numbers), Top_Values.

    One pass for the statistics, one for the most frequent values ("value (n), ..."; of equal counts the smaller text). `approx`
    counts distinct values approximately.
    """
    frame(df)
    if sample_size is not None:
        df = df.limit(sample_size)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema):
        c, num = col(f.name), is_number(f.dataType)
        aggs += [F.count(c).alias(f"c{i}"), (F.approx_count_distinct(c) if approx else F.count_distinct(c)).alias(f"u{i}")]
        aggs += [F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}")]
        aggs += [F.round(F.avg(c), 6).alias(f"m{i}"), F.round(F.stddev_samp(c), 6).alias(f"s{i}")] if num else []
    one = df.agg(*aggs)
    none = F.lit(None).cast("double")
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(a * F.lit(100.0), b), F.lit(0.0)), 4)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("_i"), F.lit(f.name).alias("Column"), F.lit(f.dataType.simpleString()).alias("Dtype"), F.col("n").alias("Row_Count"), (F.col("n") - F.col(f"c{i}")).alias("Null_Count"), pct(F.col("n") - F.col(f"c{i}"), F.col("n")).alias("Null_Rate_Pct"),
            F.col(f"u{i}").alias("Unique_Count"), pct(F.col(f"u{i}"), F.col("n")).alias("Cardinality_Pct"), F.col(f"a{i}").alias("Min"), F.col(f"b{i}").alias("Max"),
            (F.col(f"m{i}").cast("double") if is_number(f.dataType) else none).alias("Mean"), (F.col(f"s{i}").cast("double") if is_number(f.dataType) else none).alias("Std"),
        )
        for i, f in enumerate(df.schema)
    ])
    stats = one.select(F.inline(rows))
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), col(f.name).cast("string").alias("v")) for i, f in enumerate(df.schema)])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").filter("v is not null").groupBy("_i", "v").agg(F.count(F.lit(1)).alias("k"))
    # A window limited by rank keeps only top_n rows of each part before it shuffles.
    w = Window.partitionBy("_i").orderBy(F.col("k").desc(), "v")
    top = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_n)
    top = top.groupBy("_i").agg(F.array_sort(F.collect_list(F.struct("r", F.concat("v", F.lit(" ("), F.col("k").cast("string"), F.lit(")")).alias("t")))).alias("a"))
    top = top.select("_i", F.array_join(F.transform("a", lambda x: x["t"]), ", ").alias("Top_Values"))
    return stats.join(F.broadcast(top), "_i", "left").orderBy("_i").drop("_i")  # one row per column
