"""Mixing sources to target weights by hash thresholds, without sorting records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anchorline.session import join_small, materialize

#: Bits of the hash that each histogram level looks at; what is left after the last level is told apart by the whole hash.
BITS = (12, 12)
SPAN = 63


@dataclass
class Mix:
    """`chosen`: id, source, tokens, repeats. `shares`: what each source was to give and gives."""

    chosen: DataFrame
    shares: DataFrame


def mix_sources(sizes: DataFrame, targets: DataFrame, key: str, source: str = "source", size: str = "tokens", total: int | None = None, seed: int = 42) -> Mix:
    """Choose records so that every source gives its target share of the total size.

    `sizes` holds `key` (unique), `source`, `size`; `targets` holds source, target_share, max_repeats (one row a source). Sources without
    records cannot give anything: the shares of the others are scaled up to a sum of 1. The total is the largest at which every
    source meets its share with at most max_repeats uses of each record, or the given `total`, of which a source that is too small gives
    all it can (its share then falls short). A source's budget is spent as whole passes over all its records, then as one partial pass over
    the records whose hash lies under a threshold: sums by hash bucket find the bucket in which the budget ends, only that bucket is refined,
    and the last record is taken if that brings the sum nearer to the budget. Thresholds of growing budgets are nested.

    Records with a null source, a source without target, or no size take no part. An empty `sizes` gives no records.
    """
    own = sizes.select(key, F.col(source).alias("source"), F.col(size).cast("bigint").alias("tokens")).filter("source is not null and tokens > 0")
    own = materialize(own.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 64 - SPAN)), "sizes")
    want = targets.select(F.col("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats")).filter("source is not null")
    have = own.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("records"))
    plan = want.join(have, "source", "left").fillna(0, ["available", "records"])
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    totals = plan.agg(F.sum(F.when(usable, F.col("target_share"))).alias("mass"))
    plan = plan.crossJoin(F.broadcast(totals)).withColumn("share", F.when(usable, F.col("target_share") / F.col("mass")).otherwise(0.0))  # one row
    reach = plan.agg(F.min(F.when(usable, F.col("available") * F.col("max_repeats") / F.col("share"))).alias("reach"))
    if total is not None:
        reach = reach.select(F.when(F.col("reach").isNotNull(), F.lit(float(total))).alias("reach"))
    plan = plan.crossJoin(F.broadcast(reach)).withColumn("budget", F.least(F.coalesce(F.col("share") * F.col("reach"), F.lit(0.0)), (F.col("available") * F.col("max_repeats")).cast("double")))  # one row
    passes = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.greatest("available", F.lit(1)) + 1e-9), F.col("max_repeats"))).otherwise(0)
    plan = plan.withColumn("passes", passes.cast("bigint")).withColumn("rest", F.greatest(F.col("budget") - F.col("passes") * F.col("available"), F.lit(0.0)))
    plan = materialize(plan, "plan")
    sources = plan.count()

    # The threshold of each source, level by level; `before` is the size under the bucket in question.
    edge = plan.filter("rest > 0").select("source", "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    used = 0
    for bits in (*BITS, SPAN - sum(BITS)):
        last = used + bits == SPAN
        part = join_small(own, edge.select("source", "rest", "prefix", "before"), "source", rows=sources)
        if used:
            part = part.filter(F.shiftright("h", SPAN - used) == F.col("prefix"))
        hist = part.groupBy("source", "rest", "before", F.shiftright("h", SPAN - used - bits).alias("bucket")).agg(F.sum("tokens").alias("n"))
        w = Window.partitionBy("source").orderBy("bucket")  # at most 2**12 buckets, or the few records of one bucket
        upto = hist.withColumn("upto", F.col("before") + F.sum("n").over(w))
        if last:
            taken = upto.filter(F.col("upto") - F.col("n") / 2 <= F.col("rest")).groupBy("source").agg(F.max("bucket").alias("top"))
            edge = edge.join(taken, "source", "left")
        else:
            at = upto.filter(F.col("upto") >= F.col("rest")).groupBy("source", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
            edge = materialize(at.select("source", "rest", F.col("b.bucket").alias("prefix"), F.col("b.before").alias("before")), "edge")
        used += bits
    # Everything under the boundary bucket, and in it up to the last record taken.
    low = F.shiftleft(F.col("prefix"), SPAN - sum(BITS)) - 1
    cuts = materialize(edge.select("source", F.coalesce("top", low).alias("cut")), "cuts")
    rule = plan.join(cuts, "source", "left").select("source", "passes", "cut")
    extra = F.coalesce((F.col("h") <= F.col("cut")).cast("bigint"), F.lit(0))
    chosen = join_small(own, rule, "source", rows=sources).select(key, "source", "tokens", (F.col("passes") + extra).alias("repeats")).filter("repeats > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_records"), F.max("repeats").alias("most_repeats"))
    got = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_records", "most_repeats"])
    whole = got.agg(F.sum("mixed_tokens").alias("whole"))
    shares = got.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", "max_repeats", F.col("records"), F.col("available").alias("available_tokens"), "mixed_records", "mixed_tokens", "most_repeats",
        F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("whole")), F.lit(0.0)).alias("actual_share"),
    )
    return Mix(chosen, shares)
