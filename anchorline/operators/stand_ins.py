"""Stand-ins: values that take the place of a missing one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.text import strip
from anchorline.session import join_small, materialize

#: Texts that by convention say "no value", in lower case without white space around them.
PLACEHOLDERS = ("n/a", "na", "#n/a", "n.a.", "null", "nil", "none", "nan", "unknown", "undefined", "missing", "not available", "tbd", "tba", "unspecified")

#: A value is a stand-in if it recurs in at least so many groups (two: its smallest and largest differ) and fits them in less than this share.
LEAST_GROUPS, FITS = 2, 0.2
#: A number fits if it lies within this factor of what its group and its partner column let expect.
FACTOR = 2.5


def placeholder_text(col: Column) -> Column:
    """The text is blank, has no letter or digit, or is one of PLACEHOLDERS; null for null."""
    s = F.lower(strip(col))
    return s.isin(*PLACEHOLDERS) | ~col.rlike(r"[\p{L}\p{N}]")


@dataclass
class StandIns:
    """Stand-ins found: a (materialized) frame `col, value` with values as text."""

    found: DataFrame

    def values(self, col: str, most: int = 10_000) -> list[str]:
        """The stand-ins of a column as a list; refuses more than `most`."""
        rows = self.found.filter(F.col("col") == col).select("value").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} stand-ins in {col}")
        return sorted(r["value"] for r in rows)


def find_stand_ins(df: DataFrame, group: str, category: str, amount: str, quantity: str, period: str) -> StandIns:
    """Find the values of `category` (text), `amount` and `quantity` (integers) that stand for "no value".

    A number is held against its expectation: amounts and quantities of one `group` are tied by its usual rate
    (amount / quantity), corrected by how far the rates of the `period` are from usual. A value that recurs in at least
    LEAST_GROUPS groups, and in fewer than FITS of its rows lies within FACTOR of the expectation, is a stand-in. A text recurs in
    place of a value if it is the most frequent text of fewer than FITS of the groups it occurs in; blank texts, texts without letter or
    digit and PLACEHOLDERS always are. Null groups give no evidence; an empty table has no stand-ins.

    All steps are aggregates with map-side combination, so a hot group is no hot task; usual rates are approximate
    medians, mergeable and bounded in memory, and the factor is wide against their error.
    """
    rows = df.select(F.col(group).alias("g"), F.col(period).alias("p"), F.col(amount).cast("double").alias("a"), F.col(quantity).cast("double").alias("q"), F.col(category).alias("c"))
    known = rows.filter("g is not null")
    rated = known.filter("a is not null and a <> 0 and q > 0").select("g", "p", "a", "q", (F.abs("a") / F.col("q")).alias("r"))
    rate = materialize(rated.groupBy("g").agg(F.percentile_approx("r", 0.5, 200).alias("rate")), "rates")
    rel = join_small(rated, rate, "g").withColumn("rel", F.col("r") / F.col("rate"))
    off = materialize(rel.groupBy("p").agg(F.percentile_approx("rel", 0.5, 1000).alias("off")), "offsets")
    # Zero, and quantities under one, have no rate: they fit nothing, and say nothing of the other column. One scan serves both kinds.
    ok = F.coalesce((F.col("a") != 0) & (F.col("q") > 0), F.lit(False))
    held = known.select("g", "p", "a", "q", ok.alias("ok")).filter("ok or a = 0 or q <= 0")
    both = join_small(join_small(held, rate, "g", "left"), off, "p", "left").filter("not ok or off is not null")
    fit = F.when(F.col("ok"), (F.abs("a") / F.col("q") / F.col("rate") / F.col("off")).between(1 / FACTOR, FACTOR).cast("int")).otherwise(0)
    # 0 is the amount, 1 the quantity: numbers are exploded and grouped at less cost than structs and names.
    both = both.select(F.xxhash64("g").alias("h"), "ok", "a", "q", fit.alias("fit"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    v = F.when(F.col("i") == 0, F.when(F.col("ok") | (F.col("a") == 0), F.col("a"))).otherwise(F.when(F.col("ok") | (F.col("q") <= 0), F.col("q")))
    long = both.select("i", "h", "fit", v.alias("v")).filter("v is not null")
    by = long.groupBy("i", "v").agg(F.avg("fit").alias("fit"), F.min("h").alias("lo"), F.max("h").alias("hi"))  # two groups: lo and hi differ
    odd = by.filter((F.col("lo") != F.col("hi")) & (F.col("fit") < FITS))
    numbers = odd.select(F.when(F.col("i") == 0, amount).otherwise(quantity).alias("col"), F.col("v").cast("bigint").cast("string").alias("value"))
    texts = materialize(rows.filter("c is not null").groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")), "texts")
    held = texts.filter("g is not null")
    own = held.filter(~placeholder_text(F.col("c"))).groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("own"))
    seen = held.join(own, "g").groupBy("c").agg(F.avg((F.col("c") == F.col("own")).cast("int")).alias("fit"), F.count(F.lit(1)).alias("groups"))
    odd = seen.filter((F.col("groups") >= LEAST_GROUPS) & (F.col("fit") < FITS)).select("c")
    plain = texts.filter(placeholder_text(F.col("c"))).select("c")
    words = odd.union(plain).distinct().select(F.lit(category).alias("col"), F.col("c").alias("value"))
    return StandIns(materialize(numbers.union(words), "stand-ins"))
