"""Filling missing cells from the closest similar records (nearest-neighbour hot deck)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from anchorline.operators.value_counts import median_of_counts
from anchorline.session import is_small, join_small, materialize

#: What names of columns added on the way begin with; no input column may.
OWN = "__hot_deck_"
#: Days before and after a receiver from which the donors of a timed first block come.
WINDOW = 31

CELL = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("col", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("donor_id", T.LongType()), T.StructField("donors", T.LongType()), T.StructField("level", T.IntegerType()),
])


@dataclass
class Target:
    """A column to fill: its blocks from narrow to wide (lists of observed features), whether it holds integers (weighted
    median) or text (majority), and whether donors are ranked by nearness in time."""

    col: str
    blocks: list[list[str]]
    numeric: bool = True
    timed: bool = True


@dataclass
class HotDeck:
    """`cells`: row_id, col, value (text, null if there is no donor), donor_id, donors, level of each missing cell.
    `filled`: all rows with the cells filled, and for each target `<col>_filled` and `<col>_donor`."""

    cells: DataFrame
    filled: DataFrame
    targets: list[Target] = field(default_factory=list)


def hot_deck(df: DataFrame, targets: list[Target], missing: dict[str, Column], row_id: str, day: str) -> HotDeck:
    """Fill the cells for which `missing[col]` holds.

    Records are hashed into blocks by their observed features. In a timed first block each donor at most WINDOW days apart
    weighs 1 / (1 + days apart); wider timed blocks, tried for cells without a donor so far, take the donors of the nearest day. Blocks that
    are not timed, cells without a day and blocks without dated donors weigh all donors alike. Numbers get
    the weighted (lower) median of the donors, text their majority (ties fixed by a hash of the text), so a filled value always
    occurs in a donor, which is named. Donors enter as counts per (block, day, value): a hot block costs no more than
    its distinct days and values. A null feature puts a record in no block; a column without any donor stays null
    and unfilled. `row_id` must be unique. Other columns pass unchanged.
    """
    names = [t.col for t in targets]
    if clash := [c for t in names for c in (f"{t}_filled", f"{t}_donor") if c in df.columns]:
        raise ValueError(f"columns already there: {clash}")
    marks = [F.coalesce(missing[c], F.lit(False)).alias(f"{OWN}m{i}") for i, c in enumerate(names)]
    marked = df.select("*", *marks)
    feats = sorted({f for t in targets for b in t.blocks for f in b} | set(names))
    clean = {f: F.when(~F.col(f"{OWN}m{names.index(f)}"), F.col(f)) if f in names else F.col(f) for f in feats}
    slim = marked.select(F.col(row_id).alias("_id"), F.col(day).cast("date").alias("_day"), *[c.alias(f) for f, c in clean.items()], *[f"{OWN}m{i}" for i in range(len(names))])
    some = F.lit(False)
    for i in range(len(names)):
        some = some | F.col(f"{OWN}m{i}")
    receivers = materialize(slim.filter(some), "receivers")
    whole = df.schema[row_id].dataType.typeName() in ("byte", "short", "integer", "long")
    low, high = df.agg(F.min(row_id), F.max(row_id)).first() if whole else (None, None)
    low = low if low is not None and high - low < 1 << 57 else None
    cells = None
    for i, t in enumerate(targets):
        own = _fill(slim.filter(F.col(t.col).isNotNull()), receivers.filter(f"{OWN}m{i}"), t, low).select(
            F.col("_id").cast("bigint").alias("row_id"), F.lit(t.col).alias("col"), F.col("_value").cast("string").alias("value"), F.col("_donor").cast("bigint").alias("donor_id"), F.col("_n").cast("bigint").alias("donors"), F.col("_level").alias("level")
        )
        cells = own if cells is None else cells.unionByName(own)
    cells = materialize(cells, "cells")
    wide = cells.groupBy(F.col("row_id").alias(f"{OWN}id")).agg(*[F.max(F.when(F.col("col") == c, F.struct("value", "donor_id"))).alias(f"{OWN}f{i}") for i, c in enumerate(names)])
    same = lambda i, c: F.when(F.col(f"{OWN}m{i}"), F.col(f"{OWN}f{i}.value").cast(df.schema[c].dataType)).otherwise(F.col(c))
    extra = lambda i, c: [(F.col(f"{OWN}m{i}") & F.col(f"{OWN}f{i}.value").isNotNull()).alias(f"{c}_filled"), F.col(f"{OWN}f{i}.donor_id").alias(f"{c}_donor")]
    flags = [x for i, c in enumerate(names) for x in extra(i, c)]
    out = [same(names.index(c), c).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns]
    # Only incomplete rows are moved; complete ones keep their partition.
    void = [F.lit(None).cast("struct<value:string,donor_id:bigint>").alias(f"{OWN}f{i}") for i in range(len(names))]
    whole = marked.filter(~some).select("*", *void).select(*out, *flags)
    holes = marked.filter(some)
    holes = holes.join(wide, holes[row_id] == wide[f"{OWN}id"], "left").select(*out, *flags)
    return HotDeck(cells, whole.unionByName(holes), targets)


def _fill(donors: DataFrame, receivers: DataFrame, t: Target, low: int | None) -> DataFrame:
    """receivers with _value, _donor, _n (donors that had a say) and _level (1 is the narrowest block; null without a donor). `low`: see `_near`."""
    done, rest, blocks = [], receivers, list(enumerate(t.blocks, 1))
    # The blocks of timed targets widen all at once, for the cells that the first one leaves; others are few passes over counts.
    steps = [blocks[:1], *([blocks[1:]] if blocks[1:] else [])] if t.timed else [[b] for b in blocks]
    for at, levels in enumerate(steps):
        got = _near(donors, rest, levels[0][1], t, low) if t.timed and not at else _widen(donors, rest, levels, t)
        got = materialize(got.select("_id", "_value", "_donor", "_n", "_level"), "filled")
        done.append(got)
        rest = rest.join(got.select("_id"), "_id", "left_anti")
        if at < len(steps) - 1:
            rest = materialize(rest, "unfilled")
            if rest.isEmpty():
                break
    else:
        done.append(rest.select("_id", F.lit(None).cast(donors.schema[t.col].dataType).alias("_value"), F.lit(None).cast("bigint").alias("_donor"), F.lit(0).cast("bigint").alias("_n"), F.lit(None).cast("int").alias("_level")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _asked(given: DataFrame, tail: DataFrame, by: list[str], values: list[str], joined: bool = False) -> DataFrame:
    """Donors of the blocks that receivers ask for, counted per block and value: by, values, _c, _d (smallest donor id).

    Few asked blocks are broadcast and donors filtered before they are counted; otherwise donors are counted first, which leaves
    of a hot block only its distinct values, and then joined. `joined`: the caller joins with the asked blocks in any case.
    """
    count = lambda x: x.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("_c"), F.min("_d").alias("_d"))
    asked = materialize(tail.select(*by).distinct(), "asked")
    if is_small(asked):
        return count(given.join(F.broadcast(asked), by, "left_semi"))
    return count(given) if joined else count(given).join(asked, by, "left_semi")


def _near(donors: DataFrame, receivers: DataFrame, block: list[str], t: Target, low: int | None) -> DataFrame:
    """Receivers with the donors of their block of at most WINDOW days before or after, weighted by how near their day is.

    `low`: the smallest id, if all are less than 2**57 above it; then a donor and how near it is fit one number, whose least is found by hashing.
    """
    keys = [f"_k{i}" for i in range(len(block))]
    keyed = lambda x: x.select("*", *[F.col(f).alias(k) for f, k in zip(block, keys, strict=True)]).filter(" and ".join(f"{k} is not null" for k in [*keys, "_day"]))
    # A window of 31 days on both sides touches the day's month and its two neighbours.
    months = F.array(*[F.add_months(F.trunc("_day", "month"), k) for k in (-1, 0, 1)])
    tail = keyed(receivers).select("_id", "_day", *keys)
    days = materialize(tail.select(*keys, "_day").distinct().withColumn("_at", F.monotonically_increasing_id()), "receiver-days")
    wide = days.select("*", F.explode(months).alias("_month"))
    given = keyed(donors).select(*keys, F.col(t.col).alias("_v"), F.col("_id").alias("_d"), F.col("_day").alias("_from"), F.trunc("_day", "month").alias("_month"))
    counts = _asked(given, wide, [*keys, "_month"], ["_from", "_v"], joined=True)
    pairs = counts.join(wide, [*keys, "_month"]).withColumn("_gap", F.abs(F.date_diff("_from", "_day")).cast("bigint")).filter(F.col("_gap") <= WINDOW)
    closest = F.min_by("_d", F.struct("_gap", "_d")) if low is None else F.min(F.col("_gap") * (1 << 57) + (F.col("_d") - low)).bitwiseAND((1 << 57) - 1) + low
    vals = pairs.groupBy("_at", "_v").agg(F.sum(F.col("_c") / (1 + F.col("_gap"))).alias("_w"), F.sum("_c").alias("_c"), closest.alias("_d"))
    picked = _choose(vals, ["_at"], t).join(days, "_at")
    return tail.join(picked, [*keys, "_day"]).withColumn("_level", F.lit(1))


def _widen(donors: DataFrame, receivers: DataFrame, levels: list[tuple[int, list[str]]], t: Target) -> DataFrame:
    """Receivers with the donors of the first of several blocks, each wider than the one before, that has any: those of the nearest day, on
    both sides if equally near, however far away; all of them if the target is not timed, the receiver has no day or the block no dated donors.

    Donors are read twice for all blocks together: for the days that each asked block has, of which only the distinct ones are ordered, and
    to be counted where some receiver has chosen them.
    """
    feats = sorted({f for _, block in levels for f in block})
    cell = lambda f, block: (F.col(f) if f in block else F.lit(None).cast(donors.schema[f].dataType)).alias(f"f{feats.index(f)}")
    held = lambda block: F.expr(" and ".join(f"`{f}` is not null" for f in block) or "true")
    keys = F.array(*[F.when(held(block), F.struct(F.lit(level).alias("level"), *[cell(f, block) for f in feats])) for level, block in levels])
    spread = lambda x, *cols: x.select(*cols, F.explode(keys).alias("_k")).filter("_k is not null")
    tail = spread(receivers, "_id", "_day")
    told = [F.col(t.col).alias("_v"), F.col("_id").alias("_d"), (F.col("_day") if t.timed else F.lit(None).cast("date")).alias("_from")]
    given = spread(donors, *told)
    within = lambda blocks: _looked_up(donors, told, blocks, levels, feats)
    # From here on blocks go by a number.
    asked = materialize(tail.select("_k").distinct().select("_k", F.col("_k.level").alias("_level"), F.monotonically_increasing_id().alias("_at")), "asked")
    few = is_small(asked)
    tail = _numbered(tail, asked, few).select("_id", "_day", "_at", "_level")
    days = (within(asked) if few else _numbered(given.select("_k", "_from").distinct(), asked, few)).select("_at", "_from").distinct()
    days = materialize(days, "donor-days")
    ways = tail.join(days.select("_at").distinct(), "_at", "left_semi")
    if t.timed:
        ways = ways.join(_nearest(days.filter("_from is not null"), tail.select("_at", "_day").filter("_day is not null").distinct()), ["_at", "_day"], "left")
    else:
        ways = ways.withColumn("_found", F.lit(None).cast("array<date>"))
    chosen = ways.groupBy("_id").agg(F.min(F.struct("_level", "_at", "_day", "_found")).alias("_w")).select("_id", "_w.*")
    chosen = materialize(chosen, "chosen")
    near, alike = chosen.filter("_found is not null"), chosen.filter("_found is null")
    want = materialize(near.select("_at", "_day", F.explode("_found").alias("_from")).distinct(), "nearest-days")
    whole = materialize(alike.select("_at").distinct(), "blocks")
    heads = materialize(asked.join(chosen.select("_at").distinct(), "_at", "left_semi"), "heads")
    counts = materialize(_counted(given, within, heads, want, whole), "donors")
    cols = ["_id", "_value", "_donor", "_n", "_level"]
    got = []
    if t.timed:
        vals = counts.join(want, ["_at", "_from"]).groupBy("_at", "_day", "_v").agg(F.sum("_c").cast("double").alias("_w"), F.sum("_c").alias("_c"), F.min("_d").alias("_d"))
        got.append(near.join(_choose(vals, ["_at", "_day"], t), ["_at", "_day"]).select(*cols))
    if not t.timed or not whole.isEmpty():
        vals = counts.join(whole, "_at", "left_semi").groupBy("_at", "_v").agg(F.sum("_c").alias("_c"), F.min("_d").alias("_d"))
        got.append(alike.join(_all(vals, ["_at"], t), "_at").select(*cols))
    return got[0] if len(got) == 1 else got[0].unionByName(got[1])


def _numbered(rows: DataFrame, blocks: DataFrame, few: bool) -> DataFrame:
    """Rows of the `blocks` with their number _at: by a broadcast if the blocks are few."""
    return rows.join(F.broadcast(blocks) if few else blocks.hint("merge"), "_k")


def _looked_up(donors: DataFrame, told: list[Column], blocks: DataFrame, levels: list[tuple[int, list[str]]], feats: list[str]) -> DataFrame:
    """The columns `told` (_v, _d, _from) of the donors of few `blocks` with the block's number _at: one broadcast for each level that `blocks` has, by its plain
    features; the row is then spread over the numbers found, not over structs of features."""
    have = {x["_level"] for x in blocks.select("_level").distinct().collect()}
    rows, found = donors.select("*", *[c.alias(f"{OWN}{i}") for i, c in enumerate(told)]), []
    for level, block in levels:
        if level not in have:
            continue
        keys = [f"{OWN}k{i}" for i in range(len(block))]
        side = blocks.filter(F.col("_level") == level).select(*[F.col("_k")[f"f{feats.index(f)}"].alias(k) for f, k in zip(block, keys, strict=True)], F.col("_at").alias(f"{OWN}at{level}"))
        same = F.lit(True)
        for f, k in zip(block, keys, strict=True):
            same = same & (F.col(f) == F.col(k))
        rows = rows.join(F.broadcast(side), same, "left").drop(*keys)
        found.append(F.col(f"{OWN}at{level}"))
    at = F.explode(F.array(*found)) if len(found) > 1 else found[0] if found else F.lit(None).cast("bigint")
    return rows.select(at.alias("_at"), *[F.col(f"{OWN}{i}").alias(n) for i, n in enumerate(("_v", "_d", "_from"))]).filter("_at is not null")


def _counted(given: DataFrame, within: Callable[[DataFrame], DataFrame], heads: DataFrame, want: DataFrame, whole: DataFrame) -> DataFrame:
    """Donors of the days `want` (_at, _from) and of the whole blocks `whole` (_at), both of `heads`: _at, _from, _v, _c, _d, counted before they are joined if those are many."""
    days = materialize(want.select("_at", "_from").distinct().withColumn("_is", F.lit(True)), "wanted")
    few, small = is_small(heads), is_small(days)
    values, one, more = ["_from", "_v"], [F.count(F.lit(1)).alias("_c"), F.min("_d").alias("_d")], [F.sum("_c").alias("_c"), F.min("_d").alias("_d")]
    rows = within(heads) if few else _numbered(given.groupBy("_k", *values).agg(*one), heads, few)
    if not small and few:
        rows = rows.groupBy("_at", *values).agg(*one)
    rows = rows.join(F.broadcast(days) if small else days.hint("merge"), ["_at", "_from"], "left")
    rows = join_small(rows, whole.withColumn("_all", F.lit(True)), "_at", "left").filter("_is or _all")
    return rows.groupBy("_at", *values).agg(*(one if few and small else more))


def _nearest(days: DataFrame, asks: DataFrame) -> DataFrame:
    """_at, _day of `asks` with _found: the nearest of the block's days, two if equally near; blocks without days are left out. `days`: _at, _from."""
    line = asks.withColumns({"_from": F.lit(None).cast("date"), "_ask": F.lit(True)}).unionByName(days.select("_at", F.col("_from").alias("_day"), "_from", F.lit(False).alias("_ask")))
    # Each frame ends with its row, a donor's day before a receiver's equal one; a frame to the end of the block would be read anew for every row.
    side = lambda way: F.last("_from", True).over(Window.partitionBy("_at").orderBy(way("_day"), "_ask").rowsBetween(Window.unboundedPreceding, 0))
    sides = line.select("_at", "_day", "_ask", side(F.asc).alias("_b"), side(F.desc).alias("_a")).filter("_ask and (_b is not null or _a is not null)")
    gap = F.least(F.date_diff("_day", "_b"), F.date_diff("_a", "_day"))
    found = F.array(F.when(F.date_diff("_day", "_b") == gap, F.col("_b")), F.when(F.date_diff("_a", "_day") == gap, F.col("_a")))
    return sides.select("_at", "_day", F.array_distinct(F.array_compact(found)).alias("_found"))


def _choose(vals: DataFrame, by: list[str], t: Target) -> DataFrame:
    """The weighted lower median or majority of the values of each group; a group has at most the distinct values of its window's days."""
    if not t.numeric:
        best = F.max_by(F.struct("_v", "_d"), F.struct("_w", F.lit(0) - F.xxhash64("_v")))
        return vals.groupBy(*by).agg(best.alias("_b"), F.sum("_c").alias("_n")).select(*by, F.col("_b._v").alias("_value"), F.col("_b._d").alias("_donor"), "_n")
    arr = vals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_v", "_w", "_d"))).alias("_a"), F.sum("_w").alias("_t"), F.sum("_c").alias("_n"))
    walk = F.aggregate(
        "_a", F.struct(F.lit(0.0).alias("s"), F.lit(None).cast(vals.schema["_v"].dataType).alias("v"), F.lit(None).cast("bigint").alias("d")),
        lambda acc, x: F.when(acc["v"].isNotNull(), acc).otherwise(
            F.when(acc["s"] + x["_w"] >= F.col("_t") / 2 - 1e-9, F.struct((acc["s"] + x["_w"]).alias("s"), x["_v"].alias("v"), x["_d"].alias("d")))
            .otherwise(F.struct((acc["s"] + x["_w"]).alias("s"), F.lit(None).cast(vals.schema["_v"].dataType).alias("v"), F.lit(None).cast("bigint").alias("d")))
        ),
    )
    return arr.select(*by, walk.alias("_b"), "_n").select(*by, F.col("_b.v").alias("_value"), F.col("_b.d").alias("_donor"), "_n")


def _all(vals: DataFrame, keys: list[str], t: Target) -> DataFrame:
    """Per block: all its donors alike."""
    if not t.numeric:
        best = F.max_by(F.struct("_v", "_d"), F.struct("_c", F.lit(0) - F.xxhash64("_v")))
        out = vals.groupBy(*keys).agg(best.alias("_b"), F.sum("_c").alias("_n")).filter("_n is not null")
        return out.select(*keys, F.col("_b._v").alias("_value"), F.col("_b._d").alias("_donor"), "_n")
    vals = materialize(vals, "values")
    by = keys or ["_one"]
    flat = vals if keys else vals.withColumn("_one", F.lit(1))
    med = median_of_counts(flat, by, F.col("_v"), "_c", lower=True)
    sizes = flat.groupBy(*by).agg(F.sum("_c").alias("_n"))
    out = med.join(sizes, by).join(flat.select(*by, F.col("_v").alias("median"), "_d"), [*by, "median"])
    return out.select(*keys, F.col("median").alias("_value"), F.col("_d").alias("_donor"), "_n")
