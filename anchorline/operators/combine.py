"""Join tools: joins, unions, lookups, fuzzy matches and key groups."""

from __future__ import annotations

import difflib
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.functions.checks import col, columns, frame, one_of
from anchorline.functions.order import temp
from anchorline.functions.types import is_text
from anchorline.operators.alike import LEAST, meet, split_blocks
from anchorline.operators.groups import connected_components
from anchorline.session import BROADCAST_ROWS, is_small, join_small, materialize


class Joined(NamedTuple):
    """Left rows without partner, joined rows, right rows without partner."""

    left: DataFrame
    joined: DataFrame
    right: DataFrame


def join(left: DataFrame, right: DataFrame, on: str | list[str] | None = None, left_on: str | list[str] | None = None, right_on: str | list[str] | None = None,
         suffixes: tuple[str, str] = ("_left", "_right"), null_safe: bool = True, hint: str | None = None) -> Joined:
    """Equi-join with three outputs, each planned only if used.

    Right keys are changed to the left keys' types (a key that cannot be is unmatched, and never takes part as a null). Null keys match
    null keys unless null_safe is False. Columns of the same name that are no keys get suffixes. The physical join is left to the
    optimizer; `hint` passes a join hint for the right side.
    """
    frame(left, "left"), frame(right, "right")
    if on is not None:
        lk = rk = columns(left, on)
        columns(right, on)
    elif left_on is not None and right_on is not None:
        lk, rk = columns(left, left_on), columns(right, right_on)
    else:
        raise ValueError("join needs on, or left_on and right_on")
    if len(lk) != len(rk):
        raise ValueError("left_on and right_on must have the same length")
    keys = [temp(f"k{i}") for i in range(len(lk))]
    bad = temp("bad")
    r, failed = right, F.lit(False)
    for k, a, b in zip(keys, lk, rk, strict=True):
        t = left.schema[a].dataType
        c = col(b)
        if t != right.schema[b].dataType:
            c = c.try_cast(t)
            failed = failed | (c.isNull() & col(b).isNotNull())
        r = r.withColumn(k, c)
    drift = any(left.schema[a].dataType != right.schema[b].dataType for a, b in zip(lk, rk, strict=True))
    if drift:
        r = r.withColumn(bad, failed)
    if hint:
        r = r.hint(hint)
    l2 = left.alias("l")
    r2 = r.alias("r")
    cond = F.lit(True)
    for k, a in zip(keys, lk, strict=True):
        x, y = F.col(f"l.`{a}`"), F.col(f"r.`{k}`")
        cond = cond & (x.eqNullSafe(y) if null_safe else (x == y))
    if drift:
        cond = cond & ~F.col(f"r.`{bad}`")
    both = set(left.columns) & set(right.columns)
    shared = set(lk) if on is not None else set()
    out = [F.col(f"l.`{c}`").alias(c + suffixes[0] if c in both and c not in shared else c) for c in left.columns]
    out += [F.col(f"r.`{c}`").alias(c + suffixes[1] if c in both else c) for c in right.columns if c not in shared]
    joined = l2.join(r2, cond, "inner").select(*out)
    only_left = l2.join(r2, cond, "left_anti").select(*[F.col(f"l.`{c}`") for c in left.columns])
    coerced = {b: k for b, k in zip(rk, keys, strict=True)}
    shown = [F.when(F.col(f"r.`{bad}`"), None).otherwise(F.col(f"r.`{coerced[c]}`")).alias(c) if drift and c in coerced else F.col(f"r.`{c}`") for c in right.columns]
    only_right = r2.join(l2, cond, "left_anti").select(*shown)
    return Joined(only_left, joined, only_right)


def join_multiple(*dfs: DataFrame, on: str | list[str] | None = None, join_type: str = "outer") -> DataFrame:
    """Join two or more frames from left to right on `on` (by default their common columns). Columns that clash get _2, _3, ..."""
    if len(dfs) < 2:
        raise ValueError("join_multiple needs at least two frames")
    one_of(join_type, ("inner", "outer", "left", "right", "cross"), "join_type")
    out = frame(dfs[0])
    for i, df in enumerate(dfs[1:], 2):
        frame(df)
        keys = [] if join_type == "cross" else ([on] if isinstance(on, str) else list(on)) if on is not None else [c for c in out.columns if c in df.columns]
        if join_type != "cross":
            columns(out, keys), columns(df, keys)
            if not keys:
                raise ValueError("no common columns to join on")
        clash = {c: f"{c}_{i}" for c in df.columns if c in out.columns and c not in keys}
        df = df.select(*[col(c).alias(clash.get(c, c)) for c in df.columns])
        out = out.crossJoin(df) if join_type == "cross" else out.join(df, keys, join_type)
    return out


def union(*dfs: DataFrame, by: str = "name") -> DataFrame:
    """All rows of all frames, columns matched by name (missing ones null) or by position (first frame's names), widened to common types."""
    if len(dfs) < 2:
        raise ValueError("union needs at least two frames")
    one_of(by, ("name", "position"), "by")
    for d in dfs:
        frame(d)
    if by == "position":
        if len({len(d.columns) for d in dfs}) > 1:
            raise ValueError("frames must have the same number of columns")
        dfs = (dfs[0], *[d.toDF(*dfs[0].columns) for d in dfs[1:]])
    # Text and non-text meet as text.
    kinds: dict[str, set[bool]] = {}
    for d in dfs:
        for f in d.schema:
            kinds.setdefault(f.name, set()).add(is_text(f.dataType))
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    if mixed:
        dfs = tuple(d.select(*[col(c).cast("string").alias(c) if c in mixed else col(c) for c in d.columns]) for d in dfs)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def find_replace(df: DataFrame, find_df: DataFrame, find_col: str, replace_col: str, target_col: str | None = None, mode: str = "entire", append: bool = False) -> DataFrame:
    """Replace values by a lookup table, or append what was found.

    entire: whole values (of equal lookup keys the last row counts); partial: all literal occurrences, row by row of the lookup in its
    order. With `append` the result is a new column named `replace_col` (`<name>_found` if taken); partial then takes the first lookup row
    that occurs. Unmatched values stay (append: null). A partial lookup is applied row-wise and must fit BROADCAST_ROWS; an entire one is joined.
    """
    columns(find_df, [find_col, replace_col])
    target = target_col or find_col
    columns(df, target)
    new = (replace_col if replace_col not in df.columns else f"{replace_col}_found") if append else target
    pos = temp("pos")
    ranked = find_df.select(col(find_col).alias("f"), col(replace_col).alias("r"), F.monotonically_increasing_id().alias(pos)).filter("f is not null")
    if mode == "entire":
        key, val, hit = temp("f"), temp("r"), temp("hit")
        once = ranked.groupBy(F.col("f").cast(df.schema[target].dataType).alias(key)).agg(F.max_by("r", pos).alias(val)).withColumn(hit, F.lit(True))
        once = materialize(once, "lookup")
        base = df.withColumn(key, col(target))
        out = join_small(base, once, key, "left")
        c = F.col(val) if append else F.when(F.col(hit), F.col(val).cast(df.schema[target].dataType)).otherwise(col(target))
        if append:
            return out.select(*[col(x) for x in df.columns], c.alias(new))
        return out.select(*[c.alias(new) if x == new else col(x) for x in df.columns])
    if mode != "partial":
        raise ValueError(f"mode must be 'entire' or 'partial', got {mode!r}")
    rows = ranked.orderBy(pos).select(F.col("f").cast("string"), F.col("r").cast("string")).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"a partial lookup may hold at most {BROADCAST_ROWS} rows")
    pairs = [(r[0], r[1] or "") for r in rows if r[0] != ""]
    text = col(target).cast("string")
    if not pairs:
        return df.withColumn(new, F.lit(None).cast("string")) if append else df
    table = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(r).alias("r")) for f, r in pairs])
    if append:
        return df.withColumn(new, F.get(F.filter(table, lambda p: F.contains(text, p["f"])), F.lit(0)).getField("r"))
    return df.withColumn(new, F.when(text.isNotNull(), F.aggregate(table, text, lambda acc, p: F.replace(acc, p["f"], p["r"]))))


def append_fields(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every right row; clashing names get _left and _right. The right side is broadcast only if it is small in rows and bytes."""
    frame(left, "left"), frame(right, "right")
    both = set(left.columns) & set(right.columns)
    a = left.select(*[col(c).alias(c + "_left" if c in both else c) for c in left.columns])
    b = right.select(*[col(c).alias(c + "_right" if c in both else c) for c in right.columns])
    return a.crossJoin(F.broadcast(b) if is_small(b) else b)


def fuzzy_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float = 0.6, score_column: str = "MatchScore", method: str = "ratio", block: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rows whose texts are alike: all columns with _left and _right, and the score (4 places).

    ratio: twice the matching characters by the length of both (difflib), in Arrow batches behind a native bound on lengths and on the
    characters both hold, which loses no pair. levenshtein: 1 - distance / longer length; in blocks with many pairs, only those are scored
    whose counts of characters allow the threshold (`alike.meet`), which loses none either. Distinct texts are compared, not rows; `block` names
    a left and a right column whose values must be equal, without which every text meets every other. Null texts and blocks match nothing.
    """
    columns(left, left_on), columns(right, right_on)
    one_of(method, ("ratio", "levenshtein"), "method")
    side = lambda df, c, n, i: df.select(col(c).cast("string").alias(n), (col(block[i]) if block else F.lit(0)).alias(f"k{i}")).filter(F.col(n).isNotNull()).distinct()
    a, b = side(left, left_on, "x", 0), side(right, right_on, "y", 1)
    la, lb = F.length("x"), F.length("y")
    longer = F.greatest(la, lb, F.lit(1))
    if method == "levenshtein":
        # Beyond the distance that the threshold allows, the distance is given up: -1.
        d = F.call_function("levenshtein", F.col("x"), F.col("y"), F.floor((1 - threshold) * longer + 1e-6).cast("int"))
        bound, score = 1 - F.abs(la - lb) / longer >= threshold, F.when(d >= 0, 1 - d / longer)
    else:
        # No ratio exceeds the one of the characters both texts hold, counted.
        bound, score = 2 * F.least(la, lb) / F.greatest(la + lb, F.lit(1)) >= threshold, _ratio("x", "y", F.lit(float(threshold)))
    alike = bound | ((la == 0) & (lb == 0))
    same, groups = left is right and left_on == right_on and (block is None or block[0] == block[1]), None
    if method == "levenshtein" and LEAST <= threshold <= 1 and a.schema["k0"].dataType == b.schema["k1"].dataType:
        a = materialize(a.filter(F.col("k0").isNotNull()), "texts")
        b = a.select(F.col("x").alias("y"), F.col("k0").alias("k1")) if same else materialize(b.filter(F.col("k1").isNotNull()), "texts")
        a, b, groups = split_blocks(a, b, same)
    pairs = a.join(b, (F.col("k0") == F.col("k1")) & alike).select("x", "y", "k0", F.lit(False).alias("m"))
    if groups is not None:
        pairs = pairs.union(meet(groups, float(threshold), same))
    pairs = pairs.withColumn("s", score).filter(F.col("s") >= threshold).select("x", "y", "k0", "m", F.round("s", 4).alias("s"))
    pairs = materialize(pairs, "matches")
    pairs = (pairs.union(pairs.filter("m").select(F.col("y").alias("x"), F.col("x").alias("y"), "k0", "m", "s")) if same else pairs).drop("m")
    la2 = left.select(*[col(c).alias(f"{c}_left") for c in left.columns], col(left_on).cast("string").alias("x"))
    lb2 = right.select(*[col(c).alias(f"{c}_right") for c in right.columns], col(right_on).cast("string").alias("y"))
    keyed = lambda df, i: df.withColumn("k0", col(block[i] + ("_left", "_right")[i]) if block else F.lit(0))
    out = keyed(la2, 0).join(pairs, ["x", "k0"]).join(keyed(lb2, 1), ["y", "k0"])
    return out.select(*[col(f"{c}_left") for c in left.columns], *[col(f"{c}_right") for c in right.columns], F.col("s").alias(score_column))


@F.pandas_udf(T.DoubleType())
def _ratio(x: pd.Series, y: pd.Series, t: pd.Series) -> pd.Series:
    out, matcher, last = [], difflib.SequenceMatcher(None), None
    least = float(t.iloc[0]) if len(t) else 0.0
    for a, b in zip(x, y, strict=True):
        if b != last:
            matcher.set_seq2(b)
            last = b
        matcher.set_seq1(a)
        out.append(matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else 0.0)
    return pd.Series(out)


def make_group(df: DataFrame, key1: str, key2: str) -> DataFrame:
    """Group of each key: Key, and Group, the smallest key (as text) that it is connected with by rows. A row with one key alone connects nothing.

    Components are found by joins over encoded keys; a key shared by many rows is combined before it is shuffled.
    """
    columns(df, [key1, key2])
    pairs = df.select(col(key1).cast("string").alias("a"), col(key2).cast("string").alias("b")).distinct()
    nodes = pairs.select("a").union(pairs.select("b")).filter("a is not null").distinct()
    edges = pairs.filter("a is not null and b is not null").select(F.col("a").alias("x"), F.col("b").alias("y"))
    found = connected_components(nodes, edges, "a", "x", "y")
    return found.select(F.col("component").alias("Group"), F.col("a").alias("Key")).orderBy("Group", "Key")

