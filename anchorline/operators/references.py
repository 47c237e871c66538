"""References to records that do not exist."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.session import join_small, materialize

#: Keys of one bitmap, as in Spark's bitmap functions.
BITS = 32_768
#: References of a key range and period from which a bitmap (4 KB) is smaller than their positions (2 bytes each), and those of a key range that one part holds.
SPARSE, PART = 2_048, 1_000_000


def dense_codes(keys: DataFrame, key: str) -> DataFrame:
    """Dictionary of the distinct non-null `key`: key, code (0, 1, 2 ... in key order), without a single-task sort."""
    once = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    laid = materialize(once.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(key, F.monotonically_increasing_id().alias("_mid")), "dictionary")
    part = F.shiftright("_mid", 33)
    sizes = sorted((r[0], r[1]) for r in laid.groupBy(part).count().collect())  # one row per partition
    offset, at = {}, 0
    for p, n in sizes:
        offset[p], at = at, at + n
    if not offset:
        return laid.select(key, F.lit(0).cast("bigint").alias("code"))
    starts = laid.sparkSession.createDataFrame(sorted(offset.items()), "p bigint, start bigint")
    return laid.join(F.broadcast(starts), part == F.col("p")).select(key, (F.col("start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("code"))


def orphan_pairs(refs: DataFrame, parent: DataFrame, key: str, seen: str, arrived: str, deleted: str | None) -> DataFrame:
    """Pairs (key, period) of references whose record is not there: key, seen, kind.

    `refs` and `parent` hold `key`; `seen` is the time at which a reference was loaded (its period), `arrived` that of a parent row (its
    smallest counts) and `deleted` that of its deletion (the smallest counts; null: never). Kinds: `missing` (no such
    parent row), `late` (arrived after `seen`), `deleted` (deleted at or before `seen`); a record that is both late and deleted is late.

    Keys become dense integers; each period and range of 32 768 keys has one container of references, compressed by density: a bitmap of 4 KB, or
    the positions themselves while they are fewer than SPARSE. Against it stand the keys that had arrived and been deleted by that period: reference
    AND NOT parent, and the surviving bits are decoded. Every task holds one key range, its parents' times and at most about PART references. Null keys and null `seen` refer to nothing;
    a parent row without an arrival time never arrives (late). Empty tables give the obvious results.
    """
    own = refs.select(F.col(key).alias("k"), F.col(seen).alias("s")).filter("k is not null and s is not null").distinct()
    gone = F.col(deleted) if deleted else F.lit(None).cast("timestamp_ntz")
    holds = parent.select(F.col(key).alias("k"), F.col(arrived).cast("timestamp_ntz").alias("a"), gone.cast("timestamp_ntz").alias("x")).filter("k is not null")
    holds = holds.groupBy("k").agg(F.min("a").alias("a"), F.min("x").alias("x"))
    book = materialize(dense_codes(own.select("k").union(holds.select("k")), "k"), "codes")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = F.expr("code div 32768")
    coded = materialize(own.join(book, "k").select(bucket.alias("bucket"), F.col("s"), (F.col("code") % BITS).cast("int").alias("pos")), "coded")
    sizes = materialize(coded.groupBy("bucket", "s").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # A dense container is a bitmap (one bit per position), a sparse one the sorted positions: neither is ever larger than the bitmap.
    dense = materialize(sizes.filter(F.col("n") >= SPARSE).select("bucket", "s"), "dense")
    full = join_small(coded, dense, ["bucket", "s"], "left_semi").groupBy("bucket", "s").agg(F.bitmap_construct_agg(F.col("pos").cast("bigint")).alias("bits"))
    thin = join_small(coded, dense, ["bucket", "s"], "left_anti").groupBy("bucket", "s").agg(F.array_sort(F.collect_list(F.col("pos").cast("smallint"))).alias("held"))
    left = full.withColumn("held", F.lit(None).cast("array<smallint>")).unionByName(thin.withColumn("bits", F.lit(None).cast("binary")))
    # A key range with very many references is worked on in parts of its periods, each beside the range's parents.
    parts = materialize(sizes.groupBy("bucket").agg((F.sum("n").cast("bigint") / PART + 1).cast("int").alias("parts")), "parts")
    left = join_small(left, parts, "bucket").select("bucket", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part"), micros("s").alias("seen"), "bits", "held")
    right = holds.join(book, "k").select(bucket.alias("bucket"), (F.col("code") % BITS).cast("int").alias("pos"), micros("a").alias("a"), micros("x").alias("x"))
    right = join_small(right, parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pos", "a", "x")
    found = left.groupBy("bucket", "part").cogroup(right.groupBy("bucket", "part")).applyInPandas(_and_not, "code bigint, seen bigint, kind string")
    out = found.join(book, "code").select(F.col("k").alias(key), F.timestamp_micros("seen").cast(refs.schema[seen].dataType).alias(seen), "kind")
    return out


def _and_not(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """One key range: bitmaps as numpy words, bit i of byte i // 8 being position i."""
    never = np.iinfo(np.int64).max
    there, arrive, gone = np.zeros(BITS, bool), np.full(BITS, never), np.full(BITS, never)
    if len(parents):
        pos = parents["pos"].to_numpy()
        there[pos] = True
        arrive[pos] = parents["a"].astype("Int64").fillna(never).to_numpy(dtype=np.int64)
        gone[pos] = parents["x"].astype("Int64").fillna(never).to_numpy(dtype=np.int64)
    pack = lambda mask: np.packbits(mask, bitorder="little")
    ever = pack(there)
    out = []
    for bucket, seen, bits, held in zip(refs["bucket"], refs["seen"], refs["bits"], refs["held"], strict=True):
        if bits is None:  # a few positions: looked up one by one
            pos = np.asarray(held, dtype=np.int64)
            known, came, left = there[pos], arrive[pos] <= seen, gone[pos] <= seen
            for kind, hit in (("missing", ~known), ("late", known & ~came), ("deleted", came & left)):
                if hit.any():
                    out.append(pd.DataFrame({"code": pos[hit] + int(bucket) * BITS, "seen": np.int64(seen), "kind": kind}))
            continue
        ref = np.frombuffer(bits, dtype=np.uint8)
        here = pack(arrive <= seen)
        dead = pack(gone <= seen)
        for kind, found in (("missing", ref & ~ever), ("late", ref & ever & ~here), ("deleted", ref & here & dead)):
            if found.any():
                codes = np.flatnonzero(np.unpackbits(found, bitorder="little")).astype(np.int64) + int(bucket) * BITS
                out.append(pd.DataFrame({"code": codes, "seen": np.int64(seen), "kind": kind}))
    return pd.concat(out) if out else pd.DataFrame({"code": pd.Series(dtype="int64"), "seen": pd.Series(dtype="int64"), "kind": pd.Series(dtype="object")})


def orphan_rows(refs: DataFrame, parent: DataFrame, key: str, seen: str, arrived: str, deleted: str | None, keep: list[str]) -> DataFrame:
    """Rows of `refs` whose reference does not exist: `keep` columns and kind (see `orphan_pairs`; a column of `refs` of that name is not kept).

    The pairs are found once and joined back; a key that many rows share is split by AQE where the pairs are too many to broadcast.
    """
    keep = [c for c in keep if c != "kind"]
    pairs = materialize(orphan_pairs(refs, parent, key, seen, arrived, deleted), "orphans")
    rows = refs.filter(F.col(key).isNotNull()).select(*dict.fromkeys([*keep, key, seen]))
    return join_small(rows, pairs, [key, seen]).select(*keep, "kind")


def orphan_report(rows: DataFrame, table: str, day: str) -> DataFrame:
    """Number of orphan references per table, month of `day` (null: no date) and kind: table, month, kind, rows."""
    return rows.groupBy(F.lit(table).alias("table"), F.trunc(day, "month").alias("month"), "kind").agg(F.count(F.lit(1)).alias("rows"))
