"""Pairs of texts that may be within an edit distance, from counts of their characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.session import join_small, materialize

#: Pairs of a block up to which a plain join is cheaper; texts of one side that one task holds at once, and their bytes.
FEW, CHUNK, CHUNK_BYTES = 4_096, 16_384, 32 << 20
#: Pairs compared at once (they stay in the processor's cache), and pairs of one batch that goes back.
TILE, BATCH = 65_536, 8_192
#: Share below which the counts tell texts hardly apart.
LEAST = 0.6


def split_blocks(a: DataFrame, b: DataFrame, same: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """`a` (x, k0) and `b` (y, k1) of the blocks with few pairs, and the texts of all others, ready for `meet` (None: there are no others).

    A large block's sides are dealt into chunks of about CHUNK texts or CHUNK_BYTES and every pair of chunks (i, j) becomes a group of its own: k0, i, j, side, t.
    With `same` both sides are equal, and only the pairs of chunks with i <= j are made.
    """
    parts = lambda c: (F.greatest(F.count(F.lit(1)) / CHUNK, F.sum(F.octet_length(c)) / CHUNK_BYTES) + 1).cast("int")
    sizes = a.groupBy("k0").agg(F.count(F.lit(1)).alias("na"), parts("x").alias("pa"))
    if same:
        sizes = sizes.withColumns({"nb": F.col("na"), "pb": F.col("pa")})
    else:
        sizes = sizes.join(b.groupBy(F.col("k1").alias("k0")).agg(F.count(F.lit(1)).alias("nb"), parts("y").alias("pb")), "k0")
    large = materialize(sizes.filter(F.col("na") * F.col("nb") > FEW).select("k0", "pa", "pb"), "blocks")
    n = large.count()
    if not n:
        return a, b, None
    dealt = lambda df, c, own, other: join_small(df, large, "k0", rows=n).select("k0", F.pmod(F.xxhash64(c), F.col(own)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("o"), F.col(c).alias("t"))
    if same:
        groups = dealt(a, "x", "pa", "pa").select("k0", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("o") < F.col("c")).alias("side"), "t")
    else:
        groups = dealt(a, "x", "pa", "pb").select("k0", F.col("c").alias("i"), F.col("o").alias("j"), F.lit(False).alias("side"), "t")
        groups = groups.union(dealt(b.withColumnRenamed("k1", "k0"), "y", "pb", "pa").select("k0", F.col("o").alias("i"), F.col("c").alias("j"), F.lit(True).alias("side"), "t"))
    few = lambda df, k: join_small(df, large.select(F.col("k0").alias(k)), k, "left_anti", rows=n)
    return few(a, "k0"), few(b, "k1"), groups


def meet(groups: DataFrame, threshold: float, same: bool) -> DataFrame:
    """Pairs (x, y, k0) of each group for which 1 - edit distance / longer length may reach `threshold`, no such pair left out; m: (y, x) is one too and is not listed.

    One edit changes the counts of at most two characters and of at most four pairs of adjacent characters by one each (an inserted or deleted character: of one
    and three). Counts are kept as bits, each telling whether a character occurs at least so often, so two texts differ in no more bits than counts.
    """
    spark = groups.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType()), groups.schema["k0"], T.StructField("m", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(pa.Table.from_batches(list(batches)), threshold, same)

    # A fixed number of tasks: by its bytes, this would be gathered into one.
    return groups.repartition(tasks, "k0", "i", "j").groupBy("k0", "i", "j").applyInArrow(run, schema)


def _meet(group: pa.Table, threshold: float, same: bool) -> Iterator[pa.RecordBatch]:
    key, side, texts = (pa.concat_arrays(group[c].chunks) for c in ("k0", "side", "t"))
    side = side.to_numpy(zero_copy_only=False)
    own = same and not side.any()  # a chunk with itself
    at, (lengths, words) = np.arange(len(side)), _features(texts)
    order = np.argsort(lengths, kind="stable")
    a, b = (order, order) if own else (order[~side[order]], order[side[order]])

    def batch(i: np.ndarray, j: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([texts.take(pa.array(i)), texts.take(pa.array(j)), key.take(pa.array(np.zeros(len(i), np.int64))), pa.array(m)], ["x", "y", "k0", "m"])

    if own:
        for s in range(0, len(at), BATCH):
            yield batch(at[s : s + BATCH], at[s : s + BATCH], np.zeros(len(at[s : s + BATCH]), bool))
    held, n = [], 0
    for i, j in _near(lengths[a], words[:, a], lengths[b], words[:, b], threshold, own):
        held.append((a[i], b[j]))
        n += len(i)
        if n >= BATCH:
            yield batch(*map(np.concatenate, zip(*held, strict=True)), np.full(n, same))
            held, n = [], 0
    if n:
        yield batch(*map(np.concatenate, zip(*held, strict=True)), np.full(n, same))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each text, and its bits: four words for characters, four for pairs of adjacent ones."""
    lengths, ones, twos = [np.zeros(0, np.int64)], [np.zeros((0, 256), np.uint8)], [np.zeros((0, 1024), np.uint8)]
    ends, s = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while s < len(texts):
        e = max(s + 1, min(s + 2048, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + (1 << 20), "right"))))
        own = [t.decode("utf-8", "replace") for t in texts.slice(s, e - s).cast(pa.binary()).to_pylist()]
        s = e
        size = np.array([len(t) for t in own], np.int64)
        flat = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(own)), size)
        count = lambda at, n: np.minimum(np.bincount(at, minlength=len(own) * n), 255).astype(np.uint8).reshape(-1, n)  # noqa: B023, E731
        lengths.append(size)
        ones.append(count(row * 256 + (flat & 255), 256))
        twos.append(count((row[1:] * 1024 + ((flat[:-1] * 37 + flat[1:]) & 1023))[row[1:] == row[:-1]], 1024))
    return np.concatenate(lengths), np.concatenate([_bits(np.concatenate(ones), 12), _bits(np.concatenate(twos), 3)])


def _bits(counts: np.ndarray, levels: int) -> np.ndarray:
    """Four words a row: the 256 tests `counts[:, c] >= level` that tell the rows best apart, the best first. Each holds for its own count alone, so any choice of them is right."""
    share = np.concatenate([np.count_nonzero(counts >= v, axis=0) for v in range(1, levels + 1)]) / max(1, len(counts))
    best = np.argsort(-share * (1 - share), kind="stable")[:256]
    return np.ascontiguousarray(np.packbits(np.take(counts, best % counts.shape[1], axis=1) >= best // counts.shape[1] + 1, axis=1).view(np.uint64).T)


def _near(la: np.ndarray, wa: np.ndarray, lb: np.ndarray, wb: np.ndarray, threshold: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that may be alike; both sides sorted by length. own: both are the same, and each pair is given once, none of a text with itself."""
    wa, wb, e = np.ascontiguousarray(wa), np.ascontiguousarray(wb), 1e-6
    starts = np.flatnonzero(np.r_[True, la[1:] != la[:-1]]) if len(la) else []
    for s, end in zip(starts, [*starts[1:], len(la)], strict=True):
        n = int(la[s])
        lo, hi = np.searchsorted(lb, n * threshold - e), np.searchsorted(lb, n / threshold + e, "right")
        lo = max(lo, s) if own else lo
        apart = np.abs(lb[lo:hi] - n)
        most = 2 * np.floor((1 - threshold) * np.maximum(lb[lo:hi], n) + e).astype(np.int64) - apart
        small = np.minimum(most, 255).astype(np.uint8)
        step = max(1, TILE // max(1, hi - lo))
        for p in range(s, end, step):
            q, c = min(p + step, end), (p - lo if own else 0)
            if lo + c >= hi:
                break
            differ = np.bitwise_count(wa[0, p:q, None] ^ wb[0, None, lo + c : hi])
            differ += np.bitwise_count(wa[1, p:q, None] ^ wb[1, None, lo + c : hi])
            hit = np.flatnonzero(differ <= small[c:])
            i, j = np.divmod(hit, hi - lo - c)
            d = differ.ravel()[hit].astype(np.int64)
            i, j = i + p, j + c
            if own:
                keep = j + lo > i
                i, j, d = i[keep], j[keep], d[keep]
            for w in (2, 3):
                d += np.bitwise_count(wa[w, i] ^ wb[w, j + lo])
            keep = d <= most[j]
            i, j = i[keep], j[keep]
            d = np.zeros(len(i), np.int64)
            for w in (4, 5, 6, 7):
                d += np.bitwise_count(wa[w, i] ^ wb[w, j + lo])
            keep = d <= 2 * most[j] + apart[j]
            if keep.any():
                yield i[keep], j[keep] + lo
