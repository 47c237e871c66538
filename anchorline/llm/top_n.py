"""Top N items within every group, by lower bounds of the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anchorline.session import join_small, materialize

#: Rows gathered in a task before they are cut down to N per group, and kept rows beyond which a task hands on and starts again.
CHUNK, KEEP = 200_000, 1_000_000


def top_n(df: DataFrame, groups: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The `n` rows of highest `score` in each group, of equal scores the smaller `tie` first: groups, score, tie, rank.

    Each task keeps, in one pass, only its own n best of every group; the worst of a full set is a lower bound of the
    group's n-th best. The largest bound of each group is joined to the rows kept, removes those under it, and the survivors are ranked. What is
    shuffled is at most n rows per task and group, so a group with any share of the rows is no hot spot.

    Rows that repeat group, score and tie count once. Null groups are groups; rows with a null score or tie take no part.
    Scores and ties must be integers. An empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    slim = df.select(*groups, F.col(score).cast("bigint").alias(score), F.col(tie).cast("bigint").alias(tie)).filter(F.col(score).isNotNull() & F.col(tie).isNotNull())
    schema = slim.withColumn("_bound", F.lit(None).cast("bigint")).schema

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates([*groups, score, tie]).sort_values([score, tie], ascending=[False, True], kind="stable")
        return frame[frame.groupby(groups, dropna=False, sort=False).cumcount() < n]

    def out(frame: pd.DataFrame) -> pa.RecordBatch:
        by = frame.groupby(groups, dropna=False, sort=False)[score]
        full = by.transform("size") >= n
        frame = frame.assign(_bound=by.transform("min").where(full).astype("Int64"))
        return pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, size = None, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= max(CHUNK, 0 if kept is None else len(kept)):
                new = pa.Table.from_batches(held).to_pandas()
                kept, held, size = cut(new if kept is None else pd.concat([kept, new])), [], 0
                if len(kept) > KEEP:
                    yield out(kept)
                    kept = None
        if held:
            new = pa.Table.from_batches(held).to_pandas()
            kept = cut(new if kept is None else pd.concat([kept, new]))
        if kept is not None and len(kept):
            yield out(kept)

    best = materialize(slim.mapInArrow(local, schema), "local-best")
    bounds = best.filter("_bound is not null").groupBy(*groups).agg(F.max("_bound").alias("_most"))
    bounds = materialize(bounds.select(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)], "_most"), "bounds")
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    # A row under the bound is under n rows of one task. Bounds few enough to be broadcast act before the survivors are shuffled.
    kept = join_small(best, bounds, same, "left").filter(F.col("_most").isNull() | (F.col(score) >= F.col("_most"))).select(*groups, score, tie)
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(tie))
    ranked = kept.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= n)
    return ranked.groupBy(*groups, score, tie).agg(F.min("rank").cast("bigint").alias("rank"))
