"""Session access, shared storage and size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Bytes up to which a side may be broadcast: the optimizer's estimate of it, which for a written table is the size of its files.
BROADCAST_BYTES = 64 << 20

_made: list[tuple[SparkSession, str]] = []

_current: contextvars.ContextVar[SparkSession | None] = contextvars.ContextVar("anchorline_spark", default=None)


def get_spark() -> SparkSession:
    """The session set by `use_spark`, else the active one, else a new one."""
    spark = _current.get() or SparkSession.getActiveSession()
    return spark or SparkSession.builder.getOrCreate()


@contextlib.contextmanager
def use_spark(spark: SparkSession):
    """Make `spark` the session of source tools within the block."""
    token = _current.set(spark)
    try:
        yield spark
    finally:
        _current.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one is set only where none is, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="anchorline-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by `clean_up` or when the driver ends."""
    path = os.path.join(shared_dir(spark), f"anchorline-{name}-{uuid.uuid4().hex}")
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of `df`; very large where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> bool:
    """Whether `df` may be broadcast: at most `bound` rows (counted unless given) whose text and binary cells hold at most BROADCAST_BYTES."""
    wide = [F.sum(F.octet_length(F.col(f"`{f.name}`"))) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    flat = all(f.dataType.typeName() not in ("array", "map", "struct", "variant") for f in df.schema)
    if rows is not None and (rows > bound or (flat and not wide)):
        return rows <= bound
    few = df.limit(bound + 1) if rows is None else df
    n, *held = few.agg(F.count(F.lit(1)), *wide).first()
    return n <= bound and sum(h or 0 for h in held) <= BROADCAST_BYTES and (flat or estimated_bytes(df) <= BROADCAST_BYTES)


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join with `small` broadcast only if it is small in rows and bytes (see `is_small`); otherwise a shuffle join that AQE splits when skewed.

    `rows` is the known row count of `small`; without it the side is counted, so give a materialized one.
    """
    return df.join(F.broadcast(small) if is_small(small, rows, bound) else small.hint("merge"), on, how)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it by themselves (PYTHONPATH, an installed package, or in local mode the working folder)."""
    root, sc = Path(__file__).resolve().parent.parent, spark.sparkContext
    local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd() if local else ""]
    if root.name in ("site-packages", "dist-packages") or any(p and Path(p).resolve() == root for p in places) or getattr(sc, "_anchorline_sent", False):
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="anchorline-code-"), "anchorline_code"), "zip", root, "anchorline"))  # served by the driver
    sc._anchorline_sent = True


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Condition under which all `keys` are equal, nulls included."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def clean_up() -> int:
    """Remove all tables that `materialize` and the tools wrote so far; frames that still read them become unusable. The number removed."""
    n = len(_made)
    while _made:
        _remove(*_made.pop())
    return n


atexit.register(clean_up)
