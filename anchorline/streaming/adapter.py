"""Running tools over streams: row-wise tools directly, whole pipelines per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from anchorline.plans.pipeline import Pipeline, PipelineSpec
from anchorline.session import new_path

#: Tools that look at one row at a time, or at a static table: they plan over a stream as over a table.
ROW_WISE = {
    "Preparation.filter", "Preparation.formula", "Preparation.select", "Preparation.data_cleansing", "Preparation.date_filter", "Preparation.multi_field_formula", "Join.union", "Join.append_fields", "Transform.arrange", "Transform.transpose",
    "Parse.date_time", "Parse.regex_match", "Parse.regex_parse", "Parse.regex_replace", "Parse.regex_tokenize", "Parse.text_to_columns", "Parse.xml_parse", "Developer.base64_encode", "Developer.base64_decode", "Developer.dynamic_rename", "Developer.dynamic_select", "Developer.json_parse",
}


def check_streamable(spec: PipelineSpec) -> None:
    """ValueError naming the steps that depend on order or on all rows, which a stream does not have."""
    if bad := [f"{s.id} ({s.tool})" for s in spec.steps if s.tool not in ROW_WISE]:
        raise ValueError(f"not for streams: {', '.join(bad)}; run them per micro-batch with for_each_batch")


def apply_to_stream(stream: DataFrame, config: dict, source: str = "stream") -> DataFrame:
    """The last step's output of a pipeline of row-wise tools over a stream; steps refer to the stream as `source`."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    pipe = Pipeline({"name": config.get("name", "stream"), "steps": config["steps"]})
    check_streamable(pipe.spec)
    pipe.state[source] = stream
    for s in pipe.spec.steps:
        pipe.state[s.id] = pipe._call(s)
    last = pipe.state[pipe.spec.steps[-1].id]
    return last[0] if isinstance(last, tuple) else last


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Run any tools on each micro-batch, a plain table to them. Batches are numbered and repeated after a failure: sinks should be keyed by the number."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint or new_path(stream.sparkSession, "stream"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options: object) -> DataFrame:
    """Files of a folder as a stream; the schema is that of the files there if none is given."""
    schema = schema or spark.read.format(format).options(**options).load(path).schema
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def windowed_totals(stream: DataFrame, time: str, value: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Number and sum of `value` per window and keys; rows later than `late` behind the newest are dropped by the watermark."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    grouped = timed.groupBy(F.window("_time", width, slide), *keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "rows", "total")
