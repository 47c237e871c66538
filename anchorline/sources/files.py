"""In/Out tools: reading, writing, inline data, browsing and listing folders."""

from __future__ import annotations

import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.functions.checks import frame
from anchorline.session import _remove, get_spark


class PickleRemovedError(ValueError):
    """Pickle files can run code when read and are not supported."""


# Extensions and formats. Those of the second group have no Spark reader and are read as one table by an optional package.
SPARK_FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".orc": "orc", ".txt": "text", ".xml": "xml", ".avro": "avro"}
OTHER_FORMATS = {".feather": "feather", ".html": "html", ".htm": "html", ".xlsx": "excel", ".xls": "excel", ".sas7bdat": "sas", ".xpt": "sas", ".dta": "stata", ".sav": "spss"}
PICKLES = {".pkl", ".pickle"}
#: Bytes of a file without Spark reader up to which the driver reads it.
MOST_DRIVER_BYTES = 500_000_000


def _format(path: str, fmt: str | None) -> str:
    ext = os.path.splitext(str(path).rstrip("/"))[1].lower()
    if ext in PICKLES or fmt in ("pickle", "pkl"):
        raise PickleRemovedError("pickle files are not supported: reading one can run any code")
    if fmt:
        return fmt.lower()
    if ext in SPARK_FORMATS:
        return SPARK_FORMATS[ext]
    if ext in OTHER_FORMATS:
        return OTHER_FORMATS[ext]
    if os.path.isdir(path):
        inner = {os.path.splitext(f)[1].lower() for f in os.listdir(path) if not f.startswith(("_", "."))} & set(SPARK_FORMATS)
        if len(inner) == 1:
            return SPARK_FORMATS[inner.pop()]
        return "parquet"
    if any(c in str(path) for c in "*?["):
        return "parquet"
    raise ValueError(f"Unsupported file format: {ext or path!r}")


def input_data(path: str, format: str | None = None, schema: str | T.StructType | None = None, **options: object) -> DataFrame:
    """Read a file, folder or glob by its extension or `format`: csv, tsv, json (one document or array), jsonl, parquet, orc, text, xml, table, jdbc, and
    through optional packages feather, html (first table), excel, sas, stata, spss.

    A local path that is missing raises FileNotFoundError, an unknown format ValueError, pickle PickleRemovedError. csv and tsv have a header and inferred types
    unless told otherwise. Predicates and columns reach parquet and orc scans.
    """
    spark = get_spark()
    if format in ("table", "jdbc"):
        return spark.read.table(path) if format == "table" else spark.read.format("jdbc").options(url=path, **options).load()
    fmt = _format(path, format)
    if "://" not in str(path) and not any(c in str(path) for c in "*?[") and not os.path.exists(path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    if fmt in ("csv", "tsv"):
        base = {"header": "true"} | ({} if schema is not None else {"inferSchema": "true"}) | ({"sep": "\t"} if fmt == "tsv" else {})
        return reader.options(**(base | options)).csv(str(path))
    if fmt == "json":
        return reader.options(**({"multiLine": "true"} | options)).json(str(path))
    if fmt == "jsonl":
        return reader.options(**options).json(str(path))
    if fmt in ("parquet", "orc", "text"):
        return getattr(reader.options(**options), fmt)(str(path))
    if fmt in ("xml", "avro", "delta", "iceberg"):
        return reader.format(fmt).options(**options).load(str(path))
    return _by_pandas(path, fmt, options)


def _by_pandas(path: str, fmt: str, options: dict) -> DataFrame:
    import pandas as pd

    if os.path.exists(path) and os.path.getsize(path) > MOST_DRIVER_BYTES:
        raise ValueError(f"{path}: files of this format over {MOST_DRIVER_BYTES} bytes must be converted first")
    readers = {"feather": pd.read_feather, "html": lambda p, **k: pd.read_html(p, **k)[0], "excel": pd.read_excel, "sas": pd.read_sas, "stata": pd.read_stata, "spss": pd.read_spss}
    if fmt not in readers:
        raise ValueError(f"Unsupported file format: {fmt!r}")
    try:
        pdf = readers[fmt](path, **options)
    except ImportError as e:
        raise ImportError(f"reading {fmt} needs an optional package: {e}") from e
    pdf.columns = [str(c) for c in pdf.columns]
    return get_spark().createDataFrame(pdf)


def output_data(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite", single_file: bool = True, partition_by: list[str] | None = None, **options: object) -> None:
    """Write by extension or `format`; missing parent folders are made.

    A local path with a file extension becomes one file (single_file), written by one task; use single_file=False, or a path without
    extension, for a folder of part files written in parallel, partitioned by `partition_by` if given. feather, html, excel and stata are written by the driver, up
    to MOST_DRIVER_BYTES.
    """
    frame(df)
    fmt = _format_out(path, format)
    local = "://" not in str(path)
    if local and (parent := os.path.dirname(str(path))):
        os.makedirs(parent, exist_ok=True)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    if fmt in ("feather", "html", "excel", "stata"):
        _check_driver_size(df, fmt)
        pdf = df.toPandas()
        {"feather": pdf.to_feather, "html": lambda p: pdf.to_html(p, index=False), "excel": lambda p: pdf.to_excel(p, index=False), "stata": lambda p: pdf.to_stata(p, write_index=False)}[fmt](path)
        return
    one = single_file and local and not partition_by and os.path.splitext(str(path))[1].lower() in SPARK_FORMATS
    out = df.coalesce(1) if one else df
    to = f"{path}.__parts" if one else str(path)
    writer = out.write.mode(mode if not one else "overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt in ("csv", "tsv"):
        writer.options(**({"header": "true"} | ({"sep": "\t"} if fmt == "tsv" else {}) | options)).csv(to)
    elif fmt in ("json", "jsonl"):
        writer.options(**options).json(to)
    elif fmt in ("parquet", "orc", "text"):
        getattr(writer.options(**options), fmt)(to)
    else:
        writer.format(fmt).options(**options).save(to)
    if one:
        try:
            if os.path.exists(path) and mode in ("error", "errorifexists"):
                raise FileExistsError(path)
            if os.path.exists(path) and mode == "ignore":
                return
            if os.path.isdir(path):
                raise IsADirectoryError(f"{path} is a folder; remove it or write with single_file=False")
            part = next(p for p in sorted(Path(to).iterdir()) if p.name.startswith("part-"))
            os.replace(part, path)
        finally:
            _remove(df.sparkSession, to)


def _check_driver_size(df: DataFrame, fmt: str) -> None:
    """Raise before the driver collects more than MOST_DRIVER_BYTES, or more rows than a sheet holds."""
    cells = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) + 8 for f in df.schema]
    size = F.lit(0)
    for c in cells:
        size = size + c
    rows, held = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    if rows > 1_048_576 or (held or 0) > MOST_DRIVER_BYTES:
        raise ValueError(f"{fmt} is written by the driver and may hold at most 1048576 rows and {MOST_DRIVER_BYTES} bytes, not {rows} and {held}")


def _format_out(path: str, fmt: str | None) -> str:
    ext = os.path.splitext(str(path))[1].lower()
    if fmt is None and ext == "":
        return "parquet"
    if fmt is None and ext in (".sas7bdat", ".xpt", ".sav"):
        raise ValueError(f"Unsupported output format: {ext!r}")
    return _format(path, fmt)


def text_input(data: dict[str, list] | list, columns: list[str] | None = None) -> DataFrame:
    """Inline data: a dict of lists, a list of dicts, or a list of rows with `columns`."""
    spark = get_spark()
    if isinstance(data, dict):
        names, rows = list(data), list(zip(*data.values(), strict=True)) if data else []
    elif isinstance(data, list) and data and all(isinstance(r, dict) for r in data):
        names = list(dict.fromkeys(k for r in data for k in r))
        rows = [tuple(r.get(k) for k in names) for r in data]
    elif isinstance(data, list):
        if columns is None:
            raise ValueError("rows need columns")
        names, rows = list(columns), [tuple(r) if isinstance(r, list | tuple) else (r,) for r in data]
    else:
        raise TypeError(f"data must be a dict or a list, got {type(data).__name__}")
    types = {}
    for i, n in enumerate(names):
        vals = [r[i] for r in rows if r[i] is not None]
        if vals and all(isinstance(v, int | float) and not isinstance(v, bool) for v in vals) and any(isinstance(v, float) for v in vals):
            types[n] = T.DoubleType()
        elif not vals:
            types[n] = T.StringType()
    if not rows:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    rows = [tuple(float(v) if isinstance(types.get(n), T.DoubleType) and v is not None else v for n, v in zip(names, r, strict=True)) for r in rows]
    fields = [T.StructField(n, types[n]) if n in types else T.StructField(n, spark.createDataFrame([(next(r[i] for r in rows if r[i] is not None),)], ["c"]).schema[0].dataType) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, T.StructType(fields))


def browse(df: DataFrame, n: int = 10) -> DataFrame:
    """Print shape, columns, statistics and the first rows; return `df` unchanged."""
    from anchorline.operators.develop import column_info

    info = column_info(frame(df)).collect()
    rows = info[0]["NonNullCount"] + info[0]["NullCount"] if info else df.count()
    print(f"{rows} rows x {len(df.columns)} columns")
    for r in info:
        print(f"  {r['Name']}: {r['Type']}, {r['NonNullCount']} non-null, {r['NullCount']} null, {r['UniqueCount']} unique")
    if df.columns:
        df.summary().show(truncate=40)
    df.show(n, truncate=40)
    return df


_LISTING = "FullPath string, Directory string, FileName string, ShortFileName string, CreationTime timestamp, LastWriteTime timestamp, LastAccessTime timestamp, Size bigint"


def directory(path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder that match `pattern` (may hold **), sorted; metadata only. A missing folder raises FileNotFoundError. Addresses with a scheme are listed by Spark."""
    spark = get_spark()
    if "://" in str(path):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(str(path)).select("path", "modificationTime", "length")  # content is not read
        name = F.element_at(F.split("path", "/"), -1)
        none = F.lit(None).cast("timestamp")
        return files.select(F.col("path").alias("FullPath"), F.regexp_replace("path", "/[^/]*$", "").alias("Directory"), name.alias("FileName"), F.regexp_replace(name, r"\.[^.]*$", "").alias("ShortFileName"), none.alias("CreationTime"), F.col("modificationTime").alias("LastWriteTime"), none.alias("LastAccessTime"), F.col("length").alias("Size"))
    base = Path(path)
    if not base.is_dir():
        raise FileNotFoundError(path)
    at = lambda t: datetime.fromtimestamp(t, UTC).replace(tzinfo=None)
    rows = []
    for p in sorted(base.glob(pattern)):
        if p.is_file():
            s = p.stat()
            rows.append((str(p.absolute()), str(p.absolute().parent), p.name, p.stem, at(s.st_ctime), at(s.st_mtime), at(s.st_atime), s.st_size))
    return spark.createDataFrame(rows, _LISTING)


def date_time_now() -> DataFrame:
    """One row, one column: the time of the query."""
    return get_spark().range(1).select(F.current_timestamp().alias("DateTime"))


