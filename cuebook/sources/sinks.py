"""Sinks: signal tables, JSON-safe output, and json/csv writers.

Signals are stored one row per signal (not one blob per run), partitioned by bot, appended;
a run's folder can be rewritten idempotently (``replace_run``) after a retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import qcol


def json_safe_column(c: Column, dtype: T.DataType) -> Column:
    """Dates/timestamps -> ISO text, decimals -> double, nested types walked; others unchanged."""
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: json_safe_column(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _k, v: json_safe_column(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        safe = F.struct(*[json_safe_column(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(c.isNotNull(), safe)
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    return c


def json_safe(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe_column(qcol(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_rows(df: DataFrame, column: str = "record") -> DataFrame:
    """Each row as one JSON object text (nulls kept), after the JSON-safe conversion."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[qcol(c) for c in safe.columns]),
                                 {"ignoreNullFields": "false"}).alias(column))


def write_signals(signals: DataFrame, path: str) -> None:
    """Append signal rows partitioned by bot and run (``bot_id``/``run_id`` columns required)."""
    signals.write.mode("append").partitionBy("bot_id", "run_id").parquet(path)


def run_folder(spark: SparkSession, path: str, bot_id: str, run_id: str) -> str:
    """The folder of one run's signals below ``path``, named as a partitioned write names it."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{path.rstrip('/')}/bot_id={escape(bot_id)}/run_id={escape(run_id)}"


def replace_run(signals: DataFrame, path: str, bot_id: str, run_id: str) -> None:
    """Rewrite the signals of one run: a retried run replaces its own output, also with no rows."""
    own = signals.filter((F.col("bot_id") == bot_id) & (F.col("run_id") == run_id)).drop("bot_id", "run_id")
    own.write.mode("overwrite").parquet(run_folder(signals.sparkSession, path, bot_id, run_id))


def write_output(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Declared output formats: ``json`` (nested kept) or ``csv`` (nested columns as JSON text)."""
    safe = json_safe(df)
    if fmt == "json":
        safe.write.mode(mode).json(path)
    elif fmt == "csv":
        flat = safe.select(*[
            F.to_json(qcol(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)
            else qcol(f.name) for f in safe.schema.fields])
        flat.write.mode(mode).option("header", "true").csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown output format {fmt!r}")
