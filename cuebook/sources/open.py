"""Open a data source by URI, the Spark way (``spark.read`` / ``spark.table`` / JDBC).

Schemes: ``parquet:``, ``orc:``, ``csv:``, ``json:``, ``delta:`` (when the jar is present),
``table:`` (catalog table), ``jdbc:...`` (read-only by convention: the credential must be
read-only; a session statement can make it so), or a bare path whose extension picks the format.
An unknown scheme is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILE_FORMATS = ("parquet", "orc", "csv", "json", "delta", "text")


def jdbc_options(url: str, table: str, *, read_only_statement: str | None = None,
                 partition_column: str | None = None, lower_bound: int | None = None,
                 upper_bound: int | None = None, num_partitions: int | None = None,
                 **extra: str) -> dict[str, str]:
    """Options for a parallel JDBC read: split on a numeric column into ``num_partitions`` ranges."""
    opts = {"url": url, "dbtable": table, **extra}
    if read_only_statement:
        opts["sessionInitStatement"] = read_only_statement
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("a partitioned JDBC read needs bounds and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    return opts


def open_source(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    if uri.startswith("jdbc:"):
        table = options.pop("dbtable", None) or options.pop("table", None)
        if not table:
            raise ValueError("a jdbc source needs dbtable=")
        return spark.read.format("jdbc").options(**jdbc_options(uri, table, **options)).load()
    scheme, sep, rest = uri.partition(":")
    if sep and scheme in FILE_FORMATS:
        reader = spark.read.options(**options)
        if scheme == "csv":
            reader = reader.option("header", options.get("header", "true"))
        return reader.format(scheme).load(rest)
    if sep and scheme == "table":
        return spark.table(rest)
    if not sep or scheme in ("file", "hdfs", "s3a", "gs", "abfss") or len(scheme) == 1:
        lowered = uri.lower().rstrip("/")
        for fmt in FILE_FORMATS:
            if lowered.endswith("." + fmt):
                return spark.read.options(**options).format(fmt).load(uri)
        return spark.read.options(**options).parquet(uri)
    raise ValueError(f"unknown source scheme {scheme!r} in {uri!r}")
