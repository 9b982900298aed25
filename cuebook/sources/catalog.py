"""Catalog listings as DataFrames: tables, and (table, ordinal, column, type) schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Catalog tables and temp views of the session (name, database, type, temporary)."""
    rows = [(t.name, t.database or "", t.tableType, bool(t.isTemporary))
            for t in spark.catalog.listTables(database) if t.database not in ("information_schema",)]
    return spark.createDataFrame(rows, "name string, database string, type string, temporary boolean")


def table_schema(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column/type pairs of each table in ordinal order (schema metadata, no data read)."""
    rows = [(name, i, f.name, f.dataType.simpleString())
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, ordinal int, column string, type string")
