"""Scope checks over whole access logs (the per-query check is ``cuebook.plans.guard``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_violations(access: DataFrame, scopes: DataFrame, table_col: str = "table_name") -> DataFrame:
    """Accesses to tables outside their bot's declared scope.

    ``access``: ``bot_id, run_id, <table_col>`` (one row per table read).
    ``scopes``: ``bot_id, tables array<string>, unscoped boolean``.
    Fail closed: a bot without a scope row, or with an empty list and no ``unscoped`` flag,
    violates on every access; an empty list *with* ``unscoped`` is open. Names compare exactly,
    ignoring case. Both joins are on ``bot_id``; AQE broadcasts the scope side when its runtime
    size is small and splits a skewed bot otherwise.
    """
    pairs = scopes.select("bot_id", F.explode("tables").alias("_t")).select(
        "bot_id", F.lower("_t").alias("_t")).distinct()
    outside = access.withColumn("_t", F.lower(table_col)).join(pairs, on=["bot_id", "_t"], how="left_anti")
    info = scopes.select("bot_id", F.coalesce(F.size("tables"), F.lit(0)).alias("_n"),
                         F.coalesce(F.col("unscoped"), F.lit(False)).alias("_open"))
    out = outside.join(info, on="bot_id", how="left")
    reason = (F.when(F.col("_n").isNull(), F.lit("bot declares no scope"))
              .when(F.col("_n") == 0, F.lit("empty scope without unscoped"))
              .otherwise(F.lit("table outside the declared scope")))
    keep = ~(F.coalesce(F.col("_open"), F.lit(False)) & (F.coalesce(F.col("_n"), F.lit(-1)) == 0))
    return out.filter(keep).select(*access.columns, reason.alias("reason"))
