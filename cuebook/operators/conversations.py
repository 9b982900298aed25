"""Conversation tables: append with per-conversation sequence numbers, ordered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ordered_index


def append_seq(existing: DataFrame, new: DataFrame, conv: str = "conversation_id",
               order: list[Column | str] | None = None, seq: str = "seq",
               partitions: int | None = None) -> DataFrame:
    """Number a batch of new messages after each conversation's current max ``seq``.

    ``order`` ranks the new messages of one conversation (arrival order; must end in a unique
    key). The per-conversation max is a partial aggregate, and the numbering uses the
    range-partitioned index, so one huge conversation is split across tasks.
    """
    order = order or [F.col("created_at"), F.col("id")]
    top = existing.groupBy(conv).agg(F.max(seq).alias("_max"))
    numbered = ordered_index(new, [conv], order, out="_i", partitions=partitions)
    return numbered.join(top, on=conv, how="left").withColumn(
        seq, (F.coalesce(F.col("_max"), F.lit(0)) + F.col("_i") + F.lit(1)).cast("long")).drop("_max", "_i")


def messages(table: DataFrame, conv: str = "conversation_id", seq: str = "seq",
             role: str = "role") -> DataFrame:
    """Messages without ``system`` turns, in sequence order per conversation."""
    return table.filter(F.coalesce(F.col(role), F.lit("")) != F.lit("system")).orderBy(conv, seq)


def conversations(table: DataFrame, conv: str = "conversation_id",
                  updated: str = "created_at") -> DataFrame:
    """Each conversation with its last update, most recent first."""
    return table.groupBy(conv).agg(F.max(updated).alias("updated_at")) \
        .orderBy(F.col("updated_at").desc(), F.col(conv))
