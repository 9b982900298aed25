"""As-of join: each row with what was valid when it happened, without gathering a group in one task.

Both sides become one ordered sequence: (key, time, side), facts before the rows that ask for them at the
same time. Rows are dealt to ranges of that order (see ``ordered``), so a busy key spans many tasks. Inside a range
the last fact is carried along by a running window; a range's first rows get the last fact of an earlier
range from a table of (range, key) pairs. Only keys that cross a bound are in it: at most 2 x ranges rows, a
proven bound, broadcast.

Whole rows move once. Facts are reduced to one for each key and time before (with map-side combine), so that many
facts of one moment are no hot range either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import qcol
from .ordered import _PID, _partitions, _range_of


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    return not isinstance(dtype, T.MapType | T.VariantType)


def as_of_join(rows: DataFrame, facts: DataFrame, by: list[str], at: str, since: str, carry: dict[str, str],
               partitions: int | None = None) -> DataFrame:
    """``rows`` with the columns ``carry`` (column of ``facts`` -> new name) of the newest fact of the same ``by``
    whose ``since`` is not after the row's ``at``; nulls where there is none.

    Of facts at one time the greatest in ``carry``'s order counts (null least). A null key or time matches
    nothing; a row with one stays, without a fact. Rows that are equal in all columns share a range. Both inputs are
    read three times (a sample, carried facts, rows) and have to give the same rows each time.
    """
    clash = set(carry.values()) & set(rows.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    keys = [f"_cue_k{i}" for i in range(len(by))]
    known = facts.dropna(subset=[*by, since]).groupBy(*[qcol(b).alias(k) for b, k in zip(by, keys)], qcol(since).alias("_cue_at")) \
        .agg(F.max(F.struct(*[qcol(c).alias(name) for c, name in carry.items()])).alias("_cue_fact"))
    spread = [qcol(f.name) for f in rows.schema.fields if _hashable(f.dataType)]
    asked = rows.select(*[qcol(b).alias(k) for b, k in zip(by, keys)], qcol(at).alias("_cue_at"), F.xxhash64(*spread).alias("_cue_spread"),
                        F.struct(*[qcol(c) for c in rows.columns]).alias("_cue_row"))
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("_cue_asks", F.col("_cue_row").isNotNull())
    order = [F.col("_cue_at"), F.col("_cue_asks"), F.col("_cue_spread")]
    ranged = both.withColumn(_PID, _range_of(both, [F.col(k) for k in keys] + order, _partitions(rows, partitions)))

    until = Window.partitionBy(_PID, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_cue_local", F.last("_cue_fact", ignorenulls=True).over(until)).filter("_cue_asks")
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max_by("_cue_fact", F.when(~F.col("_cue_asks"), F.col("_cue_at")))
    carried = ranged.groupBy(_PID, *keys).agg(newest.alias("_cue_fact")) \
        .withColumn("_cue_np", F.count(F.lit(1)).over(per_key)) \
        .withColumn("_cue_before", F.last("_cue_fact", ignorenulls=True).over(earlier)) \
        .filter((F.col("_cue_np") > 1) & F.col("_cue_before").isNotNull()) \
        .select(F.col(_PID).alias("_cue_opid"), *[F.col(k).alias(f"{k}o") for k in keys], "_cue_before")
    cond = [F.col(_PID) == F.col("_cue_opid")] + [F.col(k) == F.col(f"{k}o") for k in keys]
    found = F.coalesce("_cue_local", "_cue_before")
    return local.join(F.broadcast(carried), on=cond, how="left").select("_cue_row.*", *[found.getField(n).alias(n) for n in carry.values()])
