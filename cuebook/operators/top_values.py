"""The most frequent values of a column, exactly, without shuffling every distinct value.

1. A frequent-items sketch over 64-bit hashes names a few candidates (Spark's ``approx_top_k``: one
   mergeable sketch of fixed size a task).
2. One pass counts the candidates by value and everything else by hash bucket. Counts combine before the
   shuffle, so a task sends at most candidates + ``buckets`` rows.
3. A value cannot occur more often than its bucket. Buckets below the last candidate that makes the list are
   closed; values of the others, and only these, are counted in full.

The sketch only decides how many buckets stay open, never what is right: with frequent values none do, on a flat
column many, on a column without repeats all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import qcol
from ..session import checkpoint_dir

TRACKED = 8192  # items in the sketch of a task
BUCKETS = 65536
CANDIDATES = 4  # for each value asked for


def bucket_counts(df: DataFrame, column: str, limit: int, tracked: int = TRACKED, buckets: int = BUCKETS) -> DataFrame:
    """``value, bucket, n``: candidates counted by value (bucket null), all other rows by bucket (value null)."""
    hashed = df.select(qcol(column).alias("value"), F.xxhash64(qcol(column)).alias("h"))
    named = min(CANDIDATES * limit, tracked)
    found = hashed.agg(F.expr(f"approx_top_k(h, {named}, {tracked})").alias("top")).first()
    candidates = [item.item for item in (found.top or [])]  # at most ``named`` numbers
    chosen = F.col("h").isin(candidates) if candidates else F.lit(False)
    return hashed.select(F.when(chosen, F.col("value")).alias("value"), F.when(~chosen, F.pmod("h", F.lit(buckets))).alias("bucket")) \
        .groupBy("value", "bucket").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, limit: int = 50, tracked: int = TRACKED, buckets: int = BUCKETS) -> DataFrame:
    """``column, n``: the ``limit`` values that occur most (ties: value order, null first), the rows of a full count.

    Null is a value. An empty table gives no rows. The sketch and the bucket counts run at once (their small result is checkpointed); the
    rest is lazy. ``df`` has to give the same rows each time it is read.
    """
    checkpoint_dir(df.sparkSession)
    counted = bucket_counts(df, column, limit, tracked, buckets).checkpoint(eager=True)
    by_value = counted.filter("bucket IS NULL").select("value", "n")
    last = by_value.orderBy(F.col("n").desc()).limit(limit).agg(F.min("n").alias("n"), F.count("n").alias("k")).first()
    bound = last.n if last.k == limit else 0
    open_buckets = counted.filter((F.col("bucket").isNotNull()) & (F.col("n") >= bound)).select(F.col("bucket").alias("_cue_bucket"))
    if not open_buckets.isEmpty():
        known = by_value.select(F.col("value").alias("_cue_known"))
        rest = df.select(qcol(column).alias("value")).join(
            F.broadcast(open_buckets), F.pmod(F.xxhash64("value"), F.lit(buckets)) == F.col("_cue_bucket"), "left_semi")  # at most ``buckets`` rows
        full = rest.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        by_value = by_value.unionByName(full.join(F.broadcast(known), F.col("value").eqNullSafe(F.col("_cue_known")), "left_anti"))
    return by_value.orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()).limit(limit).select(F.col("value").alias(column), "n")
