"""Ordered numbering and running totals that never put one whole group into one task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends each group to a single task, so a
group holding a third of all rows becomes one straggler. Here rows are dealt to ranges of
``(g, k)`` instead; a hot group spans many ranges. Each range numbers its own rows,
and a small table of per-(range, group) counts supplies the offset a range adds.

* ``ordered_index``: 0-based position of each row inside its group, in ``order`` order.
* ``running_totals``: cumulative sums in one order, optionally per group (plus grand totals).

``ordered_index`` moves whole rows once. The bounds of the ranges come from a bounded sample of
the narrow key columns and become constants, so a row's range follows from its values alone: it is the same
in the pass that counts (which reads only the key columns, and combines before its shuffle) and in the pass that numbers,
whatever order rows come in, and nothing has to be written in between. Only groups that
cross a bound need an offset: at most 2 x ranges rows, a proven bound, broadcast.

``running_totals`` costs one range shuffle plus one hash shuffle of its rows, which are aggregates already, and
checkpoints them (reliably, in ``spark.checkpoint.dir``), as its ranges are Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_PID = "_cue_pid"


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _sort_cols(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_SAMPLE = 20  # sampled keys for each range


def _direction(c: Column) -> tuple[Column, bool, bool]:
    """(what a sort column sorts by, descending, nulls last)."""
    node = c._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return c, False, False
    return _column(c, node.child()), "Descending" in node.sortDirection().toString(), "NullsLast" in node.nullOrdering().toString()


def _column(like: Column, node) -> Column:
    from pyspark import SparkContext

    return type(like)(SparkContext._active_spark_context._jvm.org.apache.spark.sql.Column(node))


def _range_of(df: DataFrame, keys: list[Column], ranges: int) -> Column:
    """The number of the range of ``keys`` that a row lies in: 0 up to ``ranges`` - 1, growing with the keys' order."""
    parts = [_direction(c) for c in keys]
    narrow = df.select(*[value.alias(f"k{i}") for i, (value, _, _) in enumerate(parts)])
    sorting = [{(False, False): c.asc_nulls_first(), (False, True): c.asc_nulls_last(), (True, False): c.desc_nulls_first(), (True, True): c.desc_nulls_last()}[how]
               for c, how in ((F.col(f"k{i}"), (down, last)) for i, (_, down, last) in enumerate(parts))]
    sample = narrow.withColumn("_cue_r", F.rand(17)).orderBy("_cue_r").limit(_SAMPLE * ranges).drop("_cue_r").distinct()
    found = [r[0] for r in sample.orderBy(*sorting).select(F.to_json(F.struct(*narrow.columns), _JSON)).collect()]
    every = max(1, -(-len(found) // ranges))
    found = found[every::every]
    if not found:
        return F.lit(0)
    kind = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in narrow.schema.fields)
    bounds = F.from_json(F.lit("[" + ",".join(found) + "]"), f"array<struct<{kind}>>", _JSON)

    def reached(bound: Column) -> Column:
        """Whether the bound is not after the row."""
        result = F.lit(True)
        for i, (value, down, last) in reversed(list(enumerate(parts))):
            b = bound[f"k{i}"]
            before = (b > value) if down else (b < value)
            missing = (value.isNull() & b.isNotNull()) if last else (b.isNull() & value.isNotNull())
            result = F.coalesce(before, F.lit(False)) | missing | (b.eqNullSafe(value) & result)
        return result

    steps = [1 << k for k in range(len(found).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(
        (at + step <= len(found)) & reached(F.get(bounds, at + step - 1)), at + step).otherwise(at))


def ordered_index(df: DataFrame, group: list[str], order: list[Column | str], out: str = "idx",
                  partitions: int | None = None) -> DataFrame:
    """Add ``out``: the 0-based position of each row within ``group`` ordered by ``order``.

    ``order`` should end in a unique tie-breaker, or equal keys may swap between runs. ``df`` is read three times (a sample,
    counts, rows; the first two only its key columns) and has to give the same rows each time.
    """
    p = _partitions(df, partitions)
    ranged = df.withColumn(_PID, _range_of(df, [F.col(g) for g in group] + _sort_cols(order), p))
    local = Window.partitionBy(_PID, *group).orderBy(*_sort_cols(order))
    numbered = ranged.withColumn("_cue_local", F.row_number().over(local) - F.lit(1))
    counts = ranged.groupBy(_PID, *group).agg(F.count(F.lit(1)).alias("_cue_n"))
    # Each of the p - 1 bounds falls inside at most one group, so the groups that cross one cover at most 2p
    # (range, group) pairs. Every other row's offset is 0.
    per_group = Window.partitionBy(*group)
    before = per_group.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_cue_np", F.count(F.lit(1)).over(per_group)) \
        .withColumn("_cue_off", F.coalesce(F.sum("_cue_n").over(before), F.lit(0))).filter(F.col("_cue_np") > 1) \
        .select(F.col(_PID).alias("_cue_opid"), *[F.col(g).alias(f"_cue_o_{g}") for g in group], "_cue_off")
    cond = [F.col(_PID) == F.col("_cue_opid")] + [F.col(g).eqNullSafe(F.col(f"_cue_o_{g}")) for g in group]
    joined = numbered.join(F.broadcast(offsets), on=cond, how="left")
    idx = F.coalesce(F.col("_cue_off"), F.lit(0)) + F.col("_cue_local")
    return joined.withColumn(out, idx.cast("long")).drop(
        _PID, "_cue_local", "_cue_off", "_cue_opid", *[f"_cue_o_{g}" for g in group])


def _null_safe(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    cond = None
    for c in cols:
        part = left[c].eqNullSafe(right[c])
        cond = part if cond is None else cond & part
    return cond if cond is not None else F.lit(True)


def running_totals(df: DataFrame, order: list[Column | str], sums: dict[str, str],
                   totals: dict[str, str] | None = None, partitions: int | None = None,
                   group: list[str] | None = None) -> DataFrame:
    """Cumulative sums in ``order`` (inclusive of the current row), per ``group`` if given.

    ``sums`` maps source column -> output column; ``totals`` (optional) maps source column ->
    output column holding the (group's) grand total, without a cross join: totals ride on the
    per-partition offset table. Without groups that table has one row per partition (a proven
    size bound -> broadcast); with groups it has at most ``partitions + groups`` rows.
    """
    group = list(group or [])
    p = _partitions(df, partitions)
    gcols = [F.col(g) for g in group]
    ranged = df.repartitionByRange(p, *gcols, *_sort_cols(order)).withColumn(_PID, F.spark_partition_id())
    inside = Window.partitionBy(_PID, *group).orderBy(*_sort_cols(order)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(src).over(inside).alias(f"_cue_c_{dst}") for src, dst in sums.items()])
    checkpoint_dir(df.sparkSession)
    local = local.checkpoint(eager=True)
    per_part = local.groupBy(_PID, *group).agg(*[F.sum(src).alias(f"_cue_t_{src}") for src in
                                                 set(sums) | set(totals or {})])
    prior = Window.partitionBy(*group).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group).orderBy(_PID).rowsBetween(Window.unboundedPreceding,
                                                                Window.unboundedFollowing)
    offsets = per_part.select(
        _PID, *group,
        *[F.coalesce(F.sum(f"_cue_t_{src}").over(prior), F.lit(0)).alias(f"_cue_o_{dst}")
          for src, dst in sums.items()],
        *[F.sum(f"_cue_t_{src}").over(whole).alias(dst) for src, dst in (totals or {}).items()],
    )
    if not group:
        out = local.join(F.broadcast(offsets), on=_PID, how="inner")
    else:
        renamed = offsets.select(*[F.col(c).alias(f"_cue_k_{c}") if c in group or c == _PID else F.col(c)
                                   for c in offsets.columns])
        cond = [local[_PID] == renamed[f"_cue_k_{_PID}"]] + \
            [local[g].eqNullSafe(renamed[f"_cue_k_{g}"]) for g in group]
        out = local.join(renamed, on=cond, how="inner").drop(*[f"_cue_k_{c}" for c in [_PID, *group]])
    for dst in sums.values():
        out = out.withColumn(dst, F.col(f"_cue_o_{dst}") + F.col(f"_cue_c_{dst}"))
    drop = [_PID] + [f"_cue_o_{d}" for d in sums.values()] + [f"_cue_c_{d}" for d in sums.values()]
    return out.drop(*drop)
