"""Run history as append-only tables.

``run_events``: ``run_id, bot_id, type (run_started|run_progress|run_completed|run_failed),
ts, as_of, summary, error, record_count, execution_ms`` -- one row per lifecycle event.
``runs`` (the state): one row per run, derived from its events (last event wins).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Run states and the event types that move a run between them.
RUNNING, COMPLETED, FAILED = "running", "completed", "failed"
EVENT_STATUS = {"run_started": RUNNING, "run_progress": RUNNING,
                "run_completed": COMPLETED, "run_failed": FAILED}
# One lifecycle event, as ``lifecycle_event`` makes it.
EVENT_SCHEMA = ("run_id string, bot_id string, type string, ts timestamp, as_of string, stage string, summary string, "
                "error string, record_count long, execution_ms long, metadata string")


def run_state(events: DataFrame) -> DataFrame:
    """Current state per run from its lifecycle events (map-side partial aggregation).

    Events of other types say nothing about a run and are left out; a replayed event changes
    nothing, so the fold may run over a log that holds replays, in any order."""
    status = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in EVENT_STATUS.items()])
    ev = events.filter(F.col("type").isin(*EVENT_STATUS)).withColumn("_status", status).withColumn(
        "_rank", F.when(F.col("type").isin("run_completed", "run_failed"), F.lit(1)).otherwise(F.lit(0)))
    last = F.max(F.struct("_rank", "ts", "_status", "summary", "error"))
    return ev.groupBy("run_id").agg(
        F.first("bot_id", ignorenulls=True).alias("bot_id"),
        F.max_by("as_of", F.when(F.col("type") == "run_started", F.col("ts"))).alias("as_of"),
        F.min("ts").alias("created_at"),
        last.alias("_last"),
        F.min(F.when(F.col("type") == "run_started", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("type").isin("run_completed", "run_failed"), F.col("ts"))).alias("finished_at"),
    ).select("run_id", "bot_id", "as_of", "created_at", F.col("_last._status").alias("status"),
             "started_at", "finished_at",
             F.coalesce(F.col("_last.summary"), F.lit("")).alias("summary"),
             F.coalesce(F.col("_last.error"), F.lit("")).alias("error"))


def get_run(runs: DataFrame, bot_id: str, run_id: str) -> DataFrame:
    """The run if this bot owns it, else empty."""
    return runs.filter((F.col("bot_id") == bot_id) & (F.col("run_id") == run_id))


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("run_id").desc()]


def latest(runs: DataFrame) -> DataFrame:
    """Newest completed run of every bot: one aggregate (partial, skew-safe), no window."""
    done = runs.filter(F.col("status") == COMPLETED)
    newest = F.max(F.struct(*[F.col(c) for c in ("created_at", "run_id")], F.struct(*runs.columns).alias("r")))
    return done.groupBy("bot_id").agg(newest.alias("_n")).select("_n.r.*")


def history(runs: DataFrame, limit: int = 20, status: str | None = None) -> DataFrame:
    """Newest ``limit`` runs per bot (tie: run_id desc). ``row_number <= k`` is planned with a
    per-partition group limit before the shuffle, so a busy bot ships at most k rows per task."""
    src = runs if status is None else runs.filter(F.col("status") == status)
    w = Window.partitionBy("bot_id").orderBy(*_newest_first())
    return src.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def recent(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest ``limit`` runs across all bots (a distributed top-k, TakeOrderedAndProject)."""
    return runs.orderBy(*_newest_first()).limit(limit)


def with_duration(runs: DataFrame) -> DataFrame:
    """Runs plus duration_ms (finished - started; NULL while running)."""
    dur = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1000)
    return runs.withColumn("duration_ms", F.floor(dur).cast("long"))


def with_record_counts(runs: DataFrame, signals: DataFrame) -> DataFrame:
    """Runs plus record_count (signals per run, partial aggregation) and duration_ms."""
    counts = signals.groupBy("run_id").agg(F.count(F.lit(1)).alias("record_count"))
    return with_duration(runs.join(counts, on="run_id", how="left").withColumn(
        "record_count", F.coalesce(F.col("record_count"), F.lit(0))))


def resolve_as_of(spec: Column, ref_date: Column | dt.date) -> Column:
    """''/D/D-0/today -> the reference date; D-n -> n days before it; other text unchanged.

    Returns ISO text. ``ref_date`` is a parameter (the run date), never the wall clock inside a
    task, so retries and replays resolve the same way.
    """
    ref = F.lit(ref_date) if isinstance(ref_date, dt.date) else ref_date
    ref = ref.cast("date")
    s = F.coalesce(spec, F.lit(""))
    days = F.regexp_extract(s, r"^D-(\d+)$", 1)
    return (F.when(s.isin("", "D", "D-0", "today"), F.date_format(ref, "yyyy-MM-dd"))
            .when(days != "", F.date_format(F.date_sub(ref, days.cast("int")), "yyyy-MM-dd"))
            .otherwise(s))


def as_of_filter(df: DataFrame, ts_col: str, as_of: Column | str) -> DataFrame:
    """Optional data cut: keep rows on or before the end of the as-of day."""
    limit = F.lit(as_of) if isinstance(as_of, str) else as_of
    return df.filter(F.col(ts_col) < F.date_add(limit.cast("date"), 1).cast("timestamp"))


def bot_overview(bots: DataFrame, runs: DataFrame, last: int = 10) -> DataFrame:
    """Every bot with its newest ``last`` runs as rows (bot columns repeated)."""
    return bots.join(history(runs, limit=last), on="bot_id", how="left")


def lifecycle_event(spark, bot_id: str, run_id: str, kind: str, *, as_of: str = "", stage: str = "", summary: str = "",
                    error: str = "", record_count: int | None = None, execution_ms: int | None = None,
                    metadata: str | None = None, ts: dt.datetime | None = None) -> DataFrame:
    """One lifecycle event (``kind``: a key of ``EVENT_STATUS``), ready to append to ``run_events``."""
    if kind not in EVENT_STATUS:
        raise ValueError(f"unknown event type {kind!r}")
    ts = ts or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    return spark.createDataFrame([(run_id, bot_id, kind, ts, as_of, stage, summary, error, record_count, execution_ms, metadata)],
                                 EVENT_SCHEMA)


def distinct_events(events: DataFrame) -> DataFrame:
    """Replays dropped: events equal in run, type, time and stage count once, whenever they arrive."""
    stage = F.col("stage") if "stage" in events.columns else F.lit("")
    return events.withColumn("_stage", F.coalesce(stage, F.lit(""))).dropDuplicates(["run_id", "type", "ts", "_stage"]).drop("_stage")
