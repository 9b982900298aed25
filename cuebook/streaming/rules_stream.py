"""Rules and history on Structured Streaming.

* J1 ``evaluate`` works unchanged on a streaming DataFrame (stateless, append mode, file sink).
* J2 ``hot_reload_sink``: ``foreachBatch`` re-reads the ruleset file for every micro-batch.
* J3 idempotent sink: each micro-batch overwrites its own ``batch_id=`` folder, so a replayed
  batch after a failure rewrites the same files, and one without rows empties them.
* J4 ``run_states``: a keyed aggregation holds each run's state; a micro-batch stores the states it changed. The fold is a
  set of maxima, so replays, late rows and the split into batches change nothing. ``stored_events`` keeps the log itself.
* J5 ``decision_states``: a keyed aggregation holds each case's newest decision. A micro-batch stores the cases whose
  decision changed and how that moves the tally of their runs: plus the new decision, minus the one before. A tally is
  the sum of these moves; neither the log nor the cases of a run are read again.

State is in RocksDB (``state_session``), with a changelog in the checkpoint folder, and never expires. Every store has a folder for
each micro-batch, which a replay overwrites.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import load
from ..operators.review import DECISION_KEY, latest_decisions
from ..operators.rules import evaluate
from ..operators.runs import distinct_events, run_state
from ..plans.catalog import RUNS_SQL, _flat, query, run_events
from ..session import scratch_path


def read_ruleset(spark: SparkSession, path: str) -> dict:
    """The ruleset JSON at ``path`` (any Hadoop file system), read through Spark."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    return json.loads("".join(lines))


def write_ruleset(spark: SparkSession, doc: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def stream_table(spark: SparkSession, folder: str, glob: str = "*.parquet",
                 max_files: int | None = None) -> DataFrame:
    """Parquet files of ``folder`` matching ``glob`` as a stream (schema from a batch read); a folder of that name gives its files."""
    whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
    if whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(whole):  # the filter sees the names of files only
        folder, glob = f"{folder}/{glob}", "*.parquet"
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(folder)


def write_batch_idempotent(batch: DataFrame, batch_id: int, out: str) -> None:
    """Overwrite exactly this batch's folder (a replay rewrites, never duplicates; no rows clear it)."""
    batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")


def hot_reload_sink(ruleset_path: str, out: str, keep: list[str] | None = None
                    ) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: load the current ruleset, evaluate, write idempotently."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rules = load(read_ruleset(batch.sparkSession, ruleset_path))
        write_batch_idempotent(evaluate(batch, rules, keep=keep), batch_id, out)
    return run


def run_available(stream_df: DataFrame, checkpoint: str, *, out: str | None = None,
                  foreach: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything available now, then stop: into the Parquet folder ``out``, or by ``foreach``."""
    writer = stream_df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(foreach) if foreach is not None else writer.format("parquet").option("path", out).outputMode("append")
    q = writer.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """The lifecycle events of a store, replays dropped."""
    return distinct_events(spark.read.parquet(path))


# The state store: RocksDB with small buffers and a changelog; a store closes when its task has committed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
BUCKETS = 64  # of a store of decisions, by run


def state_session(spark: SparkSession) -> SparkSession:
    """A session for streams with keyed state; the caller's own settings stay as they are."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    for key, value in STATE_CONF.items():
        session.conf.set(key, value)
    return session


def run_keyed(stream_df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process everything available now; ``sink`` gets the keys each micro-batch changed."""
    q = stream_df.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_states(events: DataFrame, checkpoint: str, out: str) -> None:
    """J4: the states of runs that a stream of lifecycle events changes, in ``out/batch_id=N``."""
    run_keyed(run_state(events), checkpoint, lambda batch, n: write_batch_idempotent(batch, n, out))


def current(store: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key in a store of changes (one row a key and batch that changed it)."""
    rest = [c for c in store.columns if c not in (*key, "batch_id")]
    return store.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_n")).select(*key, "_n.*")


def decision_states(decisions: DataFrame, checkpoint: str, out: str) -> None:
    """J5: the cases whose newest decision a stream of decisions changes, in ``out/latest``, and what that does to the
    tallies of their runs, in ``out/moves``."""
    out = out.rstrip("/")

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("bot_id", "run_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        batch.select(*DECISION_KEY, "decision", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/latest/batch_id={n}")
        store = spark.read.schema(LATEST_SCHEMA).option("basePath", f"{out}/latest").parquet(f"{out}/latest")
        touched = [r[0] for r in store.filter(F.col("batch_id") == n).select("bucket").distinct().collect()]  # at most BUCKETS
        mine = store.filter((F.col("batch_id") <= n) & F.col("bucket").isin(touched))  # a replay sees what the first run saw
        now, old = F.col("batch_id") == n, F.when(F.col("batch_id") < n, F.col("batch_id"))
        change = mine.groupBy(*DECISION_KEY).agg(F.max(F.when(now, F.col("decision"))).alias("new"), F.max_by("decision", old).alias("old")) \
            .filter("new is not null")

        def move(kind: str) -> Column:
            return (F.count_if(F.col("new") == kind) - F.count_if(F.col("old") == kind)).alias(kind)

        write_batch_idempotent(change.groupBy("bot_id", "run_id").agg(move("accepted"), move("rejected")), n, f"{out}/moves")

    run_keyed(latest_decisions(decisions), checkpoint, sink)


LATEST_SCHEMA = "bot_id string, run_id string, case_id string, decision string, batch_id int, bucket int"


def stream_tally(cases: DataFrame, moves: DataFrame) -> DataFrame:
    """The tally of every run that has moves: the columns of ``review.tally``."""
    totals = cases.groupBy("bot_id", "run_id").agg(F.count(F.lit(1)).alias("total"))
    counts = moves.groupBy("bot_id", "run_id").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    reviewed = F.col("accepted") + F.col("rejected")
    return totals.join(counts, ["bot_id", "run_id"]).select("bot_id", "run_id", "accepted", "rejected", reviewed.alias("reviewed"), "total",
                                                            (F.col("total") - reviewed).alias("pending"))


# --------------------------------------------------------------- registered streaming queries

STREAM_RULES = {
    "id_field": "event_id",
    "rules": [
        {"rule_id": 60, "score": 0.85, "label": "big_purchase", "conditions": {"criteria": [
            {"field": "event_type", "operator": "eq", "value": "purchase"},
            {"field": "value", "operator": "gt", "value": 300}]}},
        {"rule_id": 61, "score": 0.5, "label": "error_or_tiny", "conditions": {
            "combination": "or", "criteria": [
                {"field": "event_type", "operator": "in", "value": ["error"]},
                {"field": "value", "operator": "lt", "value": 0.5}]}},
    ],
}

STREAM_RULES_SQL = """
SELECT CAST(event_id AS VARCHAR) AS target_id, CAST(60 AS BIGINT) AS rule_id, 'big_purchase' AS label,
       CAST(0.85 AS DOUBLE) AS score, 'high' AS confidence, 'event_type eq purchase; value gt 300' AS evidence,
       '{"rule_id":60}' AS features, '{"event_id":' || event_id || '}' AS subject
FROM events WHERE event_type = 'purchase' AND value > 300
UNION ALL
SELECT CAST(event_id AS VARCHAR), 61, 'error_or_tiny', CAST(0.5 AS DOUBLE), 'medium',
       concat_ws('; ', CASE WHEN event_type IN ('error') THEN 'event_type in [''error'']' END,
                       CASE WHEN value < 0.5 THEN 'value lt 0.5' END),
       '{"rule_id":61}', '{"event_id":' || event_id || '}'
FROM events WHERE event_type IN ('error') OR value < 0.5
"""


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


MAX_FILES = 64  # per micro-batch


@query("stream_rules_events", STREAM_RULES_SQL)
def stream_rules_events(spark: SparkSession, sf: str) -> DataFrame:
    """J1: the batch rule program on a file stream of ``events`` (availableNow, file sink)."""
    base = _fresh(spark, "stream-rules")
    stream = stream_table(spark, sf, "events.parquet", MAX_FILES)
    run_available(_flat(evaluate(stream, STREAM_RULES)), base + "/ckpt", out=base + "/signals")
    return spark.read.parquet(base + "/signals")


@query("stream_rules_hot_reload", STREAM_RULES_SQL)
def stream_rules_hot_reload(spark: SparkSession, sf: str) -> DataFrame:
    """J2 + J3: foreachBatch re-reads the ruleset file and overwrites its batch partition."""
    base = _fresh(spark, "hot-reload")
    rules_file = base + "/ruleset"
    write_ruleset(spark, STREAM_RULES, rules_file)
    out = base + "/signals"
    stream = stream_table(spark, sf, "events.parquet", MAX_FILES)
    run_available(stream, base + "/ckpt", foreach=hot_reload_sink(rules_file, out))
    return _flat(spark.read.parquet(out).drop("batch_id"))


@query("stream_run_state", RUNS_SQL + """
SELECT run_id, bot_id, status, epoch_us(created_at) AS started_us, finished_us FROM r
""")
def stream_run_state(spark: SparkSession, sf: str) -> DataFrame:
    """J4: lifecycle events as a stream into keyed state; the newest state of each run."""
    base = _fresh(spark, "run-states")
    run_states(run_events(spark, sf, stream_table(state_session(spark), sf, "events.parquet", MAX_FILES)), base + "/ckpt", base + "/states")
    st = current(spark.read.parquet(base + "/states"), ["run_id"])
    return st.select("run_id", "bot_id", "status", F.unix_micros("started_at").alias("started_us"),
                     F.unix_micros("finished_at").alias("finished_us"))


@query("stream_review_tally", """
WITH c AS (SELECT 'docs' AS bot_id, 'run_' || source AS run_id, doc_id FROM documents),
d AS (SELECT c.*, CASE WHEN l.toxic = 1 OR l.quality <> 1 THEN 'rejected' ELSE 'accepted' END AS decision
      FROM c JOIN labels l ON c.doc_id = l.doc_id)
SELECT c.bot_id, c.run_id, count(d.decision) FILTER (WHERE d.decision = 'accepted') AS accepted,
       count(d.decision) FILTER (WHERE d.decision = 'rejected') AS rejected,
       count(d.decision) AS reviewed, count(*) AS total, count(*) - count(d.decision) AS pending
FROM c LEFT JOIN d ON c.doc_id = d.doc_id GROUP BY c.bot_id, c.run_id HAVING count(d.decision) > 0
""")
def stream_review_tally(spark: SparkSession, sf: str) -> DataFrame:
    """J5: decisions arrive as a stream, several micro-batches; each moves the tallies of the runs it touches."""
    from ..plans.catalog import decision_log, doc_cases

    base = _fresh(spark, "review-tally")
    cases = doc_cases(spark, sf)
    log = decision_log(spark, sf, cases)
    log.repartition(3).write.parquet(base + "/log")
    stream = state_session(spark).readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(base + "/log")
    decision_states(stream, base + "/ckpt", base)
    return stream_tally(cases, spark.read.parquet(base + "/moves"))
