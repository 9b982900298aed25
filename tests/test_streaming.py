"""Structured Streaming: rules on a file stream, hot reload + idempotent batches, lifecycle
dedupe, per-batch tally recompute."""

import datetime as dt
import uuid

import pytest

from cuebook.operators.rules import evaluate
from cuebook.session import scratch_path
from cuebook.streaming import rules_stream as rs

SF = "/root/testdata/sf0.001"


def _dir(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def test_stream_matches_batch(spark):
    batch = evaluate(spark.read.parquet(f"{SF}/events.parquet"), rs.STREAM_RULES)
    stream = rs.stream_rules_events(spark, SF)
    assert sorted(r.target_id + str(r.rule_id) for r in stream.collect()) == \
        sorted(r.target_id + str(r.rule_id) for r in batch.collect())


def test_hot_reload_reads_ruleset_each_batch_and_replay_is_idempotent(spark, tmp_path):
    base = _dir(spark, "reload")
    src = str(tmp_path / "in")
    spark.range(0, 10).selectExpr("id", "id * 10 AS v").write.parquet(src + "/a")
    rules_path = base + "/rules"
    rs.write_ruleset(spark, {"id_field": "id", "rules": [{"rule_id": 1, "conditions": {"criteria": [
        {"field": "v", "operator": "gt", "value": 50}]}}]}, rules_path)
    out = base + "/out"
    stream = spark.readStream.schema("id long, v long").parquet(src + "/*")
    rs.run_available(stream, base + "/ckpt", foreach=rs.hot_reload_sink(rules_path, out))
    assert spark.read.parquet(out).count() == 4
    rs.write_ruleset(spark, {"id_field": "id", "rules": [{"rule_id": 2, "conditions": {"criteria": [
        {"field": "v", "operator": "lt", "value": 20}]}}]}, rules_path)
    spark.range(10, 20).selectExpr("id", "(id - 10) * 10 AS v").write.parquet(src + "/b")
    rs.run_available(spark.readStream.schema("id long, v long").parquet(src + "/*"), base + "/ckpt",
                     foreach=rs.hot_reload_sink(rules_path, out))
    got = spark.read.parquet(out)
    assert sorted((r.rule_id, r.target_id) for r in got.collect()) == \
        [(1, str(i)) for i in (6, 7, 8, 9)] + [(2, "10"), (2, "11")]
    # replaying batch 0 rewrites its partition instead of appending duplicates
    rs.write_batch_idempotent(evaluate(spark.read.parquet(src + "/a"), {"id_field": "id", "rules": [
        {"rule_id": 1, "conditions": {"criteria": [{"field": "v", "operator": "gt", "value": 50}]}}]}), 0, out)
    assert spark.read.parquet(out).count() == 6
    # and one that finds nothing any more empties it
    rs.write_batch_idempotent(got.filter("false").drop("batch_id"), 0, out)
    assert sorted(r.target_id for r in spark.read.parquet(out).collect()) == ["10", "11"]


@pytest.mark.parametrize("newest_first, per_batch", [(False, 1), (True, 1), (True, 100)])
def test_stored_events_do_not_depend_on_the_split(spark, tmp_path, newest_first, per_batch):
    """Late events stay, replays drop out, progress rows are told apart, in any order and batch size."""
    schema, t = "run_id string, bot_id string, type string, ts timestamp, stage string", dt.datetime(2024, 1, 1)
    rows = [(f"r{i}", "b", "run_started", t + dt.timedelta(hours=i), "") for i in range(6)]
    rows += [("r0", "b", "run_progress", t + dt.timedelta(minutes=1), f"s{k}") for k in range(5)] + rows[:3]
    for n, row in enumerate(reversed(rows) if newest_first else rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
    rs.run_available(stream, _dir(spark, "lc"), out=str(tmp_path / "store"))
    assert rs.stored_events(spark, str(tmp_path / "store")).count() == 11


RUN_EVENTS = "run_id string, bot_id string, type string, ts timestamp, as_of string, stage string, summary string, error string"


@pytest.mark.parametrize("per_batch", [1, 3, 100])
def test_run_states_equal_the_fold_of_the_log(spark, tmp_path, per_batch):
    """Small batches, late rows (a start after its end) and replays: the state a batch job gives."""
    t, rows = dt.datetime(2024, 1, 1), []
    for i in range(4):
        rows.append((f"r{i}", "b", "run_completed" if i % 2 else "run_failed", t + dt.timedelta(hours=i, minutes=5), None, None, f"s{i}", "" if i % 2 else "boom"))
        rows.append((f"r{i}", "b", "run_started", t + dt.timedelta(hours=i), "2024-01-01", None, "", ""))
        rows.append((f"r{i}", "b", "run_progress", t + dt.timedelta(hours=i, minutes=1), None, "x", "", ""))
    rows += rows[:4]
    for row in rows:
        spark.createDataFrame([row], RUN_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rs.state_session(spark).readStream.schema(RUN_EVENTS).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
    base = _dir(spark, "states")
    rs.run_states(stream, base + "/ckpt", base + "/out")
    from cuebook.operators.runs import run_state

    want = run_state(spark.createDataFrame(rows, RUN_EVENTS))
    got = rs.current(spark.read.parquet(base + "/out"), ["run_id"]).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


DECISIONS = "bot_id string, run_id string, case_id string, decision string, note string, reviewer string, updated_at timestamp"


def test_tallies_follow_changes_of_mind(spark, tmp_path):
    """Decisions change, come late and twice, over many batches and a restart; every batch leaves the batch job's tally."""
    import random

    from cuebook.operators.review import latest_decisions, tally

    rng, t = random.Random(4), dt.datetime(2024, 1, 1)
    cases = spark.createDataFrame([("b", f"r{k % 3}", str(k)) for k in range(12)], "bot_id string, run_id string, case_id string")
    rows = []
    for i in range(10):
        k = rng.randrange(12)
        rows.append(("b", f"r{k % 3}", str(k), rng.choice(["accepted", "rejected", "pending", "nonsense"]), "", "", t + dt.timedelta(minutes=rng.randrange(500))))
    rows.append(rows[0])
    base, src = _dir(spark, "tally"), str(tmp_path / "in")
    for half in (rows[:6], rows[6:]):
        for row in half:
            spark.createDataFrame([row], DECISIONS).coalesce(1).write.mode("append").parquet(src)
        stream = rs.state_session(spark).readStream.schema(DECISIONS).option("maxFilesPerTrigger", 2).parquet(src)
        rs.decision_states(stream, base + "/ckpt", base)
        seen = spark.read.parquet(src)
        want = {r.run_id: r for r in tally(cases, latest_decisions(seen)).collect()}
        got = rs.stream_tally(cases, spark.read.parquet(base + "/moves")).collect()
        assert got and all(r == want[r.run_id] for r in got)
        assert {r.run_id for r in want.values() if r.reviewed} <= {r.run_id for r in got}
    # a replayed batch moves nothing twice
    moves = sorted(map(tuple, spark.read.parquet(base + "/moves").collect()))
    last = max(m[-1] for m in moves)
    again = spark.read.parquet(f"{base}/latest").filter(f"batch_id = {last}").selectExpr("bot_id", "run_id", "case_id", "decision")
    kept = {}
    orig = rs.run_keyed
    rs.run_keyed = lambda df, ckpt, sink: kept.update(sink=sink)
    try:
        rs.decision_states(spark.createDataFrame([], DECISIONS), "", base)
    finally:
        rs.run_keyed = orig
    kept["sink"](spark.createDataFrame(again.collect(), again.schema), last)
    assert sorted(map(tuple, spark.read.parquet(base + "/moves").collect())) == moves


def test_a_table_of_several_files_streams(spark):
    """A large table is a folder of part files under the table's name."""
    from cuebook.plans.catalog import all_queries

    sf = _dir(spark, "parts")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{sf}/events.parquet")
    for name in ("stream_rules_events", "stream_rules_hot_reload", "stream_run_state"):
        run = all_queries()[name]
        got, want = run(spark, sf).collect(), run(spark, SF).collect()
        assert want and sorted(map(str, got)) == sorted(map(str, want)), name
