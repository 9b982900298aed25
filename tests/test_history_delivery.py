"""Run lifecycle and history reads, as-of resolution, delivery tables, conversations."""

import json
import datetime as dt

from pyspark.sql import functions as F

from cuebook.operators import conversations as conv
from cuebook.operators import outbox as ob
from cuebook.operators import runs as rn


def _runs(spark):
    ev = []
    t = dt.datetime(2024, 1, 1)
    for i, (bot, outcome) in enumerate([("a", "completed"), ("a", "completed"), ("a", "failed"),
                                        ("b", "completed"), ("b", None)]):
        start = t + dt.timedelta(hours=i)
        ev.append((f"run_{i}", bot, "run_started", start, "2024-01-01", None, None))
        if outcome:
            kind = "run_completed" if outcome == "completed" else "run_failed"
            err = "ValueError: boom" if outcome == "failed" else None
            ev.append((f"run_{i}", bot, kind, start + dt.timedelta(seconds=90), "2024-01-01", f"s{i}", err))
    df = spark.createDataFrame(ev, "run_id string, bot_id string, type string, ts timestamp, as_of string, "
                                   "summary string, error string")
    return rn.run_state(df)


def test_lifecycle_and_reads(spark):
    runs = _runs(spark)
    st = {r.run_id: (r.status, r.error) for r in runs.collect()}
    assert st == {"run_0": ("completed", ""), "run_1": ("completed", ""), "run_2": ("failed", "ValueError: boom"),
                  "run_3": ("completed", ""), "run_4": ("running", "")}
    assert {r.bot_id: r.run_id for r in rn.latest(runs).collect()} == {"a": "run_1", "b": "run_3"}
    assert [r.run_id for r in rn.history(runs, 2).filter("bot_id = 'a'").orderBy(F.col("created_at").desc()).collect()] \
        == ["run_2", "run_1"]
    assert [r.run_id for r in rn.recent(runs, 3).collect()] == ["run_4", "run_3", "run_2"]
    assert rn.get_run(runs, "b", "run_0").count() == 0 and rn.get_run(runs, "a", "run_0").count() == 1
    d = {r.run_id: r.duration_ms for r in rn.with_duration(runs).collect()}
    assert d["run_0"] == 90000 and d["run_4"] is None


def test_history_plans_a_group_limit(spark):
    runs = _runs(spark)
    plan = rn.history(runs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_resolve_as_of(spark):
    df = spark.createDataFrame([("",), ("D",), ("D-0",), ("today",), ("D-3",), ("2023-05-01",), (None,), ("D-x",)],
                               "s string")
    got = [r.v for r in df.select(rn.resolve_as_of(F.col("s"), dt.date(2024, 3, 2)).alias("v")).collect()]
    assert got == ["2024-03-02"] * 4 + ["2024-02-28", "2023-05-01", "2024-03-02", "D-x"]


def test_url_templates_and_scheme(spark):
    subs = spark.createDataFrame([
        ("s1", "b", "webhook", "https://h/x?t=${WEBHOOK_TOKEN}"),
        ("s2", "b", "webhook", "https://h/x?p=${DB_PASSWORD}"),
        ("s3", "b", "webhook", "https://h/x?u=${WEBHOOK_UNKNOWN}"),
        ("s4", "b", "webhook", "file:///etc/passwd"),
        ("s5", "b", "sse", "https://h/sse"),
        ("s6", "b", "webhook", None)], "id string, bot_id string, type string, url string").withColumn(
        "name", F.lit(None).cast("string"))
    got = {r.id: r.url for r in ob.webhook_targets(subs, {"WEBHOOK_TOKEN": "abc", "PATH": "/bin"}).collect()}
    assert got == {"s1": "https://h/x?t=abc", "s2": "https://h/x?p=${DB_PASSWORD}", "s3": "https://h/x?u="}
    assert ob.template_values({"WEBHOOK_A": "1", "SECRET": "2", "webhook_b": "3"}) == {"WEBHOOK_A": "1"}


def test_effective_webhooks_and_subscription_log(spark):
    sinks = spark.createDataFrame([("b", [("webhook", "https://m"), ("webhook", ""), ("email", "x@y")])],
                                  "bot_id string, sinks array<struct<type:string, url:string>>")
    log = spark.createDataFrame([
        ("register", "s1", "b", "webhook", "https://s1", None, 1), ("register", "s2", "b", "fax", "x", None, 2),
        ("register", "s3", "b", "webhook", "https://s3", None, 3), ("remove", "s3", None, None, None, None, 4),
    ], "op string, id string, bot_id string, type string, url string, name string, ts int")
    live = ob.current_subscriptions(log)
    assert [r.id for r in live.collect()] == ["s1"]
    eff = {(r.id, r.url) for r in ob.effective_webhooks(sinks, live).collect()}
    assert eff == {("manifest", "https://m"), ("s1", "https://s1")}


def test_outbox_chunks_bounded(spark):
    cases = spark.range(0, 2500).select(F.lit("b").alias("bot_id"), F.lit("r").alias("run_id"),
                                        F.col("id").alias("case_index"), F.col("id").cast("string").alias("target_id"))
    runs = spark.createDataFrame([("b", "r", "2024-01-01", "ok", "completed"), ("b", "none", "", "", "completed"), ("b", "broke", "", "", "failed")],
                                 "bot_id string, run_id string, as_of string, summary string, status string")
    box = ob.outbox(cases, runs, chunk_rows=1000).orderBy("run_id", "chunk").collect()
    assert [(r.run_id, r.n_records) for r in box] == [("none", 0), ("r", 1000), ("r", 1000), ("r", 500)]
    bodies = [json.loads(r.payload) for r in box]
    assert bodies[0]["data"] == [] and bodies[1]["summary"] == "ok" and bodies[1]["metadata"] == {}
    assert [x["case_index"] for b in bodies[1:] for x in b["data"]] == list(range(2500))


def test_url_values_are_expanded_once(spark):
    df = spark.createDataFrame([("http://h/${WEBHOOK_A}/${WEBHOOK_Z}${DB}",), ("plain",), (None,), ("${WEBHOOK_A}",)], "u string")
    got = [r.e for r in df.select(ob.expand_url(F.col("u"), {"WEBHOOK_A": "<${WEBHOOK_B}>", "WEBHOOK_B": "secret"}).alias("e")).collect()]
    assert got == ["http://h/<${WEBHOOK_B}>/${DB}", "plain", None, "<${WEBHOOK_B}>"]


def test_recent_has_no_cap(spark):
    runs = spark.range(500).selectExpr("'b' AS bot_id", "cast(id AS string) AS run_id", "timestamp_seconds(id) AS created_at")
    assert rn.recent(runs, 400).count() == 400


def test_conversations(spark):
    t = dt.datetime(2024, 1, 1)
    existing = spark.createDataFrame([("c1", 1, "system", "s", t), ("c1", 2, "user", "hi", t)],
                                     "conversation_id string, seq long, role string, text string, created_at timestamp")
    new = spark.createDataFrame([("c1", 10, "assistant", "yo", t + dt.timedelta(1)),
                                 ("c1", 11, "user", "ok", t + dt.timedelta(2)),
                                 ("c2", 12, "user", "new", t + dt.timedelta(3))],
                                "conversation_id string, id long, role string, text string, created_at timestamp")
    added = conv.append_seq(existing, new)
    assert sorted((r.conversation_id, r.text, r.seq) for r in added.collect()) == \
        [("c1", "ok", 4), ("c1", "yo", 3), ("c2", "new", 1)]
    table = existing.unionByName(added.drop("id"))
    assert [r.text for r in conv.messages(table).collect()] == ["hi", "yo", "ok", "new"]
    assert [r.conversation_id for r in conv.conversations(table).collect()] == ["c2", "c1"]


def test_as_of_filter_and_decision_reads(spark):
    from cuebook.operators.review import decisions_for

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 59),), (dt.datetime(2024, 1, 2, 0, 0),)], "ts timestamp")
    assert rn.as_of_filter(df, "ts", "2024-01-01").count() == 1
    dec = spark.createDataFrame([("b", "r", "0", "accepted"), ("b", "r", "1", "rejected"), ("b", "x", "0", "accepted")],
                                "bot_id string, run_id string, case_id string, decision string")
    assert decisions_for(dec, "b", "r").count() == 2
    assert [r.decision for r in decisions_for(dec, "b", "r", "1").collect()] == ["rejected"]


def test_frame_logic_field(spark):
    from cuebook.operators.signals import frame, to_signals

    sig = to_signals(spark.createDataFrame([("a", 0.9)], "id string, s double"), F.col("id"), "x", score=F.col("s"))
    meta = frame(sig, "x", logic={"rule": "total >= 75"}).metadata.first()
    assert meta.logic == '{"rule": "total >= 75"}'
