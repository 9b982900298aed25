"""Ruleset runs with bookkeeping, ruleset versions, sinks and JSON-safe output, sources."""

import datetime as dt
import decimal
import json
import uuid

import pytest
from pyspark.sql import functions as F

from cuebook.model import RulesetError
from cuebook.operators import bots
from cuebook.operators.runs import bot_overview, run_state
from cuebook.session import scratch_path
from cuebook.sources.catalog import list_tables, table_schema
from cuebook.sources.governed import GovernedSource
from cuebook.sources.open import jdbc_options, open_source
from cuebook.sources.sinks import json_safe, replace_run, to_json_rows, write_output, write_signals

SF = "/root/testdata/sf0.001"
RULES = {"id_field": "o_orderkey", "source_table": "orders", "rules": [
    {"rule_id": 1, "score": 0.8, "conditions": {"criteria": [{"field": "o_totalprice", "operator": "gt",
                                                               "value": 400000}]}}]}


def _d(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def test_run_bot_records_lifecycle_and_cases(spark):
    src = GovernedSource.open(spark, {"orders": f"parquet:{SF}/orders.parquet"})
    events, sigs = _d(spark, "events"), _d(spark, "signals")
    run_id = bots.run_bot(spark, "orders_bot", RULES, src, ["orders"], events_path=events, signals_path=sigs,
                          as_of="2024-01-31")
    state = run_state(spark.read.parquet(events)).first()
    assert (state.run_id, state.status, state.bot_id) == (run_id, "completed", "orders_bot")
    stored = spark.read.parquet(sigs).filter(F.col("run_id") == run_id)
    n = spark.read.parquet(f"{SF}/orders.parquet").filter("o_totalprice > 400000").count()
    assert stored.count() == n
    assert sorted(r.case_index for r in stored.collect()) == list(range(n))
    # a ruleset reading outside the scope fails, and the failure is recorded
    bad = dict(RULES, source_table="customer")
    with pytest.raises(PermissionError):
        bots.run_bot(spark, "orders_bot", bad, src, ["orders"], events_path=events, signals_path=sigs)
    st = {r.status: r.error for r in run_state(spark.read.parquet(events)).collect()}
    assert st["failed"].startswith("ScopeViolation:")
    with pytest.raises(ValueError):
        bots.run_bot(spark, "x", RULES, src, [], events_path=events, signals_path=sigs)


def test_run_ruleset_reads_path_and_rejects_invalid(spark):
    path = _d(spark, "ruleset")
    spark.createDataFrame([(json.dumps(RULES),)], "value string").coalesce(1).write.text(path)
    src = GovernedSource.open(spark, {"orders": f"parquet:{SF}/orders.parquet"})
    res = bots.run_ruleset(spark, path, src.scoped(["orders"]))
    assert res.rules_total == 1 and res.unsupported == []
    assert res.framed.metadata.first().rules_total == 1
    with pytest.raises(RulesetError):
        bots.run_ruleset(spark, {"rules": [{"rule_id": 1}, {"rule_id": 1}]}, src)
    with pytest.raises(RulesetError):
        bots.run_ruleset(spark, {"rules": []}, src)


def test_versions_propose_approve(spark):
    t = dt.datetime(2024, 1, 1)
    base = dict(RULES, task="t")
    versions = spark.createDataFrame([("b", 1, "approved", json.dumps(base), "ann", t)], bots.VERSIONS_SCHEMA)
    staged = bots.propose(spark, versions, "b", {"source_table": "secret", "task": "new",
                                                  "rules": [{"rule_id": 7}]})
    row = staged.first()
    assert row.version == 2 and row.status == "staged"
    assert json.loads(row.ruleset)["source_table"] == "orders"
    versions = versions.unionByName(staged)
    # a second proposal takes the place of the pending one
    versions = versions.unionByName(bots.propose(spark, versions, "b", {"task": "new", "rules": [{"rule_id": 8}]}))
    pending = bots.pending_proposals(versions).collect()
    assert [(p.version, json.loads(p.ruleset)["rules"]) for p in pending] == [(2, [{"rule_id": 8}])]
    versions = versions.unionByName(bots.decide_proposal(spark, versions, "b", approve=True, reviewer="bob"))
    live = bots.live_rulesets(versions).first()
    assert live.version == 2 and json.loads(live.ruleset)["task"] == "new"
    assert bots.pending_proposals(versions).count() == 0
    assert {(r.version, r.status) for r in bots.version_history(versions).collect()} == {(1, "approved"),
                                                                                         (2, "approved")}
    with pytest.raises(RulesetError):
        bots.propose(spark, versions, "b", {"rules": [{"rule_id": 1}, {"rule_id": 1}]})


def test_json_safe_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), decimal.Decimal("1.50"),
                                 [dt.date(2024, 1, 3)], None)],
                               "d date, ts timestamp, m decimal(10,2), ds array<date>, n string")
    rec = json.loads(to_json_rows(df).first().record)
    assert rec == {"d": "2024-01-02", "ts": "2024-01-02T03:04:05", "m": 1.5, "ds": ["2024-01-03"], "n": None}
    assert dict(json_safe(df).dtypes)["m"] == "double"
    write_output(df, str(tmp_path / "j"), "json")
    write_output(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first().ds == '["2024-01-03"]'
    with pytest.raises(ValueError):
        write_output(df, str(tmp_path / "x"), "xml")


def test_signal_sink_replace_run(spark, tmp_path):
    out = str(tmp_path / "sig")
    rows = spark.createDataFrame([("b", "r1", "t1"), ("b", "r1", "t2"), ("b", "r2", "t3")],
                                 "bot_id string, run_id string, target_id string")
    write_signals(rows, out)
    replace_run(rows.filter("run_id = 'r1'").limit(1), out, "b", "r1")
    got = sorted((r.run_id, r.target_id) for r in spark.read.parquet(out).collect())
    assert [g[0] for g in got] == ["r1", "r2"]
    replace_run(rows.filter("false"), out, "b", "r1")  # a retry that finds nothing leaves nothing
    spark.catalog.refreshByPath(out)
    assert [r.run_id for r in spark.read.parquet(out).collect()] == ["r2"]


def test_run_bot_leaves_a_trace_when_it_dies(spark):
    """The start is stored before the work; a transform gets the resolved day."""
    events, sigs, seen = _d(spark, "events"), _d(spark, "signals"), {}
    src = GovernedSource.open(spark, {"orders": f"parquet:{SF}/orders.parquet"})

    def work(spark, source, as_of):
        seen["as_of"] = as_of
        seen["types"] = [r.type for r in spark.read.parquet(events).collect()]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        bots.run_bot(spark, "b", work, src, ["orders"], events_path=events, signals_path=sigs, as_of="D-2", ref_date=dt.date(2024, 3, 1))
    assert seen == {"as_of": "2024-02-28", "types": ["run_started"]}
    stored = spark.read.parquet(events)
    assert sorted(r.type for r in stored.collect()) == ["run_failed", "run_started"]
    assert run_state(stored).first().error == "RuntimeError: lost"
    unknown = stored.limit(1).withColumn("type", F.lit("run_paused")).withColumn("ts", F.expr("ts + interval 1 day"))
    assert run_state(stored.unionByName(unknown)).first().status == "failed"


def test_sources_and_catalog(spark, tmp_path):
    assert open_source(spark, f"parquet:{SF}/region.parquet").count() == 5
    assert open_source(spark, f"{SF}/region.parquet").count() == 5
    spark.range(3).write.csv(str(tmp_path / "c.csv"))
    assert open_source(spark, "csv:" + str(tmp_path / "c.csv"), header="false").count() == 3
    with pytest.raises(ValueError):
        open_source(spark, "mongodb://x/y")
    opts = jdbc_options("jdbc:postgresql://h/db", "t", read_only_statement="SET default_transaction_read_only = on",
                        partition_column="id", lower_bound=0, upper_bound=100, num_partitions=4)
    assert opts["numPartitions"] == "4" and "read_only" in opts["sessionInitStatement"]
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id")
    open_source(spark, f"parquet:{SF}/nation.parquet").createOrReplaceTempView("nation_v")
    assert "nation_v" in {r.name for r in list_tables(spark).collect()}
    sch = table_schema(spark, {"nation": open_source(spark, f"parquet:{SF}/nation.parquet")}).collect()
    assert [(r.ordinal, r.column) for r in sch] == [(0, "n_nationkey"), (1, "n_name"), (2, "n_regionkey")]


def test_bot_overview(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([("b", f"r{i}", t + dt.timedelta(hours=i), "completed") for i in range(12)],
                                 "bot_id string, run_id string, created_at timestamp, status string")
    bots_df = spark.createDataFrame([("b", "Bot B"), ("c", "Bot C")], "bot_id string, name string")
    ov = bot_overview(bots_df, runs, last=10)
    assert ov.filter("bot_id = 'b'").count() == 10 and ov.filter("bot_id = 'c'").count() == 1
