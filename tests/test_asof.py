"""As-of join against a plain loop: hot keys, ties, nulls, empty sides, ranges that cut a key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cuebook.operators.bots import live_when
from cuebook.operators.review import decided_when
from cuebook.plans.asof import as_of_join

ROWS = "id long, k string, at timestamp, tags map<string,string>"
FACTS = "k string, since timestamp, v long, w string"
T0 = dt.datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + dt.timedelta(seconds=n)


def expected(rows, facts):
    out = {}
    for i, k, t, _ in rows:
        best = None
        for fk, since, v, w in facts:
            if None in (k, t, since) or fk != k or since > t:
                continue
            key = (since, v is not None, v or 0, w is not None, w or "")
            if best is None or key > best[0]:
                best = (key, v, w)
        out[i] = best[1:] if best else (None, None)
    return out


@pytest.mark.parametrize("seed,partitions", [(1, 8), (2, 8), (3, 3), (4, 1)])
def test_random(spark, seed, partitions):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c d", None, "never"]
    rows = [(i, rng.choice(keys), at(rng.choice([None, *range(60)])), {"x": "y"}) for i in range(400)]
    facts = [(rng.choice(["hot", "hot", "a", "b", "c d", None]), at(rng.choice([None, *range(60)])), rng.choice([None, 1, 2, 3]),
              rng.choice([None, "p", "q"])) for _ in range(int(90))]
    left, right = spark.createDataFrame(rows, ROWS), spark.createDataFrame(facts, FACTS)
    got = as_of_join(left, right, ["k"], "at", "since", {"v": "v", "w": "fact w"}, partitions=partitions)
    assert got.columns == ["id", "k", "at", "tags", "v", "fact w"]
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.id: (r.v, r["fact w"]) for r in found} == expected(rows, facts)


def test_a_fact_carried_over_empty_ranges(spark):
    """One old fact, then thousands of rows over all ranges: each range but the first gets it from an earlier one."""
    left = spark.range(4000).select(F.col("id"), F.lit("k").alias("k"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).alias("at"))
    right = spark.createDataFrame([("k", at(10), 7)], "k string, since timestamp, v long")
    got = as_of_join(left, right, ["k"], "at", "since", {"v": "v"}, partitions=8)
    assert got.filter("v = 7").count() == 3990 and got.filter("v is null").count() == 10


def test_rows_of_one_moment_span_ranges(spark):
    left = spark.range(2000).select("id", F.lit("k").alias("k"), F.lit(at(5)).alias("at"))
    right = spark.createDataFrame([("k", at(5), 7), ("k", at(5), 9), ("k", at(6), 11)], "k string, since timestamp, v long")
    got = as_of_join(left, right, ["k"], "at", "since", {"v": "v"}, partitions=8)
    assert got.filter("v = 9").count() == 2000
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_empty_sides_and_clashes(spark):
    rows, facts = spark.createDataFrame([(1, "k", at(1), None)], ROWS), spark.createDataFrame([("k", at(0), 1, "w")], FACTS)
    none = as_of_join(rows, facts.limit(0), ["k"], "at", "since", {"v": "v"}).collect()
    assert [(r.id, r.v) for r in none] == [(1, None)]
    assert as_of_join(rows.limit(0), facts, ["k"], "at", "since", {"v": "v"}).count() == 0
    with pytest.raises(ValueError, match="already there"):
        as_of_join(rows, facts, ["k"], "at", "since", {"v": "id"})


def test_plan_has_no_hot_step(spark):
    rows, facts = spark.createDataFrame([(1, "k", at(1), None)], ROWS), spark.createDataFrame([("k", at(0), 1, "w")], FACTS)
    p = as_of_join(rows, facts, ["k"], "at", "since", {"v": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in p and "Cartesian" not in p and "NestedLoop" not in p
    assert "Exchange hashpartitioning(_cue_pid" in p  # rows go by range and key, never by key alone


def test_live_version_when_a_run_started(spark):
    log = [("b", 1, "staged", "r1", "ann", at(0)), ("b", 1, "approved", "r1", "ann", at(10)), ("b", 2, "approved", "r2", "ann", at(20)),
           ("b", 3, "discarded", "r3", "ann", at(30)), ("c", 1, "approved", "c1", "ann", at(5))]
    versions = spark.createDataFrame(log, "bot_id string, version long, status string, ruleset string, reviewer string, ts timestamp")
    runs = spark.createDataFrame([("r9", "b", at(9)), ("r10", "b", at(10)), ("r40", "b", at(40)), ("rc", "c", at(40)), ("rn", "c", None)],
                                 "run_id string, bot_id string, started_at timestamp")
    assert {r.run_id: (r.ruleset_version, r.ruleset) for r in live_when(runs, versions).collect()} == {
        "r9": (None, None), "r10": (1, "r1"), "r40": (2, "r2"), "rc": (1, "c1"), "rn": (None, None)}


def test_decision_when_a_case_was_seen(spark):
    log = spark.createDataFrame([("b", "r", "0", "accepted", "n", "ann", at(10)), ("b", "r", "0", "maybe", "", "ann", at(20)),
                                 ("b", "r", "0", "rejected", "", "bob", at(30))],
                                "bot_id string, run_id string, case_id string, decision string, note string, reviewer string, updated_at timestamp")
    looks = spark.createDataFrame([("b", "r", "0", at(t)) for t in (5, 10, 25, 30)] + [("b", "r", "1", at(50))],
                                  "bot_id string, run_id string, case_id string, seen timestamp")
    got = decided_when(looks, log, "seen").orderBy("case_id", "seen").collect()
    assert [(r.decision, r.review_note, r.reviewer) for r in got] == [
        ("pending", "", ""), ("accepted", "n", "ann"), ("accepted", "n", "ann"), ("rejected", "", "bob"), ("pending", "", "")]
