"""Signals, predictions, framing, contract; review cases, decisions, tally, tuning; ordered
index and running totals against brute force (including one hot group)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuebook.operators import review as rv
from cuebook.operators.signals import NOTE, check_contract, frame, to_predictions, to_signals
from cuebook.plans.ordered import ordered_index, running_totals


def test_frame_threshold_sort_and_metadata(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.3), ("c", 0.6)], "id string, s double")
    sig = to_signals(df, F.col("id"), "lead", score=F.col("s"))
    fr = frame(sig, "lead", threshold=0.5, as_of="2024-01-01")
    assert [r.target_id for r in fr.data.collect()] == ["a", "c"]
    m = fr.metadata.first()
    assert (m.cohort_size, m.flagged, m.kind, m.threshold) == (3, 2, "signal", 0.5)
    assert m.summary == f"lead: 2 signal(s) (as of 2024-01-01; {NOTE})"
    none = frame(sig, "lead").metadata.first()
    assert none.threshold is None and "as of n/a" in none.summary


def test_prediction_clamp_and_band(spark):
    df = spark.createDataFrame([("h", 1.5), ("l", -0.2), ("x", 0.9), ("y", 0.3)], "id string, p double")
    preds = to_predictions(df, F.col("id"), F.col("p"))
    got = {r.target_id: (r.score, r.confidence) for r in preds.collect()}
    assert got == {"h": (1.0, "high"), "l": (0.0, "low"), "x": (0.9, "high"), "y": (0.3, "low")}
    fr = frame(preds, "p", threshold=0.5, kind="prediction")
    assert [r.target_id for r in fr.data.collect()] == ["h", "x"]
    assert "prediction(s)" in fr.metadata.first().summary
    bad = spark.createDataFrame([("z", None)], "id string, p double")
    with pytest.raises(Exception):
        to_predictions(bad, F.col("id"), F.col("p")).collect()


def test_signal_without_score_and_contract(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.42)], "id string, s double")
    sig = to_signals(df, F.col("id"), "x", score=F.col("s"), subject=F.struct(F.col("id").alias("k")))
    got = {r.target_id: (r.score, r.confidence, r.subject) for r in sig.collect()}
    assert got == {"a": (None, "", '{"k":"a"}'), "b": (0.42, "medium", '{"k":"b"}')}
    c = check_contract(sig).first()
    assert c.ok and c.records == 2
    broken = sig.withColumn("note", F.lit("verdict")).withColumn("score", F.lit(2.0))
    c2 = check_contract(broken).first()
    assert not c2.ok and c2.bad_note == 2 and c2.bad_score == 2


def test_ordered_index_matches_row_number_with_hot_group(spark):
    hot = spark.range(0, 3000).select(F.lit("hot").alias("g"), (F.col("id") * 7 % 1000).alias("k"), "id")
    cold = spark.range(0, 500).select(F.concat(F.lit("g"), (F.col("id") % 37).cast("string")).alias("g"),
                                      (F.col("id") % 11).alias("k"), "id")
    df = hot.unionByName(cold)
    got = ordered_index(df, ["g"], [F.col("k").desc(), F.col("id")], partitions=7)
    w = Window.partitionBy("g").orderBy(F.col("k").desc(), F.col("id"))
    want = df.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    assert sorted(got.select("g", "id", "idx").collect()) == sorted(want.select("g", "id", "idx").collect())
    # the hot group really is spread over several partitions
    ranged = df.repartitionByRange(7, "g", F.col("k").desc(), "id").withColumn("p", F.spark_partition_id())
    assert ranged.filter("g = 'hot'").select("p").distinct().count() > 1


def test_running_totals_with_grand_total(spark):
    df = spark.createDataFrame([(float(s), n, a) for s, n, a in
                                [(0.9, 3, 2), (0.8, 1, 1), (0.5, 4, 0), (0.3, 2, 1), (0.1, 5, 5)]],
                               "score double, n long, acc long")
    out = running_totals(df, [F.col("score").desc()], {"n": "cn", "acc": "ca"}, totals={"acc": "tot"},
                         partitions=3)
    got = sorted((r.score, r.cn, r.ca, r.tot) for r in out.collect())
    assert got == [(0.1, 15, 9, 9), (0.3, 10, 4, 9), (0.5, 8, 3, 9), (0.8, 4, 3, 9), (0.9, 3, 2, 9)]


def _cases(spark):
    sig = spark.createDataFrame([("b1", "r1", "t1", 0.9), ("b1", "r1", "t2", 0.8), ("b1", "r1", "t3", 0.3)],
                                "bot_id string, run_id string, target string, s double")
    sig = to_signals(sig, F.col("target"), "x", score=F.col("s"), keep=["bot_id", "run_id"])
    return rv.build_cases(sig)


def test_cases_tally_and_case_list(spark):
    cases = _cases(spark)
    assert sorted((r.target_id, r.case_id) for r in cases.collect()) == [("t1", "0"), ("t2", "1"), ("t3", "2")]
    log = spark.createDataFrame([
        ("b1", "r1", "0", "accepted", "", "ann", "2024-01-01 10:00:00"),
        ("b1", "r1", "1", "pending", "", "ann", "2024-01-01 10:00:00"),
        ("b1", "r1", "1", "rejected", "no", "bob", "2024-01-01 11:00:00"),
        ("b1", "r1", "2", "bogus", "", "x", "2024-01-01 12:00:00"),
        ("b1", "r9", "0", "accepted", "", "x", "2024-01-01 12:00:00"),
    ], "bot_id string, run_id string, case_id string, decision string, note string, reviewer string, "
       "updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    latest = rv.latest_decisions(log)
    t = rv.tally(cases, latest).first()
    assert (t.accepted, t.rejected, t.reviewed, t.total, t.pending) == (1, 1, 2, 3, 1)
    lst = {r.case_id: (r.decision, r.review_note, r.reviewer) for r in rv.case_list(cases, latest).collect()}
    assert lst == {"0": ("accepted", "", "ann"), "1": ("rejected", "no", "bob"), "2": ("pending", "", "")}
    assert rv.split_decisions(log)[1].count() == 1
    assert [r.run_id for r in rv.unknown_case_decisions(latest, cases).collect()] == ["r9"]


def test_tuning_recommends_best_f1(spark):
    labels = spark.createDataFrame([(0.9, True), (0.8, True), (0.3, False)], "score double, accepted boolean")
    pts = {r.threshold: r for r in rv.threshold_sweep(labels, partitions=2).collect()}
    assert (pts[0.8].tp, pts[0.8].fp, pts[0.8].fn, pts[0.8].f1) == (2, 0, 0, 1.0)
    assert (pts[0.9].precision, pts[0.9].recall) == (1.0, 0.5)
    assert (pts[0.3].flagged, pts[0.3].precision) == (3, 0.6667)
    best = rv.recommend(rv.threshold_sweep(labels)).first()
    assert (best.threshold, best.f1) == (0.8, 1.0)
    h = rv.tuning_header(labels.unionByName(spark.createDataFrame([(None, False)], "score double, accepted boolean")))
    assert tuple(h.first()) == (4, 2, 2, 1)


def test_tuning_with_no_scores_is_empty(spark):
    labels = spark.createDataFrame([(None, True)], "score double, accepted boolean")
    assert rv.threshold_sweep(labels).count() == 0
    assert rv.recommend(rv.threshold_sweep(labels)).count() == 0


def test_collect_labels_uses_newest_runs_any_status(spark):
    runs = spark.createDataFrame([("b1", "r1", "2024-01-01", "completed"), ("b1", "r2", "2024-01-02", "failed")],
                                 "bot_id string, run_id string, created_at string, status string")
    runs = runs.withColumn("created_at", F.to_timestamp("created_at"))
    cases = _cases(spark)
    log = spark.createDataFrame([("b1", "r1", "0", "accepted", "", "", "2024-01-01 10:00:00"),
                                 ("b1", "r1", "2", "pending", "", "", "2024-01-01 10:00:00")],
                                "bot_id string, run_id string, case_id string, decision string, note string, "
                                "reviewer string, updated_at string")
    labels = rv.collect_labels(runs, cases, log, limit=1)
    assert labels.count() == 0  # newest run (failed, no data) only
    labels = rv.collect_labels(runs, cases, log, limit=50)
    assert [(r.case_id, r.accepted) for r in labels.collect()] == [("0", True)]


def test_sweep_per_bot_matches_single_bot_sweeps(spark):
    import random

    rnd = random.Random(3)
    rows = [("hot", round(rnd.random(), 2), rnd.random() < 0.6) for _ in range(400)]
    rows += [(f"b{k}", round(rnd.random(), 1), rnd.random() < 0.5) for k in range(5) for _ in range(30)]
    labels = spark.createDataFrame(rows, "bot_id string, score double, accepted boolean")
    both = {(r.bot_id, r.threshold): tuple(r)[2:] for r in
            rv.threshold_sweep(labels, partitions=5, by=["bot_id"]).collect()}
    for bot in ["hot", "b0", "b3"]:
        single = {(bot, r.threshold): tuple(r)[1:] for r in
                  rv.threshold_sweep(labels.filter(F.col("bot_id") == bot), partitions=3).collect()}
        assert single == {k: v for k, v in both.items() if k[0] == bot}
    best = {r.bot_id: (r.threshold, r.f1) for r in rv.recommend(
        rv.threshold_sweep(labels, by=["bot_id"]), by=["bot_id"]).collect()}
    one = rv.recommend(rv.threshold_sweep(labels.filter("bot_id = 'hot'"))).first()
    assert best["hot"] == (one.threshold, one.f1) and len(best) == 6


def test_ordered_index_null_group_and_broadcast_offsets(spark):
    df = spark.range(0, 2000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("g")).alias("g"),
                                     "id")
    got = ordered_index(df, ["g"], ["id"], partitions=6)
    assert got.count() == 2000
    w = Window.partitionBy("g").orderBy("id")
    want = df.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    assert sorted(got.select("g", "id", "idx").collect(), key=str) == sorted(want.collect(), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "SortMergeJoin" not in plan


def test_running_totals_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 0.5, 2), ("a", 1.0, 5)], "g string, s double, n long")
    out = running_totals(df, [F.col("s").desc()], {"n": "c"}, totals={"n": "t"}, partitions=2, group=["g"])
    assert sorted((r.g or "", r.s, r.c, r.t) for r in out.collect()) == [("", 0.5, 3, 3), ("", 1.0, 1, 3),
                                                                       ("a", 1.0, 5, 5)]


@pytest.mark.parametrize("seed", range(3))
def test_ordered_index_random_shapes(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = []
    for g in range(rnd.randint(1, 12)):
        size = rnd.choice([1, 2, 5, 50, 400])
        rows += [(f"g{g}" if rnd.random() > 0.1 else None, rnd.randint(0, 30), len(rows) + i) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, k int, id long")
    parts = rnd.choice([1, 3, 8, 17])
    got = ordered_index(df, ["g"], [F.col("k").desc(), "id"], partitions=parts)
    w = Window.partitionBy("g").orderBy(F.col("k").desc(), "id")
    want = df.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    assert sorted(map(tuple, got.select("g", "id", "idx").collect()), key=str) == \
        sorted(map(tuple, want.select("g", "id", "idx").collect()), key=str)
