"""Bucketed review store: same rows as the plain tables, no shuffle of cases or decisions when they are read."""

import datetime as dt

import pytest

from cuebook.operators import review
from cuebook.session import scratch_path
from cuebook.sources.review_store import DECISIONS_SCHEMA, ReviewStore

CASES = "bot_id string, run_id string, case_id string, case_index long, target_id string, score double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    cases = spark.createDataFrame([("b", f"r{r}", str(i), i, f"t{i}", 0.5) for r in range(3) for i in range(40 if r else 400)], CASES)
    t = dt.datetime(2024, 1, 1)
    log = [("b", f"r{r}", str(i), d, "", "ann", t + dt.timedelta(hours=h)) for r in range(3) for i in range(0, 40, 3)
           for h, d in enumerate(("accepted", "rejected" if i % 2 else "accepted", "maybe"))] + [("b", "gone", "1", "accepted", "", "ann", t)]
    log = spark.createDataFrame(log, DECISIONS_SCHEMA)
    store = ReviewStore.open(spark, f"rs_{tmp_path.name.replace('-', '_')}", str(tmp_path / "it's"), CASES, buckets=4)
    store.add_cases(cases.filter("run_id <> 'r2'"))
    store.add_cases(cases.filter("run_id = 'r2'"))  # appended later, into the same buckets
    store.add_decisions(log.filter("hour(updated_at) = 0"))
    store.add_decisions(log.filter("hour(updated_at) > 0"))
    yield store, cases, log
    store.forget()


def test_same_rows_as_plain_tables(stored):
    store, cases, log = stored
    latest = review.latest_decisions(log)
    assert rows(store.decisions()) == rows(latest)
    assert rows(store.case_list()) == rows(review.case_list(cases, latest))
    assert rows(store.tally()) == rows(review.tally(cases, latest))
    assert rows(store.unknown()) == rows(review.unknown_case_decisions(latest, cases)) and store.unknown().count() == 1


def test_no_exchange_of_cases_or_decisions(spark, stored):
    store, _, _ = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (store.decisions(), store.case_list(), store.unknown()):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        tally = store.tally()._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in tally.split("\n") if "Exchange" in line]
        assert len(exchanges) == 2 and all("hashpartitioning(bot_id" in e and "case_id" not in e for e in exchanges)  # partial counts of runs only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reopened_from_its_folder(spark, stored, tmp_path):
    store, _, log = stored
    before = rows(store.case_list())
    store.forget()
    again = ReviewStore.open(spark, store.name, str(tmp_path / "it's"), CASES, buckets=4)
    assert rows(again.case_list()) == before
    again.add_decisions(log.limit(0))  # nothing to add
    assert rows(again.case_list()) == before


def test_refusals(spark):
    with pytest.raises(ValueError):
        ReviewStore.open(spark, "x; drop", scratch_path(spark, "rs"), CASES)
    with pytest.raises(ValueError, match="case_id"):
        ReviewStore.open(spark, "rs_bad", scratch_path(spark, "rs"), "bot_id string, run_id string")
