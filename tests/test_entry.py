"""Driver contract: entry() smoke, query/oracle registry, and the oracle comparison at sf0.001."""

import pytest

import __spark_entry__ as ent
from cuebook.plans.catalog import all_oracles, all_queries
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["target_id", "rule_id", "label"]
    scores = [r.score for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_every_oracle_has_a_query():
    assert set(ent.oracle_sql()) <= set(ent.queries())
    assert set(all_queries()) == set(all_oracles()) <= set(ent.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ent.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    rep = compare(spark, SF, name, ent.queries()[name], ent.oracle_sql()[name], con)
    assert rep["ok"], rep
