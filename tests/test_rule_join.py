"""Rules as a table: the join gives what the scan gives, without collecting rules and without a nested loop."""

import json

import pytest

from cuebook.operators import rule_join
from cuebook.operators.rule_join import evaluate_table
from cuebook.operators.rules import RULES_TABLE_SCHEMA, evaluate
from cuebook.plans.catalog import part_rules
from cuebook.sources.tables import load_table

from .test_rule_index import SCHEMA, rows, ruleset


def table(spark, rs):
    out = []
    for r in rs["rules"]:
        criteria = [(c["field"], c["operator"], json.dumps(c["value"]), c.get("baseline_field")) for c in r["conditions"]["criteria"]]
        out.append((r["rule_id"], r.get("score", 0.7), r.get("label", "rule_match"), r["conditions"].get("combination", "and"), criteria))
    return spark.createDataFrame(out, RULES_TABLE_SCHEMA)


def signals(df):
    return sorted((r.target_id, r.rule_id, r.label, r.score, r.confidence, r.evidence, json.loads(r.features), r.subject, r.note) for r in df.collect())


@pytest.mark.parametrize(("seed", "buckets"), [(11, 4), (12, 256), (13, 1)])
def test_same_signals_as_the_scan(spark, seed, buckets):
    df = spark.createDataFrame(rows(seed, 200), SCHEMA).repartition(3)
    rs = ruleset(seed, 120, ors=0.3)
    assert signals(evaluate_table(df, table(spark, rs), "id", buckets=buckets)) == signals(evaluate(df, rs))


def test_values_of_many_kinds(spark):
    df = spark.createDataFrame([(1, 2**60 + 1, "it's", True, 0.1), (2, 2**60, "5", False, 5.0), (3, None, None, None, None)], "id long, n long, s string, f boolean, d double")
    rules = [("n", "eq", 2**60), ("n", "eq", 2**60 + 1), ("n", "in", [2**60, "5", None]), ("s", "eq", "5"), ("s", "eq", 5), ("f", "eq", True), ("f", "eq", 1),
             ("d", "eq", 5), ("d", "in", [5.0, 0.1]), ("d", "eq", 0.1), ("n", "eq", None), ("s", "in", ["it", "5"]), ("d", "lte", 0.1),
             ("missing", "eq", 1), ("s", "text_present", "IT")]
    rs = {"rules": [{"rule_id": i, "score": 0.9, "label": "x", "conditions": {"combination": "and", "criteria": [{"field": f, "operator": o, "value": v}]}}
                    for i, (f, o, v) in enumerate(rules)]}
    assert signals(evaluate_table(df, table(spark, rs), "id")) == signals(evaluate(df, rs | {"id_field": "id"}))


def test_plan_joins_by_keys(spark):
    sf = "/root/testdata/sf0.001"
    df = evaluate_table(load_table(spark, sf, "lineitem"), part_rules(spark, sf), "l_orderkey")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "Cartesian" not in p and "Python" not in p
    assert p.count("FileScan") == 1 and p.count("Scan ExistingRDD") == 1  # rows, rules


def test_rules_that_see_every_row_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(rule_join, "MOST_SCANNED", 2)
    df = spark.createDataFrame(rows(1, 5), SCHEMA)
    rs = {"rules": [{"rule_id": i, "conditions": {"criteria": [{"field": "word", "operator": "text_present", "value": "r"}]}} for i in range(3)]}
    with pytest.raises(ValueError, match="see every row"):
        evaluate_table(df, table(spark, rs), "id")


def test_empty_tables(spark):
    df = spark.createDataFrame(rows(1, 5), SCHEMA)
    rs = table(spark, ruleset(11, 20))
    assert evaluate_table(df, rs.limit(0), "id").collect() == []
    assert evaluate_table(df.limit(0), rs, "id").collect() == []


def criteria(*found):
    return [(field, op, json.dumps(value), None) for field, op, value in found]


def candidates(monkeypatch, df, rules, **more):
    """(signals, pairs of row and rule that meet under a key)."""
    from pyspark.sql.classic.dataframe import DataFrame

    join, met = DataFrame.join, []
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "join", lambda self, *a, **b: met.append(join(self, *a, **b)) or met[-1])
        out = evaluate_table(df, rules, "id", **more).count()
    return out, met[0].count()


@pytest.mark.parametrize("buckets", [1, 256])
def test_ranges_meet_only_rows_within(spark, monkeypatch, buckets):
    df = spark.range(400).selectExpr("id", "CAST(IF(id % 2 = 0, 500, id) AS DOUBLE) AS x")  # a value that half of the rows have
    bands = [(i, 0.5, "far", "and", criteria(("x", "gt", 1000 + i), ("x", "lte", 1010 + i))) for i in range(600)]
    bands += [(1000 + i, 0.5, "near", "and", criteria(("x", "gt", i * 20), ("x", "lt", i * 20 + 3))) for i in range(5)]
    bands += [(2000 + i, 0.5, "by", "and", criteria(("x", "gt", 500), ("x", "lt", 501 + i))) for i in range(5)]
    n, pairs = candidates(monkeypatch, df, spark.createDataFrame(bands, RULES_TABLE_SCHEMA), buckets=buckets)
    assert (n, pairs) == (5, 5)  # of "gt 20i and lt 20i + 3" the one odd number


def test_rows_under_no_key_stay_out_of_the_join(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    join, lefts = DataFrame.join, []
    df = spark.range(5000).selectExpr("id", "id * 7 AS n", "CONCAT('w', id) AS w", "id + 0.5D AS d")
    found = [(i, 0.5, "one", "or", criteria(("n", "eq", 70 * i), ("w", "in", [f"w{i}", "none"]), ("d", "eq", i + 0.5))) for i in range(1, 4)]
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "join", lambda self, *a, **b: lefts.append(self) or join(self, *a, **b))
        out = evaluate_table(df, spark.createDataFrame(found, RULES_TABLE_SCHEMA), "id")
    assert sorted((int(r.target_id), r.rule_id) for r in out.collect()) == sorted((at, i) for i in range(1, 4) for at in (i, 10 * i))
    assert lefts[0].count() < 20  # nine keys of rules; 15,000 of rows


@pytest.mark.parametrize("words", [1, 1 << 14])
def test_key_bitmaps_lose_no_pair(spark, monkeypatch, words):
    monkeypatch.setattr(rule_join, "KEY_WORDS", words)
    df = spark.createDataFrame(rows(31, 150), SCHEMA)
    rs = {"id_field": "id", "rules": [{"rule_id": i, "conditions": {"combination": "or" if i % 2 else "and", "criteria": [
        {"field": f, "operator": "eq", "value": v}, {"field": g, "operator": "in", "value": [v, "red"]}]}}
        for i, (f, g, v) in enumerate((f, g, v) for f in ("a", "b", "c", "word") for g in ("a", "b", "word") for v in (-3, 0, 0.5, 2.5, "red", "", True))]}
    assert signals(evaluate_table(df, table(spark, rs), "id")) == signals(evaluate(df, rs))


@pytest.mark.parametrize(("cuts", "fan", "chunk"), [(1, 2, 1), (16, 2, 3), (16, 3, 256)])
def test_places_nodes_and_chunks_lose_no_pair(spark, monkeypatch, cuts, fan, chunk):
    for name, value in (("BOUND_CUTS", cuts), ("FAN", fan), ("CHUNK", chunk)):
        monkeypatch.setattr(rule_join, name, value)
    df = spark.createDataFrame(rows(21, 150), SCHEMA)
    found = [{"rule_id": i, "conditions": {"combination": "or" if i % 5 == 0 else "and", "criteria": [
        {"field": f, "operator": low, "value": at}, {"field": f, "operator": high, "value": at + width}]}}
        for i, (f, low, high, at, width) in enumerate((f, low, high, at, width) for f in "abc" for low in ("gt", "gte") for high in ("lt", "lte")
                                                      for at in (-20, -3, 0, 2.5, 11) for width in (-1, 0, 0.5, 40))]
    rs = {"id_field": "id", "rules": found}
    assert signals(evaluate_table(df, table(spark, rs), "id", buckets=4)) == signals(evaluate(df, rs))
