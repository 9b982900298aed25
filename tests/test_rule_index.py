"""The threshold index against plain Python over rows with nulls, NaN, cut points hit exactly, and many rules."""

import math
import random

import pytest

from cuebook.model import load
from cuebook.operators.rule_index import RuleIndex
from cuebook.operators.rules import evaluate, evaluate_compact, expand, rule_dimension

SCHEMA = "id long, a int, b double, c float, t string, word string, base double"


def rows(seed, n):
    rng = random.Random(seed)
    number = lambda *more: rng.choice([None, *more, *range(-3, 12)])
    real = lambda *more: None if (x := number(*more)) is None else float(x)
    return [(i, number(), real(math.nan, math.inf, 2.5, -0.0), real(0.5, math.nan), rng.choice([None, "3", " 4.5 ", "x", "nan", "1e1", "-0"]),
             rng.choice([None, "red", "green", ""]), real(0.0, math.nan)) for i in range(n)]


def holds(c, row):
    x, v, op = row[c["field"]], c["value"], c["operator"]
    if op in ("eq", "ne"):
        return (x == v and not isinstance(x, str)) != (op == "ne") if not isinstance(v, str) else (x == v) != (op == "ne")
    if op == "in":
        return x in v
    if op == "text_present":
        return str(v).lower() in str(x).lower()
    try:
        number = float(x)
        if op == "relative_decrease":
            base = float(row[c["baseline_field"]])
            return base != 0 and (base - number) / base * 100 >= v
    except (TypeError, ValueError):
        return False
    return {"lt": number < v, "lte": number <= v, "gt": number > v, "gte": number >= v}[op]


def criterion(rng):
    kind = rng.random()
    if kind < 0.55:
        return {"field": rng.choice("abct"), "operator": rng.choice(["lt", "lte", "gt", "gte"]), "value": rng.choice([rng.randint(-4, 12), 2.5, 0.5, 4.5])}
    if kind < 0.7:
        return {"field": rng.choice("abc"), "operator": rng.choice(["eq", "ne"]), "value": rng.choice([0, 2.5, 3, 0.5, -1])}
    if kind < 0.8:
        return {"field": rng.choice("abc"), "operator": "in", "value": rng.sample(range(-3, 12), 3)}
    if kind < 0.9:
        return {"field": rng.choice("abt"), "operator": "relative_decrease", "value": rng.choice([-50, 0, 10, 50]), "baseline_field": "base"}
    return rng.choice([{"field": "word", "operator": "eq", "value": "red"}, {"field": "word", "operator": "text_present", "value": "RE"},
                       {"field": "a", "operator": "eq", "value": None}, {"field": "word", "operator": "in", "value": ["red", None]}])


def ruleset(seed, n, ors=0.15):
    rng = random.Random(seed)
    return {"rules": [{"rule_id": 1000 + i, "conditions": {"combination": "or" if rng.random() < ors else "and",
                                                           "criteria": [criterion(rng) for _ in range(rng.randint(1, 4))]}} for i in range(n)]}


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 7), (3, 64), (4, 65), (5, 300)])
def test_against_python(spark, seed, n):
    data = rows(seed, 300)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    names = [f.name for f in df.schema]
    rs = ruleset(seed, n)
    want, evidence = set(), {}
    for r in data:
        row = dict(zip(names, r, strict=True))
        for rule in rs["rules"]:
            passed = [holds(c, row) for c in rule["conditions"]["criteria"]]
            how = rule["conditions"]["combination"]
            if (all if how == "and" else any)(passed):
                want.add((str(row["id"]), rule["rule_id"]))
                evidence[str(row["id"]), rule["rule_id"]] = [f"{c['field']} {c['operator']} {c['value']}" for c, p in
                                                            zip(rule["conditions"]["criteria"], passed, strict=True) if p]
    got = evaluate(df, rs).collect()
    assert {(r.target_id, r.rule_id) for r in got} == want and len(got) == len(want)
    assert all(r.evidence == evidence[r.target_id, r.rule_id] for r in got)
    wide = expand(evaluate_compact(df, rs), rule_dimension(spark, rs)).collect()
    assert sorted((r.target_id, r.rule_id, r.evidence) for r in wide) == sorted((r.target_id, r.rule_id, r.evidence) for r in got)


def test_search_is_logarithmic_and_written_once(spark):
    """1,000 rules add a few projections, not a thousand conditions; no filter repeats the search."""
    df = spark.createDataFrame(rows(1, 5), SCHEMA)
    plans = {}
    for n in (10, 1000):
        rs = {"rules": [{"rule_id": i, "conditions": {"criteria": [{"field": "b", "operator": "gt", "value": i * 1.5}, {"field": "b", "operator": "lte", "value": i * 1.5 + 3}]}}
                        for i in range(n)]}
        index = RuleIndex(list(load(rs).rules), df.schema)
        assert len(index.axes) == 1 and not index.others
        plans[n] = evaluate(df, rs)._jdf.queryExecution().optimizedPlan().toString()
    assert plans[1000].count("CASE WHEN") <= plans[10].count("CASE WHEN") + 12
    filters = [line for line in plans[1000].split("\n") if "Filter " in line]
    assert not any("_cue_p" in line for line in filters)
