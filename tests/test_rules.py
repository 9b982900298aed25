"""Rule evaluation on parcels, validation, never-fires report, plans of large rulesets."""

import json

import pytest
from pyspark.sql import functions as F

from cuebook.model import RulesetError, load, merge, validate
from cuebook.operators.rules import evaluate, rules_from_table, validate_rules

PARCELS = "parcel string, kilos double, paid int, quoted int, remark string, stops array<string>"
ROWS = [("p-7", 31.5, 60, 80, "Fragile, this side up", ["north", "east"]), ("p-8", 2.0, 90, 90, None, []), ("p-9", 0.4, None, 0, "left at door", None)]


def crit(field, operator, value=None, **more):
    return {"field": field, "operator": operator, "value": value, **more}


def rule(rule_id, *criteria, how="and", **more):
    return {"rule_id": rule_id, "conditions": {"combination": how, "criteria": list(criteria)}, **more}


def rules_of(*rules, **more):
    return {"id_field": "parcel", "rules": list(rules), **more}


@pytest.fixture
def parcels(spark):
    return spark.createDataFrame(ROWS, PARCELS)


def hits(df, ruleset):
    return {(r.target_id, r.rule_id): r for r in evaluate(df, ruleset).collect()}


def test_each_operator_on_parcels(parcels):
    got = hits(parcels, rules_of(
        rule(11, crit("kilos", "gte", 31.5), score=0.95, label="heavy", output={"lane": "B"}),
        rule(12, crit("paid", "relative_decrease", 20, baseline_field="quoted")),
        rule(13, crit("remark", "text_present", "FRAGILE")),
        rule(14, crit("remark", "eq", None)),
        rule(15, crit("paid", "ne", 90), crit("kilos", "lt", 1)),
        rule(16, crit("stops", "eq", ["north", "east"])),
        rule(17, crit("stops", "eq", []))))
    assert sorted(got) == [("p-7", 11), ("p-7", 12), ("p-7", 13), ("p-7", 16), ("p-8", 14), ("p-8", 17), ("p-9", 15)]
    heavy, plain = got["p-7", 11], got["p-7", 12]
    assert (heavy.label, heavy.score, heavy.confidence, heavy.evidence) == ("heavy", 0.95, "high", ["kilos gte 31.5"])
    assert json.loads(heavy.features) == {"rule_id": 11, "lane": "B"} and json.loads(heavy.subject) == {"parcel": "p-7"}
    assert (plain.label, plain.score, plain.confidence) == ("rule_match", 0.7, "medium-high")
    assert heavy.note == plain.note != ""


def test_numbers_beyond_64_bits_match_nothing(parcels):
    far = 10**25
    assert hits(parcels, rules_of(rule(1, crit("paid", "eq", far)), rule(2, crit("paid", "in", [far, -far])), rule(3, crit("kilos", "eq", 10**400)),
                                  rule(4, crit("paid", "gt", far)))) == {}
    assert sorted(hits(parcels, rules_of(rule(5, crit("paid", "lt", far)), rule(6, crit("paid", "in", [far, 60, "x", 1.5] + [float("inf")]))))) == [("p-7", 5), ("p-7", 6), ("p-8", 5)]


WRONG = {
    "an operator nobody knows": (rules_of(rule(1, crit("kilos", "between", [1, 2]))), "between"),
    "text as a bound": (rules_of(rule(1, crit("kilos", "gte", "ten"))), "number"),
    "a truth value as a bound": (rules_of(rule(1, crit("kilos", "lte", False))), "number"),
    "a decrease from nowhere": (rules_of(rule(1, crit("paid", "relative_decrease", 10))), "baseline_field"),
    "one value where a list belongs": (rules_of(rule(1, crit("paid", "in", "60"))), "list"),
    "a search for nothing": (rules_of(rule(1, crit("remark", "text_present", ""))), "empty"),
    "an id given again": (rules_of(rule(4), rule(5), rule(4)), "already"),
    "a score below zero": (rules_of(rule(1, score=-0.1)), "score"),
    "a third way to combine": (rules_of(rule(1, how="none")), "combination"),
}


@pytest.mark.parametrize("name", WRONG)
def test_documents_that_are_refused(name):
    doc, said = WRONG[name]
    report = validate(doc)
    assert report.valid is False and said in " / ".join(e["msg"] for e in report.errors)
    with pytest.raises(RulesetError):
        load(json.dumps(doc))


def test_rules_that_cannot_fire_are_reported_and_silent(parcels):
    gone, light = crit("customs", "eq", "x"), crit("kilos", "lt", 5)
    doc = rules_of(rule(21), rule(22, light, gone), rule(23, gone, light, how="or"), rule(24, gone, crit("duty", "gt", 0), how="or"), rule(25, light))
    assert [u["rule_id"] for u in validate(doc, set(parcels.columns)).unsupported] == [21, 22, 24]
    assert {r for _, r in hits(parcels, doc)} == {23, 25}
    nameless = doc | {"id_field": "barcode"}
    assert len(validate(nameless, set(parcels.columns)).unsupported) == 5 and hits(parcels, nameless) == {}
    assert [u["rule_id"] for u in validate(doc).unsupported] == [21]  # no fields known: only what holds for any data


def test_or_rules_tell_which_criteria_passed(parcels):
    got = hits(parcels, rules_of(rule(31, crit("kilos", "gt", 30), crit("customs", "eq", 1), crit("paid", "in", [60, 61]), crit("paid", "gt", 89), how="or")))
    assert {k[0]: v.evidence for k, v in got.items()} == {"p-7": ["kilos gt 30", "paid in [60, 61]"], "p-8": ["paid gt 89"]}


def test_output_keys_win_and_kept_columns_ride_along(parcels):
    doc = rules_of(rule(41, crit("kilos", "gt", 0), output={"rule_id": "own", "tags": ["a", None]}))
    out = evaluate(parcels.withColumn("depot", F.lit(3)), doc, keep=["depot"]).collect()
    assert [r.depot for r in out] == [3, 3, 3] and json.loads(out[0].features) == {"rule_id": "own", "tags": ["a", None]}


def test_no_rows_and_no_id(spark):
    doc = rules_of(rule(51, crit("kilos", "gt", 0)))
    assert hits(spark.createDataFrame([], PARCELS), doc) == {}
    (key, row), = hits(spark.createDataFrame([(None, 1.0, 1, 1, "", [])], PARCELS), doc).items()
    assert key == ("None", 51) and json.loads(row.subject) == {"parcel": None}


@pytest.mark.parametrize("k", [5, 17, 100, 300])
def test_any_number_of_rules_filters_at_the_scan(spark, k):
    from cuebook.plans.catalog import many_lineitem_rules
    from cuebook.sources.tables import load_table

    df = evaluate(load_table(spark, "/root/testdata/sf0.001", "lineitem"), many_lineitem_rules(k))
    pushed = df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
    assert "l_quantity" in pushed or "l_discount" in pushed


def test_the_scan_filter_lets_every_match_pass(spark):
    rows = [(i, i - 5, (i - 5) / 4, "abc"[i % 3]) for i in range(12)] + [(99, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "parcel long, n int, x double, t string")
    doc = rules_of(rule(1, crit("n", "gt", 2.5)), rule(2, crit("x", "lte", -1)), rule(3, crit("t", "eq", "b"), crit("n", "ne", 0)),
                   rule(4, crit("n", "in", [0, 1.0, 9.5]), crit("t", "eq", "c"), how="or"), rule(5, crit("x", "eq", 0.25)), rule(6, crit("t", "text_present", "A"), crit("n", "lt", -4)))
    want = {(str(p), r) for p, n, x, t in rows if n is not None for r, ok in (
        (1, n > 2.5), (2, x <= -1), (3, t == "b" and n != 0), (4, n in (0, 1) or t == "c"), (5, x == 0.25), (6, t == "a" and n < -4)) if ok}
    assert set(hits(df, doc)) == want


def test_many_rules_single_scan_matches_union(spark):
    from cuebook.plans.catalog import many_lineitem_rules
    from cuebook.sources.tables import load_table

    li = load_table(spark, "/root/testdata/sf0.001", "lineitem")
    for k in (5, 40):
        rs = many_lineitem_rules(k)
        got = {(r.rule_id, r.n) for r in evaluate(li, rs).groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
        want = set()
        for rule in rs["rules"]:
            q, d = (c["value"] for c in rule["conditions"]["criteria"])
            n = li.filter((F.col("l_quantity") > q) & (F.col("l_discount") <= d)).count()
            if n:
                want.add((rule["rule_id"], n))
        assert got == want


def test_rules_table_validation(spark):
    rules = spark.createDataFrame([
        (1, 0.5, "a", "and", [("x", "gt", "5", None)]),
        (2, 1.5, "b", "xor", [("x", "lt", '"text"', None), ("y", "relative_decrease", "3", None)]),
        (2, 0.5, "c", "and", [("z", "in", "4", None), ("z", "text_present", '""', None)]),
        (3, 0.5, "d", "and", []),
        (4, 0.5, "e", "or", [("gone", "eq", "1", None), ("x", "eq", "1", None)]),
        (5, 0.5, "f", "and", [("gone", "eq", "1", None), ("x", "eq", "1", None)]),
    ], "rule_id long, score double, label string, combination string, "
       "criteria array<struct<field:string, operator:string, value:string, baseline_field:string>>")
    out = validate_rules(rules, known_fields=["x", "y", "z"]).collect()
    errs = {(r.rule_id, r.msg) for r in out if r.severity == "error"}
    assert (2, "rule_id is used more than once") in errs
    assert (2, "score must be a number in [0, 1]") in errs
    assert (2, "combination must be 'and' or 'or'") in errs
    assert (2, "lt needs a numeric value") in errs
    assert (2, "relative_decrease needs 'baseline_field'") in errs
    assert (2, "'in' needs a list value") in errs
    assert (2, "'text_present' needs non-empty text") in errs
    assert not any(r.rule_id == 1 for r in out)
    unsup = {r.rule_id for r in out if r.severity == "unsupported"}
    assert unsup == {3, 5}
    doc = rules_from_table([r.asDict(recursive=True) for r in rules.filter("rule_id = 1").collect()])
    assert load(doc).rules[0].criteria[0].value == 5


def test_a_proposal_sets_rules_and_descriptions_only():
    live = {"id_field": "parcel", "query": "SELECT 1", "task": "weigh", "source_columns": ["kilos"], "rules": [rule(1)]}
    asked = {"id_field": "x", "query": "SELECT 2", "source_table": "y", "task": "count", "rules": [rule(2)], "extra": 1}
    assert merge(live, asked) == live | {"task": "count", "rules": [rule(2)]}
    assert merge(live, {}) == live | {"rules": []}


def _rows_full(df):
    return sorted((r.target_id, r.rule_id, r.label, r.score, r.confidence, tuple(r.evidence), r.features,
                   r.subject, r.note) for r in df.collect())


def test_compact_signals_expand_to_full(spark):
    from cuebook.operators.rules import evaluate_compact, expand, rule_dimension
    from cuebook.plans.catalog import LINEITEM_RULES, ORDERS_RULES
    from cuebook.sources.tables import load_table

    sf = "/root/testdata/sf0.001"
    for table, rules in (("lineitem", LINEITEM_RULES), ("orders", ORDERS_RULES)):
        df = load_table(spark, sf, table)
        full = evaluate(df, rules)
        compact = evaluate_compact(df, rules)
        assert set(compact.columns) == {"target_id", "subject", "rule_id", "evidence_mask", "evidence_override"}
        assert _rows_full(expand(compact, rule_dimension(spark, rules))) == _rows_full(full)


def test_wide_or_rule_evidence(spark):
    from cuebook.operators.rules import evaluate_compact, expand, rule_dimension

    df = spark.createDataFrame([(i, i) for i in range(70)], "id long, v long")
    wide = {"id_field": "id", "rules": [{"rule_id": 1, "conditions": {"combination": "or", "criteria": [
        {"field": "v", "operator": "eq", "value": k} for k in range(65)]}}]}
    got = {int(r.target_id): list(r.evidence) for r in evaluate(df, wide).collect()}
    assert got == {k: [f"v eq {k}"] for k in range(65)}
    back = expand(evaluate_compact(df, wide), rule_dimension(spark, wide))
    assert {int(r.target_id): list(r.evidence) for r in back.collect()} == got
