"""Plan shape: one scan, pushed filters, pruned read schema, codegen, no Python in hot paths,
no single-partition exchange where a hot group could sit."""

from pyspark.sql import functions as F

from cuebook.operators.review import build_cases, threshold_sweep
from cuebook.operators.rules import evaluate
from cuebook.plans.catalog import LINEITEM_RULES, ORDERS_RULES, doc_signals, many_lineitem_rules
from cuebook.sources.tables import load_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rule_program_is_one_pushed_scan(spark):
    pushable = dict(ORDERS_RULES, rules=[r for r in ORDERS_RULES["rules"] if r["rule_id"] != 2])
    df = evaluate(load_table(spark, SF, "orders"), pushable)
    p = plan(df)
    assert p.count("FileScan parquet") == 1
    assert "PushedFilters: [Or(" in p
    # a case-insensitive substring cannot be pushed, but another criterion of its rule can
    assert "PushedFilters: [Or(" in plan(evaluate(load_table(spark, SF, "orders"), ORDERS_RULES))
    only = dict(ORDERS_RULES, rules=[{"rule_id": 2, "conditions": {"criteria": [{"field": "o_orderpriority", "operator": "text_present", "value": "x"}]}}])
    assert "PushedFilters: []" in plan(evaluate(load_table(spark, SF, "orders"), only))
    read = p[p.index("ReadSchema:"):].split("\n")[0]
    assert "o_orderdate" not in read and "o_custkey" not in read
    for bad in ("BatchEvalPython", "ArrowEvalPython", "Exchange", "BroadcastHashJoin", "SortMergeJoin"):
        assert bad not in p
    assert "*(1) Filter" in p and "*(2) Generate" in p  # compiled


def test_large_rule_program_stays_compiled(spark):
    df = evaluate(load_table(spark, SF, "lineitem"), many_lineitem_rules(100))
    p = plan(df)
    assert p.count("FileScan parquet") == 1 and "Exchange" not in p
    head = p.split("FileScan")[0]
    assert head.count("Filter (") == 2 and "_cue_p" not in head.split("Filter (")[2].split("\n")[0]  # bounds only, not the rule program again
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_evaluate_keeps_nan_and_text_rules_correct_with_pushdown(spark):
    df = evaluate(load_table(spark, SF, "lineitem"), LINEITEM_RULES, keep=["l_linenumber"])
    assert "l_shipdate" not in plan(df).split("PushedFilters")[1].split("\n")[0]


def test_case_index_has_no_single_partition_step(spark):
    cases = build_cases(doc_signals(spark, SF))
    p = plan(cases)
    assert "SinglePartition" not in p
    # whole rows are shuffled once, by range and run, and nothing is written in between
    assert "rangepartitioning" not in p.lower() and "Scan ExistingRDD" not in p
    exchanges = [line for line in p.split("\n") if "Exchange hashpartitioning" in line]
    assert len([x for x in exchanges if "_cue_pid" in x]) == 2  # the rows, and the counts of (range, run)
    assert len(exchanges) == 3  # and the counts' window by run, over ranges of a run
    assert p.count("FileScan") == 2  # to count, to number
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_sweep_single_partition_only_on_partition_totals(spark):
    labels = doc_signals(spark, SF).select("score", (F.col("score") > 0.5).alias("accepted"))
    p = plan(threshold_sweep(labels, partitions=4))
    # the only unpartitioned window runs over the per-partition totals (<= partitions rows)
    assert p.count("SinglePartition") <= 1
    assert "BroadcastExchange" in p or "BroadcastHashJoin" in p
