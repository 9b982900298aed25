"""Print the physical plans of the core operators (``python -m cuebook.plans.show [sf_dir]``)."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F


def key_plans(spark, sf: str) -> dict:
    from ..operators import review as rv
    from ..operators import runs as rn
    from ..operators.rules import evaluate
    from . import catalog as c
    from ..sources.tables import load_table

    return {
        "evaluate, 3 rules over orders": evaluate(load_table(spark, sf, "orders"),
                                                                   dict(c.ORDERS_RULES, rules=c.ORDERS_RULES["rules"][:1]
                                                                        + c.ORDERS_RULES["rules"][2:4])),
        "evaluate, 100 rules over lineitem": evaluate(load_table(spark, sf, "lineitem"),
                                                                       c.many_lineitem_rules(100)),
        "build_cases (hot-group-safe case index)": rv.build_cases(c.doc_signals(spark, sf)),
        "threshold_sweep per bot": rv.threshold_sweep(c.doc_labels(spark, sf).withColumn("bot_id", F.col("run_id")),
                                                      by=["bot_id"]),
        "history, newest 5 runs per bot": rn.history(c.runs_table(spark, sf), 5),
        "latest decisions": rv.latest_decisions(c.decision_log(spark, sf)),
    }


def main(argv: list[str]) -> None:
    from ..session import local_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    for title, df in key_plans(spark, sf).items():
        print(f"## {title}\n")
        print("```")
        print(df._jdf.queryExecution().executedPlan().toString().strip())
        print("```\n")


if __name__ == "__main__":
    main(sys.argv)
