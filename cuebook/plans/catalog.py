"""Named queries over the driver tables, each with an equivalent DuckDB SQL oracle.

Every query reads whole tables (or data Spark derives from them); none caps rows except where
the limit is the feature (top-k reports, samples). Outputs are flat and aliased so the oracle's
column names match. Queries without an oracle say why next to their registration.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import conversations as conv
from ..operators import outbox as ob
from ..operators import review as rv
from ..operators import runs as rn
from ..operators.govern import scope_violations
from ..functions.text import redact_text
from ..operators.protect import mask_columns, redact_nested
from ..operators.rule_join import evaluate_table
from ..operators.rules import evaluate, rule_counts
from ..operators.signals import NOTE, check_contract, frame, to_predictions, to_signals
from ..sources.governed import GovernedSource, value_counts
from ..sources.tables import load_table, table_path

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load_table(spark, sf, name)


def _flat(signals: DataFrame, *extra: str) -> DataFrame:
    """Signals with evidence as one text (flat columns for comparison)."""
    return signals.select(*extra, "target_id", "rule_id", "label", "score", "confidence",
                          F.array_join("evidence", "; ").alias("evidence"), "features", "subject")


# ------------------------------------------------------------------------- C: rule evaluation

ORDERS_RULES = {
    "id_field": "o_orderkey", "source_table": "orders",
    "rules": [
        {"rule_id": 1, "score": 0.8, "label": "high_value", "output": {"code": "HIGH_VALUE"},
         "conditions": {"criteria": [{"field": "o_totalprice", "operator": "gt", "value": 450000}]}},
        {"rule_id": 2, "score": 0.65, "label": "urgent_open",
         "conditions": {"combination": "and", "criteria": [
             {"field": "o_orderpriority", "operator": "text_present", "value": "URGENT"},
             {"field": "o_orderstatus", "operator": "in", "value": ["O"]}]}},
        {"rule_id": 3, "score": 0.45, "label": "pending_or_small",
         "conditions": {"combination": "or", "criteria": [
             {"field": "o_orderstatus", "operator": "eq", "value": "P"},
             {"field": "o_totalprice", "operator": "lt", "value": 5000}]}},
        {"rule_id": 4, "score": 0.9, "label": "big_not_low",
         "conditions": {"criteria": [
             {"field": "o_orderpriority", "operator": "ne", "value": "5-LOW"},
             {"field": "o_totalprice", "operator": "gte", "value": 490000}]}},
        {"rule_id": 5, "score": 0.5, "label": "never", "conditions": {"criteria": [
            {"field": "o_comment", "operator": "eq", "value": "x"}]}},
    ],
}

ORDERS_RULES_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS target_id, CAST(1 AS BIGINT) AS rule_id, 'high_value' AS label,
       CAST(0.8 AS DOUBLE) AS score, 'high' AS confidence, 'o_totalprice gt 450000' AS evidence,
       '{"rule_id":1,"code":"HIGH_VALUE"}' AS features, '{"o_orderkey":' || o_orderkey || '}' AS subject
FROM orders WHERE o_totalprice > 450000
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 2, 'urgent_open', CAST(0.65 AS DOUBLE), 'medium-high',
       'o_orderpriority text_present URGENT; o_orderstatus in [''O'']', '{"rule_id":2}',
       '{"o_orderkey":' || o_orderkey || '}'
FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus IN ('O')
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 3, 'pending_or_small', CAST(0.45 AS DOUBLE), 'medium',
       concat_ws('; ', CASE WHEN o_orderstatus = 'P' THEN 'o_orderstatus eq P' END,
                       CASE WHEN o_totalprice < 5000 THEN 'o_totalprice lt 5000' END),
       '{"rule_id":3}', '{"o_orderkey":' || o_orderkey || '}'
FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 5000
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 4, 'big_not_low', CAST(0.9 AS DOUBLE), 'high',
       'o_orderpriority ne 5-LOW; o_totalprice gte 490000', '{"rule_id":4}',
       '{"o_orderkey":' || o_orderkey || '}'
FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW' AND o_totalprice >= 490000
"""


@query("rules_orders", ORDERS_RULES_SQL)
def rules_orders(spark, sf):
    return _flat(evaluate(_t(spark, sf, "orders"), ORDERS_RULES))


LINEITEM_RULES = {
    "id_field": "l_orderkey",
    "rules": [
        {"rule_id": 10, "score": 0.7, "label": "bulk_discount", "conditions": {"criteria": [
            {"field": "l_quantity", "operator": "gte", "value": 45},
            {"field": "l_discount", "operator": "gte", "value": 0.08}]}},
        {"rule_id": 11, "score": 0.55, "label": "returned_or_taxed", "conditions": {
            "combination": "or", "criteria": [
                {"field": "l_returnflag", "operator": "eq", "value": "R"},
                {"field": "l_tax", "operator": "gt", "value": 0.075},
                {"field": "l_shipdate", "operator": "gt", "value": 5},
                {"field": "l_missing", "operator": "eq", "value": 1}]}},
        {"rule_id": 12, "score": 0.3, "label": "cheap_line", "conditions": {"criteria": [
            {"field": "l_extendedprice", "operator": "lte", "value": 1500.5}]}},
    ],
}


@query("rules_lineitem_and_or", """
SELECT l_linenumber, CAST(l_orderkey AS VARCHAR) AS target_id, CAST(10 AS BIGINT) AS rule_id,
       'bulk_discount' AS label, CAST(0.7 AS DOUBLE) AS score, 'medium-high' AS confidence,
       'l_quantity gte 45; l_discount gte 0.08' AS evidence, '{"rule_id":10}' AS features,
       '{"l_orderkey":' || l_orderkey || '}' AS subject
FROM lineitem WHERE l_quantity >= 45 AND l_discount >= 0.08
UNION ALL
SELECT l_linenumber, CAST(l_orderkey AS VARCHAR), 11, 'returned_or_taxed', CAST(0.55 AS DOUBLE), 'medium',
       concat_ws('; ', CASE WHEN l_returnflag = 'R' THEN 'l_returnflag eq R' END,
                       CASE WHEN l_tax > 0.075 THEN 'l_tax gt 0.075' END),
       '{"rule_id":11}', '{"l_orderkey":' || l_orderkey || '}'
FROM lineitem WHERE l_returnflag = 'R' OR l_tax > 0.075
UNION ALL
SELECT l_linenumber, CAST(l_orderkey AS VARCHAR), 12, 'cheap_line', CAST(0.3 AS DOUBLE), 'low',
       'l_extendedprice lte 1500.5', '{"rule_id":12}', '{"l_orderkey":' || l_orderkey || '}'
FROM lineitem WHERE l_extendedprice <= 1500.5
""")
def rules_lineitem_and_or(spark, sf):
    return _flat(evaluate(_t(spark, sf, "lineitem"), LINEITEM_RULES, keep=["l_linenumber"]), "l_linenumber")


LINEITEM_SQL = ORACLES["rules_lineitem_and_or"]


@query("rules_lineitem_compact", LINEITEM_SQL)
def rules_lineitem_compact(spark, sf):
    """The same rules stored compactly, then expanded with the broadcast rules dimension."""
    from ..operators.rules import evaluate_compact, expand, rule_dimension

    compact = evaluate_compact(_t(spark, sf, "lineitem"), LINEITEM_RULES, keep=["l_linenumber"])
    return _flat(expand(compact, rule_dimension(spark, LINEITEM_RULES)), "l_linenumber")


def daily_activity(spark, sf) -> DataFrame:
    """Per user and day: summed value and the previous active day's sum as the baseline.
    The window partitions by user over at most one row per day (bounded), after aggregation."""
    ev = _t(spark, sf, "events")
    daily = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("day_value"))
    w = Window.partitionBy("user_id").orderBy("day")
    return daily.withColumn("prev_value", F.lag("day_value").over(w)).withColumn(
        "entity", F.concat(F.col("user_id").cast("string"), F.lit("@"), F.col("day").cast("string")))


DROP_RULES = {
    "id_field": "entity",
    "query": "SELECT * FROM daily_activity",
    "rules": [
        {"rule_id": 20, "score": 0.75, "label": "activity_drop", "conditions": {"criteria": [
            {"field": "day_value", "operator": "relative_decrease", "baseline_field": "prev_value",
             "value": 60}]}},
        {"rule_id": 21, "score": 0.62, "label": "busy_day", "conditions": {"criteria": [
            {"field": "day_value", "operator": "gte", "value": 600}]}},
    ],
}

DAILY_SQL = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS day_value
           FROM events GROUP BY user_id, CAST(ts AS DATE)),
b AS (SELECT *, lag(day_value) OVER (PARTITION BY user_id ORDER BY day) AS prev_value,
             CAST(user_id AS VARCHAR) || '@' || CAST(day AS VARCHAR) AS entity FROM d)
"""


@query("rules_relative_decrease", DAILY_SQL + """
SELECT entity AS target_id, CAST(20 AS BIGINT) AS rule_id, 'activity_drop' AS label,
       CAST(0.75 AS DOUBLE) AS score, 'medium-high' AS confidence,
       'day_value relative_decrease 60' AS evidence, '{"rule_id":20}' AS features,
       '{"entity":"' || entity || '"}' AS subject
FROM b WHERE prev_value <> 0 AND (prev_value - day_value) / prev_value * 100 >= 60
UNION ALL
SELECT entity, 21, 'busy_day', CAST(0.62 AS DOUBLE), 'medium-high', 'day_value gte 600',
       '{"rule_id":21}', '{"entity":"' || entity || '"}'
FROM b WHERE day_value >= 600
""")
def rules_relative_decrease(spark, sf):
    return _flat(evaluate(daily_activity(spark, sf), DROP_RULES))


CUSTOMER_RULES = {
    "id_field": "c_custkey",
    "rules": [
        {"rule_id": 30, "score": 0.5, "label": "building", "conditions": {"criteria": [
            {"field": "c_mktsegment", "operator": "eq", "value": "BUILDING"}]}},
        {"rule_id": 31, "score": 0.65, "label": "negative_balance", "conditions": {"criteria": [
            {"field": "c_acctbal", "operator": "lt", "value": 0},
            {"field": "c_mktsegment", "operator": "ne", "value": "AUTOMOBILE"}]}},
        {"rule_id": 32, "score": 0.35, "label": "nations", "conditions": {"criteria": [
            {"field": "c_nationkey", "operator": "in", "value": [3, 7.0, 7.5, None, True, "9"]}]}},
        {"rule_id": 33, "score": 0.25, "label": "rich_or_odd", "conditions": {
            "combination": "or", "criteria": [
                {"field": "c_name", "operator": "eq", "value": 5},
                {"field": "c_acctbal", "operator": "gt", "value": 9900}]}},
    ],
}


@query("rules_customer_eq_ne_in", """
SELECT CAST(c_custkey AS VARCHAR) AS target_id, CAST(30 AS BIGINT) AS rule_id, 'building' AS label,
       CAST(0.5 AS DOUBLE) AS score, 'medium' AS confidence, 'c_mktsegment eq BUILDING' AS evidence,
       '{"rule_id":30}' AS features, '{"c_custkey":' || c_custkey || '}' AS subject
FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), 31, 'negative_balance', CAST(0.65 AS DOUBLE), 'medium-high',
       'c_acctbal lt 0; c_mktsegment ne AUTOMOBILE', '{"rule_id":31}', '{"c_custkey":' || c_custkey || '}'
FROM customer WHERE c_acctbal < 0 AND c_mktsegment IS DISTINCT FROM 'AUTOMOBILE'
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), 32, 'nations', CAST(0.35 AS DOUBLE), 'low',
       'c_nationkey in [3, 7.0, 7.5, None, True, ''9'']', '{"rule_id":32}', '{"c_custkey":' || c_custkey || '}'
FROM customer WHERE c_nationkey IN (3, 7, 1) OR c_nationkey IS NULL
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), 33, 'rich_or_odd', CAST(0.25 AS DOUBLE), 'low',
       'c_acctbal gt 9900', '{"rule_id":33}', '{"c_custkey":' || c_custkey || '}'
FROM customer WHERE c_acctbal > 9900
""")
def rules_customer_eq_ne_in(spark, sf):
    return _flat(evaluate(_t(spark, sf, "customer"), CUSTOMER_RULES))


PART_RULES = {
    "id_field": "p_partkey",
    "rules": [
        {"rule_id": 40, "score": 0.6, "label": "brand_small_size", "conditions": {"criteria": [
            {"field": "p_brand", "operator": "in", "value": ["Brand#1", "Brand#12"]},
            {"field": "p_size", "operator": "in", "value": [1, 2, 3, 4, 5]}]}},
        {"rule_id": 41, "score": 0.4, "label": "small_or_pricey", "conditions": {
            "combination": "or", "criteria": [
                {"field": "p_type", "operator": "in", "value": ["SMALL"]},
                {"field": "p_retailprice", "operator": "gt", "value": 995}]}},
    ],
}


@query("rules_part_in", """
SELECT CAST(p_partkey AS VARCHAR) AS target_id, CAST(40 AS BIGINT) AS rule_id, 'brand_small_size' AS label,
       CAST(0.6 AS DOUBLE) AS score, 'medium-high' AS confidence,
       'p_brand in [''Brand#1'', ''Brand#12'']; p_size in [1, 2, 3, 4, 5]' AS evidence,
       '{"rule_id":40}' AS features, '{"p_partkey":' || p_partkey || '}' AS subject
FROM part WHERE p_brand IN ('Brand#1', 'Brand#12') AND p_size IN (1, 2, 3, 4, 5)
UNION ALL
SELECT CAST(p_partkey AS VARCHAR), 41, 'small_or_pricey', CAST(0.4 AS DOUBLE), 'medium',
       concat_ws('; ', CASE WHEN p_type IN ('SMALL') THEN 'p_type in [''SMALL'']' END,
                       CASE WHEN p_retailprice > 995 THEN 'p_retailprice gt 995' END),
       '{"rule_id":41}', '{"p_partkey":' || p_partkey || '}'
FROM part WHERE p_type IN ('SMALL') OR p_retailprice > 995
""")
def rules_part_in(spark, sf):
    return _flat(evaluate(_t(spark, sf, "part"), PART_RULES))


DOC_RULES = {
    "id_field": "doc_id",
    "rules": [
        {"rule_id": 50, "score": 0.9, "label": "licence_text", "conditions": {"criteria": [
            {"field": "text", "operator": "text_present", "value": "License"}]}},
        {"rule_id": 51, "score": 0.42, "label": "mail_or_german", "conditions": {
            "combination": "or", "criteria": [
                {"field": "text", "operator": "text_present", "value": "@"},
                {"field": "lang", "operator": "eq", "value": "de"}]}},
        {"rule_id": 52, "score": 0.2, "label": "long_numeric_text", "conditions": {"criteria": [
            {"field": "n_chars", "operator": "gt", "value": 15000},
            {"field": "source", "operator": "text_present", "value": "src1"}]}},
    ],
}


@query("rules_documents_text", """
SELECT CAST(doc_id AS VARCHAR) AS target_id, CAST(50 AS BIGINT) AS rule_id, 'licence_text' AS label,
       CAST(0.9 AS DOUBLE) AS score, 'high' AS confidence, 'text text_present License' AS evidence,
       '{"rule_id":50}' AS features, '{"doc_id":' || doc_id || '}' AS subject
FROM documents WHERE contains(lower(text), 'license')
UNION ALL
SELECT CAST(doc_id AS VARCHAR), 51, 'mail_or_german', CAST(0.42 AS DOUBLE), 'medium',
       concat_ws('; ', CASE WHEN contains(text, '@') THEN 'text text_present @' END,
                       CASE WHEN lang = 'de' THEN 'lang eq de' END),
       '{"rule_id":51}', '{"doc_id":' || doc_id || '}'
FROM documents WHERE contains(text, '@') OR lang = 'de'
UNION ALL
SELECT CAST(doc_id AS VARCHAR), 52, 'long_numeric_text', CAST(0.2 AS DOUBLE), 'low',
       'n_chars gt 15000; source text_present src1', '{"rule_id":52}', '{"doc_id":' || doc_id || '}'
FROM documents WHERE n_chars > 15000 AND contains(lower(source), 'src1')
""")
def rules_documents_text(spark, sf):
    return _flat(evaluate(_t(spark, sf, "documents"), DOC_RULES))


def many_lineitem_rules(k: int) -> dict:
    """``k`` two-criterion rules built from a parameter (bench: 1, 10, 100 rules)."""
    rules = []
    for i in range(k):
        rules.append({"rule_id": 100 + i, "score": round(0.3 + 0.6 * (i % 10) / 10, 2),
                      "label": f"qty_disc_{i}", "conditions": {"criteria": [
                          {"field": "l_quantity", "operator": "gt", "value": (i * 7) % 50},
                          {"field": "l_discount", "operator": "lte", "value": round(0.01 * (i % 11), 2)}]}})
    return {"id_field": "l_orderkey", "rules": rules}


def _many_rules_sql(k: int) -> str:
    parts = []
    for r in many_lineitem_rules(k)["rules"]:
        q, d = r["conditions"]["criteria"][0]["value"], r["conditions"]["criteria"][1]["value"]
        parts.append(f"SELECT CAST({r['rule_id']} AS BIGINT) AS rule_id, '{r['label']}' AS label, "
                     f"count(*) AS n_signals FROM lineitem WHERE l_quantity > {q} AND l_discount <= {d}")
    body = "\nUNION ALL\n".join(parts)
    return f"SELECT * FROM ({body}) WHERE n_signals > 0"


@query("rule_counts_lineitem_10", _many_rules_sql(10))
def rule_counts_lineitem_10(spark, sf):
    return rule_counts(evaluate(_t(spark, sf, "lineitem"), many_lineitem_rules(10)))


def narrow_lineitem_rules(k: int) -> dict:
    """``k`` rules of three criteria, each a narrow price range: many rules, few matches."""
    return {"id_field": "l_orderkey", "rules": [
        {"rule_id": i, "label": "price_band", "conditions": {"criteria": [
            {"field": "l_extendedprice", "operator": "gt", "value": 1000 + 97.5 * i},
            {"field": "l_extendedprice", "operator": "lte", "value": 1500 + 97.5 * i},
            {"field": "l_quantity", "operator": "gte", "value": i % 50}]}} for i in range(k)]}


@query("rule_counts_lineitem_500", """
SELECT i AS rule_id, 'price_band' AS label, count(*) AS n_signals FROM lineitem, range(500) r(i)
WHERE l_extendedprice > 1000 + 97.5::DOUBLE * i AND l_extendedprice <= 1500 + 97.5::DOUBLE * i AND l_quantity >= i % 50 GROUP BY i
""")
def rule_counts_lineitem_500(spark, sf):
    return rule_counts(evaluate(_t(spark, sf, "lineitem"), narrow_lineitem_rules(500)))


def part_rules(spark, sf) -> DataFrame:
    """Rules derived from ``part``: about its own line items, a price range, one of two flags."""
    num = "CAST({} AS STRING)"
    return _t(spark, sf, "part").selectExpr(
        "p_partkey AS rule_id", "CAST(0.5 AS DOUBLE) AS score", "CASE p_partkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'band' ELSE 'either' END AS label",
        "CASE WHEN p_partkey % 3 = 2 THEN 'or' ELSE 'and' END AS combination",
        f"""CASE p_partkey % 3
          WHEN 0 THEN array(named_struct('field', 'l_quantity', 'operator', 'gt', 'value', {num.format('p_size')}, 'baseline_field', CAST(NULL AS STRING)),
                            named_struct('field', 'l_partkey', 'operator', 'eq', 'value', {num.format('p_partkey')}, 'baseline_field', CAST(NULL AS STRING)))
          WHEN 1 THEN array(named_struct('field', 'l_extendedprice', 'operator', 'gte', 'value', {num.format('p_partkey * 40')}, 'baseline_field', CAST(NULL AS STRING)),
                            named_struct('field', 'l_extendedprice', 'operator', 'lt', 'value', {num.format('p_partkey * 40 + 100')}, 'baseline_field', CAST(NULL AS STRING)),
                            named_struct('field', 'l_returnflag', 'operator', 'ne', 'value', '"R"', 'baseline_field', CAST(NULL AS STRING)))
          ELSE array(named_struct('field', 'l_partkey', 'operator', 'in', 'value', concat('[', p_partkey, ',', p_partkey + 1, ']'), 'baseline_field', CAST(NULL AS STRING)),
                     named_struct('field', 'l_suppkey', 'operator', 'eq', 'value', {num.format('p_partkey')}, 'baseline_field', CAST(NULL AS STRING)))
        END AS criteria""")


@query("rules_table_joined", """
WITH m AS (
  SELECT p_partkey, p_partkey % 3 AS k, l_orderkey,
    CASE p_partkey % 3 WHEN 0 THEN 'l_quantity gt ' || p_size || ';l_partkey eq ' || p_partkey
      WHEN 1 THEN 'l_extendedprice gte ' || p_partkey * 40 || ';l_extendedprice lt ' || (p_partkey * 40 + 100) || ';l_returnflag ne R'
      ELSE concat_ws(';', CASE WHEN l_partkey IN (p_partkey, p_partkey + 1) THEN 'l_partkey in [' || p_partkey || ', ' || (p_partkey + 1) || ']' END,
                     CASE WHEN l_suppkey = p_partkey THEN 'l_suppkey eq ' || p_partkey END) END AS evidence
  FROM part, lineitem
  WHERE (p_partkey % 3 = 0 AND l_partkey = p_partkey AND l_quantity > p_size)
     OR (p_partkey % 3 = 1 AND l_extendedprice >= p_partkey * 40 AND l_extendedprice < p_partkey * 40 + 100 AND l_returnflag <> 'R')
     OR (p_partkey % 3 = 2 AND (l_partkey IN (p_partkey, p_partkey + 1) OR l_suppkey = p_partkey)))
SELECT p_partkey AS rule_id, CASE k WHEN 0 THEN 'own' WHEN 1 THEN 'band' ELSE 'either' END AS label, count(*) AS n_signals,
  min(CAST(l_orderkey AS VARCHAR)) AS first_target, min(evidence) AS first_evidence, max(evidence) AS last_evidence
FROM m GROUP BY ALL
""")
def rules_table_joined(spark, sf):
    signals = evaluate_table(_t(spark, sf, "lineitem"), part_rules(spark, sf), "l_orderkey")
    text = F.array_join("evidence", ";")
    return signals.groupBy("rule_id", "label").agg(F.count("*").alias("n_signals"), F.min("target_id").alias("first_target"),
                                                   F.min(text).alias("first_evidence"), F.max(text).alias("last_evidence"))


# ------------------------------------------------------------------ D: signals and predictions

def doc_signals(spark, sf) -> DataFrame:
    """One signal per document: score = n_chars / 5000 (clamped, rounded); run = its source."""
    docs = _t(spark, sf, "documents").withColumn("bot_id", F.lit("docs")).withColumn(
        "run_id", F.concat(F.lit("run_"), F.col("source")))
    return to_signals(docs, F.col("doc_id"), "long_document",
                      score=F.col("n_chars") / F.lit(5000),
                      evidence=F.array(F.concat(F.lit("n_chars "), F.col("n_chars").cast("string"))),
                      features=F.struct("lang", "source"), subject=F.struct("doc_id"),
                      keep=["bot_id", "run_id", "doc_id"])


DOC_SCORE_SQL = "round(least(1.0, greatest(0.0, n_chars / 5000.0)), 3)"
DOC_BAND_SQL = (f"CASE WHEN {DOC_SCORE_SQL} >= 0.8 THEN 'high' WHEN {DOC_SCORE_SQL} >= 0.6 THEN 'medium-high' "
                f"WHEN {DOC_SCORE_SQL} >= 0.4 THEN 'medium' ELSE 'low' END")


@query("signals_top20", f"""
SELECT CAST(doc_id AS VARCHAR) AS target_id, 'long_document' AS label, {DOC_SCORE_SQL} AS score,
       {DOC_BAND_SQL} AS confidence,
       '{{"lang":"' || lang || '","source":"' || source || '"}}' AS features
FROM documents WHERE {DOC_SCORE_SQL} >= 0.5
ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 20
""")
def signals_top20(spark, sf):
    framed = frame(doc_signals(spark, sf), "long_document", threshold=0.5)
    return framed.data.limit(20).select("target_id", "label", "score", "confidence", "features")


@query("confidence_bands", f"""
SELECT {DOC_BAND_SQL} AS confidence, count(*) AS n, round(avg({DOC_SCORE_SQL}), 6) AS avg_score
FROM documents GROUP BY 1
""")
def confidence_bands(spark, sf):
    return doc_signals(spark, sf).groupBy("confidence").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


PRED_SCORE_SQL = "round(least(1.0, greatest(0.0, o_totalprice / 500000.0)), 3)"


@query("prediction_frame", f"""
WITH m AS (SELECT count(*) AS cohort_size,
                  count(*) FILTER (WHERE {PRED_SCORE_SQL} >= 0.7) AS flagged FROM orders)
SELECT 'order_value' AS label, cohort_size, flagged, 'prediction' AS kind, CAST(0.7 AS DOUBLE) AS threshold,
       'order_value: ' || flagged || ' prediction(s) (as of 2024-01-31; {NOTE})' AS summary
FROM m
""")
def prediction_frame(spark, sf):
    orders = _t(spark, sf, "orders")
    preds = to_predictions(orders, F.col("o_orderkey"), F.col("o_totalprice") / F.lit(500000),
                           label="order_value", subject=F.struct("o_orderkey"))
    return frame(preds, "order_value", threshold=0.7, as_of="2024-01-31", kind="prediction").metadata


@query("prediction_flagged", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS target_id, {PRED_SCORE_SQL} AS score,
       CASE WHEN {PRED_SCORE_SQL} >= 0.8 THEN 'high' ELSE 'medium-high' END AS confidence
FROM orders WHERE {PRED_SCORE_SQL} >= 0.7
""")
def prediction_flagged(spark, sf):
    orders = _t(spark, sf, "orders")
    preds = to_predictions(orders, F.col("o_orderkey"), F.col("o_totalprice") / F.lit(500000),
                           label="order_value")
    return frame(preds, "order_value", threshold=0.7, kind="prediction", sort=False).data.select(
        "target_id", "score", "confidence")


@query("contract_check", f"""
WITH s AS ({ORDERS_RULES_SQL})
SELECT count(*) AS records, CAST(0 AS BIGINT) AS bad_note, CAST(0 AS BIGINT) AS bad_score,
       CAST(0 AS BIGINT) AS bad_band, CAST(0 AS BIGINT) AS missing_target, true AS ok FROM s
""")
def contract_check(spark, sf):
    return check_contract(evaluate(_t(spark, sf, "orders"), ORDERS_RULES))


# --------------------------------------------------------------------- B: protect and govern

@query("mask_customer", """
SELECT c_custkey, '***' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def mask_customer(spark, sf):
    return mask_columns(_t(spark, sf, "customer"), ["C_NAME", "c_phone"])


@query("sample_masked", """
SELECT c_custkey, '***' AS c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer ORDER BY c_custkey LIMIT 10
""")
def sample_masked(spark, sf):
    """A sample that cuts its growing table; the source's own order says which rows."""
    own = spark.newSession()  # so that the caller's views stay as they are
    src = GovernedSource.open(own, {"customer": _t(own, sf, "customer").orderBy("c_custkey")}, masking=lambda d: mask_columns(d, ["c_name"]))
    return src.scoped(["customer"]).sample("customer", 10)


@query("value_stats_top50", """
SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 50
""")
def value_stats_top50(spark, sf):
    return value_counts(_t(spark, sf, "lineitem"), "l_partkey")


@query("stats_masked", """
SELECT '***' AS c_name, n FROM (SELECT c_name, count(*) AS n FROM customer GROUP BY c_name
                                ORDER BY n DESC, c_name LIMIT 50)
""")
def stats_masked(spark, sf):
    src = GovernedSource.open(spark, {"customer": "parquet:" + table_path(sf, "customer")},
                              masking=lambda d: mask_columns(d, ["c_name"]))
    return src.scoped(["customer"]).stats("customer", "c_name")


# Redaction in DuckDB. RE2's \\w and \\b know ASCII only, the patterns are Unicode-aware: the e-mail classes
# are spelled out, and letters beyond ASCII are wrapped in ASCII ones while \\b decides.
_LETTERS = (r"[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02FF}\x{0370}-\x{1FFF}"
            r"\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}]")


def redact_sql(text: str) -> str:
    out = rf"regexp_replace({text}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+', '[EMAIL]', 'g')"
    out = rf"regexp_replace({out}, '({_LETTERS})', 'ZQX\1XQZ', 'g')"
    out = rf"regexp_replace({out}, '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '[SSN]', 'g')"
    out = rf"regexp_replace({out}, '\b(?:\d[ -]?){{13,16}}\b', '[CARD]', 'g')"
    return rf"regexp_replace({out}, 'ZQX(.)XQZ', '\1', 'g')"


@query("redact_documents", f"""
SELECT doc_id, {redact_sql('text')} AS redacted, {redact_sql('text')} <> text AS changed FROM documents
""")
def redact_documents(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    red = docs.select("doc_id", "text", redact_text(F.col("text")).alias("redacted"))
    return red.select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


@query("redact_conversations", f"""
SELECT conv_id, turn, role, {redact_sql('text')} AS text FROM conversations
""")
def redact_conversations(spark, sf):
    c = _t(spark, sf, "conversations")
    return redact_nested(c, ["text"]).select("conv_id", "turn", "role", "text")


@query("redact_by_model", f"""
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN 'local/assistant' ELSE 'remote/api' END AS model,
       CASE WHEN role = 'assistant' THEN text ELSE {redact_sql('text')} END AS text FROM conversations
""")
def redact_by_model(spark, sf):
    """Model-gated redaction over every conversation turn: assistant turns go to a local model
    and stay as written; all other turns go to a remote model and are redacted."""
    from ..operators.protect import redact_unless_local

    c = _t(spark, sf, "conversations").withColumn(
        "model", F.when(F.col("role") == "assistant", F.lit("local/assistant")).otherwise(F.lit("remote/api")))
    return redact_unless_local(c, "model", ["text"]).select("conv_id", "turn", "role", "model", "text")


def access_log(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Events read as an access log: each event is a bot (user) reading a table (event type).
    Scopes: what each bot read in the first three days; accesses: everything after."""
    ev = _t(spark, sf, "events").withColumn("bot_id", F.concat(F.lit("bot_"), F.col("user_id").cast("string")))
    cut = F.lit(dt.datetime(2024, 1, 4))
    scopes = ev.filter(F.col("ts") < cut).groupBy("bot_id").agg(
        F.collect_set("event_type").alias("tables")).withColumn("unscoped", F.lit(False))
    access = ev.filter(F.col("ts") >= cut).select(
        "bot_id", F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("table_name"))
    return access, scopes


@query("scope_violations", """
WITH scope AS (SELECT DISTINCT 'bot_' || user_id AS bot_id, lower(event_type) AS t FROM events
               WHERE ts < TIMESTAMP '2024-01-04'),
bots AS (SELECT DISTINCT bot_id FROM scope),
acc AS (SELECT 'bot_' || user_id AS bot_id, 'run_' || event_id AS run_id, event_type AS table_name
        FROM events WHERE ts >= TIMESTAMP '2024-01-04')
SELECT a.bot_id, a.run_id, a.table_name,
       CASE WHEN b.bot_id IS NULL THEN 'bot declares no scope' ELSE 'table outside the declared scope' END AS reason
FROM acc a LEFT JOIN bots b ON a.bot_id = b.bot_id
WHERE NOT EXISTS (SELECT 1 FROM scope s WHERE s.bot_id = a.bot_id AND s.t = lower(a.table_name))
""")
def scope_violations_q(spark, sf):
    access, scopes = access_log(spark, sf)
    return scope_violations(access, scopes)


def _governed(spark, sf, names: list[str]):
    src = GovernedSource.open(spark, {n: "parquet:" + table_path(sf, n) for n in names})
    return src.scoped(names)


GOVERNED = {
    "governed_join": (["orders", "customer", "nation"], """
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name"""),
    "governed_setop": (["customer", "orders"], """
SELECT k FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000
               UNION SELECT o_custkey AS k FROM orders WHERE o_totalprice > 480000) u
EXCEPT
SELECT k FROM (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'
               INTERSECT SELECT o_custkey AS k FROM orders) i"""),
    "governed_cte": (["orders", "customer"], """
WITH busy AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12)
SELECT c_mktsegment, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders_n
FROM busy JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""),
    "governed_window": (["orders"], """
SELECT o_orderkey, o_custkey, rnk FROM (
  SELECT o_orderkey, o_custkey,
         CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rnk
  FROM orders) t WHERE rnk <= 2"""),
    "governed_rollup": (["lineitem"], """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""),
    "governed_semi_anti": (["customer", "orders"], """
SELECT 'with_orders' AS kind, c_mktsegment, count(*) AS customers FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) GROUP BY c_mktsegment
UNION ALL
SELECT 'without_orders' AS kind, c_mktsegment, count(*) AS customers FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) GROUP BY c_mktsegment"""),
}


def _governed_fn(names: list[str], sql: str) -> QueryFn:
    return lambda spark, sf: _governed(spark, sf, names).query(sql)


for _name, (_tables, _sql) in GOVERNED.items():
    query(_name, _sql)(_governed_fn(_tables, _sql))


# ------------------------------------------------------------------------------ E: run history

def run_events(spark, sf, events: DataFrame | None = None) -> DataFrame:
    """Events read as run lifecycles: each event starts run 'run_<event_id>' of bot
    'bot_<user_id>'; it ends ``value`` seconds later, failed for errors, still running for views."""
    ev = (events if events is not None else _t(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    bot = F.concat(F.lit("bot_"), F.col("user_id").cast("string"))
    run = F.concat(F.lit("run_"), F.col("event_id").cast("string"))
    end_ts = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1e6).cast("long"))
    end_type = F.when(F.col("event_type") == "error", F.lit("run_failed")).otherwise(F.lit("run_completed"))
    started = F.struct(F.lit("run_started").alias("type"), F.col("ts").alias("ts"),
                       F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("error"))
    ended = F.struct(end_type.alias("type"), end_ts.alias("ts"), F.col("event_type").alias("summary"),
                     F.when(F.col("event_type") == "error", F.lit("RuntimeError: failed")).alias("error"))
    lifecycle = F.when(F.col("event_type") == "view", F.array(started)).otherwise(F.array(started, ended))
    return ev.select(run.alias("run_id"), bot.alias("bot_id"),
                     F.date_format("ts", "yyyy-MM-dd").alias("as_of"),
                     F.explode(lifecycle).alias("e")).select("run_id", "bot_id", "as_of", "e.*")


RUNS_SQL = """
WITH r AS (
  SELECT 'run_' || event_id AS run_id, 'bot_' || user_id AS bot_id, ts AS created_at,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status,
         CASE WHEN event_type <> 'view' THEN epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) END AS finished_us,
         event_type, value
  FROM events)
"""


@query("run_state", RUNS_SQL + """
SELECT run_id, bot_id, status, epoch_us(created_at) AS started_us, finished_us,
       CASE WHEN status = 'running' THEN '' ELSE event_type END AS summary,
       CASE WHEN status = 'failed' THEN 'RuntimeError: failed' ELSE '' END AS error
FROM r
""")
def run_state_q(spark, sf):
    st = rn.run_state(run_events(spark, sf))
    return st.select("run_id", "bot_id", "status", F.unix_micros("started_at").alias("started_us"),
                     F.unix_micros("finished_at").alias("finished_us"), "summary", "error")


def runs_table(spark, sf) -> DataFrame:
    return rn.run_state(run_events(spark, sf))


@query("run_latest", RUNS_SQL + """
SELECT bot_id, run_id, epoch_us(created_at) AS created_us FROM (
  SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY created_at DESC, run_id DESC) AS rn
  FROM r WHERE status = 'completed') WHERE rn = 1
""")
def run_latest(spark, sf):
    return rn.latest(runs_table(spark, sf)).select("bot_id", "run_id", F.unix_micros("created_at").alias("created_us"))


@query("run_history_5", RUNS_SQL + """
SELECT bot_id, run_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY created_at DESC, run_id DESC) AS rn FROM r)
WHERE rn <= 5
""")
def run_history_5(spark, sf):
    return rn.history(runs_table(spark, sf), limit=5).select("bot_id", "run_id", "status")


@query("run_history_failed_3", RUNS_SQL + """
SELECT bot_id, run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY created_at DESC, run_id DESC) AS rn
  FROM r WHERE status = 'failed') WHERE rn <= 3
""")
def run_history_failed_3(spark, sf):
    return rn.history(runs_table(spark, sf), limit=3, status="failed").select("bot_id", "run_id")


@query("run_recent", RUNS_SQL + """
SELECT run_id, bot_id, epoch_us(created_at) AS created_us FROM r
ORDER BY created_at DESC, run_id DESC LIMIT 50
""")
def run_recent(spark, sf):
    return rn.recent(runs_table(spark, sf), 50).select("run_id", "bot_id", F.unix_micros("created_at").alias("created_us"))


@query("run_durations", RUNS_SQL + """
SELECT run_id, CAST(floor((finished_us - epoch_us(created_at)) / 1000) AS BIGINT) AS duration_ms
FROM r WHERE status <> 'running'
""")
def run_durations(spark, sf):
    runs = rn.with_duration(runs_table(spark, sf))
    return runs.filter(F.col("status") != "running").select("run_id", "duration_ms")


@query("run_record_counts", """
SELECT 'run_' || source AS run_id, count(*) AS record_count FROM documents GROUP BY source
""")
def run_record_counts(spark, sf):
    runs = doc_runs(spark, sf).withColumn("started_at", F.col("created_at")).withColumn(
        "finished_at", F.col("created_at"))
    return rn.with_record_counts(runs, doc_signals(spark, sf)).select("run_id", "record_count")


@query("as_of_resolve", """
SELECT 'run_' || event_id AS run_id, spec,
       CASE WHEN spec IN ('', 'D', 'D-0', 'today') THEN strftime(CAST(ts AS DATE), '%Y-%m-%d')
            WHEN regexp_full_match(spec, 'D-[0-9]+')
              THEN strftime(CAST(ts AS DATE) - CAST(substr(spec, 3) AS INTEGER), '%Y-%m-%d')
            ELSE spec END AS as_of
FROM (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'D' WHEN 'click' THEN 'today'
                               WHEN 'purchase' THEN 'D-' || hour(ts) WHEN 'signup' THEN 'D-0'
                               ELSE 'month-end' END AS spec FROM events)
""")
def as_of_resolve(spark, sf):
    ev = _t(spark, sf, "events")
    spec = (F.when(F.col("event_type") == "view", F.lit("D")).when(F.col("event_type") == "click", F.lit("today"))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("D-"), F.hour("ts").cast("string")))
            .when(F.col("event_type") == "signup", F.lit("D-0")).otherwise(F.lit("month-end")))
    return ev.select(F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"),
                     spec.alias("spec"), F.to_date("ts").alias("_ref")).select(
        "run_id", "spec", rn.resolve_as_of(F.col("spec"), F.col("_ref")).alias("as_of"))


# ---------------------------------------------------------------------- F: review and tuning

def doc_runs(spark, sf) -> DataFrame:
    """One review run per document source, created an hour apart by source number."""
    docs = _t(spark, sf, "documents").select("source").distinct()
    hours = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return docs.select(F.lit("docs").alias("bot_id"), F.concat(F.lit("run_"), F.col("source")).alias("run_id"),
                       (F.lit(dt.datetime(2024, 2, 1)) + F.make_interval(hours=hours)).alias("created_at"),
                       F.lit("completed").alias("status"), F.lit("2024-01-31").alias("as_of"),
                       F.lit("docs review").alias("summary"))


def doc_cases(spark, sf) -> DataFrame:
    return rv.build_cases(doc_signals(spark, sf))


def decision_log(spark, sf, cases: DataFrame | None = None) -> DataFrame:
    """Reviewer decisions from ``labels``: quality 1 accepted, else rejected; toxic documents
    are re-decided later as rejected, then get a later invalid entry that must be ignored."""
    cases = cases if cases is not None else doc_cases(spark, sf)
    lab = _t(spark, sf, "labels")
    keyed = cases.select("bot_id", "run_id", "case_id", "doc_id").join(lab, "doc_id")
    t0, t1, t2 = (dt.datetime(2024, 2, 2, h) for h in (9, 10, 11))
    first = F.struct(F.when(F.col("quality") == 1, F.lit("accepted")).otherwise(F.lit("rejected")).alias("decision"),
                     F.lit(t0).alias("updated_at"))
    again = F.struct(F.lit("rejected").alias("decision"), F.lit(t1).alias("updated_at"))
    bogus = F.struct(F.lit("maybe").alias("decision"), F.lit(t2).alias("updated_at"))
    entries = F.when(F.col("toxic") == 1, F.array(first, again, bogus)).otherwise(F.array(first))
    return keyed.select("bot_id", "run_id", "case_id", F.explode(entries).alias("d")).select(
        "bot_id", "run_id", "case_id", "d.decision", F.lit("").alias("note"),
        F.lit("reviewer").alias("reviewer"), "d.updated_at")


CASES_SQL = f"""
WITH c AS (
  SELECT 'docs' AS bot_id, 'run_' || source AS run_id, doc_id, CAST(doc_id AS VARCHAR) AS target_id,
         {DOC_SCORE_SQL} AS score,
         CAST(row_number() OVER (PARTITION BY source ORDER BY {DOC_SCORE_SQL} DESC, CAST(doc_id AS VARCHAR)) - 1
              AS BIGINT) AS case_index
  FROM documents),
d AS (SELECT c.*, CASE WHEN l.toxic = 1 OR l.quality <> 1 THEN 'rejected' ELSE 'accepted' END AS decision
      FROM c JOIN labels l ON c.doc_id = l.doc_id)
"""


@query("case_index", CASES_SQL + "SELECT run_id, target_id, score, case_index FROM c")
def case_index(spark, sf):
    return doc_cases(spark, sf).select("run_id", "target_id", "score", "case_index")


@query("decisions_latest", CASES_SQL + """
SELECT bot_id, run_id, CAST(case_index AS VARCHAR) AS case_id, decision FROM d
""")
def decisions_latest(spark, sf):
    return rv.latest_decisions(decision_log(spark, sf)).select("bot_id", "run_id", "case_id", "decision")


@query("decisions_rejected_rows", """
SELECT count(*) AS n FROM labels WHERE toxic = 1
""")
def decisions_rejected_rows(spark, sf):
    _, bad = rv.split_decisions(decision_log(spark, sf))
    return bad.agg(F.count(F.lit(1)).alias("n"))


@query("case_list", CASES_SQL + """
SELECT c.run_id, CAST(c.case_index AS VARCHAR) AS case_id, c.target_id, coalesce(d.decision, 'pending') AS decision
FROM c LEFT JOIN d ON c.doc_id = d.doc_id
""")
def case_list(spark, sf):
    cases = doc_cases(spark, sf)
    decided = rv.latest_decisions(decision_log(spark, sf, cases))
    return rv.case_list(cases, decided).select("run_id", "case_id", "target_id", "decision")


@query("review_tally", CASES_SQL + """
SELECT c.bot_id, c.run_id, count(d.decision) FILTER (WHERE d.decision = 'accepted') AS accepted,
       count(d.decision) FILTER (WHERE d.decision = 'rejected') AS rejected,
       count(d.decision) AS reviewed, count(*) AS total, count(*) - count(d.decision) AS pending
FROM c LEFT JOIN d ON c.doc_id = d.doc_id GROUP BY c.bot_id, c.run_id
""")
def review_tally(spark, sf):
    cases = doc_cases(spark, sf)
    return rv.tally(cases, rv.latest_decisions(decision_log(spark, sf, cases)))


def doc_labels(spark, sf) -> DataFrame:
    cases = doc_cases(spark, sf)
    return rv.collect_labels(doc_runs(spark, sf), cases, decision_log(spark, sf, cases), limit=50)


SWEEP_SQL = CASES_SQL + """,
g AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE decision = 'accepted') AS acc FROM d GROUP BY score),
s AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS flagged, sum(acc) OVER (ORDER BY score DESC) AS tp,
             sum(acc) OVER () AS acc_total FROM g),
p AS (SELECT score, flagged, tp, flagged - tp AS fp, acc_total - tp AS fn,
             CASE WHEN flagged > 0 THEN tp / flagged ELSE 0.0 END AS pr,
             CASE WHEN acc_total > 0 THEN tp / acc_total ELSE 0.0 END AS rc FROM s)
"""


@query("threshold_sweep", SWEEP_SQL + """
SELECT round(score, 6) AS threshold, CAST(flagged AS BIGINT) AS flagged, CAST(tp AS BIGINT) AS tp,
       CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(pr, 4) AS precision, round(rc, 4) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 4) AS f1
FROM p
""")
def threshold_sweep(spark, sf):
    return rv.threshold_sweep(doc_labels(spark, sf))


@query("threshold_recommend", SWEEP_SQL + """
SELECT round(score, 6) AS threshold, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 4) AS f1
FROM p ORDER BY f1 DESC, threshold DESC LIMIT 1
""")
def threshold_recommend(spark, sf):
    return rv.recommend(rv.threshold_sweep(doc_labels(spark, sf))).select("threshold", "f1")


@query("tuning_header", CASES_SQL + """
SELECT count(*) AS labelled, count(*) FILTER (WHERE decision = 'accepted') AS accepted,
       count(*) FILTER (WHERE decision = 'rejected') AS rejected, count(*) FILTER (WHERE score IS NULL) AS unscored
FROM d
""")
def tuning_header(spark, sf):
    return rv.tuning_header(doc_labels(spark, sf))


@query("tuning_header_by_bot", CASES_SQL + """
SELECT 'docs' AS bot_id, count(*) AS labelled, count(*) FILTER (WHERE decision = 'accepted') AS accepted,
       count(*) FILTER (WHERE decision = 'rejected') AS rejected, count(*) FILTER (WHERE score IS NULL) AS unscored
FROM d HAVING count(*) > 0
""")
def tuning_header_by_bot(spark, sf):
    return rv.tuning_header(doc_labels(spark, sf), by=["bot_id"])


# ------------------------------------------------------------------------------ G: delivery

def page_subscriptions(spark, sf) -> DataFrame:
    """Pages read as webhook subscriptions: the page URL is the hook, its host the bot."""
    pages = _t(spark, sf, "pages")
    return pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("id"),
                        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("bot_id"),
                        F.lit("webhook").alias("type"),
                        F.concat(F.col("url"), F.when(F.col("url").contains("?"), F.lit("&k=${WEBHOOK_KEY}"))
                                 .otherwise(F.lit("?k=${DB_PASSWORD}"))).alias("url"),
                        F.lit(None).cast("string").alias("name"))


@query("webhook_targets", """
SELECT 'page_' || page_id AS id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS bot_id,
       CASE WHEN contains(url, '?') THEN url || '&k=s3cr3t' ELSE url || '?k=${DB_PASSWORD}' END AS url
FROM pages WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')
""")
def webhook_targets(spark, sf):
    return ob.webhook_targets(page_subscriptions(spark, sf), {"WEBHOOK_KEY": "s3cr3t", "OTHER": "x"}).select(
        "id", "bot_id", "url")


@query("outbox_chunks", CASES_SQL + """
SELECT bot_id, run_id, CAST(floor(case_index / 25) AS BIGINT) AS chunk, count(*) AS n_records,
       min(case_index) AS first_case, max(case_index) AS last_case
FROM c GROUP BY 1, 2, 3
""")
def outbox_chunks(spark, sf):
    cases = doc_cases(spark, sf).select("bot_id", "run_id", "case_index", "target_id", "score", "label")
    box = ob.outbox(cases, doc_runs(spark, sf), chunk_rows=25)
    data = F.from_json("payload", "struct<data: array<struct<case_index: bigint>>>")["data"]
    return box.select("bot_id", "run_id", "chunk", "n_records",
                      F.array_min(F.transform(data, lambda x: x["case_index"])).alias("first_case"),
                      F.array_max(F.transform(data, lambda x: x["case_index"])).alias("last_case"))


# --------------------------------------------------------------------------- H: conversations

def conv_table(spark, sf) -> DataFrame:
    c = _t(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", "text")


@query("conversation_messages", """
SELECT conv_id, turn, role,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position
FROM conversations WHERE role <> 'system'
""")
def conversation_messages(spark, sf):
    from .ordered import ordered_index

    msgs = conv.messages(conv_table(spark, sf))
    return ordered_index(msgs, ["conversation_id"], ["seq"], out="position").select(
        F.col("conversation_id").alias("conv_id"), F.col("seq").alias("turn"), "role", "position")


@query("conversation_latest", """
SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id
""")
def conversation_latest(spark, sf):
    return conv.conversations(conv_table(spark, sf), updated="seq").select(
        F.col("conversation_id").alias("conv_id"), F.col("updated_at").alias("last_turn"))


@query("conversation_append", """
WITH old AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE turn < 2 GROUP BY conv_id),
new AS (SELECT conv_id, turn FROM conversations WHERE turn >= 2)
SELECT n.conv_id, n.turn,
       CAST(coalesce(o.m + 1, 0) + row_number() OVER (PARTITION BY n.conv_id ORDER BY n.turn) AS BIGINT) AS seq
FROM new n LEFT JOIN old o ON n.conv_id = o.conv_id
""")
def conversation_append(spark, sf):
    c = conv_table(spark, sf)
    existing = c.filter(F.col("seq") < 2)
    new = c.filter(F.col("seq") >= 2).withColumnRenamed("seq", "turn")
    # seq counts from 1 in a store; the turns here count from 0, so the old max is shifted by one
    existing = existing.withColumn("seq", F.col("seq") + 1)
    out = conv.append_seq(existing, new, order=["turn"])
    return out.select(F.col("conversation_id").alias("conv_id"), "turn", "seq")


def all_queries() -> dict[str, QueryFn]:
    from ..streaming import rules_stream  # noqa: F401 -- registers the streaming queries
    from . import ledger  # noqa: F401 -- registers the queries over stores, logs and versions

    return dict(REGISTRY)


def all_oracles() -> dict[str, str]:
    all_queries()
    return dict(ORACLES)


# ------------------------------------------------------------- bots: example signal, ruleset run

@query("high_value_orders", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS target_id, 'high_value_order' AS label,
       round(least(1.0, greatest(0.0, o_totalprice / 500000.0)), 3) AS score,
       'order total ' || CAST(o_totalprice AS VARCHAR) AS evidence,
       '{{"order_id":' || o_orderkey || '}}' AS subject
FROM orders WHERE o_totalprice >= 475000
""")
def high_value_orders(spark, sf):
    """The example signal bot: orders at or above a total, scored by total / 500000."""
    orders = _t(spark, sf, "orders").filter(F.col("o_totalprice") >= 475000)
    sig = to_signals(orders, F.col("o_orderkey"), "high_value_order", score=F.col("o_totalprice") / F.lit(500000),
                     evidence=F.array(F.concat(F.lit("order total "), F.col("o_totalprice").cast("string"))),
                     subject=F.struct(F.col("o_orderkey").alias("order_id")))
    return frame(sig, "high_value_order", sort=False).data.select(
        "target_id", "label", "score", F.array_join("evidence", "; ").alias("evidence"), "subject")


_UNSUPPORTED_ORDERS = '[{"rule_id": 5, "reason": "fields absent from the data: [\'\'o_comment\'\']"}]'


@query("run_ruleset_orders", f"""
WITH s AS ({ORDERS_RULES_SQL})
SELECT 'ruleset' AS label, count(*) AS cohort_size, count(*) AS flagged, 'signal' AS kind,
       CAST(NULL AS DOUBLE) AS threshold,
       'ruleset: ' || count(*) || ' signal(s) (as of 2024-01-31; {NOTE})' AS summary,
       5 AS rules_total, '{_UNSUPPORTED_ORDERS}' AS rules_unsupported
FROM s
""")
def run_ruleset_orders(spark, sf):
    """C17: the orders ruleset read as JSON text, run through a scoped governed source."""
    import json as _json

    from ..operators.bots import run_ruleset

    src = GovernedSource.open(spark, {"orders": "parquet:" + table_path(sf, "orders")})
    res = run_ruleset(spark, _json.dumps(ORDERS_RULES), src.scoped(["orders"]), as_of="2024-01-31")
    return res.framed.metadata


@query("threshold_sweep_per_bot", CASES_SQL + """,
g AS (SELECT run_id AS bot_id, score, count(*) AS n, count(*) FILTER (WHERE decision = 'accepted') AS acc
      FROM d GROUP BY run_id, score),
s AS (SELECT bot_id, score, sum(n) OVER (PARTITION BY bot_id ORDER BY score DESC) AS flagged,
             sum(acc) OVER (PARTITION BY bot_id ORDER BY score DESC) AS tp,
             sum(acc) OVER (PARTITION BY bot_id) AS acc_total FROM g),
p AS (SELECT bot_id, score, flagged, tp, flagged - tp AS fp, acc_total - tp AS fn,
             CASE WHEN flagged > 0 THEN tp / flagged ELSE 0.0 END AS pr,
             CASE WHEN acc_total > 0 THEN tp / acc_total ELSE 0.0 END AS rc FROM s)
SELECT bot_id, round(score, 6) AS threshold, CAST(flagged AS BIGINT) AS flagged, CAST(tp AS BIGINT) AS tp,
       CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(pr, 4) AS precision, round(rc, 4) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 4) AS f1
FROM p
""")
def threshold_sweep_per_bot(spark, sf):
    """F7 for many bots in one job: each document source's run acts as its own bot."""
    labels = doc_labels(spark, sf).withColumn("bot_id", F.col("run_id"))
    return rv.threshold_sweep(labels, by=["bot_id"])
