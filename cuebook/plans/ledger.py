"""Queries over stores, logs and versions, all derived from the driver tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bots, outbox, review, rules, runs
from ..operators.protect import mask_columns, redact_nested, redact_unless_local
from ..operators.signals import frame, to_signals
from ..session import scratch_path
from ..operators.top_values import top_values
from ..sources.governed import AuditLog, GovernedSource, masked_query, truncated
from ..sources.review_store import ReviewStore
from ..sources.sinks import replace_run, to_json_rows, write_signals
from .catalog import (CASES_SQL, ORACLES, ORDERS_RULES, RUNS_SQL, _t, decision_log, doc_cases, page_subscriptions, query, redact_sql, runs_table,
                      table_path)


def _source(spark: SparkSession, sf: str, *names: str, **how) -> GovernedSource:
    return GovernedSource.open(spark, {n: "parquet:" + table_path(sf, n) for n in names}, **how)


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


# --------------------------------------------------------------------------------- governed reads

@query("governed_sample", "SELECT count(*) // 2 AS n_rows, count(*) // 2 AS n_known, 0 AS n_unmasked, 0 AS n_twice FROM orders")
def governed_sample(spark, sf):
    """Half of the orders, and what holds whichever they are: how many, all of them orders, none twice, all masked."""
    src = _source(spark, sf, "orders", masking=lambda d: mask_columns(d, ["o_clerk", "o_orderpriority"]))
    orders = src.tables["orders"]
    got = src.scoped(["orders"]).sample("orders", orders.count() // 2)
    known = got.join(orders.select("o_orderkey", F.lit(1).alias("known")), "o_orderkey", "left")
    return known.agg(F.count("*").alias("n_rows"), F.count("known").alias("n_known"),
                     F.count_if(F.col("o_orderpriority") != "***").alias("n_unmasked"),
                     (F.count("*") - F.countDistinct("o_orderkey")).alias("n_twice"))


@query("governed_masked_query", """
SELECT c_mktsegment, '***' AS c_name, c_acctbal FROM customer WHERE c_acctbal > 5000
""")
def governed_masked_query(spark, sf):
    src = _source(spark, sf, "customer").scoped(["customer"])
    return masked_query(src, "SELECT c_mktsegment, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000", ["C_NAME"])


@query("governed_truncated", """
SELECT o_orderkey, o_totalprice, true AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50
""")
def governed_truncated(spark, sf):
    src = _source(spark, sf, "orders").scoped(["orders"])
    return truncated(src.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"), 50)


@query("audit_entries", """
SELECT 'fetch' AS kind, 'nation' AS target, (SELECT count(*) FROM nation) AS row_count, 'ok' AS outcome
UNION ALL SELECT 'write', 'orders', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), 'ok'
UNION ALL SELECT 'query', 'orders', -1, 'planned'
UNION ALL SELECT 'query', 'orders', (SELECT count(*) FROM orders), 'read'
UNION ALL SELECT 'query', 'customer', -1, 'planned'
UNION ALL SELECT 'query', 'customer', 0, 'denied'
UNION ALL SELECT 'fetch', 'nation', 0, 'error'
""")
def audit_entries(spark, sf):
    """One row for each action, also for those refused and those that fail while they run."""
    audit = AuditLog(spark, _folder(spark, "audit"))
    src = _source(spark, sf, "nation", "orders", "customer", audit=audit, count_reads=True)
    src.fetch("SELECT * FROM nation", limit=1000)
    src.write("SELECT * FROM orders WHERE o_orderstatus = 'F'", _folder(spark, "audited"))
    src.query("SELECT * FROM orders").write.format("noop").mode("overwrite").save()
    src.query("SELECT * FROM customer")  # never read
    refused = PermissionError, PySparkException
    for act in (lambda: src.scoped(["orders"]).query("SELECT * FROM customer"),
                lambda: src.fetch("SELECT raise_error(n_name) FROM nation", limit=10)):
        try:
            act()
        except refused:
            pass  # what is wanted is its audit row
    return audit.entries().select("kind", "target", "row_count", "outcome")


@query("redact_json_payloads", f"""
SELECT conv_id, turn, {redact_sql('text')} AS text, {redact_sql('text')} AS listed, 'me@example.org' AS key, turn AS number, true AS same_shape
FROM conversations
""")
def redact_json_payloads(spark, sf):
    """Message payloads as free-form JSON text: strings redacted at any depth, keys and numbers as they were."""
    t = _t(spark, sf, "conversations")
    inner = F.struct(F.array(F.struct("text", F.lit(None).cast("int").alias("n")), F.struct(F.lit(None).cast("string").alias("text"), F.lit(1).alias("n"))).alias("parts"), F.col("turn").alias("me@example.org"))
    payload = F.to_json(F.struct("role", "text", inner.alias("body")))
    red = redact_nested(t.select("conv_id", "turn", payload.alias("payload")), [], json=["payload"])
    shape = "struct<role:string,text:string,body:struct<parts:array<struct<text:string,n:int>>,`me@example.org`:bigint>>"
    back = F.from_json("payload", shape)
    return red.select("conv_id", "turn", back["text"].alias("text"), back["body"]["parts"][0]["text"].alias("listed"),
                      F.when(F.contains("payload", F.lit('"me@example.org":')), F.lit("me@example.org")).alias("key"),
                      back["body"]["me@example.org"].alias("number"), (back["body"]["parts"][1]["n"] == 1).alias("same_shape"))


@query("redact_nested_documents", f"""
SELECT doc_id, {redact_sql('text')} AS in_list, {redact_sql('text')} AS in_map, {redact_sql('text')} AS in_struct, n_chars FROM documents
""")
def redact_nested_documents(spark, sf):
    """Texts inside an array of structs, a map, and a struct."""
    text = F.col("text")
    nested = _t(spark, sf, "documents").select("doc_id", "n_chars", F.struct(
        F.array(F.struct(text.alias("t"))).alias("l"), F.create_map(F.lit("k"), text).alias("m"), F.struct(text.alias("t")).alias("s")).alias("body"))
    out = redact_nested(nested, ["body"])
    return out.select("doc_id", F.col("body.l")[0]["t"].alias("in_list"), F.col("body.m")["k"].alias("in_map"), F.col("body.s.t").alias("in_struct"), "n_chars")


@query("redact_documents_by_model", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE {redact_sql('text')} END AS text FROM documents
""")
def redact_documents_by_model(spark, sf):
    model = F.when(F.col("doc_id") % 2 == 0, F.lit("local/small")).otherwise(F.lit("remote/large"))
    return redact_unless_local(_t(spark, sf, "documents").withColumn("model", model), "model", ["text"]).select("doc_id", "text")


@query("json_rows", """
SELECT '{"event_id":' || event_id || ',"ts":"' || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') || '","day":"' ||
       strftime(ts, '%Y-%m-%d') || '","hour":"' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') || '","who":' ||
       CASE WHEN event_type = 'view' THEN 'null' ELSE '{"id":' || user_id || '}' END || '}' AS record FROM events
""")
def json_rows(spark, sf):
    ev = _t(spark, sf, "events")
    who = F.when(F.col("event_type") != "view", F.struct(F.col("user_id").alias("id")))
    return to_json_rows(ev.select("event_id", "ts", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"), who.alias("who")))


# ---------------------------------------------------------------- tables, schemas and value counts

LISTED = ("customer", "documents", "events", "nation", "orders")


def _filled_sql(names) -> str:
    """``tab, col, ordinal, n_filled`` of every column of the named tables."""
    counts = " UNION ALL ".join(f"SELECT '{n}' AS tab, name AS col, n_filled FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {n}) ON COLUMNS(*) INTO NAME name VALUE n_filled)"
                                for n in names)
    return (f"SELECT c.tab, c.col, i.ordinal_position - 1 AS ordinal, c.n_filled FROM ({counts}) c "
            "JOIN information_schema.columns i ON i.table_name = c.tab AND i.column_name = c.col")


def _filled(schema: DataFrame, src: GovernedSource) -> DataFrame:
    """A listed schema with the filled values of each column: one aggregate a table."""
    tables = {r.table: src.tables[r.table] for r in schema.select("table").distinct().collect()}
    parts = [df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n_filled").withColumn("table", F.lit(n))
             for n, df in sorted(tables.items())]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return schema.join(counts, ["table", "column"]).select(F.col("table").alias("tab"), F.col("column").alias("col"), "ordinal", "n_filled")


@query("tables_listed", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in LISTED))
def tables_listed(spark, sf):
    """The tables that a source lists, each with its rows."""
    src = _source(spark, sf, *LISTED)
    names = [r.name for r in src.list_tables().orderBy("name").collect()]
    counted = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in names)
    return src.query(counted)


@query("table_schemas", _filled_sql(LISTED))
def table_schemas(spark, sf):
    src = _source(spark, sf, *LISTED)
    return _filled(src.schema(), src)


@query("scoped_schemas", _filled_sql(("documents", "orders")))
def scoped_schemas(spark, sf):
    """A scope lists the declared tables only."""
    src = _source(spark, sf, *LISTED)
    return _filled(src.scoped(["orders", "documents"]).schema(), src)


@query("top_values_flat", ORACLES["value_stats_top50"])
def top_values_flat(spark, sf):
    """A flat column: nearly all buckets stay open."""
    return top_values(_t(spark, sf, "lineitem"), "l_partkey", 50)


WORD_SQL = "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50"


@query("top_values_words", WORD_SQL)
def top_values_words(spark, sf):
    """A skewed column: words of all documents."""
    return top_values(_t(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")), "word", 50)


# ------------------------------------------------------------------------------------ run history

@query("runs_ruleset_as_of", RUNS_SQL + """,
v AS (SELECT 'bot_' || user_id AS bot_id, ts, max(event_id) AS version FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT r.run_id, r.bot_id, v.version AS ruleset_version, '{"rules":[],"n":' || v.version || '}' AS ruleset
FROM r ASOF LEFT JOIN v ON r.bot_id = v.bot_id AND r.created_at >= v.ts
""")
def runs_ruleset_as_of(spark, sf):
    """Which ruleset version was live when each run started."""
    return bots.live_when(runs_table(spark, sf), version_log(spark, sf)).select("run_id", "bot_id", "ruleset_version", "ruleset")


@query("run_get", RUNS_SQL + """
SELECT run_id, bot_id, status FROM r WHERE run_id = (SELECT 'run_' || max(event_id) FROM events)
""")
def run_get(spark, sf):
    last = _t(spark, sf, "events").agg(F.max(F.struct("event_id", "user_id")).alias("m")).first().m
    return runs.get_run(runs_table(spark, sf), f"bot_{last.user_id}", f"run_{last.event_id}").select("run_id", "bot_id", "status")


@query("as_of_cut", """
SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-09' GROUP BY event_type
""")
def as_of_cut(spark, sf):
    return runs.as_of_filter(_t(spark, sf, "events"), "ts", "2024-01-08").groupBy("event_type").agg(F.count("*").alias("n"))


@query("bot_overview_3", RUNS_SQL + """
SELECT b.bot_id, b.name, h.run_id, h.status
FROM (SELECT 'bot_' || c_custkey AS bot_id, c_name AS name FROM customer) b LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY created_at DESC, run_id DESC) AS rn FROM r) h ON h.bot_id = b.bot_id AND h.rn <= 3
""")
def bot_overview_3(spark, sf):
    """Customers as bots: many have no run."""
    listed = _t(spark, sf, "customer").select(F.concat(F.lit("bot_"), F.col("c_custkey")).alias("bot_id"), F.col("c_name").alias("name"))
    return runs.bot_overview(listed, runs_table(spark, sf), last=3).select("bot_id", "name", "run_id", "status")


@query("run_recent_all", RUNS_SQL + "SELECT run_id FROM r")
def run_recent_all(spark, sf):
    """As many newest runs as there are runs: no cap inside."""
    table = runs_table(spark, sf)
    return runs.recent(table, table.count()).select("run_id")


@query("bot_runs", """
SELECT b.bot_id, e.type, e.stage, '2024-01-30' AS as_of,
       CASE WHEN e.counted THEN b.n END AS record_count,
       CASE WHEN e.type = 'run_completed' THEN b.n END AS cohort_size
FROM (SELECT 'high_value' AS bot_id, (SELECT count(*) FROM orders WHERE o_totalprice >= 475000) AS n
      UNION ALL SELECT 'big', (SELECT count(*) FROM orders WHERE o_totalprice > 450000)) b,
     (VALUES ('run_started', '', false), ('run_progress', 'planned', false), ('run_progress', 'stored', true),
             ('run_completed', '', true)) e(type, stage, counted)
""")
def bot_runs(spark, sf):
    """A transform and a ruleset run end to end; their events as stored."""
    def high_value(spark: SparkSession, source, as_of: str) -> DataFrame:
        rows = source.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 475000")
        return frame(to_signals(rows, F.col("o_orderkey"), "high_value_order", score=F.col("o_totalprice") / F.lit(500000)), "high value", sort=False).data

    events, signals = _folder(spark, "events"), _folder(spark, "signals")
    src = _source(spark, sf, "orders")
    ruleset = ORDERS_RULES | {"rules": ORDERS_RULES["rules"][:1]}
    for bot, work in (("high_value", high_value), ("big", ruleset)):
        bots.run_bot(spark, bot, work, src, ["orders"], events_path=events, signals_path=signals, as_of="D-1", ref_date=dt.date(2024, 1, 31))
    stored = runs.distinct_events(spark.read.parquet(events))
    return stored.select("bot_id", "type", "stage", "as_of", "record_count", F.get_json_object("metadata", "$.cohort_size").cast("long").alias("cohort_size"))


@query("signal_store_retry", """
SELECT 'b' AS bot_id, 'keeps' AS run_id, count(*) AS n FROM orders WHERE o_totalprice > 450000
""")
def signal_store_retry(spark, sf):
    """Two runs are stored; a retry of one finds nothing, and empties it."""
    orders = _t(spark, sf, "orders").filter("o_totalprice > 450000").select(F.lit("b").alias("bot_id"), F.col("o_orderkey").cast("string").alias("target_id"))
    path = _folder(spark, "signals")
    both = orders.withColumn("run_id", F.lit("keeps")).unionByName(orders.withColumn("run_id", F.lit("retried")))
    write_signals(both, path)
    replace_run(both.filter("target_id is null"), path, "b", "retried")
    return spark.read.schema("target_id string, bot_id string, run_id string").parquet(path).groupBy("bot_id", "run_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------- review

@query("decisions_of_run", CASES_SQL + """
SELECT run_id, CAST(case_index AS VARCHAR) AS case_id, decision FROM d WHERE run_id = 'run_src3'
""")
def decisions_of_run(spark, sf):
    latest = review.latest_decisions(decision_log(spark, sf))
    return review.decisions_for(latest, "docs", "run_src3").select("run_id", "case_id", "decision")


@query("decisions_unknown_case", """
SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality = 0
""")
def decisions_unknown_case(spark, sf):
    cases = doc_cases(spark, sf)
    log = review.latest_decisions(decision_log(spark, sf, cases))
    low = _t(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id"))
    gone = cases.join(low, "doc_id", "left_anti")  # cases that were withdrawn after they were decided
    return review.unknown_case_decisions(log, gone).agg(F.count("*").alias("n"))


LOOKS = tuple(dt.datetime(2024, 2, 2, h, m) for h, m in ((8, 30), (9, 0), (9, 59), (12, 0)))


@query("decisions_as_of", CASES_SQL + """
SELECT c.run_id, CAST(c.case_index AS VARCHAR) AS case_id, k.seen,
       CASE WHEN k.seen = 830 OR l.doc_id IS NULL THEN 'pending' WHEN l.quality <> 1 OR (l.toxic = 1 AND k.seen = 1200) THEN 'rejected' ELSE 'accepted' END AS decision
FROM c LEFT JOIN labels l ON c.doc_id = l.doc_id, (VALUES (830), (900), (959), (1200)) k(seen)
""")
def decisions_as_of(spark, sf):
    """The decision on every case as it stood at four times of the review day."""
    cases = doc_cases(spark, sf)
    looks = cases.select("bot_id", "run_id", "case_id", F.explode(F.array(*[F.lit(t) for t in LOOKS])).alias("seen_at"))
    found = review.decided_when(looks, decision_log(spark, sf, cases), "seen_at")
    return found.select("run_id", "case_id", (F.hour("seen_at") * 100 + F.minute("seen_at")).alias("seen"), "decision")


def review_store(spark: SparkSession, sf: str) -> ReviewStore:
    """Cases of the documents and the decisions on them, in a new bucketed store."""
    name = f"review_{uuid.uuid4().hex[:10]}"
    cases = doc_cases(spark, sf).select("bot_id", "run_id", "case_id", "case_index", "target_id", "score", "doc_id")
    store = ReviewStore.open(spark, name, _folder(spark, name), cases.schema, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    store.add_cases(cases)
    store.add_decisions(decision_log(spark, sf, store.cases))
    return store


@query("case_list_stored", ORACLES["case_list"])
def case_list_stored(spark, sf):
    return review_store(spark, sf).case_list().select("run_id", "case_id", "target_id", "decision")


@query("review_tally_stored", ORACLES["review_tally"])
def review_tally_stored(spark, sf):
    return review_store(spark, sf).tally()


# -------------------------------------------------------------------------------------- delivery

@query("webhooks_effective", """
SELECT 'manifest' AS id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS bot_id, url FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT 'page_' || page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1),
       CASE WHEN contains(url, '?') THEN url || '&k=${WEBHOOK_KEY}' ELSE url || '?k=${DB_PASSWORD}' END FROM pages
""")
def webhooks_effective(spark, sf):
    """Manifests name sinks of several types, some without a URL; only webhooks with one count."""
    pages = _t(spark, sf, "pages")
    kinds = F.element_at(F.array(F.lit("webhook"), F.lit("file"), F.lit("webhook")), (F.col("page_id") % 3 + 1).cast("int"))
    url = F.when(F.col("page_id") % 3 != 2, F.col("url")).otherwise(F.lit(""))
    manifests = pages.select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("bot_id"),
                             F.array(F.struct(kinds.alias("type"), url.alias("url")), F.struct(F.lit("sse").alias("type"), F.col("url").alias("url"))).alias("sinks"))
    return outbox.effective_webhooks(manifests, page_subscriptions(spark, sf)).select("id", "bot_id", "url")


@query("subscriptions_current", """
WITH log AS (
  SELECT 'sub_' || user_id AS id, ts, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'register' END AS op,
         CASE event_type WHEN 'view' THEN 'webhook' WHEN 'click' THEN 'file' WHEN 'purchase' THEN 'pigeon' ELSE 'email' END AS type, event_id
  FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, op DESC) AS n FROM log WHERE op = 'remove' OR type <> 'pigeon')
SELECT id, type, 'http://h/' || event_id AS url FROM last WHERE n = 1 AND op = 'register'
""")
def subscriptions_current(spark, sf):
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in (("view", "webhook"), ("click", "file"), ("purchase", "pigeon"))], F.lit("email"))
    log = _t(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "remove").otherwise("register").alias("op"), F.concat(F.lit("sub_"), "user_id").alias("id"),
        F.lit("b").alias("bot_id"), kind.alias("type"), F.concat(F.lit("http://h/"), "event_id").alias("url"), F.lit(None).cast("string").alias("name"), "ts")
    return outbox.current_subscriptions(log).select("id", "type", "url")


@query("outbox_payloads", """
SELECT 'run_' || s.source AS run_id, count(d.doc_id) AS n_cases, true AS in_order, true AS nested
FROM (SELECT DISTINCT source FROM documents UNION SELECT 'empty') s LEFT JOIN documents d ON d.source = s.source GROUP BY 1
""")
def outbox_payloads(spark, sf):
    """Payloads read back: every completed run has one, cases in order, features as objects."""
    from .catalog import doc_runs

    cases = doc_cases(spark, sf).select("bot_id", "run_id", "case_index", "target_id", "score", "features", "subject")
    listed = doc_runs(spark, sf).withColumn("metadata", F.lit('{"threshold":null}'))
    empty = listed.limit(1).withColumn("run_id", F.lit("run_empty"))
    box = outbox.outbox(cases, listed.unionByName(empty), chunk_rows=25)
    data = F.from_json("payload", "struct<metadata: struct<threshold: double>, data: array<struct<case_index: bigint, features: struct<chars: bigint>, subject: string>>>")
    at = F.transform(data["data"], lambda x: x["case_index"])
    flags = box.select("run_id", "n_records", (at == F.array_sort(at)).alias("sorted"),
                       (data["metadata"].isNotNull() & ~F.contains("payload", F.lit('"features":"'))).alias("objects"))
    return flags.groupBy("run_id").agg(F.sum("n_records").alias("n_cases"), F.min("sorted").alias("in_order"), F.min("objects").alias("nested"))


# --------------------------------------------------------------------------- rules and versions

def part_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Parts read as a rules table: scores run past 1, combinations and operators past the known ones,
    some are null, and every fiftieth rule has no criteria."""
    p, size = _t(spark, sf, "part"), F.col("p_size")
    op = F.when(size % 5 == 0, F.lit(None)).when(size % 5 == 1, "near").when(size % 5 == 2, "gt").otherwise("in").cast("string")
    one = F.struct(F.when(size % 3 == 0, "p_missing").otherwise("p_size").alias("field"), op.alias("operator"), F.lit("7").alias("value"), F.lit(None).cast("string").alias("baseline_field"))
    return p.select(F.col("p_partkey").alias("rule_id"), (size / 40.0).alias("score"), F.col("p_brand").alias("label"),
                    F.when(size % 4 == 0, "and").when(size % 4 == 1, "or").when(size % 4 == 2, "xor").alias("combination"),
                    F.when(F.col("p_partkey") % 50 == 0, F.array().cast("array<struct<field:string,operator:string,value:string,baseline_field:string>>")).otherwise(F.array(one)).alias("criteria"))


@query("rules_table_check", """
WITH p AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 50 = 0 AS bare FROM part)
SELECT id AS rule_id, 'unknown operator null' AS msg, 'error' AS severity FROM p WHERE NOT bare AND s % 5 = 0
UNION ALL SELECT id, 'unknown operator near', 'error' FROM p WHERE NOT bare AND s % 5 = 1
UNION ALL SELECT id, '''in'' needs a list value', 'error' FROM p WHERE NOT bare AND s % 5 > 2
UNION ALL SELECT id, 'combination must be ''and'' or ''or''', 'error' FROM p WHERE s % 4 > 1
UNION ALL SELECT id, 'score must be a number in [0, 1]', 'error' FROM p WHERE s > 40
UNION ALL SELECT id, 'no criteria: the rule cannot match any row', 'unsupported' FROM p WHERE bare
UNION ALL SELECT id, 'fields absent from the data: p_missing', 'unsupported' FROM p WHERE NOT bare AND s % 3 = 0 AND s % 4 < 2
""")
def rules_table_check(spark, sf):
    return rules.validate_rules(part_rules(spark, sf), ["p_partkey", "p_size"], "p_partkey").select("rule_id", "msg", "severity")


def version_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as a ruleset version log: a user is a bot, and each event one entry."""
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "discarded").otherwise("staged")
    return _t(spark, sf, "events").select(F.concat(F.lit("bot_"), "user_id").alias("bot_id"), F.col("event_id").alias("version"), status.alias("status"),
                                          F.concat(F.lit('{"rules":[],"n":'), "event_id", F.lit("}")).alias("ruleset"), F.lit("ann").alias("reviewer"), "ts")


VERSIONS_SQL = """
WITH v AS (SELECT 'bot_' || user_id AS bot_id, event_id AS version, ts, '{"rules":[],"n":' || event_id || '}' AS ruleset,
           CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'discarded' ELSE 'staged' END AS status FROM events)
"""


@query("rulesets_live", VERSIONS_SQL + """
SELECT bot_id, max(version) AS version, arg_max(ruleset, version) AS ruleset FROM v WHERE status = 'approved' GROUP BY bot_id
""")
def rulesets_live(spark, sf):
    return bots.live_rulesets(version_log(spark, sf)).select("bot_id", "version", "ruleset")


@query("proposals_pending", VERSIONS_SQL + """
SELECT bot_id, version FROM (SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY ts DESC, version DESC) AS n FROM v) WHERE n = 1 AND status = 'staged'
""")
def proposals_pending(spark, sf):
    return bots.pending_proposals(version_log(spark, sf)).select("bot_id", "version")


@query("proposal_replaced", VERSIONS_SQL + """
SELECT bot_id, max(version) AS version, 1 AS pending, 'staged' AS status FROM v WHERE bot_id = (
  SELECT min(bot_id) FROM (SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY ts DESC, version DESC) AS n FROM v) WHERE n = 1 AND status = 'staged')
GROUP BY bot_id
""")
def proposal_replaced(spark, sf):
    """The first bot with a pending proposal gets another one, which takes its place."""
    log = version_log(spark, sf)
    bot = bots.pending_proposals(log).agg(F.min("bot_id")).first()[0]
    after = log.unionByName(bots.propose(spark, log, bot, {"rules": [], "task": "another"}))
    pending = bots.pending_proposals(after).filter(F.col("bot_id") == bot)
    shown = bots.version_history(after).join(pending.select("bot_id", "version"), ["bot_id", "version"], "left_semi")
    return shown.filter(F.contains("ruleset", F.lit("another"))).groupBy("bot_id", "version", "status").agg(F.count("*").cast("int").alias("pending")) \
        .select("bot_id", "version", "pending", "status")


# ---------------------------------------------------------------------------------------- scores

@query("scores_odd", """
SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 0.0 WHEN p_size % 4 = 1 THEN NULL ELSE least(round(p_size / 40.0, 3), 1.0) END AS score,
       CASE WHEN p_size % 4 = 0 THEN 'low' WHEN p_size % 4 = 1 THEN '' WHEN p_size / 40.0 >= 0.8 THEN 'high' WHEN p_size / 40.0 >= 0.6 THEN 'medium-high'
            WHEN p_size / 40.0 >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM part
""")
def scores_odd(spark, sf):
    """NaN and missing scores among plain ones."""
    size = F.col("p_size")
    score = F.when(size % 4 == 0, F.lit(float("nan"))).when(size % 4 != 1, size / 40.0)
    return to_signals(_t(spark, sf, "part"), F.col("p_partkey"), "part", score=score).select(F.col("target_id").cast("long").alias("id"), "score", "confidence")
