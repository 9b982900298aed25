"""Delivery as tables: effective webhook targets, URL templates, scheme filter, and an outbox
of bounded payload chunks. Sending is left to whatever reads the outbox.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Subscription kinds, the only template prefix that may expand, allowed schemes.
SUBSCRIPTION_TYPES = ("webhook", "sse", "file", "email")
TEMPLATE_PREFIX = "WEBHOOK_"
TEMPLATE_NAME = re.compile(r"^[A-Z0-9_]+$")
SCHEMES = ("http://", "https://")
CHUNK_ROWS = 1000


def effective_webhooks(manifest_sinks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Manifest webhook sinks with a URL, plus the bot's registered subscriptions.

    ``manifest_sinks``: ``bot_id, sinks array<struct<type string, url string>>``;
    ``subscriptions``: ``id, bot_id, type, url, name``.
    """
    from_manifest = manifest_sinks.select("bot_id", F.explode("sinks").alias("s")).filter(
        (F.col("s.type") == "webhook") & (F.coalesce(F.col("s.url"), F.lit("")) != "")).select(
        F.lit("manifest").alias("id"), "bot_id", F.col("s.type").alias("type"),
        F.col("s.url").alias("url"), F.lit(None).cast("string").alias("name"))
    return from_manifest.unionByName(subscriptions.select("id", "bot_id", "type", "url", "name"))


def template_values(environ: dict[str, str] | None = None) -> dict[str, str]:
    """The allow-listed template values: only names starting with WEBHOOK_."""
    env = os.environ if environ is None else environ
    return {k: v for k, v in env.items() if k.startswith(TEMPLATE_PREFIX) and TEMPLATE_NAME.match(k)}


def expand_url(url: Column, values: dict[str, str]) -> Column:
    """``${WEBHOOK_X}`` -> its value ('' when unknown); any other ``${NAME}`` stays literal.

    One pass: the text is cut at the placeholders and each piece is mapped once, so a value that
    itself holds a placeholder is not expanded again."""
    hole = r"\$\{WEBHOOK_[A-Z0-9_]*\}"
    known = F.create_map(*[F.lit(x) for name, value in sorted(values.items()) for x in ("${" + name + "}", value)]) if values else None
    between = F.split(url, hole)
    holes = F.regexp_extract_all(url, F.lit(f"({hole})"), F.lit(1))
    filled = F.transform(holes, lambda h: F.coalesce(F.element_at(known, h), F.lit("")) if known is not None else F.lit(""))
    return F.array_join(F.flatten(F.zip_with(between, filled, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def deliverable(kind: Column, url: Column) -> Column:
    """Only webhook subscriptions whose URL starts with http:// or https://."""
    scheme_ok = F.coalesce(url.startswith(SCHEMES[0]) | url.startswith(SCHEMES[1]), F.lit(False))
    return (kind == F.lit("webhook")) & scheme_ok


def webhook_targets(subs: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """Expanded, scheme-checked webhook targets."""
    expanded = subs.withColumn("url", expand_url(F.col("url"), template_values(values)))
    return expanded.filter(deliverable(F.col("type"), F.col("url")))


def outbox(cases: DataFrame, runs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Payload rows per (completed run, chunk of ``chunk_rows`` cases): run header + ordered records.

    A run without cases gets one chunk with empty data. A run's data is never gathered whole: each
    payload holds at most ``chunk_rows`` records, in ``case_index`` order. ``features`` and
    ``subject`` are JSON texts in the cases and objects in the payload; the run's ``metadata``, JSON
    text too, likewise. A text there that is not JSON goes out as a string. ``cases`` needs ``bot_id, run_id, case_index`` plus signal columns; ``runs`` needs
    ``bot_id, run_id, status, as_of, summary`` and may have ``metadata``.
    """
    def as_json(c: Column) -> Column:
        """JSON text as it is; a text that is not JSON as a JSON string."""
        quoted = F.to_json(F.array(c))
        return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))

    nested = [c for c in ("features", "subject") if c in cases.columns]
    plain = [c for c in cases.columns if c not in ("bot_id", "run_id", "case_index", *nested)]
    record = F.struct("case_index", *plain, *[F.parse_json(as_json(F.coalesce(F.col(c), F.lit("null")))).alias(c) for c in nested])
    chunked = cases.select("bot_id", "run_id", "case_index", F.floor(F.col("case_index") / F.lit(chunk_rows)).cast("long").alias("chunk"),
                           F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
    grouped = chunked.groupBy("bot_id", "run_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("case_index", "record"))).alias("rows"), F.count(F.lit(1)).alias("n_records"))
    about = F.col("metadata") if "metadata" in runs.columns else F.lit(None).cast("string")
    head = runs.filter(F.col("status") == "completed").select("bot_id", "run_id", "as_of", "summary", as_json(F.coalesce(about, F.lit("{}"))).alias("metadata"))
    joined = head.join(grouped, on=["bot_id", "run_id"], how="left")
    data = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("rows", lambda r: r["record"]), ","), F.lit("")), F.lit("]"))
    chunk = F.coalesce("chunk", F.lit(0).cast("long"))
    front = F.to_json(F.struct("bot_id", "run_id", "as_of", "summary", chunk.alias("chunk")), {"ignoreNullFields": "false"})
    # The header's closing brace gives way to the two members that are JSON texts already.
    payload = F.concat(F.regexp_replace(front, r"\}$", ""), F.lit(',"metadata":'), F.col("metadata"), F.lit(',"data":'), data, F.lit("}"))
    return joined.select("bot_id", "run_id", chunk.alias("chunk"), F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records"), payload.alias("payload"))


def current_subscriptions(log: DataFrame) -> DataFrame:
    """Register/remove log -> live subscriptions (latest op per id; removed ids drop out).

    ``log``: ``op (register|remove), id, bot_id, type, url, name, ts``. Unknown types are
    refused at registration and never become live.
    """
    valid = log.filter((F.col("op") == "remove") | F.col("type").isin(*SUBSCRIPTION_TYPES))
    last = F.max(F.struct("ts", "op", "bot_id", "type", "url", "name"))
    return valid.groupBy("id").agg(last.alias("_l")).filter(F.col("_l.op") == "register").select(
        "id", F.col("_l.bot_id").alias("bot_id"), F.col("_l.type").alias("type"),
        F.col("_l.url").alias("url"), F.col("_l.name").alias("name"))
