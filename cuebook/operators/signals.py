"""Signals and predictions: build, frame (threshold, priority order, one-row metadata), check.

A signal row: ``target_id, rule_id, label, score, confidence, evidence array<string>,
features (JSON text), subject (JSON text), note``. ``rule_id`` is NULL for signals not made by
a ruleset. Every row carries the note that it is a lead for a person, not a verdict.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import confidence_band, normalise_score

NOTE = "Lead for human review only; it is not a finding, and a reviewer makes the call."

SIGNAL_SCHEMA = T.StructType([
    T.StructField("target_id", T.StringType()),
    T.StructField("rule_id", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("features", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("note", T.StringType()),
])
SIGNAL_COLUMNS = [f.name for f in SIGNAL_SCHEMA.fields]


def _json(c: Column | None, empty: str = "{}") -> Column:
    if c is None:
        return F.lit(empty)
    return F.to_json(c, {"ignoreNullFields": "false"})


def to_signals(df: DataFrame, target_id: Column, label: str | Column, *,
               score: Column | None = None, evidence: Column | None = None,
               features: Column | None = None, subject: Column | None = None,
               keep: list[str] | None = None) -> DataFrame:
    """Build signal rows from any DataFrame; ``features``/``subject`` are struct or map columns."""
    s = normalise_score(score) if score is not None else F.lit(None).cast("double")
    ev = evidence if evidence is not None else F.array().cast("array<string>")
    cols = [
        target_id.cast("string").alias("target_id"),
        F.lit(None).cast("long").alias("rule_id"),
        (F.lit(label) if isinstance(label, str) else label).alias("label"),
        s.alias("score"),
        confidence_band(s).alias("confidence"),
        ev.cast("array<string>").alias("evidence"),
        _json(features).alias("features"),
        _json(subject).alias("subject"),
        F.lit(NOTE).alias("note"),
    ]
    return df.select(*(keep or []), *cols)


def to_predictions(df: DataFrame, target_id: Column, score: Column, *, label: str = "prediction",
                   evidence: Column | None = None, features: Column | None = None,
                   subject: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Like ``to_signals`` but the score is mandatory: a NULL score fails the job."""
    checked = F.when(score.isNull(), F.raise_error(F.lit("a prediction needs a score"))).otherwise(score)
    return to_signals(df, target_id, label, score=checked, evidence=evidence, features=features,
                      subject=subject, keep=keep)


def priority_key(score: str = "score") -> list[Column]:
    """Descending score (missing = 0), then rule_id, target_id and a hash of the whole signal.

    Signals may repeat a target, so the hash ends the key: equal keys are equal signals, and
    which of two equal signals comes first cannot be seen."""
    whole = F.sha2(F.concat_ws("\x1f", F.coalesce("label", F.lit("")), F.array_join("evidence", "\x1e", "\x00"),
                               F.coalesce("features", F.lit("")), F.coalesce("subject", F.lit(""))), 256)
    return [F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col("rule_id").asc_nulls_last(),
            F.col("target_id").asc_nulls_last(), whole]


def summary_text(label: str, flagged: int, as_of: str = "", kind: str = "signal") -> str:
    noun = "prediction" if kind == "prediction" else "signal"
    return f"{label}: {flagged} {noun}(s) (as of {as_of or 'n/a'}; {NOTE})"


@dataclass
class Framed:
    data: DataFrame       # flagged signals, in priority order when sorted=True
    metadata: DataFrame   # one row: label, cohort_size, flagged, kind, threshold, summary, ...


def frame(signals: DataFrame, label: str, *, threshold: float | None = None, as_of: str = "",
          kind: str = "signal", logic: dict[str, Any] | None = None, extra: dict[str, Any] | None = None,
          sort: bool = True) -> Framed:
    """Threshold filter, priority order and the one-row framing metadata (single pass agg)."""
    passes = (F.coalesce(F.col("score"), F.lit(0.0)) >= F.lit(threshold)) if threshold is not None \
        else F.lit(True)
    data = signals.filter(passes)
    if sort:
        data = data.orderBy(*priority_key())
    noun = "prediction" if kind == "prediction" else "signal"
    meta = signals.agg(F.count(F.lit(1)).alias("cohort_size"),
                       F.count_if(passes).alias("flagged"))
    meta = meta.select(
        F.lit(label).alias("label"), "cohort_size", "flagged", F.lit(kind).alias("kind"),
        F.lit(threshold).cast("double").alias("threshold"),
        F.format_string(f"%s: %d {noun}(s) (as of %s; %s)", F.lit(label), F.col("flagged"),
                        F.lit(as_of or "n/a"), F.lit(NOTE)).alias("summary"),
        *([F.lit(json.dumps(logic, sort_keys=True)).alias("logic")] if logic else []),
        *[F.lit(v).alias(k) for k, v in (extra or {}).items()],
    )
    return Framed(data, meta)


def check_contract(signals: DataFrame, summary: str | None = None) -> DataFrame:
    """One row of contract counts: records, wrong notes, scores out of range, bad bands.

    Records carry the note themselves. An output without any carries it in its ``summary``, or is not ok."""
    noted = NOTE in (summary or "")
    s = F.col("score")
    bad_band = F.col("confidence") != confidence_band(s)
    return signals.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("note").isNull() | (F.col("note") != F.lit(NOTE))).alias("bad_note"),
        F.count_if(s.isNotNull() & ((s < 0) | (s > 1) | F.isnan(s))).alias("bad_score"),
        F.count_if(F.coalesce(bad_band, F.lit(True))).alias("bad_band"),
        F.count_if(F.col("target_id").isNull()).alias("missing_target"),
    ).withColumn("ok", (F.col("bad_note") + F.col("bad_score") + F.col("bad_band")
                        + F.col("missing_target") == 0) & ((F.col("records") > 0) | F.lit(noted)))
