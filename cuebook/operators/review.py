"""Review loop as tables: cases, decisions (append-only, last write wins), tally, labels,
and the precision/recall/F1 threshold sweep with its recommendation.

Tables:
* cases     ``bot_id, run_id, case_id (string), case_index long, score double, ...signal``
* decisions ``bot_id, run_id, case_id, decision, note, reviewer, updated_at`` (a log)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.asof import as_of_join
from ..plans.ordered import ordered_index, running_totals
from .signals import priority_key

# The decision vocabulary and the sweep's rounding.
DECISIONS = ("accepted", "rejected", "pending")
THRESHOLD_DECIMALS = 6
METRIC_DECIMALS = 4

DECISION_KEY = ["bot_id", "run_id", "case_id"]


def build_cases(signals: DataFrame, run: list[str] | None = None, order: list[Column] | None = None,
                partitions: int | None = None) -> DataFrame:
    """Number the signals of each run in priority order; ``case_id`` is that position as text.

    Uses the range-partitioned index, so one enormous run is split across many tasks. Store the
    result: decisions point at ``case_id`` and it must never change afterwards.
    """
    run = run or ["bot_id", "run_id"]
    order = order or priority_key()
    indexed = ordered_index(signals, run, order, out="case_index", partitions=partitions)
    return indexed.withColumn("case_id", F.col("case_index").cast("string"))


def split_decisions(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) decision rows; only the three known decisions are accepted."""
    ok = F.col("decision").isin(*DECISIONS)
    return log.filter(ok), log.filter(~ok | F.col("decision").isNull())


def latest_decisions(log: DataFrame) -> DataFrame:
    """Last write wins per (bot, run, case). ``max`` of a struct aggregates map-side first,
    so a hot key never lands whole on one task."""
    valid, _ = split_decisions(log)
    newest = F.max(F.struct(F.col("updated_at"), F.col("decision"), F.col("note"), F.col("reviewer")))
    return valid.groupBy(*DECISION_KEY).agg(newest.alias("_d")).select(
        *DECISION_KEY, F.col("_d.decision").alias("decision"), F.col("_d.note").alias("note"),
        F.col("_d.reviewer").alias("reviewer"), F.col("_d.updated_at").alias("updated_at"))


def decided_when(looks: DataFrame, log: DataFrame, at: str) -> DataFrame:
    """Each look at a case (``bot_id, run_id, case_id`` and the time ``at``) with the decision that stood then; ``pending`` before the
    first. Invalid entries never stood; of entries at one time the greatest decision text counts, as in ``latest_decisions``."""
    valid, _ = split_decisions(log)
    found = as_of_join(looks, valid, DECISION_KEY, at, "updated_at", {"decision": "decision", "note": "review_note", "reviewer": "reviewer"})
    return found.withColumns({"decision": F.coalesce("decision", F.lit("pending")), "review_note": F.coalesce("review_note", F.lit("")),
                              "reviewer": F.coalesce("reviewer", F.lit(""))})


def decisions_for(decisions: DataFrame, bot_id: str, run_id: str, case_id: str | None = None) -> DataFrame:
    """Latest decisions of one run, or of one case when ``case_id`` is given."""
    cond = (F.col("bot_id") == bot_id) & (F.col("run_id") == run_id)
    if case_id is not None:
        cond = cond & (F.col("case_id") == case_id)
    return decisions.filter(cond)


def case_list(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every case with its decision; undecided cases read ``pending`` with empty review note
    and reviewer (``review_note``, since a signal row already has a ``note``)."""
    d = decisions.select(*DECISION_KEY, F.col("decision").alias("_dec"), F.col("note").alias("_rnote"),
                         F.col("reviewer").alias("_rev"))
    return cases.join(d, on=DECISION_KEY, how="left").select(
        *[F.col(c) for c in cases.columns],
        F.coalesce(F.col("_dec"), F.lit("pending")).alias("decision"),
        F.coalesce(F.col("_rnote"), F.lit("")).alias("review_note"),
        F.coalesce(F.col("_rev"), F.lit("")).alias("reviewer"))


def tally(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per run: accepted, rejected, reviewed, total, pending (= total - reviewed)."""
    totals = cases.groupBy("bot_id", "run_id").agg(F.count(F.lit(1)).alias("total"))
    counts = decisions.groupBy("bot_id", "run_id").agg(
        F.count_if(F.col("decision") == "accepted").alias("accepted"),
        F.count_if(F.col("decision") == "rejected").alias("rejected"))
    out = totals.join(counts, on=["bot_id", "run_id"], how="left")
    acc = F.coalesce(F.col("accepted"), F.lit(0))
    rej = F.coalesce(F.col("rejected"), F.lit(0))
    return out.select("bot_id", "run_id", acc.alias("accepted"), rej.alias("rejected"),
                      (acc + rej).alias("reviewed"), "total",
                      (F.col("total") - acc - rej).alias("pending"))


def unknown_case_decisions(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Decisions that point at no existing case (the decide guard, for a whole log)."""
    return decisions.join(cases.select(*DECISION_KEY), on=DECISION_KEY, how="left_anti")


def collect_labels(runs: DataFrame, cases: DataFrame, decisions: DataFrame, limit: int = 50) -> DataFrame:
    """Labels from the newest ``limit`` runs of each bot (any status), pending dropped.

    ``runs`` needs ``bot_id, run_id, created_at``. Output: ``bot_id, run_id, case_id, score,
    accepted``.
    """
    from .runs import history

    recent = history(runs, limit=limit).select("bot_id", "run_id")
    labelled = latest_decisions(decisions).filter(F.col("decision") != "pending")
    return (cases.join(recent, on=["bot_id", "run_id"], how="inner")
            .join(labelled.select(*DECISION_KEY, "decision"), on=DECISION_KEY, how="inner")
            .select("bot_id", "run_id", "case_id", F.col("score").cast("double").alias("score"),
                    (F.col("decision") == "accepted").alias("accepted")))


def threshold_sweep(labels: DataFrame, partitions: int | None = None,
                    by: list[str] | None = None) -> DataFrame:
    """One point per distinct score t (per ``by`` group, e.g. ``["bot_id"]``): flagged = score
    >= t, tp, fp, fn, precision, recall, f1. Zero denominators give 0. O(N log N): group by
    score, then running sums over a range partitioning (a busy bot spans many tasks)."""
    by = list(by or [])
    scored = labels.filter(F.col("score").isNotNull())
    per_score = scored.groupBy(*by, "score").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("accepted")).cast("long").alias("acc"))
    cum = running_totals(per_score, [F.col("score").desc()], {"n": "flagged", "acc": "tp"},
                         totals={"acc": "acc_total"}, partitions=partitions, group=by)
    tp, flagged = F.col("tp"), F.col("flagged")
    fp = flagged - tp
    fn = F.col("acc_total") - tp
    precision = F.when(flagged > 0, tp / flagged).otherwise(F.lit(0.0))
    recall = F.when((tp + fn) > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when((precision + recall) > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return cum.select(
        *by, F.round("score", THRESHOLD_DECIMALS).alias("threshold"),
        flagged.cast("long").alias("flagged"), tp.cast("long").alias("tp"),
        fp.cast("long").alias("fp"), fn.cast("long").alias("fn"),
        F.round(precision, METRIC_DECIMALS).alias("precision"),
        F.round(recall, METRIC_DECIMALS).alias("recall"),
        F.round(f1, METRIC_DECIMALS).alias("f1"))


def recommend(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The F1-best point (per ``by`` group); ties go to the higher threshold (fewer flagged
    cases). Without groups: a top-1 (0 or 1 row); with groups: one max-struct aggregate."""
    if not by:
        return points.orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1)
    metrics = [c for c in points.columns if c not in by]
    best = F.max(F.struct(F.col("f1").alias("_k1"), F.col("threshold").alias("_k2"), *[F.col(c) for c in metrics]))
    return points.groupBy(*by).agg(best.alias("_b")).select(*by, *[F.col(f"_b.{c}").alias(c) for c in metrics])


def tuning_header(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """labelled, accepted, rejected, unscored -- one row, or one for each ``by`` group (e.g. ``["bot_id"]``)."""
    return labels.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("labelled"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.col("score").isNull()).alias("unscored"))
