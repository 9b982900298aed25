"""Rule evaluation over a DataFrame in one scan.

Plan shape (no shuffle, no join, no Python):

    Scan (pruned columns, pushed comparisons)
      -> Filter   OR over the columns of the loosest bounds any rule sets (see ``_Ranges``)
      -> Project  target_id, subject, array(when(or_rule_i matches, code_i) ...)
      -> Projects the threshold index: place on each axis, bitmaps, ordinals of the matching rules (``rule_index.py``)
      -> Generate words of the bitmap, those without a bit go; Generate codes
      -> Project  rule metadata looked up by ordinal in constant arrays

A code is the rule's ordinal, plus (for OR rules) a bitmask of the criteria that passed,
so the evidence texts can be filtered after the generator without re-evaluating anything.
Rule metadata (labels, scores, features JSON, evidence texts) are literals of the ruleset, so
they are constant arrays in the plan instead of a joined table. ``evaluate_compact`` stops
before that last projection and leaves the constants to a broadcast rules dimension.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Compiled, compile_criterion, python_text, qcol
from ..functions.scores import confidence_band_py, normalise_score_py
from ..model import NUMERIC_OPERATORS, OPERATORS, Criterion, Rule, Ruleset, load, never_fires
from .rule_index import RuleIndex, const_array
from .signals import NOTE

_CODE = "_cue_code"


def _combine(parts: list[Column], how: str) -> Column:
    return reduce(lambda a, b: (a & b) if how == "and" else (a | b), parts)


class _Ranges:
    """A filter that lets pass every row a rule may match, as long as the columns are many, not the rules.

    Each covered rule gives one pushable criterion (an "or" rule all of its criteria). Per
    column these merge into its lowest lower bound, its highest upper bound and its set of values,
    and the columns' conditions are joined by OR."""

    NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)

    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.values: dict[str, set] = {}

    def _fits(self, c: Criterion) -> bool:
        kind, values = self.types.get(c.field), c.value if c.operator == "in" else [c.value]
        if c.operator not in ("lt", "lte", "gt", "gte", "eq", "in") or not values:
            return False
        if isinstance(kind, T.StringType):
            return c.operator in ("eq", "in") and all(type(v) is str for v in values)
        return isinstance(kind, self.NUMBERS) and all(type(v) in (int, float) and abs(v) < 2**31 for v in values)

    def cover(self, rule: Rule) -> bool:
        """Take ``rule`` in; False if none of its criteria can stand for it."""
        able = [c for c in rule.criteria if self._fits(c)]
        if rule.combination == "or" and len(able) < len(rule.criteria) or not able:
            return False
        for c in able if rule.combination == "or" else able[:1]:
            if c.operator in ("gt", "gte"):
                self.low[c.field] = min(self.low.get(c.field, math.inf), c.value)
            elif c.operator in ("lt", "lte"):
                self.high[c.field] = max(self.high.get(c.field, -math.inf), c.value)
            else:
                self.values.setdefault(c.field, set()).update(c.value if c.operator == "in" else [c.value])
        return True

    def columns(self) -> list[Column]:
        # Bounds move out to whole numbers for integer columns, and out by a little for floats.
        def bound(name: str, value: float, out: int) -> Column:
            kind = self.types[name]
            if isinstance(kind, T.FloatType | T.DoubleType):
                return F.lit(float(value) + out * (abs(value) * 1e-6 + 1e-6)).cast(kind)
            edge = {T.ByteType: 2**7, T.ShortType: 2**15}.get(type(kind), 2**31)
            return F.lit(max(-edge, min(edge - 1, math.floor(value) if out < 0 else math.ceil(value)))).cast(kind)

        found = [qcol(n) >= bound(n, v, -1) for n, v in self.low.items()] + [qcol(n) <= bound(n, v, 1) for n, v in self.high.items()]
        for n, values in self.values.items():
            texts = isinstance(self.types[n], T.StringType)
            found.append(qcol(n).isin(sorted(values)) if texts else (qcol(n) >= bound(n, min(values), -1)) & (qcol(n) <= bound(n, max(values), 1)))
        return found


@dataclass
class _Program:
    runnable: list[Rule]
    prefilter: Column
    index: RuleIndex
    elements: list[Column]             # codes of the OR rules, null where a rule does not match
    wide_evidence: dict[int, Column]   # ordinal -> evidence array for very wide OR rules
    masked: list[bool]                 # ordinal -> evidence filtered by the bitmask


def _program(df_schema: T.StructType, ruleset: Ruleset, runnable: list[Rule]) -> _Program:
    n = len(runnable)
    mask_bits = 62 - n.bit_length()
    filters: list[Column] = []
    ranges = _Ranges(df_schema)
    elements: list[Column] = []
    wide: dict[int, Column] = {}
    masked: list[bool] = []
    index = RuleIndex(runnable, df_schema)
    for i, rule in enumerate(runnable):
        covered = ranges.cover(rule)
        masked.append(False)
        if covered and (rule.combination == "and" or len(rule.criteria) == 1):
            continue
        compiled: list[Compiled] = [compile_criterion(c, df_schema) for c in rule.criteria]
        if not covered:
            filters.append(_combine([c.prefilter for c in compiled], rule.combination))
        k = len(compiled)
        if rule.combination == "or" and k > 1:
            if k <= mask_bits:
                mask = reduce(lambda a, b: a + b, [
                    F.when(c.filter, F.lit(1 << j)).otherwise(F.lit(0)).cast("long")
                    for j, c in enumerate(compiled)])
                code = F.lit(i).cast("long") + F.lit(n).cast("long") * mask
                masked[i] = True
            else:
                texts = [F.when(c.filter, F.lit(crit.evidence_text()))
                         for c, crit in zip(compiled, rule.criteria, strict=True)]
                wide[i] = F.array_compact(F.array(*texts))
                code = F.lit(i).cast("long")
            # NULL means "no" here: no NOT is applied above these, and CASE WHEN NULL is not taken.
            elements.append(F.when(_combine([c.filter for c in compiled], "or"), code))
    return _Program(runnable, _combine([*ranges.columns(), *filters], "or"), index, elements, wide, masked)


def _matches(df: DataFrame, ruleset: Ruleset, prog: _Program, keep: list[str]) -> tuple[DataFrame, int]:
    """Rows with one ``_cue_code`` per matching rule, plus target_id, subject, keep columns."""
    n = len(prog.runnable)
    id_type = df.schema[ruleset.id_field].dataType
    id_col = qcol(ruleset.id_field)
    wide_cols = [prog.wide_evidence[i].alias(f"_cue_ev{i}") for i in sorted(prog.wide_evidence)]
    wide_names = [f"_cue_ev{i}" for i in sorted(prog.wide_evidence)]
    # The generator drops rows without a match. target_id and subject are computed once per input row, not
    # per signal. array_compact runs over the codes of OR rules only.
    hit = prog.index.codes(
        df.filter(prog.prefilter),
        [*[qcol(k) for k in keep], python_text(id_col, id_type).alias("target_id"),
         F.to_json(F.struct(id_col.alias(ruleset.id_field)), {"ignoreNullFields": "false"}).alias("subject"), *wide_cols],
        [*keep, "target_id", "subject", *wide_names], _CODE, F.array_compact(F.array(*prog.elements)) if prog.elements else None)
    return hit, n


def empty_signals(df: DataFrame) -> DataFrame:
    """A signal-shaped empty result that keeps the input's streaming/batch nature."""
    cols = [F.lit(None).cast(t).alias(c) for c, t in (
        ("target_id", "string"), ("rule_id", "bigint"), ("label", "string"), ("score", "double"),
        ("confidence", "string"), ("evidence", "array<string>"), ("features", "string"),
        ("subject", "string"), ("note", "string"))]
    return df.filter(F.lit(False)).select(*cols)


def evaluate(df: DataFrame, ruleset: Ruleset | dict[str, Any] | str,
             keep: list[str] | None = None) -> DataFrame:
    """Every runnable rule against every row; one signal row per (row, matching rule).

    Rules that can never fire on this schema are skipped (see ``unsupported``). ``keep`` names
    input columns to carry next to the signal columns (e.g. a run or partition key).
    """
    if not isinstance(ruleset, Ruleset):
        ruleset = load(ruleset)
    known = set(df.columns)
    runnable = [r for r in ruleset.rules if not never_fires(r, known, ruleset.id_field)]
    if not runnable:
        return empty_signals(df)
    prog = _program(df.schema, ruleset, runnable)
    keep = list(keep or [])
    hit, n = _matches(df, ruleset, prog, keep)

    code = F.col(_CODE)
    ordinal = (code % F.lit(n)).cast("int")
    mask = F.expr(f"{_CODE} div {n}")
    at = ordinal + F.lit(1)
    scores = [normalise_score_py(r.score) for r in runnable]
    texts = const_array([[c.evidence_text() for c in r.criteria] for r in runnable], "array<string>")
    evidence_all = F.element_at(texts, at)
    if any(prog.masked):
        evidence = F.when(F.element_at(const_array(prog.masked, "boolean"), at),
                          F.filter(evidence_all, lambda x, j: F.getbit(mask, j) == F.lit(1)))
    else:
        evidence = None
    for i in sorted(prog.wide_evidence):
        evidence = (evidence if evidence is not None else F).when(ordinal == F.lit(i), F.col(f"_cue_ev{i}"))
    evidence = evidence.otherwise(evidence_all) if evidence is not None else evidence_all

    return hit.select(
        *[qcol(k) for k in keep],
        "target_id",
        F.element_at(const_array([r.rule_id for r in runnable], "bigint"), at).alias("rule_id"),
        F.element_at(const_array([r.label for r in runnable], "string"), at).alias("label"),
        F.element_at(const_array(scores, "double"), at).alias("score"),
        F.element_at(const_array([confidence_band_py(s) for s in scores], "string"), at).alias("confidence"),
        evidence.alias("evidence"),
        F.element_at(const_array([r.features_json() for r in runnable], "string"), at).alias("features"),
        "subject",
        F.lit(NOTE).alias("note"),
    )


# ------------------------------------------------------------------ compact signals + rule table

def evaluate_compact(df: DataFrame, ruleset: Ruleset | dict[str, Any] | str,
                     keep: list[str] | None = None) -> DataFrame:
    """Like ``evaluate`` but each signal row holds only ``target_id, subject, rule_id,
    evidence_mask`` (bit j set = criterion j passed) plus ``evidence_override`` for OR rules too
    wide for a mask. Rule constants live in ``rule_dimension``; ``expand`` joins them back."""
    if not isinstance(ruleset, Ruleset):
        ruleset = load(ruleset)
    known = set(df.columns)
    runnable = [r for r in ruleset.rules if not never_fires(r, known, ruleset.id_field)]
    keep = list(keep or [])
    if not runnable:
        return df.filter(F.lit(False)).select(
            *[qcol(k) for k in keep], F.lit(None).cast("string").alias("target_id"),
            F.lit(None).cast("string").alias("subject"), F.lit(None).cast("long").alias("rule_id"),
            F.lit(None).cast("long").alias("evidence_mask"),
            F.lit(None).cast("array<string>").alias("evidence_override"))
    prog = _program(df.schema, ruleset, runnable)
    hit, n = _matches(df, ruleset, prog, keep)
    code = F.col(_CODE)
    ordinal = (code % F.lit(n)).cast("int")
    at = ordinal + F.lit(1)
    full = const_array([(1 << len(r.criteria)) - 1 if len(r.criteria) < 63 else -1 for r in runnable], "bigint")
    mask = F.when(F.element_at(const_array(prog.masked, "boolean"), at), F.expr(f"{_CODE} div {n}")) \
        .otherwise(F.element_at(full, at))
    override = None
    for i in sorted(prog.wide_evidence):
        override = (override if override is not None else F).when(ordinal == F.lit(i), F.col(f"_cue_ev{i}"))
    override = override if override is not None else F.lit(None).cast("array<string>")
    return hit.select(*[qcol(k) for k in keep], "target_id", "subject",
                      F.element_at(const_array([r.rule_id for r in runnable], "bigint"), at).alias("rule_id"),
                      mask.alias("evidence_mask"), override.alias("evidence_override"))


def rule_dimension(spark, ruleset: Ruleset | dict[str, Any] | str) -> DataFrame:
    """One row per rule with its constants: a small table whose size is the ruleset's."""
    if not isinstance(ruleset, Ruleset):
        ruleset = load(ruleset)
    rows = []
    for r in ruleset.rules:
        score = normalise_score_py(r.score)
        rows.append((r.rule_id, r.label, score, confidence_band_py(score), r.features_json(),
                     [c.evidence_text() for c in r.criteria]))
    return spark.createDataFrame(rows, "rule_id long, label string, score double, confidence string, "
                                       "features string, evidence_texts array<string>")


def expand(compact: DataFrame, rules: DataFrame) -> DataFrame:
    """Compact signals + rules dimension -> full signal rows. Spark broadcasts the dimension where
    its size allows; that of ``rule_dimension`` is known, as it is a local relation."""
    joined = compact.join(rules, on="rule_id", how="inner")
    texts = F.col("evidence_texts")
    ev = F.coalesce(F.col("evidence_override"),
                    F.when(F.col("evidence_mask") == F.lit(-1), texts).otherwise(
                        F.filter(texts, lambda x, j: F.getbit(F.col("evidence_mask"), j) == F.lit(1))))
    extra = [c for c in compact.columns if c not in ("target_id", "subject", "rule_id", "evidence_mask",
                                                     "evidence_override")]
    return joined.select(*[qcol(c) for c in extra], "target_id", "rule_id", "label", "score", "confidence",
                         ev.alias("evidence"), "features", "subject", F.lit(NOTE).alias("note"))


def rule_counts(signals: DataFrame) -> DataFrame:
    """Signals per rule (map-side partial aggregation; one row per rule)."""
    return signals.groupBy("rule_id", "label").agg(F.count(F.lit(1)).alias("n_signals"))


# ---------------------------------------------------------------------- rules held as a table

RULES_TABLE_SCHEMA = (
    "rule_id long, score double, label string, combination string, "
    "criteria array<struct<field:string, operator:string, value:string, baseline_field:string>>"
)


def rules_from_table(rows: list[dict[str, Any]]) -> dict[str, Any]:
    """Turn collected rule rows (a small, driver-sized config table) into a ruleset document."""
    rules = []
    for r in rows:
        crits = []
        for c in r["criteria"] or []:
            crits.append({"field": c["field"], "operator": c["operator"],
                          "value": json.loads(c["value"]) if c["value"] is not None else None,
                          "baseline_field": c["baseline_field"]})
        rules.append({"rule_id": r["rule_id"], "score": r["score"], "label": r["label"],
                      "conditions": {"combination": r["combination"], "criteria": crits}})
    return {"rules": rules}


def validate_rules(rules: DataFrame, known_fields: list[str] | None = None, id_field: str | None = None) -> DataFrame:
    """Hard checks and the never-fires report for a rules *table*, fully on executors.

    ``criteria.value`` holds JSON text so any JSON value can be expressed. Output rows:
    ``rule_id, loc, msg, severity`` with severity ``error`` or ``unsupported``.
    """
    numeric_ops = F.array(*[F.lit(o) for o in NUMERIC_OPERATORS])
    known_ops = F.array(*[F.lit(o) for o in OPERATORS])
    crit = rules.select("rule_id", "combination", F.posexplode_outer("criteria").alias("pos", "c"))
    v = F.col("c.value")
    first = F.substring(F.ltrim(v), 1, 1)
    is_number = v.isNotNull() & F.ltrim(v).rlike(r"^-?(\d|[1-9]\d+)(\.\d+)?([eE][+-]?\d+)?\s*$")
    is_list = first == F.lit("[")
    is_text = first == F.lit('"')
    op = F.col("c.operator")
    loc = F.concat(F.lit("criteria."), F.col("pos").cast("string"))
    checks = [
        (~F.coalesce(F.array_contains(known_ops, op), F.lit(False)), F.concat(F.lit("unknown operator "), F.coalesce(op, F.lit("null")))),
        (F.array_contains(numeric_ops, op) & ~is_number, F.concat(op, F.lit(" needs a numeric value"))),
        ((op == "relative_decrease") & (F.coalesce(F.col("c.baseline_field"), F.lit("")) == ""),
         F.lit("relative_decrease needs 'baseline_field'")),
        ((op == "in") & ~is_list, F.lit("'in' needs a list value")),
        ((op == "text_present") & ~(is_text & (F.trim(v) != F.lit('""'))),
         F.lit("'text_present' needs non-empty text")),
    ]
    errs = crit.filter(F.col("c").isNotNull()).select(
        "rule_id", loc.alias("loc"),
        F.explode(F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in checks]))).alias("msg"))
    dup = (rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
           .select("rule_id", F.lit("rule_id").alias("loc"), F.lit("rule_id is used more than once").alias("msg")))
    shape = rules.select(
        "rule_id", F.lit("rule").alias("loc"),
        F.explode(F.array_compact(F.array(
            F.when(~F.coalesce(F.col("combination").isin("and", "or"), F.lit(False)), F.lit("combination must be 'and' or 'or'")),
            F.when(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1) | F.isnan("score"),
                   F.lit("score must be a number in [0, 1]")),
        ))).alias("msg"))
    out = errs.unionByName(dup).unionByName(shape).withColumn("severity", F.lit("error"))
    known = F.array(*[F.lit(k) for k in (known_fields or [])]).cast("array<string>")
    refs = F.transform("criteria", lambda c: F.array_compact(F.array(c["field"], c["baseline_field"])))
    missing = F.transform(refs, lambda r: F.array_except(r, known))
    any_missing = F.exists(missing, lambda m: F.size(m) > 0)
    all_missing = F.forall(missing, lambda m: F.size(m) > 0)
    empty = F.coalesce(F.size("criteria"), F.lit(0)) <= 0
    if known_fields is None:
        reason = F.when(empty, F.lit("no criteria: the rule cannot match any row"))
    else:
        no_id = F.lit(id_field is not None and id_field not in known_fields)
        reason = (F.when(empty, F.lit("no criteria: the rule cannot match any row"))
                  .when(no_id, F.lit(f"id field {id_field!r} is absent from the data"))
                  .when(((F.col("combination") == "and") & any_missing)
                        | ((F.col("combination") == "or") & all_missing),
                        F.concat(F.lit("fields absent from the data: "),
                                 F.array_join(F.array_sort(F.array_distinct(F.flatten(missing))), ", "))))
    unsup = rules.select("rule_id", F.lit("rule").alias("loc"), reason.alias("msg")) \
        .filter(F.col("msg").isNotNull()).withColumn("severity", F.lit("unsupported"))
    return out.unionByName(unsup)
