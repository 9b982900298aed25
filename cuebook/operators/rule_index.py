"""Threshold index over the columns of a ruleset: which rules match a row, without asking each rule.

Criteria that compare a number with a constant (``lt lte gt gte eq ne in`` on a numeric column, the bounds on numeric
text, ``relative_decrease`` on its pair of columns) lie on *axes*. An axis has the sorted distinct constants of all its
criteria as cut points; a value falls on a cut point or between two, which is its place. Per axis and place a bitmap, built
once on the driver, names the rules whose criteria on that axis all pass. A row does one binary search per axis, unrolled into
log2(cut points) projections, and ANDs the bitmaps, 64 rules a word. Criteria that have no axis are computed once each,
however many rules share them, and clear the bits of their rules. Words without a bit go; the set bits of the others
become rule ordinals a byte at a time, through constant arrays.

So a row costs axes x log(cut points), a word per 64 rules and its matches. Everything is native projections and
generators, whose code does not grow with the rules. The bitmaps hold places x rules bits an axis: half a megabyte for
1,000 rules of two cut points each, 50 MB for 10,000; beyond a few thousand rules take the join of ``rule_join.py``. Rules that join their criteria by "or" are not indexed (see ``rules.py``); they need which criteria passed.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import FRACTIONAL, INTEGRAL, compile_criterion, decrease_ratio, python_float, qcol
from ..model import Criterion, Rule

WORD, BYTE = 64, 8


def const_array(values: Sequence[Any], kind: str) -> Column:
    """A constant array built from one JSON literal: Catalyst folds it into a literal array,
    and the driver makes one call instead of two per element (matters at hundreds of rules)."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


@dataclass
class _Axis:
    """One number of a row and the criteria that compare it."""

    value: Column
    tests: list[tuple[int, Criterion]] = field(default_factory=list)  # (rule ordinal, criterion)
    cuts: list[float] = field(default_factory=list)

    def spans(self, c: Criterion) -> list[tuple[int, int]]:
        """The places where ``c`` holds, as runs: 2i is between cut points i-1 and i, 2i+1 is on cut point i; the last is no number."""
        last = 2 * len(self.cuts) + 1
        on = sorted({2 * bisect_left(self.cuts, v) + 1 for v in (c.value if c.operator == "in" else [c.value])})
        if c.operator in ("eq", "in"):
            return [(p, p) for p in on]
        at = on[0]
        return {"lt": [(0, at - 1)], "lte": [(0, at)], "gt": [(at + 1, last - 1)], "ne": [(0, at - 1), (at + 1, last)]} \
            .get(c.operator, [(at, last - 1)])

    def bitmaps(self, rules: int) -> list[int]:
        """For each place the bits of the rules that it does not rule out."""
        places = 2 * len(self.cuts) + 2
        own: dict[int, list[tuple[int, int]]] = {}
        for ordinal, c in self.tests:
            spans = own.get(ordinal, [(0, places - 1)])
            own[ordinal] = [(max(a, x), min(b, y)) for a, b in spans for x, y in self.spans(c) if max(a, x) <= min(b, y)]
        begin, end = [0] * (places + 1), [0] * (places + 1)
        for ordinal, spans in own.items():
            for a, b in spans:
                begin[a] |= 1 << ordinal
                end[b + 1] |= 1 << ordinal
        now = ((1 << rules) - 1) & ~sum(1 << i for i in own)
        out = []
        for p in range(places):
            now = now & ~end[p] | begin[p]
            out.append(now)
        return out


def _plain(v: Any) -> bool:
    return type(v) in (int, float) and abs(v) < 2**53  # a NaN is not, an exact double is


def axis_of(c: Criterion, types: dict[str, T.DataType]) -> tuple | None:
    """The key of the axis that decides ``c``, None if it has none."""
    kind = types.get(c.field)
    if c.operator in ("lt", "lte", "gt", "gte") and _plain(c.value):
        if isinstance(kind, INTEGRAL + FRACTIONAL):
            return ("number", c.field)
        return ("text", c.field) if isinstance(kind, T.StringType) else None
    if c.operator in ("eq", "ne") and _plain(c.value) and isinstance(kind, INTEGRAL + FRACTIONAL):
        return ("number", c.field)
    if c.operator == "in" and isinstance(kind, INTEGRAL + FRACTIONAL) and isinstance(c.value, list | tuple) and all(map(_plain, c.value)):
        return ("number", c.field)
    if c.operator == "relative_decrease" and _plain(c.value) and c.baseline_field in types:
        return ("decrease", c.field, c.baseline_field)
    return None


class RuleIndex:
    """The index of the "and" rules among ``rules``; ordinals are places in ``rules``."""

    def __init__(self, rules: list[Rule], schema: T.StructType):
        self.schema, self.n = schema, len(rules)
        self.types = {f.name: f.dataType for f in schema.fields}
        self.axes: dict[tuple, _Axis] = {}
        self.others: dict[str, tuple[Criterion, list[int]]] = {}
        self.indexed = [i for i, r in enumerate(rules) if r.combination == "and" or len(r.criteria) == 1]
        for i in self.indexed:
            for c in rules[i].criteria:
                self._take(i, c)
        for axis in self.axes.values():
            axis.cuts = sorted({float(v) + 0.0 for _, c in axis.tests for v in (c.value if c.operator == "in" else [c.value])})

    def _take(self, ordinal: int, c: Criterion) -> None:
        key = axis_of(c, self.types)
        value = self._value(key) if key and key not in self.axes else None
        if key and (key in self.axes or value is not None):
            self.axes.setdefault(key, _Axis(value)).tests.append((ordinal, c))
        else:
            name = json.dumps([c.field, c.operator, c.value, c.baseline_field], default=str) + str(type(c.value))
            self.others.setdefault(name, (c, []))[1].append(ordinal)

    def _value(self, key: tuple) -> Column | None:
        """A double; null or NaN where no criterion but "ne" holds."""
        if key[0] == "number":
            return qcol(key[1]).cast("double")
        numbers = [python_float(qcol(name), self.types[name]) for name in key[1:]]
        if None in numbers:
            return None
        return numbers[0][0] if key[0] == "text" else decrease_ratio(numbers[0][0], numbers[1][0])

    def _tables(self, more: bool) -> tuple[list[list[list[int]]], list[list[int]]]:
        """(for each axis the words at each place, for each other criterion the words when it fails).

        Words have an end of their own that is set where there are ``more`` codes. The first axis knows which rules are indexed."""
        words, every = -(-self.n // WORD), (1 << self.n) - 1
        tables = [axis.bitmaps(self.n) for axis in self.axes.values()] or [[every]]
        tables[0] = [x & sum(1 << i for i in self.indexed) for x in tables[0]]
        fails = [every & ~sum(1 << i for i in set(rules)) for _, rules in self.others.values()]

        def split(bits: int) -> list[int]:
            row = [bits >> WORD * k & (1 << WORD) - 1 for k in range(words)]
            return [*(x - (x >> WORD - 1 << WORD) for x in row), *([-1] if more else [])]

        return [[split(x) for x in table] for table in tables], [split(x) for x in fails]

    def _places(self, out: DataFrame, stay: list[Column], values: list[str], places: list[str]) -> DataFrame:
        """The place of each axis' value: an unrolled binary search, then whether the value lies on its cut point."""
        cuts = [const_array(axis.cuts, "double") for axis in self.axes.values()]
        size = [len(axis.cuts) for axis in self.axes.values()]
        step = 1 << max(size, default=0).bit_length()
        while step > 1:
            step //= 2
            found = [(F.when(F.get(own, F.col(p) + F.lit(step - 1)) < F.col(x), F.col(p) + F.lit(step)).otherwise(F.col(p))
                      if step <= n else F.col(p)).alias(p) for own, n, x, p in zip(cuts, size, values, places, strict=True)]
            out = out.select(*stay, *map(F.col, values), *found)
        return out.select(*stay, *[
            F.when(F.col(x).isNull() | F.isnan(x), F.lit(2 * n + 1))
            .otherwise(F.col(p) * 2 + F.coalesce((F.get(own, F.col(p)) == F.col(x)).cast("int"), F.lit(0))).alias(p)
            for own, n, x, p in zip(cuts, size, values, places, strict=True)])

    def codes(self, src: DataFrame, keep: list[Column], names: list[str], code: str, more: Column | None = None) -> DataFrame:
        """``keep`` (columns called ``names``), a row for each matching rule with its ordinal as ``code``, and one for
        each value of the array ``more``."""
        places = [f"_cue_p{a}" for a in range(len(self.axes))]
        values = [f"_cue_x{a}" for a in range(len(self.axes))]
        others = [f"_cue_o{j}" for j in range(len(self.others))]
        rest = [*others, *(["_cue_more"] if more is not None else [])]
        out = src.select(*keep, *[compile_criterion(c, self.schema).value.alias(o) for (c, _), o in zip(self.others.values(), others, strict=True)],
                         *([more.alias("_cue_more")] if more is not None else []),
                         *[axis.value.alias(x) for axis, x in zip(self.axes.values(), values, strict=True)],
                         *[F.lit(0).alias(p) for p in places])
        out = self._places(out, [qcol(n) for n in [*names, *rest]], values, places)
        tables, fails = self._tables(more is not None)
        rows = [F.get(const_array(table, "array<bigint>"), F.col(p) if self.axes else F.lit(0)) for table, p in zip(tables, places or [""], strict=True)]
        # The generators explode expressions, not columns: from a column Catalyst would infer a filter, push it below
        # the projections and so write the whole search out again, each step three times in the next.
        out = out.select(*[qcol(n) for n in names], *rest, *places[1:], F.posexplode(rows[0]).alias("_cue_k", "_cue_w"))
        word = F.col("_cue_w")
        for row in rows[1:]:
            word = word.bitwiseAND(F.get(row, F.col("_cue_k")))
        for name, row in zip(others, fails, strict=True):
            word = word.bitwiseAND(F.when(F.col(name), F.lit(-1).cast("long")).otherwise(F.get(const_array(row, "bigint"), F.col("_cue_k"))))
        out = out.select(*[qcol(n) for n in names], *rest[len(others):], "_cue_k", word.alias("_cue_w")).filter("_cue_w <> 0")
        bits = []
        for first in range(0, WORD, BYTE):
            lists = [[first + b for b in range(BYTE) if x >> b & 1] for x in range(1 << BYTE)]
            byte = F.shiftrightunsigned("_cue_w", first).bitwiseAND(F.lit((1 << BYTE) - 1)).cast("int")
            bits.append(F.get(const_array(lists, "array<bigint>"), byte))
        found, base = F.flatten(F.array(*bits)), F.col("_cue_k").cast("long") * WORD
        if more is not None:
            end = F.col("_cue_k") == F.lit(-(-self.n // WORD))
            found, base = F.when(end, F.col("_cue_more")).otherwise(found), F.when(end, F.lit(0).cast("long")).otherwise(base)
        out = out.select(*[qcol(n) for n in names], base.alias("_cue_base"), F.explode(found).alias("_cue_bit"))
        return out.select(*[qcol(n) for n in names], (F.col("_cue_base") + F.col("_cue_bit")).alias(code))
