"""Criterion -> Column, decided by the column's Spark type at plan-build time.

Every criterion compiles to two forms:

* ``filter`` form: may be NULL where the answer is "no"; used inside the OR pre-filter so that
  plain comparisons still reach the parquet scan as pushed filters.
* ``value`` form: ``coalesce(filter, false)`` -- never NULL, safe under NOT and inside arrays.
* ``loose`` form: a superset of the matches that pushes to the scan (no NaN guard); only used
  in the pre-filter, where letting extra rows through is harmless because the rule program
  decides the matches afterwards.

The semantics follow plain Python comparison of a row value with a JSON value:
no text<->number coercion, ``True == 1``, NaN never compares, NULL equals only null,
numeric operators convert with Python's ``float()`` rules and fail closed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Criterion

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)

# Fixed value: the text grammar Python's float() accepts (ASCII digits, optional '_' between
# digits, optional exponent, inf/infinity/nan in any case), with surrounding whitespace.
PY_FLOAT_PATTERN = (
    r"(?i)^\s*[+-]?(?:(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:e[+-]?\d(?:_?\d)*)?"
    r"|inf|infinity|nan)\s*$"
)


@dataclass(frozen=True)
class Compiled:
    filter: Column
    nullable: bool = True
    loose: Column | None = None

    @property
    def value(self) -> Column:
        """Null-free form, built only where it is needed (each Column op is a driver call)."""
        return F.coalesce(self.filter, F.lit(False)) if self.nullable else self.filter

    @property
    def prefilter(self) -> Column:
        return self.loose if self.loose is not None else self.filter


def qcol(name: str) -> Column:
    """Reference a top-level column by its exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def _false() -> Compiled:
    return Compiled(F.lit(False), nullable=False)


def _both(expr: Column, nullable: bool = True) -> Compiled:
    return Compiled(expr, nullable)


def _is_nan_value(v: Any) -> bool:
    return isinstance(v, float) and math.isnan(v)


def python_float(c: Column, dtype: T.DataType) -> tuple[Column, bool] | None:
    """``float(value)`` as a double Column, or None when Python would always refuse.

    The flag says whether the result can be NaN (then comparisons need a NaN guard).
    """
    if isinstance(dtype, INTEGRAL):
        return c.cast("double"), False
    if isinstance(dtype, T.DecimalType):
        return c.cast("double"), False
    if isinstance(dtype, FRACTIONAL):
        return c.cast("double"), True
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double"), False
    if isinstance(dtype, T.StringType):
        cleaned = F.regexp_replace(c, "_", "")
        conv = F.when(c.rlike(PY_FLOAT_PATTERN), cleaned.try_cast("double"))
        return conv, True
    return None  # dates, timestamps, binary, nested: float() raises -> criterion is false


def python_float_repr(d: Column) -> Column:
    """Python's ``repr`` of a finite double: the shortest digits that read back as the same
    double (the first of 15, 16, 17 significant digits that round-trips, trailing zeros
    dropped), in fixed notation for decimal exponents -4..15 ('10000000.0', '0.0001') and as
    'd.ddde+XX' otherwise."""
    def sci(p: int) -> Column:
        return F.format_string(f"%.{p}e", d)

    def trips(t: Column) -> Column:
        return t.try_cast("double") == d

    t = F.when(trips(sci(14)), sci(14)).when(trips(sci(15)), sci(15)).otherwise(sci(16))
    sign = F.regexp_extract(t, r"^(-?)", 1)
    lead = F.regexp_extract(t, r"^-?(\d)", 1)
    frac = F.regexp_replace(F.regexp_extract(t, r"^-?\d\.(\d+)e", 1), "0+$", "")
    e = F.regexp_extract(t, r"e([+-]\d+)$", 1).try_cast("int")
    digits = F.concat(lead, frac)
    n = F.length(digits)
    whole = F.substring(F.rpad(digits, F.greatest(n, e + 1), F.lit("0")), F.lit(1), e + 1)
    rest = F.substring(digits, e + 2, 1000)
    fixed_pos = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    fixed_neg = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    mant = F.concat(lead, F.when(n > 1, F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    ae = F.abs(e).cast("string")
    exp_txt = F.concat(F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                       F.when(F.length(ae) < 2, F.concat(F.lit("0"), ae)).otherwise(ae))
    body = (F.when((e >= 0) & (e < 16), fixed_pos).when((e < 0) & (e >= -4), fixed_neg)
            .otherwise(F.concat(mant, F.lit("e"), exp_txt)))
    zero = F.when(d == 0, F.when(F.format_string("%s", d).startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(finite, F.coalesce(zero, F.concat(sign, body)))


def python_text(c: Column, dtype: T.DataType) -> Column:
    """``str(value)`` of a row value as text (NULL -> 'None', True -> 'True', inf -> 'inf')."""
    if isinstance(dtype, T.StringType):
        txt = c
    elif isinstance(dtype, T.BooleanType):
        txt = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dtype, FRACTIONAL):
        d = c.cast("double")
        txt = (F.when(F.isnan(d), F.lit("nan"))
               .when(d == float("inf"), F.lit("inf"))
               .when(d == float("-inf"), F.lit("-inf"))
               .otherwise(python_float_repr(d)))
    elif isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        txt = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
            .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    else:
        txt = c.cast("string")
    return F.coalesce(txt, F.lit("None"))


def _eq(c: Column, dtype: T.DataType, v: Any) -> Compiled:
    """Python ``row_value == v`` (null-free: eqNullSafe never yields NULL)."""
    if v is None:
        return _both(c.isNull(), nullable=False)
    if isinstance(v, bool):
        if isinstance(dtype, T.BooleanType):
            return _both(c.eqNullSafe(F.lit(v)), nullable=False)
        if isinstance(dtype, INTEGRAL + FRACTIONAL + (T.DecimalType,)):
            return _both(c.eqNullSafe(F.lit(int(v))), nullable=False)
        return _false()
    if isinstance(v, int | float):
        if _is_nan_value(v):
            return _false()
        if isinstance(dtype, INTEGRAL):
            if isinstance(v, float) and not (math.isinf(v) or v.is_integer()):
                return _false()
            if isinstance(v, float) and math.isinf(v) or not _in_64_bits(v):
                return _false()
            return _both(c.eqNullSafe(F.lit(int(v))), nullable=False)
        if isinstance(dtype, FRACTIONAL + (T.DecimalType,)):
            if isinstance(v, int) and not _in_64_bits(v) and int(_as_double(v) if abs(v) < 2**1023 else 0) != v:
                return _false()
            return _both(c.eqNullSafe(F.lit(_as_double(v))), nullable=False)
        if isinstance(dtype, T.BooleanType):
            if v in (0, 1):
                return _both(c.eqNullSafe(F.lit(bool(v))), nullable=False)
            return _false()
        return _false()
    if isinstance(v, str):
        if isinstance(dtype, T.StringType):
            return _both(c.eqNullSafe(F.lit(v)), nullable=False)
        return _false()
    if isinstance(v, list | tuple) and isinstance(dtype, T.ArrayType):
        same = F.coalesce(F.size(c) == len(v), F.lit(False)) & c.isNotNull()
        for i, x in enumerate(v):
            same = same & _eq(F.get(c, F.lit(i)), dtype.elementType, x).value
        return _both(same, nullable=False)
    return _false()  # lists / objects never equal a scalar column


def _in_64_bits(v: int | float) -> bool:
    return -(2**63) <= v < 2**63


def _as_double(v: int | float) -> float:
    """``v`` as a double; an integer beyond its range is infinite."""
    return float(v) if abs(v) < 2**1023 else math.copysign(math.inf, v)


def _in(c: Column, dtype: T.DataType, values: list[Any]) -> Compiled:
    """Python ``row_value in values`` -- membership by the same equality as ``eq``."""
    has_null = any(v is None for v in values)
    typed: list[Any] = []
    for v in values:
        if v is None or isinstance(v, list | dict) or _is_nan_value(v):
            continue
        if isinstance(dtype, T.StringType):
            if isinstance(v, str):
                typed.append(v)
        elif isinstance(dtype, T.BooleanType):
            if isinstance(v, bool):
                typed.append(v)
            elif isinstance(v, int | float) and v in (0, 1):
                typed.append(bool(v))
        elif isinstance(dtype, INTEGRAL):
            if isinstance(v, bool):
                typed.append(int(v))
            elif isinstance(v, int | float) and _in_64_bits(v) and int(v) == v:
                typed.append(int(v))
        elif isinstance(dtype, FRACTIONAL + (T.DecimalType,)):
            if isinstance(v, int | float) and (isinstance(v, float) or _in_64_bits(v)):
                typed.append(float(v))
    typed = list(dict.fromkeys(typed))
    parts: list[Column] = []
    if typed:
        parts.append(c.isin(typed))
    if has_null:
        parts.append(c.isNull())
    if not parts:
        return _false()
    expr = parts[0] if len(parts) == 1 else (parts[0] | parts[1])
    return _both(expr)


def _compare(conv: tuple[Column, bool] | None, op: str, v: float) -> Compiled:
    if conv is None or _is_nan_value(v):
        return _false()
    x, may_nan = conv
    v = v if isinstance(v, float) or _in_64_bits(v) else _as_double(v)
    if op == "lt":
        expr = x < F.lit(v)
    elif op == "lte":
        expr = x <= F.lit(v)
    elif op == "gt":
        expr = x > F.lit(v)
    else:
        expr = x >= F.lit(v)
    loose = expr
    if may_nan and op in ("gt", "gte"):
        expr = expr & ~F.isnan(x)
    return Compiled(expr, True, loose)


def _numeric_column_compare(c: Column, dtype: T.DataType, op: str, v: float) -> Compiled:
    """Plain numeric column: compare the column itself so the predicate pushes to the scan."""
    if _is_nan_value(v):
        return _false()
    lit = F.lit(v if isinstance(v, float) or _in_64_bits(v) else _as_double(v))
    if op == "lt":
        expr = c < lit
    elif op == "lte":
        expr = c <= lit
    elif op == "gt":
        expr = c > lit
    else:
        expr = c >= lit
    loose = expr
    if isinstance(dtype, FRACTIONAL) and op in ("gt", "gte"):
        expr = expr & ~F.isnan(c)
    return Compiled(expr, True, loose)


def _relative_decrease(cur: tuple[Column, bool] | None, base: tuple[Column, bool] | None,
                       v: float) -> Compiled:
    """(baseline - current) / baseline * 100 >= v; zero/NULL/unconvertible baseline -> false."""
    if cur is None or base is None or _is_nan_value(v):
        return _false()
    ratio = decrease_ratio(cur[0], base[0])
    return _both(~F.isnan(ratio) & (ratio >= F.lit(float(v))))


def decrease_ratio(current: Column, baseline: Column) -> Column:
    """(baseline - current) / baseline * 100, null for a zero or missing baseline."""
    return F.when(baseline != F.lit(0.0), F.try_divide(baseline - current, baseline) * F.lit(100.0))


def compile_criterion(crit: Criterion, schema: T.StructType) -> Compiled:
    """Compile one criterion against a schema; absent fields compile to false."""
    types = {f.name: f.dataType for f in schema.fields}
    if crit.field not in types:
        return _false()
    c = qcol(crit.field)
    dtype = types[crit.field]
    op, v = crit.operator, crit.value
    if op == "eq":
        return _eq(c, dtype, v)
    if op == "ne":
        eq = _eq(c, dtype, v)
        return Compiled(~eq.value, nullable=False)
    if op == "in":
        if not isinstance(v, list | tuple):
            return _false()
        return _in(c, dtype, list(v))
    if op == "text_present":
        needle = str(v).lower()
        expr = F.lower(python_text(c, dtype)).contains(F.lit(needle))
        return Compiled(expr, nullable=False)
    if op in ("lt", "lte", "gt", "gte"):
        if isinstance(v, bool) or not isinstance(v, int | float):
            return _false()
        if isinstance(dtype, INTEGRAL + FRACTIONAL + (T.DecimalType,)):
            return _numeric_column_compare(c, dtype, op, float(v))
        return _compare(python_float(c, dtype), op, float(v))
    if op == "relative_decrease":
        if not crit.baseline_field or crit.baseline_field not in types:
            return _false()
        if isinstance(v, bool) or not isinstance(v, int | float):
            return _false()
        cur = python_float(c, dtype)
        base = python_float(qcol(crit.baseline_field), types[crit.baseline_field])
        return _relative_decrease(cur, base, float(v))
    return _false()
