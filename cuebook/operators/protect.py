"""Column masking and text redaction as DataFrame transforms (all native expressions)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import qcol
from ..functions.text import redact_text

# Common personal-data column names for the opt-in default masking.
COMMON_PII_COLUMNS = frozenset({
    "name", "first_name", "last_name", "full_name", "email", "phone", "phone_number", "ssn",
    "national_id", "address", "street", "zip", "zipcode", "postal_code", "dob", "birth_date",
    "date_of_birth",
})
MASK = "***"
LOCAL_MODEL_PREFIX = "local/"


def mask_columns(df: DataFrame, columns: Iterable[str], mask: str = MASK,
                 case_insensitive: bool = True) -> DataFrame:
    """Replace every value (NULLs too) of the listed columns by ``mask``; type becomes string.

    A pure projection: column pruning and pushdown still apply below it.
    """
    wanted = {c.lower() if case_insensitive else c for c in columns}
    cols = []
    for name in df.columns:
        key = name.lower() if case_insensitive else name
        cols.append(F.lit(mask).alias(name) if key in wanted else qcol(name))
    return df.select(*cols)


def default_masking(df: DataFrame, mask: str = MASK) -> DataFrame:
    return mask_columns(df, COMMON_PII_COLUMNS, mask)


def no_masking(df: DataFrame) -> DataFrame:
    return df


# A JSON text as tokens: a string (with the colon that makes it a key), or what lies between strings. Possessive, so that
# a string of any length and any number of escapes is one flat loop.
_JSON_TOKENS = r'''"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[^"]++'''


def redact_json(text: Column) -> Column:
    """A JSON text with every string value redacted, at any depth; keys, numbers, order and layout stay as written.

    A text that is not JSON, or repeats a key in one object, is redacted as plain text, keys and all; null stays null."""
    def token(t: Column) -> Column:
        value = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0]
        written = F.to_json(F.array(redact_text(value)))
        return F.when(t.startswith('"') & t.endswith('"') & (F.length(t) > 1) & ~redact_text(value).eqNullSafe(value),
                      F.substring(written, F.lit(2), F.length(written) - 2)).otherwise(t)

    walked = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_JSON_TOKENS), F.lit(0)), token), "")
    return F.when(F.try_parse_json(text).isNotNull(), walked).otherwise(redact_text(text))


def _redact_any(c: Column, dtype: T.DataType) -> Column:
    """Redact every string at any depth (values, never keys)."""
    if isinstance(dtype, T.StringType):
        return redact_text(c)
    if isinstance(dtype, T.VariantType):
        return F.try_parse_json(redact_json(F.to_json(c)))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _redact_any(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _k, v: _redact_any(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        if not dtype.fields:
            return c
        rebuilt = F.struct(*[_redact_any(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(c.isNull(), F.lit(None).cast(dtype)).otherwise(rebuilt)
    return c


def redact_nested(df: DataFrame, columns: Iterable[str] | None = None, json: Iterable[str] = ()) -> DataFrame:
    """Redact all strings inside the chosen (default: all) columns, whatever their nesting.

    Text columns named in ``json`` hold free-form JSON and are walked too (``redact_json``), as VARIANT columns always are."""
    chosen, parsed = set(columns) if columns is not None else set(df.columns), set(json)
    return df.select(*[
        (redact_json(qcol(f.name)) if f.name in parsed else _redact_any(qcol(f.name), f.dataType)).alias(f.name)
        if f.name in chosen | parsed else qcol(f.name) for f in df.schema.fields])


def is_local_model(model: Column) -> Column:
    return F.coalesce(model.startswith(LOCAL_MODEL_PREFIX), F.lit(False))


def redact_unless_local(df: DataFrame, model_col: str, columns: Iterable[str]) -> DataFrame:
    """Messages bound for ``local/...`` models pass unredacted; all others are redacted."""
    local = is_local_model(qcol(model_col))
    chosen = set(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        F.when(local, qcol(n)).otherwise(_redact_any(qcol(n), types[n])).alias(n) if n in chosen else qcol(n)
        for n in df.columns])
