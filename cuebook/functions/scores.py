"""Score normalisation and confidence bands, as Column expressions and as plain Python for
driver-side literals (rule scores are constants of the ruleset)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band cut-offs on the rounded score, and the rounding precision.
BANDS = ((0.8, "high"), (0.6, "medium-high"), (0.4, "medium"))
LOW_BAND = "low"
SCORE_DECIMALS = 3


def normalise_score(score: Column) -> Column:
    """Clamp to [0, 1] and round to 3 decimals; NULL stays NULL, NaN is 0.

    Rounding looks at the exact binary value and sends ties to the even digit, as Python's
    ``round`` does, so a rule's score and a computed score round alike (``format_number``
    rounds that way, ``round`` rounds the shortest decimal half up)."""
    s = score.cast("double")
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.isnan(s), F.lit(0.0)).otherwise(s)))
    return F.when(s.isNull(), F.lit(None).cast("double")).otherwise(F.format_number(clamped, SCORE_DECIMALS).cast("double"))


def confidence_band(rounded: Column) -> Column:
    """Band of an already-normalised score; a missing score has the empty band."""
    expr = F.when(rounded.isNull(), F.lit(""))
    for cut, name in BANDS:
        expr = expr.when(rounded >= F.lit(cut), F.lit(name))
    return expr.otherwise(F.lit(LOW_BAND))


def normalise_score_py(score: float | None) -> float | None:
    if score is None:
        return None
    if math.isnan(float(score)):
        return 0.0
    return round(min(1.0, max(0.0, float(score))), SCORE_DECIMALS)


def confidence_band_py(rounded: float | None) -> str:
    if rounded is None:
        return ""
    for cut, name in BANDS:
        if rounded >= cut:
            return name
    return LOW_BAND
