"""Numeric parsing with the acceptance rules of Python's ``float()``.

Spark's string→double cast is Java-based: it accepts ``1d``, ``1f`` and hex floats,
which Python rejects, and rejects ``1_000``, which Python takes. A regex gate decides
acceptance first; the cast then only sees text both agree on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of decimal literals accepted by Python's float().
DECIMAL_GATE = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
POS_INF_WORDS = ["inf", "+inf", "infinity", "+infinity"]
NEG_INF_WORDS = ["-inf", "-infinity"]
NAN_WORDS = ["nan", "+nan", "-nan"]


def parse_py_float(trimmed: Column) -> Column:
    """DoubleType value of ``float(trimmed)``, or null where Python raises ValueError.

    ``trimmed`` must already be stripped (see ``py_trim``).
    """
    low = F.lower(trimmed)
    return (
        F.when(trimmed.rlike(DECIMAL_GATE),
               F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double"))
        .when(low.isin(NAN_WORDS), F.lit(float("nan")))
        .when(low.isin(POS_INF_WORDS), F.lit(float("inf")))
        .when(low.isin(NEG_INF_WORDS), F.lit(float("-inf")))
    )


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def trunc_toward_zero(v: Column) -> Column:
    """``int(x)`` for a finite double, kept as double for comparisons."""
    return F.signum(v) * F.floor(F.abs(v))
