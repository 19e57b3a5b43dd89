"""Text helpers that reproduce Python ``str`` semantics with native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character for which Python's ``str.isspace()`` is true. Built from the rule,
# so it follows the running interpreter's Unicode tables (29 characters in 3.13).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_trim(c: Column | str) -> Column:
    """``str.strip()``: removes Python whitespace at both ends (SQL ``trim`` only removes spaces).

    Text that begins and ends with a printable ASCII character, ``!`` to ``~``, is left as it is without a search through the
    29 whitespace characters at either end."""
    c = as_column(c).cast("string")
    last = F.substring(c, -1, 1)
    return F.when((c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f"), c).otherwise(F.trim(c, F.lit(PY_WHITESPACE)))


def is_missing(c: Column | str) -> Column:
    """Null, empty or whitespace-only: the reference's notion of a missing cell."""
    c = as_column(c)
    return c.isNull() | (py_trim(c) == F.lit(""))


def digits_only(c: Column | str) -> Column:
    """``re.sub(r"\\D", "", s)`` for ASCII digits."""
    return F.regexp_replace(as_column(c), r"[^0-9]", "")


def python_list_text(values) -> str:
    """The text Python prints for a list, e.g. ``['USD', 'EUR']``; used in ENUM messages."""
    return str(list(values))


def python_number_text(value) -> str:
    """The text an f-string gives a JSON number (``0``, ``0.5``, ``1e-05``)."""
    return str(value)
