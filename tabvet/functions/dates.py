"""Date parsing with the semantics of Python's ``datetime.strptime``, as native expressions.

A strptime format is compiled to one Java regex built from the same directive patterns
CPython uses. The match is wrapped in an atomic group and anchored at the end, which
reproduces strptime exactly: the regex's *first* match is taken, and the parse fails if
it does not consume the whole string. The captured fields are assembled with
``try_make_timestamp_ntz``, which rejects impossible dates (30 February) the way
``datetime()`` does. No exception is thrown per row, unlike pattern-based casts.

The reference falls back to a free-form parser when no format matches: ``freeform.py``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabvet.functions.freeform import freeform_sql, offset_text
from tabvet.functions.text import PY_WHITESPACE


class FormatError(ValueError):
    """A strptime format that cannot be compiled."""


# CPython's strptime directive patterns (C locale, case-insensitive).
DIRECTIVES = {
    "d": r"3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9]",
    "f": r"[0-9]{1,6}",
    "H": r"2[0-3]|[0-1]\d|\d",
    "I": r"1[0-2]|0[1-9]|[1-9]",
    "m": r"1[0-2]|0[1-9]|[1-9]",
    "M": r"[0-5]\d|\d",
    "S": r"6[0-1]|[0-5]\d|\d",
    "y": r"\d\d",
    "Y": r"\d\d\d\d",
    "p": r"am|pm",
    "b": r"jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec",
    "B": r"september|february|november|december|january|october|august|march|april|june|july|may",
}
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july",
               "august", "september", "october", "november", "december"]

# Default formats of the date validator when a rule lists none.
DEFAULT_VALIDATION_FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S"]

_SPACE_CLASS = "[" + "".join("\\x{%x}" % ord(c) for c in PY_WHITESPACE) + "]"
_REGEX_SPECIALS = set("\\.^$*+?(){}[]|")


@dataclass(frozen=True)
class CompiledFormat:
    fmt: str
    regex: str
    fields: tuple[str, ...]


def compile_strptime(fmt: str) -> CompiledFormat:
    """Translate a strptime format into an anchored, atomic Java regex."""
    out: list[str] = []
    fields: list[str] = []
    literal_letters = False
    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            if i + 1 >= len(fmt):
                raise FormatError(f"format {fmt!r} ends with a lone '%'")
            d = fmt[i + 1]
            if d == "%":
                out.append("%")
            elif d in DIRECTIVES:
                if d in fields:
                    raise FormatError(f"format {fmt!r} repeats %{d}")
                fields.append(d)
                out.append("(" + DIRECTIVES[d] + ")")
            else:
                raise FormatError(f"format {fmt!r}: directive %{d} is not supported")
            i += 2
        elif ch.isspace():
            while i < len(fmt) and fmt[i].isspace():
                i += 1
            out.append(_SPACE_CLASS + "+")
        else:
            literal_letters = literal_letters or ch.isalpha()
            out.append("\\" + ch if ch in _REGEX_SPECIALS else ch)
            i += 1
    hours = {"H", "I"} & set(fields)
    if len(hours) > 1 or ({"b", "B"} <= set(fields)) or ({"y", "Y"} <= set(fields)) \
            or ({"m", "b"} <= set(fields)) or ({"m", "B"} <= set(fields)):
        raise FormatError(f"format {fmt!r} sets one field twice")
    # strptime ignores case; only formats that can meet letters need the slower flag
    has_letters = bool({"b", "B", "p"} & set(fields)) or literal_letters
    regex = ("(?i)" if has_letters else "") + "^(?>" + "".join(out) + ")\\z"
    return CompiledFormat(fmt, regex, tuple(fields))


# Expressions below are built as SQL text and parsed once on the JVM side: a date
# ladder written node by node through the Python API costs thousands of round trips.


def ident(name: str) -> str:
    """SQL reference to a column name."""
    return "`" + name.replace("`", "``") + "`"


def lit_rx(rx: str) -> str:
    """A raw SQL string literal (no escape processing) holding a regex."""
    if "'" in rx:
        raise FormatError(f"regex {rx!r} may not contain a single quote")
    return "r'" + rx + "'"


def _int(x: str) -> str:
    return f"try_cast({x} AS INT)"


def _seconds(second: str, micros: str) -> str:
    """Seconds with microseconds as decimal(8,6); inputs are bounded by the regexes."""
    return (f"cast(cast({second} AS decimal(16,6)) + cast({micros} AS decimal(16,6)) / 1000000 "
            f"AS decimal(8,6))")


def _month_of(name: str, full: bool, short: bool) -> str:
    whens = []
    for idx, m in enumerate(MONTH_NAMES, start=1):
        names = ([m] if full else []) + ([m[:3]] if short else []) + (["sept"] if short and idx == 9 and full else [])
        whens.append(f"WHEN lower({name}) IN ({', '.join(repr(n) for n in names)}) THEN {idx}")
    return "CASE " + " ".join(whens) + " END"


def _timestamp(year: str, month: str, day: str, hour: str, minute: str, second: str, micros: str) -> str:
    # datetime() rejects second 60/61 and year 0, which make_timestamp would roll over.
    return (f"CASE WHEN {second} <= 59 AND {year} >= 1 THEN try_make_timestamp_ntz({year}, {month}, {day}, "
            f"{hour}, {minute}, {_seconds(second, micros)}) END")


def _assemble(parts: dict[str, str]) -> str:
    """Timestamp from captured strptime fields, with strptime's defaults (1900-01-01 00:00)."""
    if "Y" in parts:
        year = _int(parts["Y"])
    elif "y" in parts:
        y = _int(parts["y"])
        year = f"({y} + CASE WHEN {y} <= 68 THEN 2000 ELSE 1900 END)"
    else:
        year = "1900"
    if "m" in parts:
        month = _int(parts["m"])
    elif "B" in parts:
        month = _month_of(parts["B"], True, False)
    elif "b" in parts:
        month = _month_of(parts["b"], False, True)
    else:
        month = "1"
    day = _int(f"ltrim({parts['d']})") if "d" in parts else "1"
    if "H" in parts:
        hour = _int(parts["H"])
    elif "I" in parts:
        h12 = _int(parts["I"])
        if "p" in parts:
            hour = (f"CASE WHEN lower({parts['p']}) = 'pm' THEN (CASE WHEN {h12} = 12 THEN 12 ELSE {h12} + 12 END) "
                    f"ELSE (CASE WHEN {h12} = 12 THEN 0 ELSE {h12} END) END")
        else:
            hour = f"CASE WHEN {h12} = 12 THEN 0 ELSE {h12} END"
    else:
        hour = "0"
    minute = _int(parts["M"]) if "M" in parts else "0"
    second = _int(parts["S"]) if "S" in parts else "0"
    micros = _int(f"rpad({parts['f']}, 6, '0')") if "f" in parts else "0"
    return _timestamp(year, month, day, hour, minute, second, micros)


def strptime_sql(x: str, fmt: str | CompiledFormat) -> str:
    """SQL for ``datetime.strptime(x, fmt)`` as TimestampNTZ, null when strptime raises."""
    cf = fmt if isinstance(fmt, CompiledFormat) else compile_strptime(fmt)
    rx = lit_rx(cf.regex)
    if not cf.fields:
        return f"CASE WHEN {x} RLIKE {rx} THEN TIMESTAMP_NTZ '1900-01-01 00:00:00' END"
    parts = {d: f"regexp_extract({x}, {rx}, {i + 1})" for i, d in enumerate(cf.fields)}
    return f"CASE WHEN {x} RLIKE {rx} THEN {_assemble(parts)} END"


SEP = "\u0001"


def strptime_parts_sql(x: str, fmt: str | CompiledFormat) -> str:
    """Captured fields of ``fmt`` as an array (one regex replace + a split), or null
    when the value does not match. Staged once, so the fields are not re-matched."""
    cf = fmt if isinstance(fmt, CompiledFormat) else compile_strptime(fmt)
    rx = lit_rx(cf.regex)
    if not cf.fields:
        return f"CASE WHEN {x} RLIKE {rx} THEN array('') END"
    repl = SEP.join(f"${i + 1}" for i in range(len(cf.fields)))
    return f"CASE WHEN {x} RLIKE {rx} THEN split(regexp_replace({x}, {rx}, '{repl}'), '{SEP}') END"


_ISO_FIELDS = set("YmdHMSf")


def iso_sql(x: str, fmt: str | CompiledFormat) -> str | None:
    """``strptime(x, fmt)`` for a format of plain numbers, else None: one replace writes them in ISO order, and Spark's own cast
    reads that, without an array of fields, casts of each and decimal seconds."""
    cf = fmt if isinstance(fmt, CompiledFormat) else compile_strptime(fmt)
    if not set(cf.fields) <= _ISO_FIELDS:
        return None
    at = lambda d, default: f"${cf.fields.index(d) + 1}" if d in cf.fields else default
    iso = f"{at('Y', '1900')}-{at('m', '1')}-{at('d', '1')}"
    if set("HMSf") & set(cf.fields):
        iso += f" {at('H', '0')}:{at('M', '0')}:{at('S', '0')}{at('f', '') and '.' + at('f', '')}"
    rx = lit_rx(cf.regex)
    text = f"regexp_replace({x}, {rx}, '{iso}')"
    if "d" in cf.fields:
        text = f"replace({text}, '- ', '-0')"  # %d takes a space for the tens
    return f"CASE WHEN {x} RLIKE {rx}{_not_year_zero(cf, x)} THEN try_cast({text} AS TIMESTAMP_NTZ) END"


def _not_year_zero(cf: CompiledFormat, x: str) -> str:
    """datetime() has no year 0; Spark has."""
    return f" AND NOT ({x} LIKE '%0000%' AND regexp_extract({x}, {lit_rx(cf.regex)}, {cf.fields.index('Y') + 1}) = '0000')" if "Y" in cf.fields else ""


_DIGIT_DIRECTIVES = set("YmdHMSfyI")


def skeleton_sql(x: str, fmt: str) -> str | None:
    """A cheap necessary condition for ``x`` to match ``fmt`` (no regex), or None.

    When every directive of ``fmt`` matches only digits (``%d`` also a space), a
    matching value with its digits and whitespace deleted equals the format's literal
    characters without whitespace, in order. Checking that first lets most values skip
    the format's regex. Letters compare case-insensitively (ASCII ones, as in the format's regex).
    """
    literals, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            d = fmt[i + 1] if i + 1 < len(fmt) else ""
            if d not in _DIGIT_DIRECTIVES:
                return None
            i += 2
        else:
            if not fmt[i].isspace():
                literals.append(fmt[i])
            i += 1
    skel = "".join(literals).lower()
    if "'" in skel or "\\" in skel:
        return None
    # digits and Python whitespace as one literal (SQL's char(n) works modulo 256,
    # so the characters themselves are written into the literal)
    return f"translate({x}, {_ws_literal(ascii_uppercase + '0123456789')}, '{ascii_lowercase}') = '{skel}'"


def strptime_from_parts_sql(parts: str, fmt: str | CompiledFormat) -> str:
    """Timestamp from the array built by ``strptime_parts_sql``."""
    cf = fmt if isinstance(fmt, CompiledFormat) else compile_strptime(fmt)
    if not cf.fields:
        return f"CASE WHEN {parts} IS NOT NULL THEN TIMESTAMP_NTZ '1900-01-01 00:00:00' END"
    return _assemble({d: f"element_at({parts}, {i + 1})" for i, d in enumerate(cf.fields)})


def first_sql(x: str, formats) -> str:
    """First format that parses wins, as in a loop of strptime calls."""
    parts = [strptime_sql(x, f) for f in formats]
    if not parts:
        return "CAST(NULL AS TIMESTAMP_NTZ)"
    return parts[0] if len(parts) == 1 else "coalesce(" + ", ".join(parts) + ")"


def _name(c) -> str:
    if isinstance(c, str):
        return ident(c)
    raise TypeError("pass a column name")


def parse_with_format(name: str, fmt: str | CompiledFormat) -> Column:
    """``datetime.strptime`` of column ``name`` (already stripped) as TimestampNTZ."""
    return F.expr(strptime_sql(_name(name), fmt))


def parse_first(name: str, formats) -> Column:
    return F.expr(first_sql(_name(name), formats))


def parse_freeform(name: str, year: int | None = None) -> Column:
    """Free-form parse of column ``name``, any UTC offset dropped; ``year`` places two-digit years (default: now)."""
    return F.expr(freeform_sql(_name(name), year or datetime.now().year))


def parse_datetime(name: str, formats=None, freeform: bool = True, year: int | None = None) -> Column:
    """Strip, then formats first (strptime, in order), then the free-form parse."""
    t = f"trim(BOTH {_ws_literal()} FROM {_name(name)})"
    parts = [strptime_sql(t, f) for f in (formats or [])]
    if freeform:
        parts.append(freeform_sql(t, year or datetime.now().year))
    if not parts:
        return F.lit(None).cast("timestamp_ntz")
    return F.expr(parts[0] if len(parts) == 1 else "coalesce(" + ", ".join(parts) + ")")


def _ws_literal(prefix: str = "") -> str:
    """A SQL string literal holding ``prefix`` and every Python whitespace character."""
    assert "'" not in PY_WHITESPACE and "\\" not in PY_WHITESPACE
    return "'" + prefix + PY_WHITESPACE + "'"


def iso_text(ts: Column) -> Column:
    """``datetime.isoformat()``: microseconds only when non-zero (6 digits then).

    Built from the timestamp's string cast (no formatter per row): the cast prints
    ``yyyy-MM-dd HH:mm:ss`` plus the fraction without trailing zeros."""
    text = ts.cast("string")
    return F.when(ts.isNull(), F.lit(None).cast("string")).otherwise(iso_of(text))


def iso_of(text: Column) -> Column:
    """ISO text of a timestamp's string cast."""
    base = F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))
    frac = F.substring(text, 20, 7)
    return F.when(F.length(text) > 19, F.concat(base, F.rpad(frac, 7, "0"))).otherwise(base)


def normalize_date_text(value: Column, trimmed: Column, text: Column, offset: Column) -> Column:
    """ISO text of a date cell from ``text``, its parsed time cast to string (once a row), and the offset of a free-form date;
    raw text when unparseable.

    Null stays null and blank becomes ``""``, as in the reference's normalizer.
    """
    return (F.when(value.isNull(), F.lit(None).cast("string"))
            .when(trimmed == "", F.lit(""))
            .when(text.isNull(), value.cast("string"))
            .when(offset.isNull(), iso_of(text))
            .otherwise(F.concat(iso_of(text), offset_text(offset))))
