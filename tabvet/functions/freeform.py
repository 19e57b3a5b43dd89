"""Free-form dates: one match per cell, a shape, one timestamp constructor.

A complete date of any accepted shape is matched by a single regex whose alternatives are the shapes
(``SHAPES``: where the day, month and year stand) followed by an optional time and UTC offset.
Since only one shape's groups are filled, one replace writes the groups of each role (first, second and third
number, month name, clock, offset) in a row, one split stages these pieces as an array, and the same few
expressions turn the pieces of every shape into a timestamp.

Reading rules (those of the free-form parser that the reference calls): a first number of
four digits or above 31 is a year; else numeric dates are month-first, day-first if the
first number is above 12; a two-digit year lies within 50 years of the current one; fractions beyond
microseconds are cut; AM/PM needs an hour up to 12; weekday names don't matter. Partial dates
("10", "March", "10:30") are not accepted.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_SEP = "\u0001"
_MONTH = ("(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|"
          "nov(?:ember)?|dec(?:ember)?)")
_WEEKDAY = r"(?:(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)[\s.,]+)?"
_DAY, _YEAR, _ORD = r"(\d{1,2})", r"(\d{4}|\d{1,2})", "(?:st|nd|rd|th)?"
_CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d+))?)?"

#: Each shape's regex and the roles of its groups: first, second and third number of the date, month name, separator, hour, minute, second.
SHAPES = [
    (r"(\d{4}|\d{1,2})([-/.]|\s+)(\d{1,2})\2(\d{4}|\d{1,2})", "1s23"),
    (r"(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?)?", "123him"),
    (r"(\d{2})(\d{2})(\d{2})", "123"),
    (rf"{_YEAR}{_ORD}[\s./-]*(?:of\s+)?{_MONTH}[\s.,/-]*{_YEAR}", "1n3"),
    (rf"{_MONTH}[\s./-]*{_DAY}{_ORD}[\s.,/-]+{_YEAR}", "n13"),
    (rf"{_MONTH}\s+{_DAY}\s+(\d{{1,2}}):(\d{{1,2}})(?::(\d{{1,2}}))?\s+(\d{{4}})", "n1him3"),
]
_TIME = rf"(?:(?:\s+(?:at\s+)?|,\s*|t)(?:{_CLOCK}|(\d{{1,2}})(?=\s*[ap]m))\s*(?:([ap])m)?\s*(z|utc|gmt|[+-]\d{{2}}(?::?\d{{2}})?)?)?"
REGEX = rf"(?i)^{_WEEKDAY}(?:{'|'.join(rx for rx, _ in SHAPES)}){_TIME}$"
_ROLES = "".join(roles for _, roles in SHAPES) + "himfhaz"
#: What a date is split into: numbers, month name, clock, offset. Only one shape's groups are filled, so the text of a role is all its groups in a row.
_PIECES = "123nhimfaz"
_REPLACEMENT = _SEP.join("".join(f"${k + 1}" for k, r in enumerate(_ROLES) if r == role) for role in _PIECES)


def _piece(array: str, role: str) -> str:
    """The text of a role."""
    return f"element_at({array}, {_PIECES.index(role) + 1})"


def _int(text: str) -> str:
    """The number of a group of digits. An unused group is empty and counts as 0: a failed cast throws and catches an exception a row."""
    return f"try_cast(concat('0', {text}) AS INT)"


def lower_sql(x: str) -> str:
    """ASCII letters in lower case; ``lower`` goes through ICU for every cell, and no other letter is part of a date.
    It takes a map lookup a character, so only month names and offsets go through it, not whole dates."""
    return f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"


def parts_sql(x: str) -> str:
    """The pieces of a complete date as an array, null for anything else."""
    return f"CASE WHEN {x} RLIKE r'{REGEX}' THEN split(regexp_replace({x}, r'{REGEX}', '{_REPLACEMENT}'), '{_SEP}') END"


def date_sql(parts: str, year: int) -> dict[str, str]:
    """From the pieces: year, month and day. ``year`` is the current one, for two-digit years."""
    one, three, name = (_piece(parts, r) for r in "13n")
    first, second, third = (_int(_piece(parts, r)) for r in "123")
    named = f"(instr('{MONTHS}', {lower_sql(f'substr({name}, 1, 3)')}) + 2) div 3"
    year_first = f"(length({one}) = 4 OR {first} > 31)"
    text = f"CASE WHEN {year_first} THEN {one} ELSE {three} END"
    century = year // 100 * 100
    full = f"({_int(text)} + {century})"
    return {
        "y": f"CASE WHEN length({text}) > 2 THEN {_int(text)} WHEN {full} >= {year + 50} THEN {full} - 100 "
             f"WHEN {full} < {year - 50} THEN {full} + 100 ELSE {full} END",
        "mo": f"CASE WHEN {name} <> '' THEN {named} WHEN {year_first} OR {first} > 12 THEN {second} ELSE {first} END",
        "d": f"CASE WHEN {year_first} THEN {third} WHEN {name} <> '' OR {first} > 12 THEN {first} ELSE {second} END",
    }


def timestamp_sql(f: dict[str, str], parts: str) -> str:
    """The timestamp of year, month, day and the pieces of the clock."""
    hour, minute, second = (_int(_piece(parts, r)) for r in "him")
    half, fraction = _piece(parts, "a"), _piece(parts, "f")
    hour = f"(CASE WHEN {half} = '' THEN {hour} WHEN {hour} <= 12 THEN {hour} % 12 + CASE WHEN {half} IN ('p', 'P') THEN 12 ELSE 0 END END)"
    micros = _int(f"rpad({fraction}, 6, '0')")
    seconds = (f"CASE WHEN {fraction} = '' THEN cast({second} AS decimal(8,6)) "
               f"ELSE cast(cast({second} AS decimal(16,6)) + cast({micros} AS decimal(16,6)) / 1000000 AS decimal(8,6)) END")
    return f"CASE WHEN {second} <= 59 AND {f['y']} >= 1 THEN try_make_timestamp_ntz({f['y']}, {f['mo']}, {f['d']}, {hour}, {minute}, {seconds}) END"


def offset_sql(parts: str) -> str:
    """The UTC offset as written, in lower case, null without one."""
    return f"nullif({lower_sql(_piece(parts, 'z'))}, '')"


@dataclass(frozen=True)
class FreeForm:
    """Staged columns of one free-form date: the local time and the offset as written."""
    local: str
    offset: str


def stage(st, x: str, year: int, need: str | None = None, after: tuple[str, ...] = ()) -> FreeForm:
    """Stage the parse of column ``x``, only where the condition ``need`` over the columns ``after`` holds."""
    from tabvet.functions.dates import ident

    sql = parts_sql(ident(x))
    parts = st.add(F.expr(f"CASE WHEN {need} THEN {sql} END" if need else sql), [x, *after])
    fields = {k: st.add(F.expr(v), [parts]) for k, v in date_sql(ident(parts), year).items()}
    local = st.add(F.expr(timestamp_sql({k: ident(v) for k, v in fields.items()}, ident(parts))), [parts, *fields.values()])
    return FreeForm(local, st.add(F.expr(offset_sql(ident(parts))), [parts]))


def freeform_sql(x: str, year: int) -> str:
    """The local time of a free-form date as one expression; each level is bound once by a one-element transform."""
    fields = date_sql("p0", year)
    struct = ", ".join(f"{k!r}, {v}" for k, v in fields.items())
    inner = f"element_at(transform(array(named_struct({struct})), d0 -> {timestamp_sql({k: f'd0.{k}' for k in fields}, 'p0')}), 1)"
    return f"element_at(transform(array({parts_sql(x)}), p0 -> {inner}), 1)"


def offset_minutes(offset: Column) -> Column:
    """Minutes east of UTC of an offset as written."""
    digits = F.rpad(F.regexp_replace(offset, "[^0-9]", ""), 4, "0")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return F.when(F.upper(offset).isin("Z", "UTC", "GMT"), F.lit(0)).otherwise(
        F.when(F.substring(offset, 1, 1) == "-", -minutes).otherwise(minutes))


def offset_text(offset: Column) -> Column:
    """``z`` → ``+00:00``; ``+0530`` and ``+05`` → ``+05:30`` and ``+05:00``."""
    digits = F.rpad(F.regexp_replace(offset, "[^0-9]", ""), 4, "0")
    return F.when(F.upper(offset).isin("Z", "UTC", "GMT"), F.lit("+00:00")).otherwise(
        F.concat(F.substring(offset, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2)))
