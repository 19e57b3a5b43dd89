"""Field and cross-field checks as Column conditions over staged intermediate values.

Each builder returns ``Candidate(code, condition, message)`` entries for one cell, in
the order the reference evaluates them. Intermediate values (trimmed text, parsed
number, phone parts, parsed dates) are staged once per field by ``FieldValues`` so the
conditions stay small. The compiler adds the "cell is present" guard and wraps the
candidates into error structs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabvet.functions.dates import (DEFAULT_VALIDATION_FORMATS, ident, iso_sql, skeleton_sql, strptime_from_parts_sql,
                                   strptime_parts_sql)
from tabvet.functions.freeform import FreeForm, offset_minutes, stage
from tabvet.functions.numeric import is_finite, parse_py_float, trunc_toward_zero
from tabvet.functions.phone import PhoneParse, parse_phone, row_region
from tabvet.functions.text import py_trim, python_list_text, python_number_text
from tabvet.plans.regex import python_regex_to_java
from tabvet.plans.rules import FieldRule, RuleSet
from tabvet.plans.stager import Stager

col = F.col


@dataclass(frozen=True)
class Candidate:
    code: str
    when: Column
    message: Column | str


@dataclass
class CheckContext:
    rules: RuleSet
    columns: tuple[str, ...]
    as_of: Column
    phones: dict = field(default_factory=dict)  # (field, region column, default region) -> prefix of the plan's columns
    date_policy: str = "formats"
    year: int = field(default_factory=lambda: datetime.now().year)  # places two-digit years
    stager: Stager = field(default_factory=lambda: Stager("_s"))
    _values: dict = field(default_factory=dict)

    def values(self, name: str) -> "FieldValues":
        if name not in self._values:
            self._values[name] = FieldValues(self, name)
        return self._values[name]

    def whole_freeform(self, name: str) -> bool:
        """Whether a cell's free-form parse is read without formats before it: normalization of a date without formats, or a cross check."""
        rule = self.rules.field(name)
        crossed = {c.get(k) for c in self.rules.cross_checks for k in ("left", "right", "field")}
        return rule is not None and ((rule.type in ("date", "datetime") and not rule.formats) or (name in crossed and not _cross_formats(name, self)))


class FieldValues:
    """Lazily staged intermediate values of one input column."""

    def __init__(self, ctx: CheckContext, name: str):
        self.ctx, self.name, self._cache = ctx, name, {}
        st = ctx.stager
        self.trimmed = st.add(py_trim(col(name)))

    @property
    def t(self) -> Column:
        return col(self.trimmed)

    @property
    def missing(self) -> Column:
        return col(self.name).isNull() | (self.t == "")

    def _get(self, key, make):
        if key not in self._cache:
            self._cache[key] = make()
        return self._cache[key]

    def number(self) -> str:
        return self._get("num", lambda: self.ctx.stager.add(parse_py_float(self.t), [self.trimmed]))

    def by_formats(self, formats: tuple[str, ...]) -> str:
        """strptime with each format in turn; a format is only tried where the
        previous ones failed. Formats of plain numbers in a row are one stage, others stage their fields as an array."""
        def make():
            st, t = self.ctx.stager, ident(self.trimmed)
            prev, numeric = None, []

            def flush():
                nonlocal prev
                if numeric:
                    first = [ident(prev)] if prev else []
                    prev = st.add(F.expr(f"coalesce({', '.join(first + numeric)})"), [self.trimmed] + ([prev] if prev else []))
                    numeric.clear()

            for fmt in formats:
                iso = iso_sql(t, fmt)
                if iso:
                    numeric.append(iso)
                    continue
                flush()
                cond = "" if prev is None else f"{ident(prev)} IS NULL AND "
                skel = skeleton_sql(t, fmt)
                if skel:
                    cond += f"{skel} AND "
                parts = st.add(F.expr(f"CASE WHEN {cond}true THEN {strptime_parts_sql(t, fmt)} END"),
                               [self.trimmed] + ([prev] if prev else []))
                ts = strptime_from_parts_sql(ident(parts), fmt)
                expr = ts if prev is None else f"coalesce({ident(prev)}, {ts})"
                prev = st.add(F.expr(expr), [parts] + ([prev] if prev else []))
            flush()
            if prev is None:
                prev = st.add(F.lit(None).cast("timestamp_ntz"))
            return prev
        return self._get(("fmt", formats), make)

    def _freeform(self, after: tuple[str, ...] | None) -> FreeForm:
        """The free-form parse; with ``after`` only where those formats did not parse
        (its regex is the expensive part, so it runs only when needed)."""
        after = after or None

        def make():
            if not after:
                return stage(self.ctx.stager, self.trimmed, self.ctx.year)
            fmt = self.by_formats(after)
            if self.ctx.whole_freeform(self.name):  # another use reads it for every row, so it isn't parsed twice
                free = self._freeform(None)
                rest = [self.ctx.stager.add(F.when(col(fmt).isNull(), col(c)), [fmt, c]) for c in (free.local, free.offset)]
                return FreeForm(*rest)
            return stage(self.ctx.stager, self.trimmed, self.ctx.year, f"{ident(fmt)} IS NULL", (fmt,))
        return self._get(("free", after), make)

    def freeform(self, after: tuple[str, ...] | None = None) -> str:
        return self._freeform(after).local

    def offset(self, after: tuple[str, ...] | None = None) -> str:
        return self._freeform(after).offset

    def region(self, region_column: str | None, default: str) -> str:
        return self._get(("region", region_column, default),
                         lambda: self.ctx.stager.add(row_region(self.ctx.columns, region_column, default)))

    def phone(self, region_column: str | None, default: str) -> PhoneParse:
        prefix = phone_prefix(self.ctx, self.name, region_column, default)
        return self._get(("phone", prefix), lambda: parse_phone(self.ctx.stager, prefix))


def phone_prefix(ctx: CheckContext, name: str, region_column: str | None, default: str) -> str:
    """The prefix of the plan's columns for a phone field dialled from a region; the validator joins the plan for every prefix asked for."""
    return ctx.phones.setdefault((name, region_column, default), f"_p{len(ctx.phones)}")


def _range(name: str, cons, v: Column) -> list[Candidate]:
    out = []
    if "min" in cons:
        out.append(Candidate("RANGE", v < F.lit(float(cons["min"])),
                             f"{name} below minimum {python_number_text(cons['min'])}"))
    if "max" in cons:
        out.append(Candidate("RANGE", v > F.lit(float(cons["max"])),
                             f"{name} above maximum {python_number_text(cons['max'])}"))
    return out


def integer_checks(rule: FieldRule, fv: FieldValues, ctx: CheckContext) -> list[Candidate]:
    v = col(fv.number())
    ok = v.isNotNull() & is_finite(v)      # int(float('nan')) and int(inf) both fail
    iv = trunc_toward_zero(v)
    out = [Candidate("TYPE", ~ok, f"{rule.name} must be an integer")]
    return out + [Candidate(c.code, ok & c.when, c.message) for c in _range(rule.name, rule.constraints, iv)]


def float_checks(rule: FieldRule, fv: FieldValues, ctx: CheckContext) -> list[Candidate]:
    v = col(fv.number())
    comparable = v.isNotNull() & ~F.isnan(v)   # NaN passes both bounds in Python
    out = [Candidate("TYPE", v.isNull(), f"{rule.name} must be a number")]
    return out + [Candidate(c.code, comparable & c.when, c.message) for c in _range(rule.name, rule.constraints, v)]


def enum_checks(rule: FieldRule, fv: FieldValues, ctx: CheckContext) -> list[Candidate]:
    allowed = list(rule.constraints.get("allowed", []))
    texts = [a for a in allowed if isinstance(a, str)]  # a cell is text, so it never equals another kind of value
    bad = ~fv.t.isin(texts) if texts else F.lit(True)
    return [Candidate("ENUM", bad, f"{rule.name} must be one of {python_list_text(allowed)}")]


def string_checks(rule: FieldRule, fv: FieldValues, ctx: CheckContext) -> list[Candidate]:
    cons, t = rule.constraints, fv.t
    out = []
    if "regex" in cons:
        # re.match anchors at the start only; rlike alone would search anywhere.
        rx = "^(?:" + python_regex_to_java(cons["regex"]) + ")"
        out.append(Candidate("REGEX", ~t.rlike(rx), f"{rule.name} does not match required pattern"))
    if "min_length" in cons:
        out.append(Candidate("LENGTH", F.char_length(t) < F.lit(cons["min_length"]), f"{rule.name} too short"))
    if "max_length" in cons:
        out.append(Candidate("LENGTH", F.char_length(t) > F.lit(cons["max_length"]), f"{rule.name} too long"))
    return out


def region_args(rule: FieldRule, ctx: CheckContext) -> tuple[str | None, str]:
    g = ctx.rules.globals
    return rule.region_column or g.default_country_column, rule.default_region or g.default_country or "US"


def region_of(rule: FieldRule, fv: FieldValues, ctx: CheckContext) -> str:
    return fv.region(*region_args(rule, ctx))


def phone_checks(rule: FieldRule, fv: FieldValues, ctx: CheckContext) -> list[Candidate]:
    region = region_of(rule, fv, ctx)
    r = col(region)
    p = fv.phone(*region_args(rule, ctx))
    parsed = col(p.parsed)
    out = [
        Candidate("PHONE_PARSE", ~parsed, F.concat(F.lit("Cannot parse phone number for region "), r)),
        Candidate("PHONE_POSSIBLE", parsed & ~col(p.possible), "Phone number length/format is not possible"),
        Candidate("PHONE_INVALID", parsed & ~col(p.valid), "Phone number is not valid for the region"),
    ]
    expected = None
    for reg, spec in ctx.rules.globals.country_phone_rules.items():
        if spec.get("digits"):
            n = F.lit(int(spec["digits"]))
            expected = F.when(r == reg, n) if expected is None else expected.when(r == reg, n)
    if expected is not None:
        wrong = parsed & expected.isNotNull() & (F.length(col(p.digits)) != expected)
        msg = F.concat(F.lit("Expected "), expected.cast("string"), F.lit(" digits for "), r)
        out.append(Candidate("PHONE_LENGTH", F.coalesce(wrong, F.lit(False)), msg))
    # A "prefix" rule is accepted and has no effect, as in the reference.
    return out


def validation_formats(rule: FieldRule) -> tuple[str, ...]:
    return tuple(rule.formats if rule.formats is not None else DEFAULT_VALIDATION_FORMATS)


def date_checks(rule: FieldRule, fv: FieldValues, ctx: CheckContext) -> list[Candidate]:
    formats = validation_formats(rule)
    parsed = F.coalesce(col(fv.by_formats(formats)), col(fv.freeform(formats)))
    out = [Candidate("DATE_FORMAT", parsed.isNull(), F.concat(F.lit("Unrecognized date format: "), fv.t))]
    if rule.constraints.get("not_future"):
        out.append(Candidate("FUTURE_DATE", parsed.isNotNull() & (parsed > ctx.as_of),
                             "Date cannot be in the future"))
    return out


TYPE_CHECKS: dict[str, Callable[[FieldRule, FieldValues, CheckContext], list[Candidate]]] = {
    "integer": integer_checks,
    "float": float_checks,
    "enum": enum_checks,
    "phone": phone_checks,
    "date": date_checks,
    "datetime": date_checks,
    "string": string_checks,
}


@dataclass(frozen=True)
class CustomCheck:
    code: str
    message: str
    fn: Callable[[Column, object], Column]


CUSTOM_CHECKS: dict[str, CustomCheck] = {}


def register_check(name: str, code: str, message: str, fn: Callable[[Column, object], Column]) -> None:
    """Register a check usable as ``"constraints": {name: params}`` on any field.

    ``fn(trimmed_value, params)`` returns a boolean Column that is true for a *bad*
    value; ``message`` may use ``{name}`` for the field name. Return built-in
    expressions where possible; a ``pandas_udf`` call is accepted too.
    """
    CUSTOM_CHECKS[name] = CustomCheck(code, message, fn)


def custom_checks(rule: FieldRule, fv: FieldValues, ctx: CheckContext) -> list[Candidate]:
    out = []
    for key, params in rule.constraints.items():
        chk = CUSTOM_CHECKS.get(key)
        if chk is not None:
            out.append(Candidate(chk.code, chk.fn(fv.t, params), chk.message.format(name=rule.name)))
    return out


def _cross_formats(field_name: str, ctx: CheckContext) -> tuple[str, ...] | None:
    rule = ctx.rules.field(field_name)
    return tuple(rule.formats) if ctx.date_policy == "formats" and rule is not None and rule.formats else None


def cross_parse(field_name: str, ctx: CheckContext) -> Column:
    """A date cell parsed for a cross check under the chosen policy, any offset dropped.

    ``formats`` (default): the field's own formats, then the free-form parse.
    ``month_first``: the free-form parse only, as the reference's cross checks do.
    """
    fv, formats = ctx.values(field_name), _cross_formats(field_name, ctx)
    if formats:
        return F.coalesce(col(fv.by_formats(formats)), col(fv.freeform(formats)))
    return col(fv.freeform())


def cross_later(left: str, right: str, ctx: CheckContext) -> Column:
    """Whether ``left`` lies after ``right``. Two cells with offsets are compared as instants, two without as local times; a
    pair of one with and one without can't be compared and is no error."""
    offsets = [col(ctx.values(f).offset(_cross_formats(f, ctx))) for f in (left, right)]
    instants = [F.coalesce(cross_parse(f, ctx) - F.make_interval(mins=offset_minutes(o)), cross_parse(f, ctx)) for f, o in zip((left, right), offsets)]
    return (offsets[0].isNull() == offsets[1].isNull()) & (instants[0] > instants[1])
