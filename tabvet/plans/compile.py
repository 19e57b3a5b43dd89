"""RuleSet → staged projections → a bitmask of failed checks per row.

Every check of the rule set is a *candidate* with a fixed position ``k`` in the
reference's evaluation order (fields in rule order, then cross checks; inside a cell
in check order). A row carries one ``long`` per 62 candidates with bit ``k`` set when
the check failed, plus a message column only for the few checks whose message depends
on the row (phone region, the bad date text). The hot projection is therefore a few
integer additions per row and stays well inside whole-stage codegen; the error list,
``error_summary`` and per-code counts are expanded from the bits on demand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabvet.functions.dates import normalize_date_text
from tabvet.operators.checks import (TYPE_CHECKS, Candidate, CheckContext, FieldValues, cross_later, cross_parse,
                                     custom_checks, region_args)
from tabvet.plans.rules import FieldRule

CORRUPT_COLUMN = "_corrupt_record"
col = F.col


@dataclass(frozen=True)
class KeyFlags:
    unique: str | None = None      # boolean column: value is duplicated
    reference: str | None = None   # boolean column: value exists in the parent
    reference_target: str = ""


BITS = 62


@dataclass
class Slot:
    """One candidate check: its place in the report and how to read its bit."""
    k: int
    ordinal: int
    seq: int
    field: str
    code: str
    message: str | None          # literal message, or None when ``dynamic`` holds it
    dynamic: str | None = None   # column holding the row's message (null when passed)

    @property
    def mask(self) -> str:
        return f"_m{self.k // BITS}"

    @property
    def bit(self) -> int:
        return 1 << (self.k % BITS)

    def failed(self) -> Column:
        return (col(self.mask).bitwiseAND(F.lit(self.bit)) != 0)

    def message_col(self) -> Column:
        return col(self.dynamic) if self.dynamic else F.lit(self.message)


@dataclass
class Compiled:
    slots: list[Slot]
    masks: list[tuple[str, Column]]
    dynamic: list[tuple[str, Column]]
    normalized: list[tuple[str, Column]]

    @property
    def codes(self) -> list[str]:
        out: list[str] = []
        for s in self.slots:
            if s.code not in out:
                out.append(s.code)
        return out


def _field_candidates(rule: FieldRule, ctx: CheckContext, flags: KeyFlags | None) -> list[Candidate]:
    fv = ctx.values(rule.name)
    missing = fv.missing
    out: list[Candidate] = []
    if rule.required:
        out.append(Candidate("REQUIRED", missing, f"{rule.name} is required"))
    body = TYPE_CHECKS[rule.type](rule, fv, ctx) + custom_checks(rule, fv, ctx)
    if flags and flags.unique:
        body.append(Candidate("UNIQUE", col(flags.unique), f"{rule.name} must be unique"))
    if flags and flags.reference:
        body.append(Candidate("REFERENCE", ~col(flags.reference),
                              f"{rule.name} has no match in {flags.reference_target}"))
    out += [Candidate(c.code, ~missing & c.when, c.message) for c in body]
    return out


def compile_rules(ctx: CheckContext, flags: dict[str, KeyFlags], phone_region: str = "row") -> Compiled:
    rules, cols = ctx.rules, set(ctx.columns)
    slots: list[Slot] = []
    bits: dict[str, list[Column]] = {}
    dynamic: list[tuple[str, Column]] = []

    def emit(cond: Column | None, ordinal: int, seq: int, field: str, code: str, message):
        k = len(slots)
        slot = Slot(k, ordinal, seq, field, code, message if isinstance(message, str) else None)
        cond = F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))
        bits.setdefault(slot.mask, []).append(F.when(cond, F.lit(slot.bit)).otherwise(F.lit(0)))
        if not isinstance(message, str):
            slot.dynamic = f"_dm{k}"
            dynamic.append((slot.dynamic, F.when(cond, message.cast("string"))))
        slots.append(slot)

    if CORRUPT_COLUMN in cols:
        emit(col(CORRUPT_COLUMN).isNotNull(), -1, 0, CORRUPT_COLUMN, "MALFORMED", "Row has the wrong number of cells")

    for ordinal, rule in enumerate(rules.fields):
        if rule.name not in cols:
            if rule.required:
                emit(None, ordinal, 0, rule.name, "REQUIRED", f"Missing column: {rule.name}")
            continue
        for seq, c in enumerate(_field_candidates(rule, ctx, flags.get(rule.name))):
            emit(c.when, ordinal, seq, rule.name, c.code, c.message)

    base = len(rules.fields)
    for j, chk in enumerate(rules.cross_checks):
        ordinal = base + j
        if chk.type == "date_order":
            left, right = chk.get("left"), chk.get("right")
            if left not in cols or right not in cols:
                continue
            both = ~ctx.values(left).missing & ~ctx.values(right).missing
            emit(both & cross_later(left, right, ctx), ordinal, 0, left, "DATE_ORDER",
                 chk.get("message", f"{left} must be before {right}"))
        elif chk.type == "future_tolerance":
            fld = chk.get("field")
            if fld not in cols:
                continue
            days = float(chk.get("max_future_days", 0))
            limit = ctx.as_of + F.make_interval(mins=F.lit(0), secs=F.lit(days * 86400.0).cast("decimal(18,6)"))
            emit(~ctx.values(fld).missing & (cross_parse(fld, ctx) > limit), ordinal, 0, fld, "FUTURE_DATE",
                 f"{fld} is too far in the future")

    masks = []
    for name, terms in bits.items():
        total = terms[0].cast("long")
        for t in terms[1:]:
            total = total + t
        masks.append((name, total))

    normalized = []
    for rule in rules.fields:
        if rule.name not in cols:
            continue
        if rule.type == "phone":
            normalized.append((f"{rule.name}_normalized", _normalize_phone(rule, ctx, phone_region)))
        elif rule.type in ("date", "datetime"):
            fv = ctx.values(rule.name)
            formats = tuple(rule.formats) if rule.formats else None
            deps = [fv.by_formats(formats), fv.freeform(formats)] if formats else [fv.freeform()]
            text = ctx.stager.add(F.coalesce(*[col(d) for d in deps]).cast("string"), deps)
            normalized.append((f"{rule.name}_normalized",
                               normalize_date_text(col(rule.name).cast("string"), fv.t, col(text), col(fv.offset(formats)))))
    return Compiled(slots, masks, dynamic, normalized)


def _normalize_phone(rule: FieldRule, ctx: CheckContext, phone_region: str) -> Column:
    fv: FieldValues = ctx.values(rule.name)
    if phone_region == "row":
        p = fv.phone(*region_args(rule, ctx))
    else:
        g = ctx.rules.globals
        p = fv.phone(None, rule.default_region if rule.default_region is not None else (g.default_country or "US"))
    raw = col(rule.name).cast("string")
    return (F.when(raw.isNull(), F.lit(None).cast("string"))
            .when(fv.t == "", F.lit(""))
            .when(col(p.parsed) & col(p.valid), col(p.e164))
            .otherwise(raw))
