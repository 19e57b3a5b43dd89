"""Phone numbers checked against a numbering-plan table, with native string expressions.

The reference calls a per-row phone library. Here a plan table (one row per
region: calling code, international and trunk prefixes, possible national lengths and
a national-number pattern) is joined to the numbers: by the region they are dialled from, and by the
longest calling code they start with. The plan is bounded by the rule set, not by
the data, and can be replaced by the user, also from a table of many regions.

Known differences from a full phone library, by design: only regions in the plan are
known (a ``+`` number with another calling code cannot be parsed); area-code
assignment is not checked (e.g. an unassigned US area code passes); letters (vanity
numbers) and extensions are not accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PlanEntry:
    region: str
    calling_code: str
    idd: str | None
    trunk: str | None
    lengths: tuple[int, ...]
    local_lengths: tuple[int, ...]
    pattern: str


# Approximate national numbering plans (public regulator data) for the
# five regions of the shipped rule set.
DEFAULT_PLAN: tuple[PlanEntry, ...] = (
    PlanEntry("US", "1", "011", "1", (10,), (7,), r"[2-9]\d{2}[2-9]\d{6}"),
    PlanEntry("IN", "91", "00", "0", (10,), (), r"[6-9]\d{9}|[1-5]\d{9}"),
    PlanEntry("SG", "65", "000", None, (8,), (), r"[3689]\d{7}"),
    PlanEntry("GB", "44", "00", "0", (9, 10), (), r"[1-35789]\d{8,9}"),
    PlanEntry("AU", "61", "0011", "0", (9,), (), r"[2-478]\d{8}"),
)

MOST_PLAN_ROWS = 10_000  # a plan is broadcast; larger ones are refused
_ENTRY = "region string, calling_code string, idd string, trunk string, lengths array<int>, local_lengths array<int>, pattern string"

# Characters a dialable number may contain after its first digit or '+'.
_DIALABLE = r"^\+?[0-9 \t\-.()/\[\]~]*$"


def plan_from_table(df: DataFrame) -> tuple[PlanEntry, ...]:
    """A plan from a table of ``PlanEntry`` columns, e.g. read from Parquet or JSON."""
    rows = df.select(*[F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in _ENTRY.split(", ")]).limit(MOST_PLAN_ROWS + 1).collect()
    return checked_plan(tuple(PlanEntry(r.region, r.calling_code, r.idd, r.trunk, tuple(r.lengths or ()), tuple(r.local_lengths or ()), r.pattern)
                              for r in sorted(rows, key=lambda r: r.region or "")))


def checked_plan(plan) -> tuple[PlanEntry, ...]:
    """The plan, if it is usable: bounded, one entry a region, digits where digits belong."""
    if len(plan) > MOST_PLAN_ROWS:
        raise ValueError(f"a numbering plan may have {MOST_PLAN_ROWS} entries at most")
    if len({p.region for p in plan}) < len(plan):
        raise ValueError("a numbering plan has one entry a region")
    for p in plan:
        if not p.region or not (p.calling_code or "").isdigit() or not p.pattern or "'" in p.region + p.pattern or not all((x or "0").isdigit() for x in (p.idd, p.trunk)):
            raise ValueError(f"bad numbering-plan entry {p!r}")
    return tuple(plan)


def _text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else f"r'{value}'"


def _ints(values) -> str:
    return "array(" + ", ".join(map(str, values)) + ")" if values else "CAST(array() AS array<int>)"


def _tables(plan) -> tuple[str, str]:
    """SQL of two tables: a region's dialling habits, and a calling code's numbers. Regions that share a code
    share its numbers: a number is valid if one of them has it."""
    codes: dict[str, list[PlanEntry]] = {}
    for p in plan:
        codes.setdefault(p.calling_code, []).append(p)
    numbers = {c: (_ints(sorted({n for p in ps for n in p.lengths + p.local_lengths})), _text("^(?:" + "|".join(p.pattern for p in ps) + ")$")) for c, ps in codes.items()}
    own = ", ".join(f"({_text(p.region)}, named_struct('code', {_text(p.calling_code)}, 'idd', {_text(p.idd)}, 'trunk', {_text(p.trunk)}, "
                    f"'dialled', {_ints(p.lengths + p.local_lengths)}, 'lengths', {numbers[p.calling_code][0]}, 'pattern', {numbers[p.calling_code][1]}))" for p in plan)
    code = ", ".join(f"({_text(c)}, named_struct('code', {_text(c)}, 'lengths', {n[0]}, 'pattern', {n[1]}))" for c, n in numbers.items())
    return f"SELECT * FROM VALUES {own} AS t(region, own)", f"SELECT * FROM VALUES {code} AS t(prefix, code)"


def join_plan(df: DataFrame, column: str, region: Column, plan, prefix: str) -> DataFrame:
    """``df`` with the plan's rows for the number in ``column`` dialled from ``region``: ``<prefix>_own`` by region, and
    ``<prefix>_code`` by the longest calling code that an international number starts with. The plan is a
    small table; there is one join for each length of calling code, the longest match wins."""
    from tabvet.functions.text import py_trim

    spark = df.sparkSession
    own, codes = (spark.sql(sql) for sql in _tables(checked_plan(plan)))
    c = lambda name: f"{prefix}_{name}"
    # from the first digit or '+' to the last digit, in one match
    body = F.regexp_extract(py_trim(F.col(column)), r"(?s)([+0-9](?:.*[0-9])?)", 1)
    df = df.withColumns({c("region"): region, c("body"): body}).withColumn(c("digits"), F.regexp_replace(c("body"), "[^0-9]", ""))
    own = own.select(F.col("region").alias(c("r")), F.col("own").alias(c("own")))
    df = df.join(F.broadcast(own), F.col(c("region")) == F.col(c("r")), "left").drop(c("r"))
    idd = F.col(c("own"))["idd"]
    df = df.withColumn(c("intl"), F.when(F.col(c("body")).startswith("+"), F.col(c("digits")))
                       .when(F.col(c("digits")).startswith(idd), F.expr(f"substr(`{c('digits')}`, length(`{c('own')}`.idd) + 1)")))
    found = []
    for n in sorted({len(p.calling_code) for p in plan}, reverse=True):
        some = codes.where(F.length("prefix") == n).select(F.col("prefix").alias(c(f"p{n}")), F.col("code").alias(c(f"c{n}")))
        df = df.join(F.broadcast(some), F.substring(c("intl"), 1, n) == F.col(c(f"p{n}")), "left").drop(c(f"p{n}"))
        found.append(c(f"c{n}"))
    return df.withColumn(c("code"), F.coalesce(*found)).drop(*found)


@dataclass(frozen=True)
class PhoneParse:
    """Names of staged columns describing one parsed number."""
    parsed: str     # boolean: the number could be parsed for the row's region
    possible: str   # boolean: national length possible for the number's country
    valid: str      # boolean: national number matches the country's pattern
    e164: str       # '+' calling code national digits (meaningful when valid)
    digits: str     # every digit of the value


def parse_phone(st, prefix: str) -> PhoneParse:
    """Parse the number whose plan rows ``join_plan`` has added under ``prefix``.

    Steps: keep the text from the first digit or '+', drop trailing non-digits; a
    leading '+' or the region's international prefix makes it international (longest
    known calling code wins); otherwise the region's trunk prefix is dropped when the
    rest has a possible length. Parsing fails without 2 to 17 national digits, with
    characters a dialled number cannot hold, or with an unknown region / code.
    """
    from tabvet.functions.dates import ident, lit_rx

    def add(sql: str, *deps: str) -> str:
        return st.add(F.expr(sql), [d for d in deps if d in st.level_of])

    body, digits, intl, own, code = (ident(f"{prefix}_{n}") for n in ("body", "digits", "intl", "own", "code"))
    local = add(f"CASE WHEN startswith({digits}, {own}.trunk) AND array_contains({own}.dialled, length({digits}) - length({own}.trunk)) "
                f"THEN substr({digits}, length({own}.trunk) + 1) ELSE {digits} END")
    international = f"{intl} IS NOT NULL"
    national = add(f"CASE WHEN {international} THEN substr({intl}, length({code}.code) + 1) ELSE {ident(local)} END", local)
    number = add(f"CASE WHEN {international} THEN {code} ELSE named_struct('code', {own}.code, 'lengths', {own}.lengths, 'pattern', {own}.pattern) END")
    n, x = ident(national), ident(number)
    parsed = add(f"coalesce(length({digits}) >= 2 AND {body} RLIKE {lit_rx(_DIALABLE)} AND {x}.code IS NOT NULL AND length({n}) BETWEEN 2 AND 17, false)",
                 national, number)
    possible = add(f"coalesce(array_contains({x}.lengths, length({n})), false)", national, number)
    valid = add(f"coalesce({n} RLIKE {x}.pattern, false)", national, number)
    e164 = add(f"concat('+', {x}.code, {n})", national, number)
    return PhoneParse(parsed, possible, valid, e164, f"{prefix}_digits")


def row_region(columns, region_column: str | None, default_region: str) -> Column:
    """Region of a row: the region column trimmed, upper-cased, first two characters;
    the default when that column is absent, null or blank."""
    from tabvet.functions.text import py_trim

    if region_column and region_column in columns:
        t = py_trim(F.col(region_column))
        return F.when(F.col(region_column).isNotNull() & (t != ""), F.substring(F.upper(t), 1, 2)).otherwise(
            F.lit(default_region))
    return F.lit(default_region)
