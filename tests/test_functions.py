"""Native expressions against the Python behaviour they reproduce."""

import math
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabvet.functions.dates import compile_strptime, parse_freeform, parse_with_format
from tabvet.functions.numeric import parse_py_float
from tabvet.functions.text import PY_WHITESPACE, py_trim

NUMBERS = ["1_000", "1d", "1f", "0x1p3", "nan", "inf", "-Infinity", " 5 ", "3.7", "1e3", ".5", "5.", "+7", "1,000",
           "", "1__0", "_1", "1_", "1e1_0", "+nan", "-NaN", "١٢"]


def py_float(s):
    try:
        return float(s.strip())
    except ValueError:
        return None


def _collect(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def _same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == b


def test_numeric_gate_edges(spark):
    got = _collect(spark, NUMBERS, lambda c: parse_py_float(py_trim(c)))
    for s, g in zip(NUMBERS, got):
        want = py_float(s) if not any(ord(ch) > 127 for ch in s) else None   # non-ASCII digits unsupported
        assert _same(g, want), (s, g, want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="0123456789_.eE+-naifty ", max_size=8), min_size=1, max_size=40))
def test_numeric_gate_random(spark, values):
    got = _collect(spark, values, lambda c: parse_py_float(py_trim(c)))
    for s, g in zip(values, got):
        assert _same(g, py_float(s)), (s, g)


def test_trim_matches_str_strip(spark):
    values = ["\t a \n", " x　", "​keep​", PY_WHITESPACE + "mid dle" + PY_WHITESPACE, "﻿z"]
    got = _collect(spark, values, py_trim)
    assert got == [v.strip() for v in values]


FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S", "%d %b %Y", "%Y%m%d", "%I:%M %p", "%y-%m-%d"]
DATES = ["2024-1-5", "24-1-5", "2024-02-30", "05/01/2024", "15/01/2024", "2024-01-05 1:2:3", "2024-01-05  10:30:00",
         "10", "12345678901234567890", "2024-01-05T10:00:00+05:30", "5 Jan 2024", "05 january 2024", "20240105",
         "12:30 pm", "12:30 AM", "2024-01-05 24:00:00", "2024-01-05 23:59:60", "0000-01-01", " 2024-01-05",
         "2024-12-31", "31/12/2024", "2/29/2023", "2/29/2024", "99-12-31", "68-01-01"]


def py_parse(s, fmt):
    try:
        return datetime.strptime(s, fmt)
    except ValueError:
        return None


def test_strptime_matches_python(spark):
    df = spark.createDataFrame([(v,) for v in DATES], "s string")
    for fmt in FORMATS:
        got = [r[0] for r in df.select(parse_with_format("s", fmt)).collect()]
        for s, g in zip(DATES, got):
            assert g == py_parse(s, fmt), (fmt, s, g)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="0123456789/-: ", min_size=1, max_size=12), min_size=1, max_size=30))
def test_strptime_random(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for fmt in ["%Y-%m-%d", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S"]:
        got = [r[0] for r in df.select(parse_with_format("s", fmt)).collect()]
        for s, g in zip(values, got):
            assert g == py_parse(s, fmt), (fmt, s, g)


FREE_FORM = {
    "2024-01-05": (2024, 1, 5), "2024-1-5": (2024, 1, 5), "2024/01/05": (2024, 1, 5), "2024.01.05": (2024, 1, 5), "20240105": (2024, 1, 5),
    "05/01/2024": (2024, 5, 1), "15/01/2024": (2024, 1, 15), "1.2.2024": (2024, 1, 2), "01 02 2024": (2024, 1, 2),
    "Jan 5, 2024": (2024, 1, 5), "January 5th, 2024": (2024, 1, 5), "5 January 2024": (2024, 1, 5), "5th of January 2024": (2024, 1, 5),
    "05-Jan-2024": (2024, 1, 5), "5jan2024": (2024, 1, 5), "Sept. 3 2023": (2023, 9, 3), "2024 Feb 29": (2024, 2, 29), "MAY 7 2021": (2021, 5, 7),
    # two-digit years, as seen from 2024
    "01/02/03": (2003, 1, 2), "13/02/03": (2003, 2, 13), "99-01-02": (1999, 1, 2), "5 Jan 73": (2073, 1, 5), "5 Jan 74": (1974, 1, 5),
    "Jan 5, 70": (2070, 1, 5), "01/02/75": (1975, 1, 2), "240105": (2005, 1, 24), "Dec 31 24": (2024, 12, 31),
    # weekday names
    "Fri, 05 Jan 2024": (2024, 1, 5), "Monday, January 8, 2024": (2024, 1, 8), "wed 2024-01-10": (2024, 1, 10), "Thu. 11 Jan 2024": (2024, 1, 11),
    # times
    "2024/01/05 10:30:00": (2024, 1, 5, 10, 30), "2024-01-05T10:30:00.250": (2024, 1, 5, 10, 30, 0, 250000), "20240105T103000": (2024, 1, 5, 10, 30),
    "202401051030": (2024, 1, 5, 10, 30), "Jan 5 2024 at 9:05": (2024, 1, 5, 9, 5), "Jan 5, 2024, 9:05": (2024, 1, 5, 9, 5),
    "Fri Jan  5 10:30:01 2024": (2024, 1, 5, 10, 30, 1), "2024-01-05 10:30:00,5": (2024, 1, 5, 10, 30, 0, 500000),
    # AM and PM
    "2024-01-05 10:30 PM": (2024, 1, 5, 22, 30), "2024-01-05 12:00 am": (2024, 1, 5), "2024-01-05 12:15pm": (2024, 1, 5, 12, 15),
    "Jan 5 2024 7 PM": (2024, 1, 5, 19), "01/02/2024 07:08:09 AM": (2024, 1, 2, 7, 8, 9),
    # long fractions are cut
    "2024-01-05T10:30:00.123456789": (2024, 1, 5, 10, 30, 0, 123456), "2024-01-05T10:30:00.9999999": (2024, 1, 5, 10, 30, 0, 999999),
    # offsets are dropped
    "2024-01-05T10:30:00Z": (2024, 1, 5, 10, 30), "2024-01-05 10:30 +05:30": (2024, 1, 5, 10, 30), "Fri, 05 Jan 2024 10:30:00 GMT": (2024, 1, 5, 10, 30),
    "2024-01-05 10:30:00-0800": (2024, 1, 5, 10, 30), "2024-01-05T10:30:00+05": (2024, 1, 5, 10, 30),
    # not complete dates, or none
    "13/13/2024": None, "02/30/2024": None, "not a date": None, "10": None, "March": None, "March 2024": None, "10:30": None, "2024-01-05 10": None,
    "2024-01-05 13:00 PM": None, "2024-13-05": None, "2024-01-05 25:00": None, "2024-01-05 10:61": None, "2024-01-05 10:30:61": None, "": None,
    "0000-01-05": None, "2024-01/05": None, "1234567": None, "2024-01-05 10:30 foo": None, "Foo 5 2024": None, "2024-01-05 am": None, "12345678901234567890": None,
}


def test_freeform_shapes(spark):
    from tabvet.functions.dates import parse_datetime
    df = spark.createDataFrame([(v,) for v in FREE_FORM], "s string")
    got = {r[0]: r[1:] for r in df.select("s", parse_freeform("s", 2024), parse_datetime("s", ["%Y"], year=2024)).collect()}
    for text, want in FREE_FORM.items():
        assert got[text][0] == (datetime(*want) if want else None), text
        assert got[text][1] == got[text][0], text


def test_freeform_shapes_staged(spark):
    """The staged path of a rule: local time, offset, and the formats first."""
    from tabvet.operators.checks import CheckContext
    from tabvet.plans.rules import load_rules
    from tabvet.plans.validate import as_of_literal
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "s", "type": "date"}]}}}, "t")
    df = spark.createDataFrame([(v,) for v in FREE_FORM] + [(None,)], "s string")
    ctx = CheckContext(rules, ("s",), as_of_literal("2024-06-01"), year=2024)
    fv = ctx.values("s")
    local, offset, rest = fv.freeform(), fv.offset(), fv.freeform(("%Y-%m-%d",))
    got = {r[0]: r[1:] for r in ctx.stager.apply(df).select("s", local, offset, rest).collect()}
    for text, want in FREE_FORM.items():
        assert got[text][0] == (datetime(*want) if want else None), text
        assert got[text][2] == (None if py_parse(text, "%Y-%m-%d") else got[text][0]), text
    assert got[None] == (None, None, None)
    assert got["2024-01-05T10:30:00Z"][1] == "z" and got["2024-01-05 10:30 +05:30"][1] == "+05:30" and got["2024-01-05"][1] is None


def test_offsets(spark):
    from pyspark.sql import functions as F
    from tabvet.functions.freeform import offset_minutes, offset_text
    df = spark.createDataFrame([("Z",), ("gmt",), ("+0530",), ("-08:00",), ("+05",), (None,)], "o string")
    got = [tuple(r) for r in df.select(offset_minutes(F.col("o")), offset_text(F.col("o"))).collect()]
    assert got == [(0, "+00:00"), (0, "+00:00"), (330, "+05:30"), (-480, "-08:00"), (300, "+05:00"), (None, None)]


def test_compile_rejects_unknown_directive():
    import pytest
    from tabvet.functions.dates import FormatError
    with pytest.raises(FormatError):
        compile_strptime("%Q")
    with pytest.raises(FormatError):
        compile_strptime("%d %d")


def test_multi_format_path_with_prefilter(spark):
    """The staged per-format path (skeleton prefilter + one match) equals a Python loop."""
    from tabvet.operators.checks import CheckContext
    from tabvet.plans.rules import load_rules
    from tabvet.plans.validate import as_of_literal

    fmts = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y", "%Y-%m-%dT%H:%M:%S")
    values = DATES + ["01/03/1995", "2024-01-05 10:30:00", "2024-01-05t10:30:00", "2024-01-05T10:30:00",
                      "1/3/1995", "2024/01/05", "2024-01-05 10:30"]
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "s", "type": "date"}]}}}, "t")
    df = spark.createDataFrame([(v,) for v in values], "s string")
    ctx = CheckContext(rules, ("s",), as_of_literal("2024-06-01"))
    fv = ctx.values("s")
    col = fv.by_formats(fmts)
    got = [r[0] for r in ctx.stager.apply(df).select(col).collect()]

    def py(v):
        for f in fmts:
            p = py_parse(v.strip(), f)
            if p is not None:
                return p
        return None
    assert got == [py(v) for v in values]


def test_freeform_case_is_folded_for_ascii_only(spark):
    """``lower`` goes through ICU for every cell; casts of unused (empty) groups threw and caught an exception each."""
    from tabvet.functions.freeform import freeform_sql
    sql = freeform_sql("x", 2024)
    assert "lower(" not in sql and all("try_cast(concat('0'," in sql[k:k + 20] for k in range(len(sql)) if sql.startswith("try_cast(", k))
    texts = ["MARCH 5, 2021 3:04 pm", "5 mar 21", "20210305T030405", "2021-03-05t10:00:00 Utc", "\u212aarch 5, 2021", "13/2/2020", "2020-02-30", "Oct 2020", "0/1/2020"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] and str(r[0]) for r in df.select(F.expr(sql)).collect()]
    assert got == ["2021-03-05 15:04:00", "2021-03-05 00:00:00", "2021-03-05 03:04:05", "2021-03-05 10:00:00", None, "2020-02-13 00:00:00", None, None, None]


def test_formats_of_numbers_are_cast_as_iso_text(spark):
    """No array of fields, casts of each and decimal seconds for them; days with a space, year 0, second 60 and fractions as strptime has them."""
    from tabvet.functions.dates import iso_sql
    values = ["2024-01-05", "2024-1- 5", "2024-02-30", "0000-01-01", "2000-00-10", "5/1/2024 1:2:3.5", "31/12/2024 23:59:59.000001", " 5/01/2024 00:00:60.1",
              "05/01/2024 00:00:59.1234567", "10:30", "1:5", "24:00", "2024", "0000", "10000", "29/02", "28/02", "2024-01-05T10:00:00Z", ""]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for fmt in ("%Y-%m-%d", "%d/%m/%Y %H:%M:%S.%f", "%H:%M", "%Y", "%d/%m"):
        sql = iso_sql("s", fmt)
        assert "split(" not in sql and "decimal" not in sql
        assert [r[0] for r in df.select(F.expr(sql)).collect()] == [py_parse(v, fmt) for v in values], fmt
    assert iso_sql("s", "%d %b %Y") is None and iso_sql("s", "%y-%m-%d") is None and iso_sql("s", "%Y-%m-%d %I") is None


def test_trim_searches_no_plain_ends(spark):
    """Most cells have nothing to trim: they were searched for 29 characters at both ends."""
    values = ["a", "ab c", "~x~", "\x7f", " a", "a\t", "　a", "a\xa0", "\xe9 ", "\xe9", "\x1fa", "a\x85", "", " ", " \xa0", None, "x\U0001f600", "!", "\U0001f600 "]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    out = df.select(py_trim("s"))
    assert [r[0] for r in out.collect()] == [v and v.strip() for v in values]
    assert "CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()
