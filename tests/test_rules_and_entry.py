import pytest

from tabvet import DEFAULT_RULES, RuleError, load_rules, register_check, validate


def test_rule_errors():
    bad = [
        {"name": "a", "type": "colour"},
        {"name": "a", "constraints": {"regex": "("}},
        {"name": "a", "type": "date", "constraints": {"formats": ["%Q"]}},
        {"name": "a", "constraints": {"min": "x"}},
    ]
    for f in bad:
        with pytest.raises(RuleError):
            load_rules({"datasets": {"t": {"fields": [f]}}}, "t")
    with pytest.raises(RuleError):
        load_rules({"datasets": {"t": {"fields": [{"name": "a"}, {"name": "a"}]}}}, "t")
    with pytest.raises(RuleError):
        load_rules(DEFAULT_RULES, "invoices")


def test_shipped_rules_load():
    for ds in ("orders", "products", "payments"):
        assert load_rules(DEFAULT_RULES, ds).fields


def test_missing_required_column_and_custom_check(spark):
    from pyspark.sql import functions as F
    register_check("no_x", "CUSTOM", "{name} contains x", lambda t, _p: t.contains("x"))
    rules = load_rules({"datasets": {"t": {"fields": [
        {"name": "a", "type": "string", "constraints": {"no_x": True}},
        {"name": "gone", "type": "string", "required": True},
        {"name": "gone_optional", "type": "string"}]}}}, "t")
    df = spark.createDataFrame([(2, "abc"), (3, "xyz")], "row_number long, a string")
    v = validate(df, rules, as_of="2024-01-01", row_number="row_number")
    got = sorted((r.row_number, r.error_code, r.error_message) for r in v.errors().collect())
    assert got == [(2, "REQUIRED", "Missing column: gone"), (3, "CUSTOM", "a contains x"),
                   (3, "REQUIRED", "Missing column: gone")]
    assert v.cleaned().where(F.col("is_valid")).count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    rows = {r.error_code: r.error_count for r in df.collect()}
    assert rows and all(v > 0 for v in rows.values())


def test_oracle_sample(spark):
    """A few registered queries against their DuckDB restatement at sf0.001."""
    import os

    import duckdb

    import __spark_entry__ as e
    from tabvet.fixtures import TABLES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t + '.parquet')}')")
    for name in ["error_report", "check_unique_products", "check_reference", "missing_chunks", "chunked_output"]:
        df = e.queries()[name](spark, sf)
        got = sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
        res = con.execute(e.oracle_sql()[name])
        cols = [c[0] for c in res.description]
        idx = sorted(range(len(cols)), key=lambda i: cols[i])
        want = sorted(tuple(str(r[i]) for i in idx) for r in res.fetchall())
        assert got == want, name


def test_assembled_storage_key(spark):
    from pyspark.sql import functions as F

    from tabvet.operators.ledger import assembled_storage_key
    df = spark.createDataFrame([("s1", "a/b\\c.csv")], "sid string, name string")
    assert df.select(assembled_storage_key(F.col("sid"), F.col("name"))).first()[0] == "uploads/s1/assembled/a_b_c.csv"


def test_row_numbers_need_a_file_scan(spark):
    df = spark.createDataFrame([("a",)], "v string")
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "v"}]}}}, "t")
    with pytest.raises(ValueError, match="row_number"):
        validate(df, rules, as_of="2024-01-01")
