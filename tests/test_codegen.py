"""Every batch query compiles: no stage falls back to interpretation."""

import pytest

from tabvet.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream")])
def test_query_compiles(spark, name):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")


def test_large_stages_are_split(spark):
    """HotSpot compiles no method above 8000 bytes: a validator's stage beyond that was interpreted row by row."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    QUERIES["check_date_order_month_first"](spark, SF)
    assert spark.conf.get(limit) == "8000"
    spark.conf.set(limit, "9000")  # a session's own choice stays
    QUERIES["check_date_order_month_first"](spark, SF)
    assert spark.conf.get(limit) == "9000"
    spark.conf.unset(limit)


def test_a_task_has_no_more_rows_of_a_larger_table(spark, monkeypatch):
    from tabvet import fixtures as fx
    monkeypatch.setattr(fx, "SPLIT_BYTES", 500)
    for query in ("check_date_order_month_first", "normalize_date_shapes", "annotate_rows"):
        assert fx.splits(spark, SF, "orders") > spark.sparkContext.defaultParallelism
        assert f"RoundRobinPartitioning({fx.splits(spark, SF, 'orders')})" in QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_are_dealt_not_the_text_made_of_them(spark):
    """The stage that scans has few tasks: making the text there took its longest task 9 s of 9 million rows, and the text was sorted and shuffled."""
    for query in ("normalize_date_shapes", "check_date_order_month_first", "annotate_rows"):
        scan = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString().split("RoundRobinPartitioning")[1].split("FileScan")[0]
        assert "CASE WHEN" not in scan and "concat(" not in scan


def test_a_cell_is_parsed_once_by_the_freeform_parser(spark):
    """The check (after its formats) and the normalization (without) each matched and split it."""
    plan = QUERIES["normalize_date_shapes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:mon(?:day)?|tue(?:sday)?") == 2  # one match, one replace
    assert plan.count("split(") == 1


@pytest.mark.parametrize("query", ["run_stats", "errors_by_code"])
def test_rows_of_a_unique_join_are_not_dealt_before(spark, query):
    """Products and payments were sorted and shuffled whole only to be shuffled by key afterwards, for the rows and again for the keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of larger tables
    try:
        plan = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("RoundRobinPartitioning") == 2  # the stored orders, for the rows and for the keys
    assert plan.count("hashpartitioning(_mk") == 3
