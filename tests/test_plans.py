"""Plan-shape guards for scale: no all-pairs joins, partial top-k, pruned scans."""

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
BATCH = [n for n in e.queries() if not n.startswith("stream_") and n not in ("scan_raw", "chunked_output")]


def _plan(spark, name):
    return e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_all_pairs_joins(spark):
    for name in BATCH:
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_newest_jobs_limit_before_shuffle(spark):
    assert "WindowGroupLimit" in _plan(spark, "recent_jobs")


def test_row_numbering_reads_one_column(spark):
    plan = e.queries()["row_numbering"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
    assert "o_orderkey" in scan and "o_totalprice" not in scan and "o_custkey" not in scan
