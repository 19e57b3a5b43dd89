"""The registered queries: one per operator of the survey's inventory.

Every query reads the driver tables (or data Spark derives from them) in full and
returns a lazy DataFrame; column names match the DuckDB restatements in ``oracles.py``.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet import fixtures as fx
from tabvet.functions.phone import plan_from_table
from tabvet.operators import ledger
from tabvet.operators.checks import FieldValues
from tabvet.plans.default_rules import DEFAULT_RULES
from tabvet.plans.rules import load_rules
from tabvet.operators.positions import with_positions
from tabvet.plans.validate import SOURCE, Validated, validate
from tabvet.session import checkpoint_dir, stored
from tabvet.sources import readers, sinks
from tabvet.streaming import stream as streaming

REPORT = ["row_number", "field_name", "error_code", "error_message"]


def orders_rules():
    return load_rules(DEFAULT_RULES, "orders")


def _orders(spark, sf, keys: bool = True, **kw) -> Validated:
    """The dirty orders against the shipped rules; ``keys=False`` for queries that read no
    UNIQUE result, so that its join isn't planned."""
    rules = orders_rules() if keys else orders_rules().with_constraint("order_id", "unique", False)
    return validate(fx.dirty_orders(spark, sf, rebalance=True), rules, as_of=fx.AS_OF, row_number="row_number", **kw)


def _products(spark, sf) -> Validated:
    """The shuffle of the UNIQUE join deals the rows, here and in the payments; a join that needs none runs in the splits of the scan."""
    return validate(fx.products(spark, sf), load_rules(DEFAULT_RULES, "products"), as_of=fx.AS_OF, row_number="row_number")


def _payments(spark, sf, reference: bool = False) -> Validated:
    rules = load_rules(DEFAULT_RULES, "payments")
    refs = None
    if reference:
        rules = rules.with_constraint("order_id", "references", {"dataset": "orders", "field": "order_id"})
        refs = {"orders": fx.parent_orders(spark, sf)}
    return validate(fx.payments(spark, sf), rules, as_of=fx.AS_OF, row_number="row_number", refs=refs)


def _codes(v: Validated, *codes) -> DataFrame:
    return v.errors().where(F.col("error_code").isin(list(codes)))


def _subset(spark, sf, fields, *codes, **kw) -> DataFrame:
    d = fx.dirty_orders(spark, sf, rebalance=True)
    v = validate(d, orders_rules().with_fields(fields), as_of=fx.AS_OF, row_number="row_number", **kw)
    return _codes(v, *codes)


def scan_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The dirty orders written as CSV by Spark, read back as all-string columns."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/scan-raw-{uuid.uuid4().hex[:12]}/orders.csv"
    (fx.dirty_orders(spark, sf).write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return readers.read_delimited(spark, path, flag_malformed=False)


def coerce_inferred(spark, sf):
    return readers.coerce_inferred(fx.products(spark, sf))


def row_numbering(spark, sf):
    from tabvet.operators.rownum import with_row_numbers
    return with_row_numbers(fx.read_table(spark, sf, "orders"), "row_number").select("o_orderkey", "row_number")


def annotate_rows(spark, sf):
    return _orders(spark, sf).with_row_number()


def valid_only(spark, sf):
    return _orders(spark, sf).with_row_number(valid_only=True)


def missing_column(spark, sf):
    d = fx.dirty_orders(spark, sf).drop("status")
    v = validate(d, orders_rules(), as_of=fx.AS_OF, row_number="row_number")
    return v.errors().where(F.col("field_name") == "status")


def phone_region(spark, sf):
    d = fx.dirty_orders(spark, sf)
    rules = orders_rules()
    from tabvet.operators.checks import CheckContext, region_of
    from tabvet.plans.validate import as_of_literal
    ctx = CheckContext(rules, tuple(d.columns), as_of_literal(fx.AS_OF))
    fv = FieldValues(ctx, "customer_phone")
    region = region_of(rules.field("customer_phone"), fv, ctx)
    return ctx.stager.apply(d).select("row_number", "country_code", F.col(region).alias("region"))


def check_phone_plan(spark, sf):
    """V12–V14, N1 against a plan of 25 regions given as a table."""
    table = spark.sql(fx.world_plan_sql()[1:-1]).select(
        "region", "calling_code", "idd", "trunk", F.split("lengths", ",").cast("array<int>").alias("lengths"),
        F.array().cast("array<int>").alias("local_lengths"), "pattern")
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "phone", "type": "phone", "region_column": "country"}]}}}, "t")
    v = validate(fx.world_phones(spark, sf), rules, as_of=fx.AS_OF, row_number="row_number", phone_plan=plan_from_table(table))
    return v.with_row_number().select("row_number", "country", "phone", "phone_normalized", "error_summary")


def normalize_phones(spark, sf):
    return _orders(spark, sf, keys=False).with_row_number().select("row_number", "customer_phone", "customer_phone_normalized")


def normalize_dates(spark, sf):
    return _orders(spark, sf, keys=False).with_row_number().select("row_number", "order_date", "order_date_normalized",
                                                       "delivery_date", "delivery_date_normalized")


def normalize_date_shapes(spark, sf):
    """Dates with AM/PM, two-digit years, weekday names, long fractions, offsets; partial and impossible ones."""
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "event_date", "type": "datetime"}]}}}, "t")
    v = validate(fx.order_dates(spark, sf, fx.DATE_SHAPES_SQL).select("row_number", "event_date"), rules, as_of=fx.AS_OF, row_number="row_number")
    return v.with_row_number().select("row_number", "event_date", "event_date_normalized", "is_valid")


def check_date_order_offsets(spark, sf):
    """X1 on dates with UTC offsets: instants are compared, pairs of which only one has an offset are not."""
    rules = load_rules({"datasets": {"t": {
        "fields": [{"name": "sent", "type": "datetime"}, {"name": "received", "type": "datetime"}],
        "cross_field_checks": [{"type": "date_order", "left": "sent", "right": "received"}]}}}, "t")
    v = validate(fx.order_dates(spark, sf, fx.OFFSET_DATES_SQL), rules, as_of=fx.AS_OF, row_number="row_number")
    return v.errors()


def errors_by_code(spark, sf):
    parts = [(_orders(spark, sf), "orders"), (_products(spark, sf), "products"), (_payments(spark, sf), "payments")]
    out = None
    for v, name in parts:
        df = v.errors_by_code().select(F.lit(name).alias("dataset"), "error_code", "error_count")
        out = df if out is None else out.unionByName(df)
    return out


def run_stats(spark, sf):
    parts = [(_orders(spark, sf), "orders"), (_products(spark, sf), "products"), (_payments(spark, sf), "payments")]
    out = None
    for v, name in parts:
        df = v.stats().select(F.lit(name).alias("dataset"), "total_rows", "valid_rows", "invalid_rows",
                              "valid_percentage", "error_count", "output_chunks")
        out = df if out is None else out.unionByName(df)
    return out


def chunked_output(spark, sf):
    layout = sinks.chunk_layout(_orders(spark, sf), chunk_rows=1000, valid_only=True)
    return layout.select("row_number", "out_pos", "chunk_index")


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def output_manifest(spark, sf):
    """The outputs written, and the manifest of the written files. Spark names the files inside
    a chunk's folder, so that part of the key and the size aren't compared."""
    manifest = sinks.write_outputs(_orders(spark, sf), _scratch(spark, "outputs"), chunk_rows=1000, valid_only=True)
    key = F.regexp_replace("storage_key", r"/part-.*\.csv$", "/*.csv")
    return manifest.select("file_type", "filename", key.alias("storage_key"), (F.col("file_size") > 0).alias("written"), "chunk_index",
                           "row_count", "is_valid_only")


def _order_files(spark, sf) -> DataFrame:
    """The dirty orders written as many CSV files (one for each 5000 keys) and read back as one input."""
    path = _scratch(spark, "order-files")
    rows = fx.dirty_orders(spark, sf).withColumn("part", F.format_string("%06d", F.floor(F.col("src_key") / 5000)))
    (rows.drop("row_number").repartition("part").sortWithinPartitions("part", "src_key").write.partitionBy("part").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return readers.read_delimited(spark, f"{path}/part=*", flag_malformed=False)


def row_numbering_multi_file(spark, sf):
    """P1 over many files: each row's file and its number in it."""
    from tabvet.operators.rownum import with_row_numbers
    rows = with_row_numbers(_order_files(spark, sf), "row_number", "source_file")
    return rows.select(F.regexp_extract("source_file", "part=([0-9]+)/", 1).alias("part"), F.col("src_key").cast("long").alias("src_key"), "row_number")


def chunked_output_multi_file(spark, sf):
    """S6, L4 over many files: valid rows of all files in file order, 1000 a chunk."""
    rules = orders_rules().with_constraint("order_id", "unique", False)
    layout = sinks.chunk_layout(validate(_order_files(spark, sf), rules, as_of=fx.AS_OF), chunk_rows=1000, valid_only=True)
    return layout.select(F.regexp_extract(SOURCE, "part=([0-9]+)/", 1).alias("part"), "row_number", "out_pos", "chunk_index")


def error_report_multi_file(spark, sf):
    """E2, L3 over many files: each error's file, and its place in report order."""
    v = validate(_order_files(spark, sf), orders_rules(), as_of=fx.AS_OF)
    errors = with_positions(stored(v.errors(with_order=True), "errors"), ["source_file", "ordinal", "row_number", "seq"], "position")
    return errors.select("position", F.regexp_extract("source_file", "part=([0-9]+)/", 1).alias("part"), *REPORT)


def _jobs(spark, sf):
    return fx.ledger(spark, sf, fx.JOBS_SQL)


def _files(spark, sf):
    return fx.ledger(spark, sf, fx.FILES_SQL)


def file_lookup(spark, sf):
    return ledger.file_lookup(fx.ledger(spark, sf, fx.REQUESTS_SQL), _files(spark, sf), _jobs(spark, sf))


def job_with_files(spark, sf):
    return ledger.job_with_files(_jobs(spark, sf), _files(spark, sf))


def _recent(spark, sf, k):
    return ledger.recent_jobs(_jobs(spark, sf), k).withColumn("created_at", F.col("created_at").cast("string"))


def recent_jobs(spark, sf):
    return _recent(spark, sf, 50)


def recent_jobs_dashboard(spark, sf):
    return _recent(spark, sf, 5)


def job_status_counts(spark, sf):
    return ledger.job_status_counts(_jobs(spark, sf))


def missing_chunks(spark, sf):
    return ledger.missing_chunks(fx.ledger(spark, sf, fx.SESSIONS_SQL), fx.ledger(spark, sf, fx.PIECES_SQL), fx.splits(spark, sf, "lineitem"))


def merge_chunks(spark, sf):
    pieces = fx.ledger(spark, sf, fx.PIECES_SQL)
    return ledger.merge_chunks(pieces.where("l_linestatus = 'O'"), pieces.where("l_linestatus <> 'O'"), fx.splits(spark, sf, "lineitem"))


def _table_stream(spark, sf, name: str) -> DataFrame:
    return streaming.read_table_stream(spark, fx.table_path(sf, name), fx.read_table(spark, sf, name).schema, bytes_per_trigger=256 << 20)


def _payment_stream(spark, events: DataFrame):
    events.createOrReplaceTempView("events_stream")
    sql = fx.PAYMENTS_SQL.format(row="cast(ts AS timestamp) AS event_ts, event_id + 2").replace("FROM events", "FROM events_stream")
    return spark.sql(sql)


def _payment_stream_rules():
    rules = load_rules(DEFAULT_RULES, "payments")
    return rules.with_constraint("payment_id", "unique", False)


def stream_validate(spark, sf):
    v = streaming.validate_stream(_payment_stream(spark, _table_stream(spark, sf, "events")), _payment_stream_rules(), as_of=fx.AS_OF,
                                  row_number="row_number")
    out = v.with_row_number().select("row_number", "is_valid", "error_summary")
    return streaming.run_available_now(out, "stream-validate")


def stream_error_rate(spark, sf):
    """ST3 in append mode. The table's files come in no order of time, so the watermark allows for its whole span; a marker at
    the end closes the last windows."""
    events, close = streaming.with_end_marker(_table_stream(spark, sf, "events"), "ts")
    v = streaming.validate_stream(_payment_stream(spark, events), _payment_stream_rules(), as_of=fx.AS_OF, row_number="row_number")
    rate = streaming.error_rate(v, "event_ts", "1 day", "36500 days")
    out = streaming.run_available_now(rate, "stream-error-rate", close=close)
    return out.where(F.col("error_count") > 0).select(F.col("window_start").cast("string").alias("window_start"),
                                                      "rows", "error_code", "error_count")


def _order_stream(spark, sf, row: str, rowsrc: str = "") -> DataFrame:
    _table_stream(spark, sf, "orders").createOrReplaceTempView("orders_stream")
    return spark.sql(fx.DIRTY_ORDERS_SQL.format(row=row, rowsrc=rowsrc).replace("FROM orders)", "FROM orders_stream)"))


def stream_unique(spark, sf):
    """ST2 over the dirty orders read as a file stream: later copies of an order id."""
    flags = streaming.first_occurrence_flags(_order_stream(spark, sf, "k + 2"), "order_id")
    return streaming.run_available_now(flags, "stream-unique")


def stream_unique_window(spark, sf):
    """ST2 with expiring state: copies of an order id within 365 days before, by order date. The table's files come in no
    order of time, so the watermark allows for its whole span."""
    orders = _order_stream(spark, sf, "cast(o_orderdate AS timestamp) AS event_ts, k + 2", ", o_orderdate")
    return streaming.run_available_now(streaming.unique_within(orders, "order_id", "event_ts", "365 days", "36500 days"), "stream-unique-window")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_raw": scan_raw,
    "coerce_inferred": coerce_inferred,
    "row_numbering": row_numbering,
    "annotate_rows": annotate_rows,
    "valid_only": valid_only,
    "missing_column": missing_column,
    "check_required": lambda s, sf: _codes(_orders(s, sf, keys=False), "REQUIRED"),
    "check_regex": lambda s, sf: _subset(s, sf, ["order_id", "country_code"], "REGEX"),
    "check_length": lambda s, sf: _subset(s, sf, ["customer_name"], "LENGTH"),
    "check_enum": lambda s, sf: _subset(s, sf, ["currency", "status"], "ENUM"),
    "check_float": lambda s, sf: _subset(s, sf, ["order_amount"], "TYPE", "RANGE"),
    "check_integer": lambda s, sf: _codes(validate(
        fx.products(s, sf), load_rules(DEFAULT_RULES, "products").with_fields(["quantity"]), as_of=fx.AS_OF,
        row_number="row_number"), "TYPE", "RANGE"),
    "check_date_format": lambda s, sf: _subset(s, sf, ["order_date", "delivery_date"], "DATE_FORMAT"),
    "check_not_future": lambda s, sf: _orders(s, sf).errors(with_order=True)
        .where("error_code = 'FUTURE_DATE' AND ordinal = 4").select(*REPORT),
    "check_date_order": lambda s, sf: _subset(s, sf, ["order_date", "delivery_date"], "DATE_ORDER"),
    "check_date_order_month_first": lambda s, sf: _subset(s, sf, ["order_date", "delivery_date"], "DATE_ORDER",
                                                          date_policy="month_first"),
    "check_future_tolerance": lambda s, sf: _orders(s, sf).errors(with_order=True)
        .where("error_code = 'FUTURE_DATE' AND ordinal = 10").select(*REPORT),
    "check_phone": lambda s, sf: _subset(s, sf, ["customer_phone", "country_code"], "PHONE_PARSE", "PHONE_POSSIBLE",
                                         "PHONE_INVALID"),
    "check_phone_length": lambda s, sf: _subset(s, sf, ["customer_phone", "country_code"], "PHONE_LENGTH"),
    "check_phone_plan": check_phone_plan,
    "phone_region": phone_region,
    "normalize_phones": normalize_phones,
    "normalize_dates": normalize_dates,
    "normalize_date_shapes": normalize_date_shapes,
    "check_date_order_offsets": check_date_order_offsets,
    "check_unique": lambda s, sf: _subset(s, sf, ["order_id"], "UNIQUE"),
    "check_unique_products": lambda s, sf: _codes(_products(s, sf), "UNIQUE"),
    "check_reference": lambda s, sf: _codes(_payments(s, sf, reference=True), "REFERENCE"),
    "error_report": lambda s, sf: _orders(s, sf).errors(),
    "error_report_products": lambda s, sf: _products(s, sf).errors(),
    "error_report_payments": lambda s, sf: _payments(s, sf).errors(),
    "errors_by_code": errors_by_code,
    "run_stats": run_stats,
    "chunked_output": chunked_output,
    "output_manifest": output_manifest,
    "row_numbering_multi_file": row_numbering_multi_file,
    "chunked_output_multi_file": chunked_output_multi_file,
    "error_report_multi_file": error_report_multi_file,
    "file_lookup": file_lookup,
    "job_with_files": job_with_files,
    "recent_jobs": recent_jobs,
    "recent_jobs_dashboard": recent_jobs_dashboard,
    "job_status_counts": job_status_counts,
    "missing_chunks": missing_chunks,
    "merge_chunks": merge_chunks,
    "stream_validate": stream_validate,
    "stream_error_rate": stream_error_rate,
    "stream_unique": stream_unique,
    "stream_unique_window": stream_unique_window,
}
