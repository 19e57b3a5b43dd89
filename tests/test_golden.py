"""The reference's only data fixture, traced by hand through its code."""

import os

from tabvet import DEFAULT_RULES, load_rules, validate
from tabvet.sources.readers import read_delimited

# The seven sample orders shipped with the reference.
SAMPLE = """order_id,customer_name,customer_phone,country_code,order_date,delivery_date,order_amount,currency,status
ORD-001,John Smith,+14155552671,US,2024-01-15,2024-01-20,150.50,USD,confirmed
ORD-002,Priya Sharma,9876543210,IN,15/01/2024,20/01/2024,2500.00,INR,shipped
ORD-003,Lee Wei,91234567,SG,2024-02-01,2024-02-05,89.99,SGD,delivered
ORD-004,Bad Phone,123,US,2024-03-01,2024-02-28,50.00,USD,pending
ORD-005,Future Order,+442071234567,GB,2030-01-01,2030-01-05,100.00,GBP,confirmed
ORD-006,Negative Amount,+61412345678,AU,2024-04-10,2024-04-15,-10.00,AUD,cancelled
ORD-007,Missing Currency,+14155559999,US,2024-05-01,,75.00,,pending
"""

GOLDEN = {
    2: ["PHONE_LENGTH"],
    3: [],
    4: [],
    5: ["PHONE_POSSIBLE", "PHONE_INVALID", "PHONE_LENGTH", "DATE_ORDER"],
    6: ["PHONE_LENGTH", "FUTURE_DATE", "FUTURE_DATE"],
    7: ["PHONE_LENGTH", "RANGE"],
    8: ["PHONE_LENGTH", "REQUIRED"],
}


def _validated(spark, tmp_dir):
    path = os.path.join(tmp_dir, "orders_sample.csv")
    with open(path, "w") as fh:
        fh.write(SAMPLE)
    df = read_delimited(spark, path)
    return validate(df, load_rules(DEFAULT_RULES, "orders"), as_of="2024-06-01 00:00:00")


def test_error_codes_per_row(spark, tmp_dir):
    v = _validated(spark, tmp_dir)
    rows = v.error_report().collect()
    got = {n: [] for n in GOLDEN}
    # report order is field-major; re-group per row keeping the in-row order
    per_row = {}
    for r in v.errors(with_order=True).orderBy("row_number", "ordinal", "seq").collect():
        per_row.setdefault(r.row_number, []).append(r.error_code)
    got.update(per_row)
    assert got == GOLDEN
    assert len(rows) == 12


def test_messages_and_summary(spark, tmp_dir):
    v = _validated(spark, tmp_dir)
    by_row = {r.order_id: r for r in v.cleaned().collect()}
    assert by_row["ORD-001"].error_summary == "Expected 10 digits for US"
    assert by_row["ORD-002"].is_valid and by_row["ORD-002"].error_summary == ""
    assert by_row["ORD-005"].error_summary == ("Expected 10 digits for GB; Date cannot be in the future; "
                                               "order_date is too far in the future")
    assert by_row["ORD-007"].error_summary == "Expected 10 digits for US; currency is required"
    assert by_row["ORD-004"].error_summary.endswith("order_date must be before or equal to delivery_date")
    assert by_row["ORD-002"].order_date_normalized == "2024-01-15T00:00:00"
    assert by_row["ORD-002"].customer_phone_normalized == "+919876543210"
    assert by_row["ORD-004"].customer_phone_normalized == "123"
    assert by_row["ORD-007"].delivery_date_normalized is None


def test_stats(spark, tmp_dir):
    v = _validated(spark, tmp_dir)
    s = v.stats().first()
    assert (s.total_rows, s.valid_rows, s.invalid_rows, s.valid_percentage) == (7, 2, 5, 28.57)
    assert dict(s.errors_by_code) == {"PHONE_LENGTH": 5, "FUTURE_DATE": 2, "PHONE_POSSIBLE": 1,
                                      "PHONE_INVALID": 1, "DATE_ORDER": 1, "RANGE": 1, "REQUIRED": 1}
    assert s.error_count == 12 and s.output_chunks == 1
    assert {r.error_code: r.error_count for r in v.errors_by_code().collect()} == dict(s.errors_by_code)
