"""DuckDB restatements of the registered queries (the correctness oracle).

Each statement is written independently of the Spark compiler: the checks are spelled
out per field as SQL predicates over the same fixture projections, and the error
lists are rebuilt with UNION ALL / string_agg. Views ``orders lineitem part events``
are provided by the caller.
"""

from __future__ import annotations

from tabvet.fixtures import (AS_OF, DATE_SHAPES_SQL, DIRTY_ORDERS_SQL, FILES_SQL, JOBS_SQL, OFFSET_DATES_SQL, PARENT_ORDERS_SQL, PAYMENTS_SQL,
                             PIECES_SQL, PRODUCTS_SQL, REQUESTS_SQL, SESSIONS_SQL, WORLD_PHONES_SQL, duck_sql, world_plan_sql)

WS = "(" + "||".join(f"chr({ord(c)})" for c in "".join(chr(c) for c in range(0x110000) if chr(c).isspace())) + ")"
TS = f"TIMESTAMP '{AS_OF}'"
NUM_GATE = r"[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
LADDER = ["%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S",
          "%Y/%m/%d", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y", "%m/%d/%Y %H:%M:%S", "%d/%m/%Y", "%d/%m/%Y %H:%M:%S",
          "%m-%d-%Y", "%d-%m-%Y", "%m.%d.%Y", "%d.%m.%Y", "%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d, %Y"]


def t(c: str) -> str:
    return f"trim({c}, {WS})"


def miss(c: str) -> str:
    return f"({c} IS NULL OR {t(c)} = '')"


def parse(c: str, formats: list[str] | None, ladder: bool = True) -> str:
    parts = [f"try_strptime({t(c)}, '{f}')" for f in (formats or [])]
    if ladder:
        parts += [f"try_strptime({t(c)}, '{f}')" for f in LADDER]
    return "coalesce(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def num(c: str) -> str:
    v = t(c)
    return (f"(CASE WHEN regexp_full_match({v}, '{NUM_GATE}') THEN TRY_CAST(replace({v}, '_', '') AS DOUBLE) "
            f"WHEN lower({v}) IN ('nan', '+nan', '-nan') THEN 'NaN'::DOUBLE "
            f"WHEN lower({v}) IN ('inf', '+inf', 'infinity', '+infinity') THEN 'Infinity'::DOUBLE "
            f"WHEN lower({v}) IN ('-inf', '-infinity') THEN '-Infinity'::DOUBLE END)")


def err(ordinal: int, seq: int, field: str, code: str, cond: str, msg: str, src: str = "d") -> str:
    return (f"SELECT row_number, {ordinal} AS ordinal, {seq} AS seq, '{field}' AS field_name, '{code}' AS error_code, "
            f"{msg} AS error_message FROM {src} WHERE {cond}")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORDER_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y"]
CURRENCIES = ["USD", "EUR", "GBP", "INR", "SGD", "AUD"]
STATUSES = ["pending", "confirmed", "shipped", "delivered", "cancelled"]
MODES = ["credit_card", "debit_card", "upi", "paypal", "bank_transfer", "cash"]


def inlist(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


def phone_cte(src: str, phone: str, region_expr: str, out: str) -> str:
    """Phone parse of ``phone`` dialled from ``region_expr`` (the numbering plan restated)."""
    return f"""
{out}_a AS (SELECT *, {region_expr} AS rg,
   regexp_replace(regexp_extract({t(phone)}, '[+0-9].*', 0), '[^0-9]+$', '') AS body FROM {src}),
{out}_b AS (SELECT *, regexp_replace(body, '[^0-9]', '', 'g') AS digits, starts_with(body, '+') AS plus,
   CASE rg WHEN 'US' THEN '011' WHEN 'IN' THEN '00' WHEN 'SG' THEN '000' WHEN 'GB' THEN '00' WHEN 'AU' THEN '0011' END AS idd,
   CASE rg WHEN 'US' THEN '1' WHEN 'IN' THEN '0' WHEN 'GB' THEN '0' WHEN 'AU' THEN '0' END AS trunk,
   CASE rg WHEN 'US' THEN [10, 7] WHEN 'IN' THEN [10] WHEN 'SG' THEN [8] WHEN 'GB' THEN [9, 10] WHEN 'AU' THEN [9] ELSE [] END AS rlens
   FROM {out}_a),
{out}_c AS (SELECT *, (NOT plus AND idd IS NOT NULL AND starts_with(digits, idd)) AS via_idd FROM {out}_b),
{out}_d AS (SELECT *, (plus OR via_idd) AS intl_flag,
   CASE WHEN plus THEN digits WHEN via_idd THEN substr(digits, length(idd) + 1) END AS intl FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN starts_with(intl, '91') THEN '91' WHEN starts_with(intl, '65') THEN '65'
   WHEN starts_with(intl, '44') THEN '44' WHEN starts_with(intl, '61') THEN '61' WHEN starts_with(intl, '1') THEN '1' END AS cc,
   CASE WHEN trunk IS NOT NULL AND starts_with(digits, trunk) AND list_contains(rlens, length(digits) - length(trunk))
        THEN substr(digits, length(trunk) + 1) ELSE digits END AS local_n FROM {out}_d),
{out}_f AS (SELECT *, CASE WHEN intl_flag THEN substr(intl, length(cc) + 1) ELSE local_n END AS nat,
   CASE WHEN intl_flag THEN (CASE cc WHEN '1' THEN 'US' WHEN '91' THEN 'IN' WHEN '65' THEN 'SG' WHEN '44' THEN 'GB'
        WHEN '61' THEN 'AU' END) ELSE rg END AS nr FROM {out}_e),
{out} AS (SELECT *,
   coalesce(length(digits) >= 2 AND regexp_full_match(body, '\\+?[0-9 \\t\\-.()/\\[\\]~]*')
     AND (CASE WHEN intl_flag THEN cc IS NOT NULL ELSE rg IN ('US', 'IN', 'SG', 'GB', 'AU') END)
     AND length(nat) BETWEEN 2 AND 17, false) AS p_parsed,
   coalesce(list_contains(CASE nr WHEN 'US' THEN [10, 7] WHEN 'IN' THEN [10] WHEN 'SG' THEN [8] WHEN 'GB' THEN [9, 10]
     WHEN 'AU' THEN [9] ELSE [] END, length(nat)), false) AS p_possible,
   coalesce(CASE nr WHEN 'US' THEN regexp_full_match(nat, '[2-9][0-9]{{2}}[2-9][0-9]{{6}}')
     WHEN 'IN' THEN regexp_full_match(nat, '[6-9][0-9]{{9}}|[1-5][0-9]{{9}}')
     WHEN 'SG' THEN regexp_full_match(nat, '[3689][0-9]{{7}}')
     WHEN 'GB' THEN regexp_full_match(nat, '[1-35789][0-9]{{8,9}}')
     WHEN 'AU' THEN regexp_full_match(nat, '[2-478][0-9]{{8}}') ELSE false END, false) AS p_valid,
   '+' || (CASE nr WHEN 'US' THEN '1' WHEN 'IN' THEN '91' WHEN 'SG' THEN '65' WHEN 'GB' THEN '44' WHEN 'AU' THEN '61' END) || nat AS p_e164,
   CASE rg WHEN 'US' THEN 10 WHEN 'IN' THEN 10 WHEN 'SG' THEN 8 WHEN 'GB' THEN 10 WHEN 'AU' THEN 9 END AS p_expected
   FROM {out}_f)"""


ORDERS_REGION = (f"CASE WHEN country_code IS NOT NULL AND {t('country_code')} <> '' "
                 f"THEN substr(upper({t('country_code')}), 1, 2) ELSE 'US' END")


def orders_base(policy: str = "formats", drop: tuple[str, ...] = ()) -> str:
    """CTEs ``d`` (dirty orders + parsed values) and ``e`` (one row per error)."""
    dirty = duck_sql(DIRTY_ORDERS_SQL, "k")
    if policy == "formats":
        lp, rp = parse("order_date", ORDER_FORMATS), parse("delivery_date", ORDER_FORMATS)
    else:
        lp, rp = parse("order_date", None), parse("delivery_date", None)
    fut = parse("order_date", ORDER_FORMATS)
    errs = []
    if "order_id" not in drop:
        errs += [err(0, 0, "order_id", "REQUIRED", miss("order_id"), q("order_id is required")),
                 err(0, 1, "order_id", "REGEX",
                     f"NOT {miss('order_id')} AND NOT regexp_matches({t('order_id')}, '^(?:^[A-Za-z0-9_-]+$)')",
                     q("order_id does not match required pattern")),
                 err(0, 2, "order_id", "UNIQUE", f"NOT {miss('order_id')} AND dup", q("order_id must be unique"))]
    errs += [
        err(1, 0, "customer_name", "REQUIRED", miss("customer_name"), q("customer_name is required")),
        err(1, 1, "customer_name", "LENGTH", f"NOT {miss('customer_name')} AND length({t('customer_name')}) < 1",
            q("customer_name too short")),
        err(1, 2, "customer_name", "LENGTH", f"NOT {miss('customer_name')} AND length({t('customer_name')}) > 200",
            q("customer_name too long")),
        err(2, 0, "customer_phone", "REQUIRED", miss("customer_phone"), q("customer_phone is required")),
        err(2, 1, "customer_phone", "PHONE_PARSE", f"NOT {miss('customer_phone')} AND NOT p_parsed",
            "'Cannot parse phone number for region ' || rg"),
        err(2, 2, "customer_phone", "PHONE_POSSIBLE", f"NOT {miss('customer_phone')} AND p_parsed AND NOT p_possible",
            q("Phone number length/format is not possible")),
        err(2, 3, "customer_phone", "PHONE_INVALID", f"NOT {miss('customer_phone')} AND p_parsed AND NOT p_valid",
            q("Phone number is not valid for the region")),
        err(2, 4, "customer_phone", "PHONE_LENGTH",
            f"NOT {miss('customer_phone')} AND p_parsed AND p_expected IS NOT NULL AND length(digits) <> p_expected",
            "'Expected ' || p_expected || ' digits for ' || rg"),
        err(3, 0, "country_code", "REQUIRED", miss("country_code"), q("country_code is required")),
        err(3, 1, "country_code", "REGEX",
            f"NOT {miss('country_code')} AND NOT regexp_matches({t('country_code')}, '^(?:^[A-Z]{{2}}$)')",
            q("country_code does not match required pattern")),
        err(4, 0, "order_date", "REQUIRED", miss("order_date"), q("order_date is required")),
        err(4, 1, "order_date", "DATE_FORMAT", f"NOT {miss('order_date')} AND od IS NULL",
            f"'Unrecognized date format: ' || {t('order_date')}"),
        err(4, 2, "order_date", "FUTURE_DATE", f"NOT {miss('order_date')} AND od > {TS}",
            q("Date cannot be in the future")),
        err(5, 0, "delivery_date", "DATE_FORMAT", f"NOT {miss('delivery_date')} AND dd IS NULL",
            f"'Unrecognized date format: ' || {t('delivery_date')}"),
        err(6, 0, "order_amount", "REQUIRED", miss("order_amount"), q("order_amount is required")),
        err(6, 1, "order_amount", "TYPE", f"NOT {miss('order_amount')} AND amt IS NULL",
            q("order_amount must be a number")),
        err(6, 2, "order_amount", "RANGE", f"NOT {miss('order_amount')} AND amt IS NOT NULL AND NOT isnan(amt) AND amt < 0",
            q("order_amount below minimum 0")),
        err(7, 0, "currency", "REQUIRED", miss("currency"), q("currency is required")),
        err(7, 1, "currency", "ENUM", f"NOT {miss('currency')} AND {t('currency')} NOT IN {inlist(CURRENCIES)}",
            q(f"currency must be one of {CURRENCIES}")),
    ]
    if "status" not in drop:
        errs += [err(8, 0, "status", "REQUIRED", miss("status"), q("status is required")),
                 err(8, 1, "status", "ENUM", f"NOT {miss('status')} AND {t('status')} NOT IN {inlist(STATUSES)}",
                     q(f"status must be one of {STATUSES}"))]
    else:
        errs += [err(8, 0, "status", "REQUIRED", "true", q("Missing column: status"))]
    errs += [
        err(9, 0, "order_date", "DATE_ORDER",
            f"NOT {miss('order_date')} AND NOT {miss('delivery_date')} AND lp > rp",
            q("order_date must be before or equal to delivery_date")),
        err(10, 0, "order_date", "FUTURE_DATE", f"NOT {miss('order_date')} AND fut > {TS} + INTERVAL 1 DAY",
            q("order_date is too far in the future")),
    ]
    dup_join = ("LEFT JOIN (SELECT order_id AS k FROM raw WHERE order_id IS NOT NULL GROUP BY order_id "
                f"HAVING count(*) > 1) u ON u.k = {t('raw.order_id')}")
    return f"""WITH raw AS ({dirty}),
r0 AS (SELECT raw.*, u.k IS NOT NULL AS dup,
   {parse('order_date', ORDER_FORMATS)} AS od, {parse('delivery_date', ORDER_FORMATS)} AS dd,
   {lp} AS lp, {rp} AS rp, {fut} AS fut, {num('order_amount')} AS amt
   FROM raw {dup_join}),
{phone_cte('r0', 'customer_phone', ORDERS_REGION, 'd')},
e AS ({' UNION ALL '.join(errs)})"""


PRODUCT_COLS = "row_number, src_order, src_line, product_id, order_id, product_name, quantity, unit_price, sku"


def products_base() -> str:
    qty = "qn"
    errs = [
        err(0, 0, "product_id", "REQUIRED", miss("product_id"), q("product_id is required")),
        err(0, 1, "product_id", "UNIQUE", f"NOT {miss('product_id')} AND dup", q("product_id must be unique")),
        err(1, 0, "order_id", "REQUIRED", miss("order_id"), q("order_id is required")),
        err(2, 0, "product_name", "REQUIRED", miss("product_name"), q("product_name is required")),
        err(2, 1, "product_name", "LENGTH", f"NOT {miss('product_name')} AND length({t('product_name')}) < 1",
            q("product_name too short")),
        err(2, 2, "product_name", "LENGTH", f"NOT {miss('product_name')} AND length({t('product_name')}) > 300",
            q("product_name too long")),
        err(3, 0, "quantity", "REQUIRED", miss("quantity"), q("quantity is required")),
        err(3, 1, "quantity", "TYPE", f"NOT {miss('quantity')} AND ({qty} IS NULL OR isnan({qty}) OR isinf({qty}))",
            q("quantity must be an integer")),
        err(3, 2, "quantity", "RANGE",
            f"NOT {miss('quantity')} AND {qty} IS NOT NULL AND isfinite({qty}) AND trunc({qty}) < 1",
            q("quantity below minimum 1")),
        err(3, 3, "quantity", "RANGE",
            f"NOT {miss('quantity')} AND {qty} IS NOT NULL AND isfinite({qty}) AND trunc({qty}) > 10000",
            q("quantity above maximum 10000")),
        err(4, 0, "unit_price", "REQUIRED", miss("unit_price"), q("unit_price is required")),
        err(4, 1, "unit_price", "TYPE", f"NOT {miss('unit_price')} AND up IS NULL", q("unit_price must be a number")),
        err(4, 2, "unit_price", "RANGE", f"NOT {miss('unit_price')} AND up IS NOT NULL AND NOT isnan(up) AND up < 0",
            q("unit_price below minimum 0")),
        err(5, 0, "sku", "REGEX", f"NOT {miss('sku')} AND NOT regexp_matches({t('sku')}, '^(?:^[A-Za-z0-9-]+$)')",
            q("sku does not match required pattern")),
    ]
    return f"""WITH raw AS ({PRODUCTS_SQL}),
d AS (SELECT raw.*, u.k IS NOT NULL AS dup, {num('quantity')} AS qn, {num('unit_price')} AS up FROM raw
   LEFT JOIN (SELECT product_id AS k FROM raw WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(*) > 1) u
   ON u.k = {t('raw.product_id')}),
e AS ({' UNION ALL '.join(errs)})"""


PAYMENT_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S"]


def payments_base(unique: bool = True, reference: bool = False) -> str:
    errs = [err(0, 0, "payment_id", "REQUIRED", miss("payment_id"), q("payment_id is required"))]
    if unique:
        errs.append(err(0, 1, "payment_id", "UNIQUE", f"NOT {miss('payment_id')} AND dup", q("payment_id must be unique")))
    errs.append(err(1, 0, "order_id", "REQUIRED", miss("order_id"), q("order_id is required")))
    if reference:
        errs.append(err(1, 1, "order_id", "REFERENCE", f"NOT {miss('order_id')} AND NOT has_parent",
                        q("order_id has no match in orders.order_id")))
    errs += [
        err(2, 0, "payment_mode", "REQUIRED", miss("payment_mode"), q("payment_mode is required")),
        err(2, 1, "payment_mode", "ENUM", f"NOT {miss('payment_mode')} AND {t('payment_mode')} NOT IN {inlist(MODES)}",
            q(f"payment_mode must be one of {MODES}")),
        err(3, 0, "amount", "REQUIRED", miss("amount"), q("amount is required")),
        err(3, 1, "amount", "TYPE", f"NOT {miss('amount')} AND amt IS NULL", q("amount must be a number")),
        err(3, 2, "amount", "RANGE", f"NOT {miss('amount')} AND amt IS NOT NULL AND NOT isnan(amt) AND amt < 0",
            q("amount below minimum 0")),
        err(4, 0, "payment_date", "REQUIRED", miss("payment_date"), q("payment_date is required")),
        err(4, 1, "payment_date", "DATE_FORMAT", f"NOT {miss('payment_date')} AND pd IS NULL",
            f"'Unrecognized date format: ' || {t('payment_date')}"),
        err(4, 2, "payment_date", "FUTURE_DATE", f"NOT {miss('payment_date')} AND pd > {TS}",
            q("Date cannot be in the future")),
        err(5, 0, "transaction_ref", "LENGTH",
            f"NOT {miss('transaction_ref')} AND length({t('transaction_ref')}) > 100", q("transaction_ref too long")),
    ]
    parents = (f"LEFT JOIN (SELECT DISTINCT {t('order_id')} AS pk FROM ({PARENT_ORDERS_SQL})) par "
               f"ON par.pk = {t('raw.order_id')}") if reference else ""
    has_parent = "par.pk IS NOT NULL" if reference else "true"
    return f"""WITH raw AS ({duck_sql(PAYMENTS_SQL, 'event_id')}),
d AS (SELECT raw.*, u.k IS NOT NULL AS dup, {has_parent} AS has_parent, {num('amount')} AS amt,
   {parse('payment_date', PAYMENT_FORMATS)} AS pd FROM raw
   LEFT JOIN (SELECT payment_id AS k FROM raw WHERE payment_id IS NOT NULL GROUP BY payment_id HAVING count(*) > 1) u
   ON u.k = {t('raw.payment_id')} {parents}),
e AS ({' UNION ALL '.join(errs)})"""


ORDER_COLS = ("row_number, src_key, order_id, customer_name, customer_phone, country_code, order_date, "
              "delivery_date, order_amount, currency, status")
REPORT = "SELECT row_number, field_name, error_code, error_message FROM e"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def norm_date(c: str, formats) -> str:
    by_fmt = parse(c, formats, ladder=False)
    free = parse(c, None)
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {t(c)} = '' THEN '' WHEN {by_fmt} IS NOT NULL THEN {iso(by_fmt)} "
            f"WHEN {free} IS NOT NULL THEN {iso(free)} ELSE {c} END")


NORM_PHONE = ("CASE WHEN customer_phone IS NULL THEN NULL WHEN " + t("customer_phone") +
              " = '' THEN '' WHEN p_parsed AND p_valid THEN p_e164 ELSE customer_phone END")


def annotated(where: str = "") -> str:
    return f"""{orders_base()},
agg AS (SELECT row_number AS rn, string_agg(error_message, '; ' ORDER BY ordinal, seq) AS summary FROM e GROUP BY 1)
SELECT {ORDER_COLS}, agg.rn IS NULL AS is_valid, coalesce(agg.summary, '') AS error_summary,
  {NORM_PHONE} AS customer_phone_normalized,
  {norm_date('order_date', ORDER_FORMATS)} AS order_date_normalized,
  {norm_date('delivery_date', ORDER_FORMATS)} AS delivery_date_normalized
FROM d LEFT JOIN agg ON agg.rn = d.row_number {where}"""


def codes(*names) -> str:
    return f"{REPORT} WHERE error_code IN {inlist(names)}"


def stats_sql(base: str, dataset: str) -> str:
    return f"""{base},
per AS (SELECT row_number, count(*) AS n FROM e GROUP BY 1),
tot AS (SELECT count(*) AS total, count(*) FILTER (WHERE per.row_number IS NULL) AS valid FROM d
        LEFT JOIN per ON per.row_number = d.row_number)
SELECT '{dataset}' AS dataset, total AS total_rows, valid AS valid_rows, total - valid AS invalid_rows,
  CASE WHEN total > 0 THEN round_even(100.0 * valid / total, 2) ELSE 0.0 END AS valid_percentage,
  (SELECT count(*) FROM e) AS error_count, CAST(greatest(1, ceil(total / 100000.0)) AS INTEGER) AS output_chunks
FROM tot"""


def by_code_sql(base: str, dataset: str) -> str:
    return f"{base} SELECT '{dataset}' AS dataset, error_code, count(*) AS error_count FROM e GROUP BY error_code"


def layout_sql() -> str:
    return f"""{annotated()}"""


def oracle_sql() -> dict[str, str]:
    dirty_str = ", ".join(f"CAST({c.strip()} AS VARCHAR) AS {c.strip()}" for c in ORDER_COLS.split(","))
    valid_rows = f"""WITH a AS ({annotated()}), v AS (SELECT row_number FROM a WHERE is_valid)"""
    in_files = (f"f AS (SELECT row_number, src_key, part, row_number() OVER (PARTITION BY part ORDER BY src_key) + 1 AS n FROM "
                f"(SELECT row_number, src_key, lpad(CAST(src_key // 5000 AS VARCHAR), 6, '0') AS part FROM ({duck_sql(DIRTY_ORDERS_SQL, 'k')})))")
    files_cte = f"WITH {in_files}"
    jobs = f"({JOBS_SQL})"
    files = f"({FILES_SQL})"
    recent = (f"SELECT user_id, id, status, CAST(created_at AS VARCHAR) AS created_at, rank FROM "
              f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank "
              f"FROM {jobs}) WHERE rank <= ")
    sessions = f"""WITH s AS (SELECT session_id, file_size, greatest(1, ceil(file_size / chunk_size))::BIGINT AS n
   FROM ({SESSIONS_SQL})),
p AS (SELECT p.session_id, p.chunk_index, s.n FROM ({PIECES_SQL}) p JOIN s USING (session_id)),
u AS (SELECT session_id, count(DISTINCT chunk_index) FILTER (WHERE chunk_index >= 0 AND chunk_index < n) AS up,
   count(*) FILTER (WHERE NOT (chunk_index >= 0 AND chunk_index < n)) AS bad FROM p GROUP BY 1),
one AS (SELECT session_id, n, unnest(range(0, n)) AS i FROM s),
gone AS (SELECT session_id, i, i - row_number() OVER (PARTITION BY session_id ORDER BY i) AS island FROM one
   WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.session_id = one.session_id AND p.chunk_index = one.i)),
gaps AS (SELECT session_id, min(i) AS first_missing, max(i) AS last_missing FROM gone GROUP BY session_id, island)
SELECT s.session_id, s.n AS chunk_count, coalesce(up, 0)::BIGINT AS uploaded_count, s.n - coalesce(up, 0) AS missing_count,
  coalesce(up, 0) = s.n AS complete, coalesce(bad, 0)::BIGINT AS invalid_pieces, s.file_size > {10 * 1024 ** 3} AS over_limit,
  first_missing, last_missing
FROM s LEFT JOIN u USING (session_id) LEFT JOIN gaps USING (session_id)"""
    out = {
        "scan_raw": f"SELECT {dirty_str} FROM ({duck_sql(DIRTY_ORDERS_SQL, 'k')})",
        "coerce_inferred": (f"SELECT row_number, src_order, src_line, product_id, order_id, product_name, quantity, "
                            f"TRY_CAST(unit_price AS DOUBLE) AS unit_price, sku FROM ({PRODUCTS_SQL})"),
        "row_numbering": "SELECT o_orderkey, o_orderkey + 2 AS row_number FROM orders",
        "annotate_rows": annotated(),
        "valid_only": annotated("WHERE agg.rn IS NULL"),
        "missing_column": (orders_base(drop=("status",)) + " " + REPORT + " WHERE field_name = 'status'"),
        "check_required": f"{orders_base()} {codes('REQUIRED')}",
        "check_regex": f"{orders_base()} {codes('REGEX')}",
        "check_length": f"{orders_base()} {codes('LENGTH')}",
        "check_enum": f"{orders_base()} {codes('ENUM')}",
        "check_float": f"{orders_base()} {codes('TYPE', 'RANGE')}",
        "check_integer": f"{products_base()} {REPORT} WHERE field_name = 'quantity' AND error_code IN ('TYPE', 'RANGE')",
        "check_date_format": f"{orders_base()} {codes('DATE_FORMAT')}",
        "check_not_future": f"{orders_base()} {REPORT} WHERE error_code = 'FUTURE_DATE' AND ordinal = 4",
        "check_date_order": f"{orders_base()} {codes('DATE_ORDER')}",
        "check_date_order_month_first": f"{orders_base('month_first')} {codes('DATE_ORDER')}",
        "check_future_tolerance": f"{orders_base()} {REPORT} WHERE error_code = 'FUTURE_DATE' AND ordinal = 10",
        "check_phone": f"{orders_base()} {codes('PHONE_PARSE', 'PHONE_POSSIBLE', 'PHONE_INVALID')}",
        "check_phone_length": f"{orders_base()} {codes('PHONE_LENGTH')}",
        "check_phone_plan": f"""WITH plan AS {world_plan_sql()},
code AS (SELECT calling_code, string_agg(lengths, ',') AS lengths, string_agg(pattern, '|') AS pattern FROM plan GROUP BY calling_code),
x AS ({WORLD_PHONES_SQL.format(row='k + 2', rowsrc='', plan='plan')}),
a AS (SELECT x.*, own.*, regexp_replace(regexp_extract(phone, '[+0-9].*', 0), '[^0-9]+$', '') AS body
  FROM x LEFT JOIN plan own ON own.region = substr(upper(country), 1, 2)),
b AS (SELECT *, regexp_replace(body, '[^0-9]', '', 'g') AS digits FROM a),
c AS (SELECT *, CASE WHEN starts_with(body, '+') THEN digits WHEN starts_with(digits, idd) THEN substr(digits, length(idd) + 1) END AS intl FROM b),
d AS (SELECT c.*, (SELECT max_by(q.calling_code, length(q.calling_code)) FROM code q WHERE starts_with(c.intl, q.calling_code)) AS cc FROM c),
e AS (SELECT *, CASE WHEN intl IS NOT NULL THEN substr(intl, length(cc) + 1)
    WHEN trunk IS NOT NULL AND starts_with(digits, trunk) AND list_contains(string_split(lengths, ','), CAST(length(digits) - length(trunk) AS VARCHAR))
      THEN substr(digits, length(trunk) + 1) ELSE digits END AS nat, CASE WHEN intl IS NOT NULL THEN cc ELSE calling_code END AS num FROM d),
f AS (SELECT e.row_number, e.country, e.phone, nat, num,
    coalesce(length(digits) >= 2 AND regexp_full_match(body, '\\+?[0-9 \\t\\-.()/\\[\\]~]*') AND num IS NOT NULL AND length(nat) BETWEEN 2 AND 17, false) AS parsed,
    coalesce(list_contains(string_split(code.lengths, ','), CAST(length(nat) AS VARCHAR)), false) AS possible,
    coalesce(regexp_full_match(nat, code.pattern), false) AS valid
  FROM e LEFT JOIN code ON code.calling_code = e.num)
SELECT row_number, country, phone, CASE WHEN parsed AND valid THEN '+' || num || nat ELSE phone END AS phone_normalized,
  CASE WHEN NOT parsed THEN 'Cannot parse phone number for region ' || substr(upper(country), 1, 2)
       ELSE concat_ws('; ', CASE WHEN NOT possible THEN 'Phone number length/format is not possible' END,
                      CASE WHEN NOT valid THEN 'Phone number is not valid for the region' END) END AS error_summary
FROM f""",
        "phone_region": f"WITH x AS ({duck_sql(DIRTY_ORDERS_SQL, 'k')}) SELECT row_number, country_code, {ORDERS_REGION} AS region FROM x",
        "normalize_phones": (f"WITH x AS ({annotated()}) SELECT row_number, customer_phone, "
                             f"customer_phone_normalized FROM x"),
        "normalize_dates": (f"WITH x AS ({annotated()}) SELECT row_number, order_date, order_date_normalized, "
                            f"delivery_date, delivery_date_normalized FROM x"),
        "normalize_date_shapes": (
            f"SELECT row_number, event_date, k % 14 NOT IN (10, 11) AS is_valid, CASE k % 14 "
            f"WHEN 0 THEN y || '-' || m || '-' || d || 'T' || hh || ':' || mi || ':00' WHEN 1 THEN y || '-' || m || '-' || d || 'T00:00:00' "
            f"WHEN 2 THEN y || '-' || m || '-' || d || 'T' || hh || ':' || mi || ':' || ss || '+00:00' "
            f"WHEN 3 THEN y || '-' || m || '-' || d || 'T' || hh || ':' || mi || ':' || ss || '.123456' "
            f"WHEN 5 THEN y || '-' || m || '-' || d || 'T' || hh || ':' || mi || ':' || ss || '+05:30' "
            f"WHEN 7 THEN y || '-' || m || '-' || d || 'T' || hh || ':' || mi || ':00' WHEN 8 THEN y || '-' || m || '-' || d || 'T00:00:00' "
            f"WHEN 9 THEN CASE WHEN d > '12' THEN y || '-' || m || '-' || d ELSE y || '-' || d || '-' || m END || 'T00:00:00' "
            f"WHEN 10 THEN event_date WHEN 11 THEN event_date WHEN 12 THEN y || '-' || m || '-' || d || 'T' || hh || ':' || mi || ':00' "
            f"WHEN 13 THEN y || '-' || m || '-' || d || 'T00:00:00' "
            f"ELSE y || '-' || m || '-' || d || 'T' || hh || ':' || mi || ':' || ss END AS event_date_normalized "
            f"FROM ({duck_sql(DATE_SHAPES_SQL, 'k')})"),
        "check_date_order_offsets": (
            f"SELECT row_number, 'sent' AS field_name, 'DATE_ORDER' AS error_code, 'sent must be before received' AS error_message "
            f"FROM ({duck_sql(OFFSET_DATES_SQL, 'k')}) WHERE (row_number - 2) % 5 IN (1, 3, 4)"),
        "check_unique": f"{orders_base()} {codes('UNIQUE')}",
        "check_unique_products": f"{products_base()} {codes('UNIQUE')}",
        "check_reference": f"{payments_base(reference=True)} {codes('REFERENCE')}",
        "error_report": f"{orders_base()} {REPORT}",
        "error_report_products": f"{products_base()} {REPORT}",
        "error_report_payments": f"{payments_base()} {REPORT}",
        "errors_by_code": (f"SELECT * FROM ({by_code_sql(orders_base(), 'orders')}) UNION ALL "
                           f"SELECT * FROM ({by_code_sql(products_base(), 'products')}) UNION ALL "
                           f"SELECT * FROM ({by_code_sql(payments_base(), 'payments')})"),
        "run_stats": (f"SELECT * FROM ({stats_sql(orders_base(), 'orders')}) UNION ALL "
                      f"SELECT * FROM ({stats_sql(products_base(), 'products')}) UNION ALL "
                      f"SELECT * FROM ({stats_sql(payments_base(), 'payments')})"),
        "chunked_output": (f"{valid_rows} SELECT row_number, row_number() OVER (ORDER BY row_number) AS out_pos, "
                           f"CAST((row_number() OVER (ORDER BY row_number) - 1) // 1000 AS INTEGER) AS chunk_index FROM v"),
        "output_manifest": (f"{valid_rows}, c AS (SELECT CAST((row_number() OVER (ORDER BY row_number) - 1) // 1000 AS INTEGER) AS ci FROM v) "
                            f"SELECT 'cleaned_chunk' AS file_type, 'cleaned_part_' || lpad(CAST(ci AS VARCHAR), 4, '0') || '.csv' AS filename, "
                            f"'cleaned/chunk_index=' || ci || '/*.csv' AS storage_key, true AS written, "
                            f"ci AS chunk_index, CAST(count(*) AS INTEGER) AS row_count, true AS is_valid_only FROM c GROUP BY ci "
                            f"UNION ALL SELECT 'errors', 'errors.csv', 'errors', true, NULL, CAST(count(*) AS INTEGER), false "
                            f"FROM ({orders_base()} SELECT * FROM e)"),
        "row_numbering_multi_file": f"{files_cte} SELECT part, src_key, n AS row_number FROM f",
        "chunked_output_multi_file": (
            f"{orders_base()}, bad AS (SELECT DISTINCT row_number FROM e WHERE error_code <> 'UNIQUE'), {in_files}, "
            f"v AS (SELECT part, n, row_number() OVER (ORDER BY part, n) AS out_pos FROM f WHERE row_number NOT IN (SELECT row_number FROM bad)) "
            f"SELECT part, n AS row_number, out_pos, CAST((out_pos - 1) // 1000 AS INTEGER) AS chunk_index FROM v"),
        "error_report_multi_file": (
            f"{orders_base()}, {in_files} SELECT row_number() OVER (ORDER BY part, ordinal, n, seq) AS position, part, n AS row_number, "
            f"field_name, error_code, error_message FROM e JOIN f USING (row_number)"),
        "file_lookup": (f"SELECT r.file_id, r.user_id, f.file_type, f.filename, f.file_size, f.chunk_index, f.row_count, "
                        f"f.is_valid_only FROM ({REQUESTS_SQL}) r JOIN {files} f ON r.file_id = f.id "
                        f"JOIN {jobs} j ON f.validation_job_id = j.id AND j.user_id = r.user_id"),
        "job_with_files": (f"SELECT j.id AS job_id, j.user_id, j.status, f.id AS file_id, f.filename, f.chunk_index, "
                           f"f.row_count FROM {jobs} j LEFT JOIN {files} f ON f.validation_job_id = j.id"),
        "recent_jobs": recent + "50",
        "recent_jobs_dashboard": recent + "5",
        "job_status_counts": (f"SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, "
                              f"count(*) FILTER (WHERE status IN ('RUNNING', 'PENDING')) AS running, "
                              f"count(*) FILTER (WHERE status = 'FAILED') AS failed FROM {jobs} GROUP BY user_id"),
        "missing_chunks": sessions,
        "merge_chunks": (f"WITH p AS (SELECT DISTINCT session_id, chunk_index::BIGINT AS i FROM ({PIECES_SQL})), "
                         f"g AS (SELECT *, i - row_number() OVER (PARTITION BY session_id ORDER BY i) AS island FROM p) "
                         f"SELECT session_id, min(i) AS first_piece, max(i) AS last_piece FROM g GROUP BY session_id, island"),
        "stream_validate": (f"{payments_base(unique=False)}, agg AS (SELECT row_number AS rn, string_agg(error_message, '; ' "
                            f"ORDER BY ordinal, seq) AS summary FROM e GROUP BY 1) SELECT row_number, agg.rn IS NULL AS is_valid, "
                            f"coalesce(agg.summary, '') AS error_summary FROM d LEFT JOIN agg ON agg.rn = d.row_number"),
        "stream_error_rate": (f"{payments_base(unique=False)}, w AS (SELECT row_number, date_trunc('day', ev.ts) AS ws FROM d "
                              f"JOIN events ev ON ev.event_id + 2 = d.row_number), "
                              f"rows_per AS (SELECT ws, count(*) AS n FROM w GROUP BY ws), "
                              f"errs AS (SELECT w.ws, e.error_code, count(*) AS c FROM e JOIN w USING (row_number) GROUP BY 1, 2) "
                              f"SELECT CAST(ws AS VARCHAR) AS window_start, rows_per.n AS rows, error_code, c AS error_count "
                              f"FROM errs JOIN rows_per USING (ws)"),
        "stream_unique": (f"WITH x AS ({duck_sql(DIRTY_ORDERS_SQL, 'k')}), y AS (SELECT row_number, {t('order_id')} AS key "
                          f"FROM x WHERE order_id IS NOT NULL AND {t('order_id')} <> '') SELECT row_number, key, "
                          f"row_number() OVER (PARTITION BY key ORDER BY row_number) > 1 AS duplicate FROM y"),
        "stream_unique_window": (
            f"WITH x AS ({DIRTY_ORDERS_SQL.format(row='o_orderdate AS od, k + 2', rowsrc=', o_orderdate')}), y AS (SELECT row_number, od, {t('order_id')} AS key "
            f"FROM x WHERE order_id IS NOT NULL AND {t('order_id')} <> '') SELECT row_number, key, coalesce(od - lag(od) OVER "
            f"(PARTITION BY key ORDER BY od, row_number) <= INTERVAL 365 DAY, false) AS duplicate FROM y"),
    }
    return out
