"""Test inputs derived from the driver's tables (``/root/testdata/sf*/``).

The three "dirty" projections plant known defects into orders, line items and events.
Their SQL runs unchanged in Spark SQL and DuckDB; only the row-identity expression
differs: Spark reads the parquet row index, DuckDB restates it from the key (the
orders and events files are stored in key order, starting at 0).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-01 00:00:00"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DIRTY_ORDERS_SQL = """
SELECT {row} AS row_number, k AS src_key,
  CASE WHEN k % 97 = 0 THEN '' WHEN k % 89 = 0 THEN concat('ORD ', cast(k AS string))
       WHEN k % 83 = 1 THEN concat('ORD-', cast(k - 1 AS string))
       WHEN k % 101 = 0 THEN concat(' ORD-', cast(k AS string))
       ELSE concat('ORD-', cast(k AS string)) END AS order_id,
  CASE WHEN k % 71 = 0 THEN NULL WHEN k % 73 = 0 THEN repeat('x', 201) ELSE concat('Customer#', cast(c AS string)) END AS customer_name,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 59 = 0 THEN '123' WHEN k % 53 = 0 THEN 'n/a'
       WHEN c % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN concat('+1415555', lpad(cast(k % 10000 AS string), 4, '0')) ELSE concat('(415) 555-', lpad(cast(k % 10000 AS string), 4, '0')) END
       WHEN c % 5 = 1 THEN concat('98765', lpad(cast(k % 100000 AS string), 5, '0'))
       WHEN c % 5 = 2 THEN concat('9123', lpad(cast(k % 10000 AS string), 4, '0'))
       WHEN c % 5 = 3 THEN concat('+44 20 7123 ', lpad(cast(k % 10000 AS string), 4, '0'))
       ELSE concat('4', lpad(cast(k % 100000000 AS string), 8, '0')) END AS customer_phone,
  CASE WHEN k % 47 = 0 THEN 'usa' WHEN c % 5 = 0 THEN 'US' WHEN c % 5 = 1 THEN 'IN' WHEN c % 5 = 2 THEN 'SG' WHEN c % 5 = 3 THEN 'GB' ELSE 'AU' END AS country_code,
  CASE WHEN k % 43 = 0 THEN 'not a date' WHEN k % 41 = 0 THEN '2030-01-01' WHEN k % 37 = 0 THEN NULL
       WHEN k % 3 = 0 THEN concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4))
       WHEN k % 3 = 1 THEN concat(d, ' 10:30:00') ELSE d END AS order_date,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 31 = 0 THEN '1994-12-31' ELSE cast(date_add(cast(d AS date), 5) AS string) END AS delivery_date,
  CASE WHEN k % 29 = 0 THEN concat('-', cast(p AS string)) WHEN k % 23 = 0 THEN 'abc' WHEN k % 19 = 0 THEN '  ' ELSE cast(p AS string) END AS order_amount,
  CASE WHEN k % 17 = 0 THEN 'XXX' WHEN c % 5 = 0 THEN 'USD' WHEN c % 5 = 1 THEN 'INR' WHEN c % 5 = 2 THEN 'SGD' WHEN c % 5 = 3 THEN 'GBP' ELSE 'AUD' END AS currency,
  CASE WHEN k % 13 = 0 THEN 'SHIPPED' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'confirmed' END AS status
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, cast(cast(o_orderdate AS date) AS string) AS d, o_orderstatus{rowsrc} FROM orders) t
"""

# Order dates in the shapes that people and programs write; each expected ISO text is known from the parts.
# Runs in both engines: {row} as above.
DATE_SHAPES_SQL = """
SELECT row_number, k, y, m, d, hh, mi, ss,
  CASE k % 14
    WHEN 0 THEN concat(mon, ' ', d, ', ', y, ' ', h12, ':', mi, ' ', half)
    WHEN 1 THEN concat(d, ' ', mon, ' ', substr(y, 3, 2))
    WHEN 2 THEN concat('Fri, ', d, ' ', mon, ' ', y, ' ', hh, ':', mi, ':', ss, ' GMT')
    WHEN 3 THEN concat(y, '-', m, '-', d, 'T', hh, ':', mi, ':', ss, '.123456789')
    WHEN 4 THEN concat(y, m, d, 'T', hh, mi, ss)
    WHEN 5 THEN concat(y, '-', m, '-', d, ' ', hh, ':', mi, ':', ss, '+0530')
    WHEN 6 THEN concat('Mon ', mon, ' ', d, ' ', hh, ':', mi, ':', ss, ' ', y)
    WHEN 7 THEN concat(m, '/', d, '/', substr(y, 3, 2), ' ', h12, ':', mi, lower(half))
    WHEN 8 THEN concat('Wednesday, ', upper(mon), '. ', d, 'th, ', y)
    WHEN 9 THEN concat(d, '.', m, '.', y)
    WHEN 10 THEN concat(mon, ' ', y)
    WHEN 11 THEN concat(y, '/', m, '/', d, ' 13:', mi, ' PM')
    WHEN 12 THEN concat(d, '-', mon, '-', y, ' ', hh, ':', mi)
    ELSE concat(y, ' ', mon, ' ', d) END AS event_date
FROM (SELECT {row} AS row_number, k, substr(dt, 1, 4) AS y, substr(dt, 6, 2) AS m, substr(dt, 9, 2) AS d,
    substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast(substr(dt, 6, 2) AS int) - 2, 3) AS mon,
    lpad(cast(k % 24 AS string), 2, '0') AS hh, lpad(cast(k % 60 AS string), 2, '0') AS mi, lpad(cast(k * 7 % 60 AS string), 2, '0') AS ss,
    cast((k + 11) % 12 + 1 AS string) AS h12, CASE WHEN k % 24 < 12 THEN 'AM' ELSE 'PM' END AS half
  FROM (SELECT o_orderkey AS k, cast(cast(o_orderdate AS date) AS string) AS dt{rowsrc} FROM orders) t) t
"""

# Pairs of times with offsets: equal instants, later ones, pairs that can't be compared, and local pairs.
OFFSET_DATES_SQL = """
SELECT {row} AS row_number,
  CASE k % 5 WHEN 0 THEN concat(dt, 'T10:00:00+05:30') WHEN 1 THEN concat(dt, 'T10:00:00-08:00') WHEN 2 THEN concat(dt, 'T10:00:00')
             WHEN 3 THEN concat(dt, ' 10:00:01') ELSE concat(dt, 'T23:30:00-01:00') END AS sent,
  CASE k % 5 WHEN 0 THEN concat(dt, 'T04:30:00Z') WHEN 1 THEN concat(dt, 'T17:00:00Z') WHEN 2 THEN concat(dt, 'T09:00:00Z')
             WHEN 3 THEN concat(dt, ' 10:00:00') ELSE concat(dt, ' 23:59:59 UTC') END AS received
FROM (SELECT o_orderkey AS k, cast(cast(o_orderdate AS date) AS string) AS dt{rowsrc} FROM orders) t
"""

PRODUCTS_SQL = """
SELECT l_orderkey * 8 + l_linenumber AS row_number, l_orderkey AS src_order, l_linenumber AS src_line,
  concat('P-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS product_id,
  CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE concat('ORD-', cast(l_orderkey AS string)) END AS order_id,
  p_name AS product_name,
  CASE WHEN l_orderkey % 29 = 0 THEN '0' WHEN l_orderkey % 23 = 0 THEN '10001' WHEN l_orderkey % 19 = 0 THEN 'many'
       WHEN l_orderkey % 17 = 0 THEN concat(cast(cast(l_quantity AS int) AS string), '.7') ELSE cast(cast(l_quantity AS int) AS string) END AS quantity,
  cast(p_retailprice AS string) AS unit_price,
  CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN p_brand ELSE concat('SKU-', cast(l_partkey AS string)) END AS sku
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

PAYMENTS_SQL = """
SELECT {row} AS row_number, concat('PAY-', cast(event_id AS string)) AS payment_id,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('ORD-', cast(event_id * 2 AS string)) END AS order_id,
  CASE WHEN event_id % 11 = 0 THEN 'cheque' WHEN event_id % 3 = 0 THEN 'credit_card' WHEN event_id % 3 = 1 THEN 'upi' ELSE 'cash' END AS payment_mode,
  CASE WHEN event_id % 17 = 0 THEN concat('-', cast(value AS string)) ELSE cast(value AS string) END AS amount,
  CASE WHEN event_id % 7 = 0 THEN substr(cast(date_trunc('second', ts) AS string), 1, 10) ELSE cast(date_trunc('second', ts) AS string) END AS payment_date,
  CASE WHEN event_id % 19 = 0 THEN repeat('r', 101) ELSE props END AS transaction_ref
FROM events
"""

PARENT_ORDERS_SQL = "SELECT concat('ORD-', cast(o_orderkey AS string)) AS order_id FROM orders"


def spark_sql(template: str) -> str:
    return template.format(row="_row_index + 2", rowsrc=", _row_index")


def duck_sql(template: str, key: str) -> str:
    return template.format(row=f"{key} + 2", rowsrc="")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


SPLIT_BYTES = 4 << 20  # Parquet bytes of a driver table (about 230,000 rows) that one task works on


def splits(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks to deal a driver table's rows over: its files are few splits. At least the cores, and more for a larger table,
    so that a task's rows don't grow with the table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // SPLIT_BYTES))


def register_sources(spark: SparkSession, sf_dir: str, names=("orders", "lineitem", "part", "events"),
                     rebalance: bool = False) -> None:
    """Temp views of the driver tables; file position exposed as ``_row_index``.

    ``rebalance`` deals the stored rows over ``splits`` tasks, so that the text made of them is made in these and isn't shuffled."""
    from tabvet.sources.readers import balanced

    for name in names:
        df = read_table(spark, sf_dir, name).withColumn("_row_index", F.col("_metadata.row_index"))
        balanced(df, splits(spark, sf_dir, name) if rebalance else None).createOrReplaceTempView(name)


def dirty_orders(spark: SparkSession, sf_dir: str, rebalance: bool = False) -> DataFrame:
    register_sources(spark, sf_dir, ("orders",), rebalance)
    return spark.sql(spark_sql(DIRTY_ORDERS_SQL))


# An approximate numbering plan of 25 regions (public regulator data): region, calling code, international and trunk
# prefix, national lengths, pattern of national numbers. Row k belongs to nation k.
WORLD_PLAN = [
    ("DZ", "213", "00", "0", (8, 9), "[5-7][0-9]{8}|[1-4][0-9]{7}"), ("AR", "54", "00", "0", (10, 11), "9?[1-3][0-9]{9}"),
    ("BR", "55", "00", "0", (10, 11), "[1-9]{2}9[0-9]{8}|[1-9]{2}[2-5][0-9]{7}"), ("CA", "1", "011", "1", (10,), "(?:204|416|514|604)[2-9][0-9]{6}"),
    ("EG", "20", "00", "0", (8, 9, 10), "1[0-9]{9}|[2-9][0-9]{7,8}"), ("ET", "251", "00", "0", (9,), "[1-59][0-9]{8}"),
    ("FR", "33", "00", "0", (9,), "[1-9][0-9]{8}"), ("DE", "49", "00", "0", (7, 8, 9, 10, 11), "[2-9][0-9]{6,10}|1[5-7][0-9]{8,9}"),
    ("IN", "91", "00", "0", (10,), "[1-9][0-9]{9}"), ("ID", "62", "001", "0", (9, 10, 11), "8[0-9]{8,10}|[2-7][0-9]{8}"),
    ("IR", "98", "00", "0", (10,), "[1-9][0-9]{9}"), ("IQ", "964", "00", "0", (8, 9, 10), "7[0-9]{9}|[1-6][0-9]{7,8}"),
    ("JP", "81", "010", "0", (9, 10), "[789]0[0-9]{8}|[1-9][0-9]{8}"), ("JO", "962", "00", "0", (8, 9), "7[0-9]{8}|[2-6][0-9]{7}"),
    ("KE", "254", "000", "0", (9,), "[17][0-9]{8}|[2-6][0-9]{8}"), ("MA", "212", "00", "0", (9,), "[5-8][0-9]{8}"),
    ("MZ", "258", "00", None, (8, 9), "8[2-7][0-9]{7}|2[0-9]{7}"), ("PE", "51", "00", "0", (8, 9), "9[0-9]{8}|[14-8][0-9]{7}"),
    ("CN", "86", "00", "0", (10, 11), "1[3-9][0-9]{9}|[2-9][0-9]{9}"), ("RO", "40", "00", "0", (9,), "[237][0-9]{8}"),
    ("SA", "966", "00", "0", (8, 9), "5[0-9]{8}|1[0-9]{7,8}"), ("VN", "84", "00", "0", (9, 10), "[35789][0-9]{8}|2[0-9]{9}"),
    ("RU", "7", "810", "8", (10,), "[3489][0-9]{9}"), ("GB", "44", "00", "0", (9, 10), "[1-35789][0-9]{8,9}"), ("US", "1", "011", "1", (10,), "[2-9][0-9]{2}[2-9][0-9]{6}"),
]


def world_plan_sql() -> str:
    """The plan as a table, in the SQL of both engines."""
    text = lambda v: "NULL" if v is None else f"'{v}'"
    rows = " UNION ALL ".join(f"SELECT {k} AS nation, '{r}' AS region, '{c}' AS calling_code, {text(i)} AS idd, {text(t)} AS trunk, "
                              f"'{','.join(map(str, n))}' AS lengths, '{p}' AS pattern" for k, (r, c, i, t, n, p) in enumerate(WORLD_PLAN))
    return f"({rows})"


# Numbers of many countries as customers of 25 nations write them, dialled from their own or a neighbour's region.
WORLD_PHONES_SQL = f"""
SELECT {{row}} AS row_number, concat(lower(substr(home.region, 1, 1)), substr(home.region, 2, 1), '-x') AS country,
  CASE k % 9 WHEN 0 THEN concat('+', p.calling_code, ' ', nat) WHEN 1 THEN concat(home.idd, ' ', p.calling_code, nat) WHEN 2 THEN concat(coalesce(home.trunk, ''), nat)
             WHEN 3 THEN nat WHEN 4 THEN concat('+', p.calling_code, '-', substr(nat, 1, 5)) WHEN 5 THEN concat('(0) ', nat, ' ext 5')
             WHEN 6 THEN concat('+999', nat) WHEN 7 THEN concat('tel: +', p.calling_code, '.', nat) ELSE concat('+', p.calling_code, '0', nat) END AS phone
FROM (SELECT o_orderkey AS k, c_nationkey AS n, (c_nationkey + o_orderkey % 3) % 25 AS far,
        substr(concat(cast(o_orderkey % 7 + 2 AS string), lpad(cast(o_orderkey * 7919 % 10000000000 AS string), 11, '3')), 1, cast(8 + o_orderkey % 4 AS int)) AS nat{{rowsrc}}
      FROM orders JOIN customer ON o_custkey = c_custkey) t
JOIN {{plan}} home ON home.nation = n JOIN {{plan}} p ON p.nation = far
"""


def world_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sources(spark, sf_dir, ("orders", "customer"), rebalance=True)
    return spark.sql(WORLD_PHONES_SQL.format(row="o_row + 2", rowsrc=", orders._row_index AS o_row", plan=world_plan_sql()))


def order_dates(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register_sources(spark, sf_dir, ("orders",), rebalance=True)
    return spark.sql(spark_sql(sql))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sources(spark, sf_dir, ("lineitem", "part"))
    return spark.sql(PRODUCTS_SQL)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sources(spark, sf_dir, ("events",))
    return spark.sql(spark_sql(PAYMENTS_SQL))


def parent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sources(spark, sf_dir, ("orders",))
    return spark.sql(PARENT_ORDERS_SQL)


# Ledger tables derived from the driver tables: orders as validation jobs, line items as
# output files (same one-to-many shape), orders as upload sessions and line items as
# the pieces reported for them.
JOBS_SQL = """
SELECT concat('job-', cast(o_orderkey AS string)) AS id,
  concat('user-', cast(o_custkey AS string)) AS user_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'products' ELSE 'payments' END AS dataset_type,
  CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderstatus = 'P' THEN 'FAILED'
       WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'PENDING' END AS status,
  o_orderdate AS created_at
FROM orders
"""

FILES_SQL = """
SELECT concat('file-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string)) AS id,
  concat('job-', cast(l_orderkey AS string)) AS validation_job_id,
  CASE WHEN l_returnflag = 'R' THEN 'errors' ELSE 'cleaned_chunk' END AS file_type,
  concat('cleaned_part_', lpad(cast(l_linenumber - 1 AS string), 4, '0'), '.csv') AS filename,
  cast(floor(l_extendedprice * 100) AS bigint) AS file_size,
  l_linenumber - 1 AS chunk_index,
  cast(l_quantity AS int) AS row_count,
  l_linestatus = 'F' AS is_valid_only
FROM lineitem
"""

REQUESTS_SQL = """
SELECT concat('file-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string)) AS file_id,
  concat('user-', cast(CASE WHEN l_partkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS string)) AS user_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

SESSIONS_SQL = """
SELECT concat('upload-', cast(o_orderkey AS string)) AS session_id,
  cast(floor(o_totalprice * 100) AS bigint) AS file_size, 5242880 AS chunk_size
FROM orders
"""

PIECES_SQL = """
SELECT concat('upload-', cast(l_orderkey AS string)) AS session_id, l_linenumber - 1 AS chunk_index, l_linestatus
FROM lineitem
"""


def ledger(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register_sources(spark, sf_dir, ("orders", "lineitem"), rebalance=True)
    return spark.sql(sql)
