"""WARC files and their Merkle fixity audit.

``write_warc`` writes pages as WARC/1.1 resource records, ``index`` reads files into one row
per record (file, place, offset, length, SHA-256), ``audit`` compares two replicas: record
hashes are the leaves, each node hashes an ordered range of ``FAN`` children, and only the
children of nodes that differ are compared on the next level down.

Defined cases: null text or URL is empty; line ends in a URL become %0D and %0A; repeated
page ids are records of their own; a null id is written as an empty one and read as null;
bytes that are no whole record form one record without an id up to the next record's
start; a file or record that only one replica has differs; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import cut

FAN = 16
RECORDS_PER_FILE = 1000
_END = b"\r\n\r\n"
_START = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n\r\n")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+)>\r\n")


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The record as text, without the two line ends behind it."""
    html = F.coalesce(html.cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html)


def write_warc(df: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", *, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write every row as a record; the two line ends behind a record are the writer's row separator."""
    rows = df.select(record(F.col(id_col), F.col(url_col), F.col(text_col)).alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(out)


def records(data: bytes):
    """(offset, record bytes) in order; a damaged stretch is one record."""
    at = 0
    while at < len(data):
        end = -1
        if data.startswith(_START, at) and (m := _LENGTH.search(data, at)):
            end = m.end() + int(m[1])
            if data[end:end + 4] != _END:
                end = -1
        if end < 0:
            end = data.find(_END + _START, at + 1)
            end = len(data) - 4 if end < 0 else end
        yield at, data[at:end]
        at = max(end, at) + 4


def index(spark: SparkSession, out: str, damage=None) -> DataFrame:
    """(file, i, offset, length, page_id, sha) of every record; ``damage(page_id, bytes)``
    stands for a faulty replica. A file is one task's work, bounded by ``records_per_file``."""
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for i, (offset, raw) in enumerate(records(data.as_buffer().to_pybytes())):
                    m = _ID.search(raw, 0, 4096)
                    page = int(m[1]) if m else None
                    raw = damage(page, raw) if damage else raw
                    rows.append((path, i, offset, len(raw), page, hashlib.sha256(raw).hexdigest()))
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    names = ["file", "i", "offset", "length", "page_id", "sha"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, i long, offset long, length long, page_id long, sha string")


def tree(leaves: DataFrame, depth: int, fan: int = FAN) -> list[DataFrame]:
    """Levels (file, i, sha) from the leaves to one node per file."""
    levels = [leaves.select("file", "i", "sha")]
    for _ in range(depth):
        below = levels[-1]
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "sha"))), lambda x: x["sha"])
        levels.append(below.groupBy("file", F.floor(F.col("i") / fan).cast("long").alias("i")).agg(F.sha2(F.concat_ws("", ordered), 256).alias("sha")))
    return levels


def audit(a: DataFrame, b: DataFrame, fan: int = FAN) -> DataFrame:
    """(file, i) of the records in which two stored indexes differ."""
    most = max((d.agg(F.max("i").alias("m")).first()["m"] or 0) for d in (a, b)) + 1
    depth = 0
    while fan ** depth < most:
        depth += 1
    left, right = tree(a, depth, fan), tree(b, depth, fan)
    bad = None
    for level in range(depth, -1, -1):
        x, y = left[level], right[level]
        if bad is not None:
            up = bad.withColumnRenamed("i", "up")
            x, y = (d.withColumn("up", F.floor(F.col("i") / fan).cast("long")).join(up, ["file", "up"], "left_semi").drop("up") for d in (x, y))
        y = y.withColumnRenamed("sha", "other")
        bad = cut(x.join(y, ["file", "i"], "full").where(~F.col("sha").eqNullSafe(F.col("other"))).select("file", "i"), f"level{level}")
    return bad


def fixity(spark: SparkSession, out: str, replica_damage=None, fan: int = FAN) -> DataFrame:
    """Every record of the files with ``damaged``: whether its replica differs."""
    a, b = cut(index(spark, out), "index"), cut(index(spark, out, replica_damage), "replica")
    bad = audit(a, b, fan).withColumn("damaged", F.lit(True))
    return a.join(bad, ["file", "i"], "left").withColumn("damaged", F.coalesce("damaged", F.lit(False)))
