"""Token ids as ORC files.

Documents are range-partitioned and sorted by id, encoded, closed with an end id and
written by Spark's ORC writer: integer run-length encoding of the ids, stripes of a given
size with row indexes, and Bloom filters on ``doc_id``. Readers take stripes in parallel;
a filter on ``doc_id`` skips files, stripes and row groups by their minima, maxima and
Bloom filters (Spark pushes it down).

Defined cases: null text is empty and stores the end id alone; repeated ids are stored as
often as they occur, next to each other; a null doc_id sorts first; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabvet.llm.bpe import default_path, encoder, groups
from tabvet.llm.common import cut, frugal, list_array, texts_of

END_ID = 0
STRIPE_BYTES = 64 << 20


def write_tokens(df: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *,
                 end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Write (doc_id, ids) of every row to ORC files under ``out``, in ascending doc_id order
    from file to file and inside each."""
    path = path or default_path()

    def run(batches):
        enc = encoder(path)
        for ids, texts in groups(batches):
            flat, at = enc.encode_many(texts)
            closed = np.insert(flat, at[1:], end_id).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(closed, np.diff(at) + 1, pa.int32())], names=["doc_id", "ids"])

    docs = texts_of(df, id_col, text_col).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    (docs.mapInArrow(frugal(run), "doc_id long, ids array<int>").write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(out))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, ids) from the files; filters on doc_id prune stripes."""
    return spark.read.schema("doc_id long, ids array<int>").orc(out)


def token_index(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files: ``start`` counts the ids
    of all documents before, from per-file totals and a running sum inside each file."""
    def run(batches):
        for batch in batches:
            ids = batch.column(2)
            flat, at = ids.flatten().to_numpy().astype("<u4", copy=False), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["file", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, out).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids")
    rows = cut(rows.mapInArrow(frugal(run), "file string, doc_id long, n_tokens long, ids_crc32 long"), "index")
    files = rows.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
