"""Row numbers as the reference reports them: 1-based record position + 1 for the header.

Parquet exposes the position in the file as ``_metadata.row_index``. CSV does not, so
a two-pass plan numbers rows without a single-partition window:

* tag every row with its file, the start of its file block and
  ``monotonically_increasing_id`` (consecutive inside one input split);
* count rows and take the smallest id per (file, block): one row per block;
* a running sum of block counts per file gives each block's first row;
* join that block table back (AQE broadcasts it when it is small).

The split layout is deterministic, so a re-executed task re-creates the same ids.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_parquet_row_numbers(df: DataFrame, name: str = "row_number") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.row_index") + F.lit(2))


def with_block_row_numbers(df: DataFrame, name: str = "row_number") -> DataFrame:
    tagged = (df.withColumn("_fp", F.col("_metadata.file_path"))
              .withColumn("_fb", F.col("_metadata.file_block_start"))
              .withColumn("_mid", F.monotonically_increasing_id()))
    blocks = tagged.groupBy("_fp", "_fb").agg(F.count(F.lit(1)).alias("_bn"), F.min("_mid").alias("_bmin"))
    before = Window.partitionBy("_fp").orderBy("_fb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    out = tagged.join(blocks.select("_fp", "_fb", "_bmin", "_base"), ["_fp", "_fb"])
    return out.withColumn(name, F.col("_mid") - F.col("_bmin") + F.col("_base") + F.lit(2)).drop(
        "_fp", "_fb", "_mid", "_bmin", "_base")


def with_row_numbers(df: DataFrame, name: str = "row_number", source: str | None = None) -> DataFrame:
    """Parquet position when the scan offers it, else the block-based plan; with ``source``, also the row's file under that name.

    Both need a file scan under ``df``; for other DataFrames (joins, aggregates,
    in-memory data) pass the row identity explicitly (``validate(row_number=...)``).
    """
    try:
        if source:
            df = df.withColumn(source, F.col("_metadata.file_path"))
        return with_parquet_row_numbers(df, name)
    except AnalysisException:
        pass
    try:
        return with_block_row_numbers(df, name)
    except AnalysisException as exc:
        raise ValueError("row numbers need a file scan (no _metadata column here); "
                         "pass row_number=<key column> to validate()") from exc
