"""Positions of rows across files and partitions.

Rows are range-partitioned and sorted by their identity (source file, row number) and
stored; each stored row keeps its partition and its place inside it. The partitions' row counts, one
small row a partition, get a prefix sum, so a row's position is its partition's base plus
its place. No window is involved, gaps between row numbers don't matter, and a re-run of a lost task
writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.session import stored


def with_positions(rows: DataFrame, keys: list[str], name: str = "out_pos", folder: str | None = None) -> DataFrame:
    """``rows`` in the order of the unique ``keys`` with the 1-based position ``name``. ``rows`` are read twice
    (the ranges are sampled), so they should be stored ones."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    ranged = stored(ranged, "positions", folder)
    part = F.shiftright("_place", 33)
    counts = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect())  # at most n rows
    bases, total = [], 0
    for p, count in counts:
        bases.append((p, total - (p << 33) + 1))
        total += count
    base = spark.createDataFrame(bases, "_part long, _base long")
    return ranged.join(F.broadcast(base), part == F.col("_part")).withColumn(name, F.col("_place") + F.col("_base")).drop("_place", "_part", "_base")
