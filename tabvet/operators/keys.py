"""Key checks: UNIQUE (V18) and REFERENCE (J5) as aggregate + join, skew-safe.

UNIQUE in the reference compares every cell with the whole column (O(n²)). Here:

1. ``dups``: raw values that already equal their trimmed form, grouped and counted
   with partial (map-side) aggregation, keeping keys seen more than once. A key held
   by a third of all rows is combined before the shuffle, so it costs one row per map
   task.
2. a per-row membership flag: the row's *trimmed* value looked up in ``dups``.

The lookup is an equi-join whose right side has one row per key. Blank cells (null join
key) are spread over ``buckets`` salts. A key that many rows hold makes a large left
partition only; AQE splits it at run time (left joins may be split on the left), and
turns the join into a broadcast when the lookup side is small. No job runs while the plan
is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.text import py_trim


def membership(df: DataFrame, key: Column, lookup: DataFrame, lookup_col: str, flag: str,
               salt_source: Column, buckets: int) -> DataFrame:
    """Append boolean ``flag``: ``key`` is a value of ``lookup[lookup_col]`` (distinct).

    Null keys never match; they are spread over ``buckets`` salts.
    """
    left = df.withColumn("_mk", key).withColumn(
        "_ms", F.when(F.col("_mk").isNull(), F.pmod(F.xxhash64(salt_source), F.lit(buckets))).otherwise(F.lit(0)).cast("int"))
    right = lookup.select(F.col(lookup_col).alias("_lk"), F.lit(0).alias("_ls"), F.lit(True).alias(flag))
    joined = left.join(right, (left["_mk"] == right["_lk"]) & (left["_ms"] == right["_ls"]), "left")
    return joined.drop("_mk", "_ms", "_lk", "_ls").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """Values (as stored) that occur more than once; only values equal to their
    trimmed form can ever match a trimmed cell, so others are dropped early."""
    raw = F.col(column).cast("string")
    return (df.select(raw.alias("_uk"))
            .where(F.col("_uk").isNotNull() & (F.col("_uk") != "") & (F.col("_uk") == py_trim(F.col("_uk"))))
            .groupBy("_uk").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > 1)
            .select("_uk"))


def _present_trimmed(column: str) -> Column:
    raw = F.col(column).cast("string")
    t = py_trim(raw)
    return F.when(raw.isNotNull() & (t != ""), t)


def with_unique_flag(df: DataFrame, column: str, flag: str, salt_source: Column, buckets: int = 64) -> DataFrame:
    """``flag`` is true when the cell's trimmed text equals the stored text of more
    than one row (every copy is flagged, the first one included)."""
    return membership(df, _present_trimmed(column), duplicate_values(df, column), "_uk", flag, salt_source, buckets)


def parent_keys(parent: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank trimmed keys of the parent table."""
    return parent.select(_present_trimmed(column).alias("_pk")).where(F.col("_pk").isNotNull()).distinct()


def with_reference_flag(df: DataFrame, column: str, parent: DataFrame, parent_column: str, flag: str,
                        salt_source: Column, buckets: int = 64) -> DataFrame:
    """``flag`` is true when the cell's trimmed text is a key of ``parent``."""
    return membership(df, _present_trimmed(column), parent_keys(parent, parent_column), "_pk", flag, salt_source, buckets)
