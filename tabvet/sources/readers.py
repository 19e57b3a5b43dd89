"""Sources: delimited text read as all-string columns, and opt-in type inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tabvet.functions.numeric import DECIMAL_GATE
from tabvet.functions.text import py_trim

CORRUPT = "_corrupt_record"


def balanced(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt round-robin over ``partitions``, for an input that is known to come in
    too few splits (one large unsplittable file); unchanged if no number is given."""
    return df if partitions is None or df.isStreaming else df.repartition(partitions)


def separator_for(path: str) -> str:
    """``.tsv`` files are tab-separated; ``.csv`` / ``.txt`` use commas."""
    return "\t" if str(path).lower().endswith(".tsv") else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, multiline: bool = False,
                   flag_malformed: bool = True) -> DataFrame:
    """Headered delimited text with every column as a string.

    Rows with too few or too many cells keep their text in ``_corrupt_record`` and
    are reported as MALFORMED by the validator. ``multiline`` is needed for quoted
    line breaks and makes each file a single split.
    """
    sep = sep or separator_for(path)
    header = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns
    fields = [StructField(n, StringType(), True) for n in header]
    if flag_malformed:
        fields.append(StructField(CORRUPT, StringType(), True))
    # An unquoted empty cell is null; a quoted empty cell ("") stays an empty string.
    reader = (spark.read.schema(StructType(fields)).option("header", True).option("sep", sep)
              .option("mode", "PERMISSIVE").option("multiLine", multiline).option("nullValue", "\u0000"))
    if flag_malformed:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        # With parser column pruning a short or long record only counts as malformed
        # when the missing cells are among the columns a query reads; a validator
        # must judge whole records, so this reader parses every column.
        reader = reader.option("columnPruning", False)
    # Every file's header is held against the first one's; another order or name is an error.
    return reader.option("enforceSchema", False).csv(path)


_INT = r"^[+-]?\d+$"
_BOOL = ["true", "false"]


def infer_types(df: DataFrame) -> dict[str, str]:
    """Column types from all rows (S2): ``bigint`` if every non-blank value is an
    integer, ``double`` if every one is a number, ``boolean`` for true/false, else
    ``string``. One aggregation, so the types hold for every cell."""
    cols = [c for c, t in df.dtypes if t == "string" and c != CORRUPT]
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        t = py_trim(F.col(c))
        present = F.col(c).isNotNull() & (t != "")
        aggs += [F.sum(present.cast("int")).alias(f"n{i}"),
                 F.sum((present & t.rlike(_INT)).cast("int")).alias(f"i{i}"),
                 F.sum((present & t.rlike(DECIMAL_GATE)).cast("int")).alias(f"f{i}"),
                 F.sum((present & F.lower(t).isin(_BOOL)).cast("int")).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"] or 0
        if n and row[f"i{i}"] == n:
            out[c] = "bigint"
        elif n and row[f"f{i}"] == n:
            out[c] = "double"
        elif n and row[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def coerce_inferred(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Cast columns to their inferred types (or to given ``types``, where cells that do
    not conform become null, as an inferring CSV reader with ``ignore_errors`` does)."""
    types = infer_types(df) if types is None else types
    out = []
    for c in df.columns:
        t = types.get(c, "string")
        if t == "string":
            out.append(F.col(c))
        elif t == "double":
            v = py_trim(F.col(c))
            out.append(F.when(v.rlike(DECIMAL_GATE), F.regexp_replace(v, "_", "").try_cast("double")).alias(c))
        else:
            out.append(py_trim(F.col(c)).try_cast(t).alias(c))
    return df.select(*out)
