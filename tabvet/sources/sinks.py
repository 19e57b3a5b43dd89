"""Sinks: cleaned rows in exact-size chunks, the error report, and the output manifest.

The validated frame is stored once, in a pass that also counts its statistics; chunks, error report and
manifest start from the stored rows. Chunk layout without a global sort or a window (S6): the kept rows
get their positions over all files from ``with_positions``; the position decides the chunk, so every chunk holds exactly
``chunk_rows`` rows in input order, also when ``valid_only`` drops rows.

Outputs are written to a staging folder below the target, moved into place, and only then does the manifest follow: a run that
dies leaves no manifest, and the manifest names the files that were written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabvet.operators.positions import with_positions
from tabvet.plans.rules import RuleError
from tabvet.plans.validate import ROW, SOURCE, Validated
from tabvet.session import move_folder, remove_folder, run_folder, stored


def chunk_layout(validated: Validated, chunk_rows: int = 100_000, valid_only: bool = False, folder: str | None = None) -> DataFrame:
    """Cleaned rows with ``out_pos`` (1-based position among output rows, over all files) and ``chunk_index``. The rows are
    validated once and stored in ``folder`` (default: a new run folder in the checkpoint folder)."""
    if chunk_rows <= 0:
        raise RuleError("chunk_rows must be positive")
    folder = folder or run_folder(validated.frame.sparkSession)
    rows = stored(validated.with_row_number(valid_only, source=True), "rows", folder)
    return with_positions(rows, validated.identity, "out_pos", folder).withColumn("chunk_index", F.floor((F.col("out_pos") - 1) / chunk_rows).cast("int"))


def write_chunks(layout: DataFrame, path: str, fmt: str = "csv") -> None:
    """One directory ``chunk_index=i`` per chunk holding exactly one file, rows in order."""
    data = layout.repartition("chunk_index").sortWithinPartitions("chunk_index", "out_pos").drop(SOURCE, ROW, "out_pos")
    writer = data.write.mode("overwrite").partitionBy("chunk_index")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_error_report(validated: Validated, path: str) -> None:
    """Errors in report order (S8); no file is written when there are none."""
    report = validated.error_report()
    if not validated.errors().isEmpty():
        report.write.mode("overwrite").option("header", True).csv(path)


_MANIFEST = "file_type, filename, storage_key, file_size, chunk_index, row_count, is_valid_only".split(", ")


def written_files(spark, path: str, pattern: str) -> DataFrame:
    """(storage_key relative to ``path``, file_size) of the files written there; reads the listing, not the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{path}/{pattern}")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.substring_index("path", f"/{root}/", -1).alias("storage_key"), F.col("length").alias("file_size"))


def write_outputs(validated: Validated, path: str, chunk_rows: int = 100_000, valid_only: bool = False,
                  job_id: str = "job") -> DataFrame:
    """Write chunks, error report and manifest under ``path``; return the stored manifest.

    One pass over the validated rows stores them and counts total, valid rows and errors by code (also kept in
    ``path/stats``). Every chunk is full but the last, so its row count follows from its number; sizes and paths are those of
    the written files. An empty output is one header-only chunk; the error report has a manifest row if there are errors.
    """
    if chunk_rows <= 0:
        raise RuleError("chunk_rows must be positive")
    spark = validated.frame.sparkSession
    scratch, staging = run_folder(spark), f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    remove_folder(spark, f"{path}/manifest")
    counted = Observation()
    kept = validated.on(stored(validated.observed(counted), "frame", scratch))
    stats = counted.get
    total = stats["valid_rows"] if valid_only else stats["total_rows"]
    if total == 0:
        empty = kept.with_row_number(valid_only).drop(ROW).limit(0)
        empty.coalesce(1).write.option("header", True).csv(f"{staging}/cleaned/chunk_index=0")
    else:
        rows = kept.with_row_number(valid_only, source=True)
        layout = with_positions(rows, kept.identity, "out_pos", scratch).withColumn("chunk_index", F.floor((F.col("out_pos") - 1) / chunk_rows).cast("int"))
        write_chunks(layout, f"{staging}/cleaned")
    if stats["error_count"]:
        kept.error_report().write.option("header", True).csv(f"{staging}/errors")
    move_folder(spark, f"{staging}/cleaned", f"{path}/cleaned")
    remove_folder(spark, f"{path}/errors")
    if stats["error_count"]:
        move_folder(spark, f"{staging}/errors", f"{path}/errors")
    remove_folder(spark, staging)

    index = F.regexp_extract("storage_key", r"chunk_index=(\d+)/", 1).cast("int")
    manifest = written_files(spark, path, "cleaned/chunk_index=*/*.csv").select(
        F.lit("cleaned_chunk").alias("file_type"), F.format_string("cleaned_part_%04d.csv", index).alias("filename"), "storage_key", "file_size",
        index.alias("chunk_index"), F.least(F.lit(chunk_rows), F.lit(total) - index * F.lit(chunk_rows)).cast("int").alias("row_count"),
        F.lit(valid_only).alias("is_valid_only"))
    if stats["error_count"]:
        size = written_files(spark, path, "errors/*.csv").agg(F.sum("file_size").alias("file_size"))
        manifest = manifest.unionByName(size.select(
            F.lit("errors").alias("file_type"), F.lit("errors.csv").alias("filename"), F.lit("errors").alias("storage_key"), "file_size",
            F.lit(None).cast("int").alias("chunk_index"), F.lit(stats["error_count"]).cast("int").alias("row_count"), F.lit(False).alias("is_valid_only")))
    codes = [F.struct(F.lit(c).alias("key"), F.lit(stats[f"code_{c}"]).alias("value")) for c in validated.compiled.codes if stats[f"code_{c}"]]
    by_code = F.map_from_entries(F.array(*codes)) if codes else F.create_map().cast("map<string,bigint>")
    spark.range(1).select(F.lit(job_id).alias("job_id"), *[F.lit(stats[c]).cast("long").alias(c) for c in ("total_rows", "valid_rows", "error_count")],
                          by_code.alias("errors_by_code")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    manifest.select(F.lit(job_id).alias("job_id"), *_MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    remove_folder(spark, scratch)
    return spark.read.parquet(f"{path}/manifest").select(*_MANIFEST)


def append_run(validated: Validated, path: str, job_id: str, dataset_type: str, rule_set: str,
               chunk_rows: int = 100_000, valid_only: bool = False) -> None:
    """Append one row with the run's statistics to the ``validation_runs`` table
    at ``path`` (parquet, partitioned by dataset type). One aggregation pass."""
    stats = validated.stats(chunk_rows, valid_only)
    row = stats.select(F.lit(job_id).alias("job_id"), F.lit(dataset_type).alias("dataset_type"),
                       F.lit(rule_set).alias("rule_set"), F.current_timestamp().alias("completed_at"), "*")
    row.write.mode("append").partitionBy("dataset_type").parquet(path)
