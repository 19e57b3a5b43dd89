"""Relational queries over the job / output-file / upload ledgers.

The reference serves these from a row store one request at a time; here they are
batch queries over whole ledger tables, written to stay balanced when one user, job
or upload session owns a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.operators.pieces import merged_ranges, missing_ranges

MAX_UPLOAD_BYTES = 10 * 1024 * 1024 * 1024   # fixed value: upload limit (10 GB)
DEFAULT_CHUNK_BYTES = 5 * 1024 * 1024        # fixed value: upload piece size (5 MB)


def assembled_storage_key(session_id: Column, filename: Column) -> Column:
    """``uploads/{session}/assembled/{name}`` with ``/`` and ``\\`` replaced by ``_``."""
    return F.concat(F.lit("uploads/"), session_id, F.lit("/assembled/"), F.translate(filename, "/\\", "__"))


def chunk_count(file_size: Column, chunk_size: Column) -> Column:
    """``max(1, ceil(file_size / chunk_size))``."""
    return F.greatest(F.lit(1), F.ceil(file_size / chunk_size)).cast("long")


def file_lookup(requests: DataFrame, files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each (file_id, user_id) request answered with the file's row when the file
    exists and its job belongs to that user (the reference's authorization join)."""
    owned = files.join(jobs.select(F.col("id").alias("validation_job_id"), F.col("user_id").alias("owner")),
                       "validation_job_id")
    return (requests.join(owned, (requests["file_id"] == owned["id"]) & (requests["user_id"] == owned["owner"]))
            .select(requests["file_id"], requests["user_id"], owned["file_type"], owned["filename"],
                    owned["file_size"], owned["chunk_index"], owned["row_count"], owned["is_valid_only"]))


def job_with_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Every job with its files, one row per (job, file); jobs without files once.

    The files are joined with an inner join (both sides splittable by AQE when one
    job owns many files); jobs with no file come from a pre-aggregated count, so no
    outer join has to stream a hot key through one task.
    """
    j = jobs.select(F.col("id").alias("job_id"), "user_id", "status")
    f = files.select(F.col("validation_job_id").alias("job_id"), F.col("id").alias("file_id"), "filename",
                     "chunk_index", "row_count")
    with_files = j.join(f, "job_id")
    per_job = f.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    without = (j.join(per_job, "job_id", "left_anti")
               .select("job_id", "user_id", "status", F.lit(None).cast("string").alias("file_id"),
                       F.lit(None).cast("string").alias("filename"), F.lit(None).cast("int").alias("chunk_index"),
                       F.lit(None).cast("int").alias("row_count")))
    return with_files.unionByName(without)


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """L1 / L2: each user's newest ``limit`` jobs (created_at desc, id desc for ties).

    ``row_number() <= limit`` lets Spark insert a partial per-group limit before the
    shuffle, so a user with millions of jobs ships at most ``limit`` rows per task.
    """
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (jobs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("user_id", "id", "status", "created_at", F.col("rank").cast("long").alias("rank")))


def job_status_counts(recent: DataFrame) -> DataFrame:
    """A5: per user, total / succeeded / running-or-pending / failed over the given jobs."""
    st = F.col("status")
    return recent.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((st == "SUCCEEDED").cast("int")).cast("long").alias("succeeded"),
        F.sum(st.isin("RUNNING", "PENDING").cast("int")).cast("long").alias("running"),
        F.sum((st == "FAILED").cast("int")).cast("long").alias("failed"))


def missing_chunks(sessions: DataFrame, pieces: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per upload session its status, and a row for each range of missing pieces.

    ``sessions``: session_id, file_size, chunk_size. ``pieces``: session_id, chunk_index
    (one row per reported piece). Pieces outside ``[0, chunk_count)`` are counted as
    invalid (T4) and never complete a session. A complete session has one row without a range.
    Sessions over the upload limit are flagged (T4).
    """
    s = sessions.select("session_id", "file_size", chunk_count(F.col("file_size"), F.col("chunk_size")).alias("chunk_count"))
    p = pieces.join(s.select("session_id", "chunk_count"), "session_id")
    valid = F.coalesce((F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("chunk_count")), F.lit(False))
    reported = p.groupBy("session_id", "chunk_index").agg(F.count_if(~valid).alias("invalid"), F.max(valid.cast("long")).alias("valid"))
    per = reported.groupBy("session_id").agg(F.sum("valid").alias("uploaded_count"), F.sum("invalid").alias("invalid_pieces"))
    zero = F.lit(0).cast("long")
    status = s.join(per, "session_id", "left").select(
        "session_id", "chunk_count", F.coalesce("uploaded_count", zero).alias("uploaded_count"),
        (F.col("chunk_count") - F.coalesce("uploaded_count", zero)).alias("missing_count"),
        (F.coalesce("uploaded_count", zero) == F.col("chunk_count")).alias("complete"), F.coalesce("invalid_pieces", zero).alias("invalid_pieces"),
        (F.col("file_size") > F.lit(MAX_UPLOAD_BYTES)).alias("over_limit"))
    return status.join(missing_ranges(s, pieces, partitions), "session_id", "left")


def merge_chunks(first: DataFrame, second: DataFrame, partitions: int | None = None) -> DataFrame:
    """Union of two piece lists per session, as ranges of successive pieces."""
    return merged_ranges(first, second, partitions=partitions)
