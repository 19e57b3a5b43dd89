"""Structured Streaming: validate an unbounded source (ST1) and error rates per
event-time window (ST3).

The compiled validation is a stateless projection, so it runs unchanged on a
streaming DataFrame. Checks that need the whole table (UNIQUE, REFERENCE, file row
numbers) are not available on a stream; pass a key column as the row identity.
Outputs go to exactly-once file sinks under the session's checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabvet.plans.rules import RuleError, RuleSet
from tabvet.plans.validate import Validated, validate
from tabvet.session import checkpoint_dir


def validate_stream(stream: DataFrame, rules: RuleSet, *, as_of: datetime | str, row_number: str,
                    **kwargs) -> Validated:
    """ST1: the batch validator over a streaming DataFrame."""
    if not stream.isStreaming:
        raise RuleError("validate_stream expects a streaming DataFrame")
    keyed = [f.name for f in rules.fields if f.unique or f.reference]
    if keyed:
        raise RuleError(f"UNIQUE / REFERENCE need the whole table; not available on a stream: {keyed}")
    return validate(stream, rules, as_of=as_of, row_number=row_number, **kwargs)


def read_table_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """A stream over the files of a Parquet table, whether its path is a folder of part files or one file. A micro-batch is
    ``files_per_trigger`` files or, if given, whole files of about ``bytes_per_trigger``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    most = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    reader = spark.readStream.schema(schema).option(*most)
    if fs.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())


def run_available_now(df: DataFrame, name: str, output_mode: str = "append", close: Callable[[], None] | None = None) -> DataFrame:
    """Run a streaming query over everything available, then read its result back; a stream without
    rows gives an empty table.

    Append mode writes to a file sink (exactly-once through its metadata log);
    complete mode rewrites the whole (bounded) aggregate per micro-batch. ``close`` is called when
    all is read, and the query then goes on from its checkpoint with what ``close`` has added to its sources.
    """
    spark: SparkSession = df.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    out, ckpt = f"{base}/out", f"{base}/checkpoint"

    def overwrite(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    for step in (None, close) if close else (None,):
        if step:
            step()
        writer = df.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True)
        q = writer.format("parquet").option("path", out).start() if output_mode == "append" else writer.foreachBatch(overwrite).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(out)


def with_end_marker(stream: DataFrame, event_time: str, at: str = "9999-01-01") -> tuple[DataFrame, Callable[[], None]]:
    """``stream`` with a second source, and a function that puts one row into it: null but for an event time that lets the watermark
    pass every window. The marker's own window stays open, so it shows in no append-mode result."""
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/end-marker-{uuid.uuid4().hex[:12]}"
    schema = StructType([StructField(f.name, f.dataType) for f in stream.schema])
    spark.createDataFrame([], schema).write.parquet(folder)
    markers = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder)

    def close() -> None:
        row = [F.lit(at if f.name == event_time else None).cast(f.dataType).alias(f.name) for f in schema]
        spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(folder)

    return stream.unionByName(markers), close


def error_rate(validated: Validated, event_time: str, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """ST3: per event-time window and error code, the number of errors and of rows. In append mode a window is
    emitted, and its state dropped, when the watermark passes its end."""
    codes = validated.compiled.codes
    frame = validated.frame.withWatermark(event_time, watermark)
    sums = frame.groupBy(F.window(event_time, window).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(validated._code_count(c)).alias(f"_c{i}") for i, c in enumerate(codes)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("error_code"), F.col(f"_c{i}").alias("error_count"))
                                for i, c in enumerate(codes)]))
    return sums.select(F.col("w.start").alias("window_start"), "rows", pairs.alias("p")).select(
        "window_start", "rows", "p.error_code", "p.error_count")


def late_rows(stream: DataFrame, event_time: str, window: str = "1 day", watermark: str = "1 day", name: str = "late") -> DataFrame:
    """The rows that ``error_rate`` leaves out: their window had ended by the watermark at the start of the batch before theirs (a
    stateful operator takes rows until then). Every micro-batch writes its late rows and its largest event time under its number,
    so a repeated batch replaces what it wrote; the watermark is read from the batches before. Run it with the trigger of the rates."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    schema = StructType([*stream.schema, StructField("epoch", LongType())])
    spark.createDataFrame([], "high timestamp, epoch long").write.parquet(f"{base}/high")
    spark.createDataFrame([], schema).write.parquet(f"{base}/late")

    def split(batch: DataFrame, epoch: int) -> None:
        high = spark.read.parquet(f"{base}/high").where(F.col("epoch") < epoch - 1).agg(F.max("high")).first()[0]
        mark = F.lit(high).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
        late = batch.withColumn("_end", F.window(event_time, window)["end"].cast("timestamp")).where(F.col("_end") <= mark)
        late.drop("_end").withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{base}/late/batch={epoch}")
        batch.agg(F.max(event_time).cast("timestamp").alias("high")).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{base}/high/batch={epoch}")

    q = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(split).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/late").drop("epoch")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096  # groups that keys are dealt over; one holds some thousand keys of a stream of ten million


def _bucketed(stream: DataFrame, key: str, row_number: str, *columns: Column, buckets: int) -> DataFrame:
    """(row_number, trimmed key, columns, bucket) of the rows with a present key. The state is kept in RocksDB, outside the JVM's heap."""
    from tabvet.functions.text import py_trim

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return (stream.select(F.col(row_number).cast("long").alias("row_number"), py_trim(F.col(key)).alias("key"), *columns)
            .where(F.col("key").isNotNull() & (F.col("key") != "")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")))


def unique_within(stream: DataFrame, key: str, event_time: str, horizon: str, watermark: str = "1 day", row_number: str = "row_number",
                  buckets: int = BUCKETS) -> DataFrame:
    """ST2 with expiring state: ``(row_number, key, duplicate)`` for every row with a present key; a row is a
    duplicate if its trimmed key occurred within ``horizon`` before it, by event time (ties by ``row_number``).

    Keys are dealt over ``buckets`` by their hash, and a group is a bucket: a call of Python a key costs more than its work. State is
    each bucket's keys and their latest event times, in RocksDB. A key is dropped when the watermark has passed its time plus the
    horizon (by a timer, if its bucket has no rows), so state is bounded by the keys of one horizon. Rows older than the watermark are
    dropped, as in every event-time operator. A group holds one bucket's rows of one micro-batch: bounded by the trigger size.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    spark = stream.sparkSession
    span = spark.range(1).select(F.expr(f"unix_millis(timestamp '2000-01-01 00:00:00' + INTERVAL {horizon}) - unix_millis(timestamp '2000-01-01 00:00:00')")).first()[0]

    def flag(_bucket, batches, state):
        latest = dict(zip(*state.get)) if state.exists else {}
        rows = [] if state.hasTimedOut else list(batches)
        if rows:
            pdf = pd.concat(rows).sort_values(["key", "at", "row_number"])
            keys, at = pdf["key"].to_numpy(), pdf["at"].to_numpy()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            last = np.append(first[1:], len(keys)) - 1
            gap = np.diff(at, prepend=at[0])
            gap[first] = [t - latest.get(k, t - span - 1) for k, t in zip(keys[first], at[first].tolist())]
            latest.update([(k, max(t, latest.get(k, t))) for k, t in zip(keys[first], at[last].tolist())])
            yield pd.DataFrame({"row_number": pdf["row_number"].to_numpy(), "key": keys, "duplicate": gap <= span})
        mark = state.getCurrentWatermarkMs()
        latest = {k: t for k, t in latest.items() if t + span > mark}
        if latest:
            state.update((list(latest), list(latest.values())))
            state.setTimeoutTimestamp(max(min(latest.values()) + span, mark + 1, 1))
        elif state.exists:
            state.remove()

    at = F.col(event_time).cast("timestamp")
    keyed = (_bucketed(stream, key, row_number, at.alias("event_time"), buckets=buckets).where(F.col("event_time").isNotNull())
             .withWatermark("event_time", watermark).withColumn("at", F.unix_millis("event_time")))
    return keyed.groupBy("bucket").applyInPandasWithState(flag, "row_number long, key string, duplicate boolean", "keys array<string>, at array<long>",
                                                          "append", GroupStateTimeout.EventTimeTimeout)


def first_occurrence_flags(stream: DataFrame, key: str, row_number: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """ST2: UNIQUE on a stream with keep-first semantics.

    Emits ``(row_number, key, duplicate)`` for every row with a present key: a row is a
    duplicate when its trimmed key was seen in an earlier micro-batch, or earlier in
    the same micro-batch (by ``row_number``). Keys are dealt over ``buckets`` by their hash; state is each bucket's
    keys, and a group handed to pandas holds one bucket's rows of one micro-batch, so
    it is bounded by the trigger size (``maxFilesPerTrigger`` / ``maxBytesPerTrigger``),
    not by the table. A micro-batch writes the buckets it meets anew: a stream of small micro-batches over
    very many keys wants more buckets. Blank keys are not checked, as in the batch UNIQUE check.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def flag(_bucket, batches, state):
        seen = state.get[0] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["key", "row_number"])
        again = rows.duplicated("key")
        known = rows["key"].isin(seen)
        state.update(([*seen, *rows["key"][~(again | known)]],))
        yield pd.DataFrame({"row_number": rows["row_number"].to_numpy(), "key": rows["key"].to_numpy(), "duplicate": (again | known).to_numpy()})

    return _bucketed(stream, key, row_number, buckets=buckets).groupBy("bucket").applyInPandasWithState(
        flag, "row_number long, key string, duplicate boolean", "keys array<string>", "append", GroupStateTimeout.NoTimeout)
