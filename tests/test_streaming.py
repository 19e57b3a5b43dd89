import os
import shutil
import time
from datetime import datetime

from tabvet import load_rules
from tabvet.streaming.stream import (error_rate, first_occurrence_flags, late_rows, read_table_stream, run_available_now, unique_within,
                                     validate_stream, with_end_marker)


def test_keep_first_across_micro_batches(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    spark.createDataFrame([(2, "A"), (3, "B"), (4, " A")], "row_number long, k string") \
        .coalesce(1).write.parquet(os.path.join(src, "f1"))
    spark.createDataFrame([(5, "B"), (6, "C"), (7, ""), (8, "C")], "row_number long, k string") \
        .coalesce(1).write.parquet(os.path.join(src, "f2"))
    stream = (spark.readStream.schema("row_number long, k string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = run_available_now(first_occurrence_flags(stream, "k"), "test-unique")
    got = sorted((r.row_number, r.key, r.duplicate) for r in out.collect())
    assert got == [(2, "A", False), (3, "B", False), (4, "A", True), (5, "B", True), (6, "C", False),
                   (8, "C", True)]


def _events(spark, folder, batches, schema="row_number long, k string, at timestamp"):
    """One file a batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(r[0], r[1], datetime.fromisoformat(r[2])) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05 if i + 1 < len(batches) else 0)
    return read_table_stream(spark, folder, spark.createDataFrame([], schema).schema)


def test_tables_as_a_file_and_as_a_folder(spark, tmp_dir):
    df = spark.range(10).repartition(3)
    df.write.parquet(os.path.join(tmp_dir, "folder.parquet"))
    df.coalesce(1).write.parquet(os.path.join(tmp_dir, "one"))
    part = next(f for f in os.listdir(os.path.join(tmp_dir, "one")) if f.endswith(".parquet"))
    shutil.copy(os.path.join(tmp_dir, "one", part), os.path.join(tmp_dir, "file.parquet"))
    for name in ("folder", "file"):
        stream = read_table_stream(spark, os.path.join(tmp_dir, f"{name}.parquet"), df.schema)
        assert sorted(r.id for r in run_available_now(stream, "test-table").collect()) == list(range(10)), name


def test_a_stream_without_rows_gives_an_empty_table(spark, tmp_dir):
    path = os.path.join(tmp_dir, "none.parquet")
    os.mkdir(path)
    out = run_available_now(read_table_stream(spark, path, spark.range(1).schema), "test-none")
    assert out.collect() == [] and out.columns == ["id"]


def test_queries_read_tables_that_are_folders(spark, tmp_dir):
    from tabvet.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    for name in ("events", "orders"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(os.path.join(tmp_dir, f"{name}.parquet"))
    for name in ("stream_validate", "stream_error_rate", "stream_unique_window"):
        rows = [sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in (sf, tmp_dir)]
        if name == "stream_unique_window":  # the later of two copies is judged in its own file's turn
            rows = [[r[:2] for r in x] for x in rows]
        assert rows[0] == rows[1] and rows[0], name


def test_copies_within_a_horizon(spark, tmp_dir):
    stream = _events(spark, os.path.join(tmp_dir, "t"), [
        [(1, "A", "2024-01-01 00:00:00"), (2, " A ", "2024-01-01 06:00:00"), (3, "B", "2024-01-01 00:00:00"), (4, "", "2024-01-01 00:00:00")],
        [(5, "A", "2024-01-02 06:00:00"), (6, "B", "2024-01-02 00:00:01"), (7, None, "2024-01-02 00:00:00")]])
    got = sorted(map(tuple, run_available_now(unique_within(stream, "k", "at", "1 day"), "test-within").collect()))
    assert got == [(1, "A", False), (2, "A", True), (3, "B", False), (5, "A", True), (6, "B", False)]


def test_state_is_dropped_when_its_horizon_has_passed(spark, tmp_dir):
    days = [[(10 * d + i, f"key{10 * d + i}", f"2024-01-{d + 1:02d} 00:00:00") for i in range(10)] for d in range(0, 30, 3)]
    flags = unique_within(_events(spark, os.path.join(tmp_dir, "t"), days), "k", "at", "2 days", "1 hour")
    q = (flags.writeStream.format("noop").outputMode("append").option("checkpointLocation", os.path.join(tmp_dir, "c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert sum(p["numInputRows"] for p in q.recentProgress) == 100
    assert max(held) <= 60 and "RocksDB" in str(q.recentProgress[-1]["stateOperators"][0]["customMetrics"] or "RocksDB").replace("rocksdb", "RocksDB")


def test_rates_in_append_mode_and_late_rows(spark, tmp_dir):
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "k", "type": "string", "required": True}]}}}, "t")
    batches = [[(1, "", "2024-01-01 01:00:00"), (2, "x", "2024-01-01 02:00:00")], [(3, "", "2024-01-04 00:00:00")],
               [(4, "", "2024-01-01 03:00:00"), (5, "", "2024-01-04 05:00:00")], [(6, "x", "2024-01-02 23:00:00"), (7, "", "2024-01-03 12:00:00")]]
    stream, close = with_end_marker(_events(spark, os.path.join(tmp_dir, "t"), batches), "at")
    v = validate_stream(stream, rules, as_of="2024-06-01", row_number="row_number")
    out = run_available_now(error_rate(v, "at", "1 day", "1 day"), "test-rate", close=close)
    got = sorted((str(r.window_start)[:10], r.rows, r.error_code, r.error_count) for r in out.collect())
    assert got == [("2024-01-01", 3, "REQUIRED", 2), ("2024-01-03", 1, "REQUIRED", 1), ("2024-01-04", 2, "REQUIRED", 2)]
    late = late_rows(read_table_stream(spark, os.path.join(tmp_dir, "t"), v.frame.select("row_number", "k", "at").schema), "at", "1 day", "1 day")
    assert sorted(r.row_number for r in late.collect()) == [6]


def test_keys_share_groups_and_their_states(spark, tmp_dir):
    """A call of Python a key took longer than the job's limit; a bucket holds many keys, whatever their number."""
    batches = [[(i, f"k{i % 60}", "2024-01-01 00:00:00") for i in range(100)], [(100 + i, f"k{i}", "2024-01-01 12:00:00") for i in range(80)]]
    flags = {"first": lambda s: first_occurrence_flags(s, "k", buckets=3), "within": lambda s: unique_within(s, "k", "at", "1 day", buckets=3)}
    for name, flag in flags.items():
        ckpt, out = os.path.join(tmp_dir, f"{name}-c"), os.path.join(tmp_dir, f"{name}-o")
        q = (flag(_events(spark, os.path.join(tmp_dir, name), batches)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 3, name
        got = {r.row_number: r.duplicate for r in spark.read.parquet(out).collect()}
        assert got == {i: i >= 60 if i < 100 else i < 160 for i in range(180)}, name


def test_small_files_share_a_micro_batch(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.parquet")
    spark.range(60).repartition(6).write.parquet(path)
    for most, batches in (({}, 6), ({"bytes_per_trigger": 1 << 20}, 1)):
        stream = read_table_stream(spark, path, spark.range(1).schema, **most)
        q = stream.writeStream.format("noop").option("checkpointLocation", os.path.join(tmp_dir, f"c{batches}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == batches
