"""UNIQUE / REFERENCE semantics and skew handling, row numbers, chunk layout."""

import os

import pytest
from pyspark.sql import functions as F

from tabvet import load_rules, validate
from tabvet.operators.rownum import with_block_row_numbers
from tabvet.sources import sinks
from tabvet.sources.readers import coerce_inferred, infer_types, read_delimited

RULES = {"datasets": {"t": {"fields": [
    {"name": "k", "type": "string", "constraints": {"unique": True}},
    {"name": "p", "type": "string", "constraints": {"references": {"dataset": "parent", "field": "id"}}},
]}}}


def _errors(spark, rows, parent=("A",), **kw):
    df = spark.createDataFrame([(i + 2, k, p) for i, (k, p) in enumerate(rows)], "row_number long, k string, p string")
    par = spark.createDataFrame([(x,) for x in parent], "id string")
    v = validate(df, load_rules(RULES, "t"), as_of="2024-01-01", row_number="row_number", refs={"parent": par}, **kw)
    return sorted((r.row_number, r.error_code) for r in v.errors().collect())


def test_unique_edge_table(spark):
    rows = [("A", None), (" A", None), ("B", None), ("B", None), (" C", None), ("C", None), ("C", None),
            (None, None), (None, None), ("  ", None)]
    got = _errors(spark, rows)
    assert got == [(4, "UNIQUE"), (5, "UNIQUE"), (6, "UNIQUE"), (7, "UNIQUE"), (8, "UNIQUE")]


def test_reference(spark):
    rows = [(None, "A"), (None, " A "), (None, "B"), (None, ""), (None, None)]
    assert _errors(spark, rows) == [(4, "REFERENCE")]


def test_hot_key_is_exact(spark):
    # one key holds a third of the rows; every copy is flagged, every other key is unique
    n = 3000
    rows = [("HOT" if i % 3 == 0 else f"K{i}", "A" if i % 3 == 0 else "ZZ") for i in range(n)]
    got = _errors(spark, rows, salt_buckets=16)
    unique = [r for r in got if r[1] == "UNIQUE"]
    ref = [r for r in got if r[1] == "REFERENCE"]
    assert len(unique) == n // 3 and len(ref) == n - n // 3


def test_block_row_numbers_match_brute_force(spark, tmp_dir):
    paths = []
    for f in range(3):
        p = os.path.join(tmp_dir, f"part{f}.csv")
        with open(p, "w") as fh:
            fh.write("a,b\n")
            for i in range(2000 + 500 * f):
                fh.write(f"{f}-{i},{i}\n")
        paths.append(p)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_delimited(spark, tmp_dir, flag_malformed=False)
        assert df.rdd.getNumPartitions() > 3
        got = with_block_row_numbers(df).select("a", "row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2000 + 2500 + 3000
    for r in got:
        _, i = r.a.split("-")
        assert r.row_number == int(i) + 2


def test_malformed_rows(spark, tmp_dir):
    p = os.path.join(tmp_dir, "m.csv")
    with open(p, "w") as fh:
        fh.write("a,b\n1,2\n3\n4,5,6\n")
    df = read_delimited(spark, p)
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "a", "type": "integer"}]}}}, "t")
    v = validate(df, rules, as_of="2024-01-01")
    codes = sorted((r.row_number, r.error_code) for r in v.errors().collect())
    assert codes == [(3, "MALFORMED"), (4, "MALFORMED")]


def test_chunks_exact_and_in_order(spark, tmp_dir):
    n = 2500
    df = spark.createDataFrame([(i + 2, "x" if i % 7 else "") for i in range(n)], "row_number long, v string")
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "v", "type": "string", "required": True}]}}}, "t")
    v = validate(df, rules, as_of="2024-01-01", row_number="row_number")
    layout = sinks.chunk_layout(v, chunk_rows=300, valid_only=True)
    rows = sorted(layout.select("row_number", "out_pos", "chunk_index").collect())
    kept = [i + 2 for i in range(n) if i % 7]
    assert [r.row_number for r in rows] == kept
    assert [r.out_pos for r in rows] == list(range(1, len(kept) + 1))
    assert all(r.chunk_index == (r.out_pos - 1) // 300 for r in rows)
    out = os.path.join(tmp_dir, "out")
    manifest = sinks.write_outputs(v, out, chunk_rows=300, valid_only=True)
    everything = manifest.collect()
    errors = [r for r in everything if r.file_type == "errors"]
    assert [(r.filename, r.storage_key, r.chunk_index, r.row_count, r.is_valid_only) for r in errors] == [("errors.csv", "errors", None, n - len(kept), False)]
    assert errors[0].file_size == sum(os.path.getsize(os.path.join(out, "errors", f)) for f in os.listdir(os.path.join(out, "errors")) if f.endswith(".csv"))
    m = sorted((r for r in everything if r.file_type != "errors"), key=lambda r: r.chunk_index)
    assert all(os.path.getsize(os.path.join(out, r.storage_key)) == r.file_size for r in m)
    assert not [f for f in os.listdir(out) if f.startswith("_staging")]
    stats = spark.read.parquet(os.path.join(out, "stats")).first()
    assert (stats.total_rows, stats.valid_rows, stats.error_count, stats.errors_by_code) == (n, len(kept), n - len(kept), {"REQUIRED": n - len(kept)})
    assert [r.row_count for r in m] == [300] * (len(kept) // 300) + ([len(kept) % 300] if len(kept) % 300 else [])
    assert m[0].filename == "cleaned_part_0000.csv" and all(r.file_size > 0 for r in m)
    for r in m:
        files = [f for f in os.listdir(os.path.join(out, "cleaned", f"chunk_index={r.chunk_index}"))
                 if f.endswith(".csv")]
        assert len(files) == 1


def _required(name="v"):
    return load_rules({"datasets": {"t": {"fields": [{"name": name, "type": "string", "required": True}]}}}, "t")


def test_positions_of_sparse_and_uneven_keys(spark):
    from tabvet.operators.positions import with_positions
    rows = [("b", 10**12), ("a", 5), ("a", 3), ("b", 7), ("c", -1), ("a", 2**40)] + [("d", i * i * 1000) for i in range(5000)]
    df = spark.createDataFrame(rows, "f string, k long").repartition(7)
    got = sorted(tuple(r) for r in with_positions(df, ["f", "k"], "pos").select("pos", "f", "k").collect())
    assert got == [(i + 1, *r) for i, r in enumerate(sorted(rows))]
    assert with_positions(df.limit(0), ["f", "k"], "pos").collect() == []


def test_rows_of_several_files_keep_their_file(spark, tmp_dir):
    """Four files of 1000 rows: 4000 identities, positions in file order, errors with their file."""
    for k in range(4):
        with open(os.path.join(tmp_dir, f"f{k}.csv"), "w") as fh:
            fh.write("v,w\n" + "".join(f"{'' if i % 10 == k else f'{k}-{i}'},x\n" for i in range(1000)))
    v = validate(read_delimited(spark, os.path.join(tmp_dir, "*.csv"), flag_malformed=False), _required(), as_of="2024-01-01")
    name = lambda path: path.rsplit("/", 1)[-1]
    want = [(f"f{k}.csv", i + 2) for k in range(4) for i in range(1000)]
    layout = sinks.chunk_layout(v, chunk_rows=300)
    got = sorted((r.out_pos, name(r._source), r.row_number, r.chunk_index) for r in layout.collect())
    assert got == [(p + 1, *x, p // 300) for p, x in enumerate(want)]
    errors = [(name(r.source_file), r.row_number) for r in v.error_report().collect()]
    assert errors == [(f, n) for f, n in want if (n - 2) % 10 == int(f[1])]
    kept = [x for x in want if x not in set(errors)]
    out = os.path.join(tmp_dir, "out")
    m = sinks.write_outputs(v, out, chunk_rows=1000, valid_only=True).where("file_type = 'cleaned_chunk'").orderBy("chunk_index").collect()
    assert [r.row_count for r in m] == [1000, 1000, 1000, 600]
    rows = [r.v for c in m for r in spark.read.option("header", True).csv(os.path.join(out, c.storage_key)).coalesce(1).collect()]
    assert rows == [f"{f[1]}-{n - 2}" for f, n in kept]


def test_no_window_and_given_source(spark):
    df = spark.createDataFrame([("x", 2, ""), ("y", 2, "a"), ("y", 3, "")], "file string, row_number long, v string")
    v = validate(df, _required(), as_of="2024-01-01", row_number="row_number", source_file="file")
    assert sorted(tuple(r)[:2] for r in v.errors().collect()) == [("x", 2), ("y", 3)]
    layout = sinks.chunk_layout(v, chunk_rows=2)
    assert "Window" not in layout._jdf.queryExecution().executedPlan().toString()
    assert sorted((r._source, r.row_number, r.out_pos) for r in layout.collect()) == [("x", 2, 1), ("y", 2, 2), ("y", 3, 3)]


def test_outputs_evaluate_the_rows_once(spark, tmp_dir):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 5000, 1, 8).select((F.col("id") + 2).alias("row_number"), F.when(F.col("id") % 9 > 0, "x").alias("v"))
    v = validate(df.mapInArrow(look, df.schema), _required(), as_of="2024-01-01", row_number="row_number")
    m = sinks.write_outputs(v, os.path.join(tmp_dir, "out"), chunk_rows=700)
    assert m.agg(F.sum("row_count")).first()[0] == 5000 + 556 and seen.value == 5000


def test_a_killed_write_leaves_no_manifest(spark, tmp_dir, monkeypatch):
    df = spark.createDataFrame([(2, "x"), (3, "")], "row_number long, v string")
    v, out = validate(df, _required(), as_of="2024-01-01", row_number="row_number"), os.path.join(tmp_dir, "out")
    sinks.write_outputs(v, out)
    assert os.path.isdir(os.path.join(out, "manifest"))

    def fail(*args, **kw):
        raise OSError("lost")
    monkeypatch.setattr(sinks, "write_chunks", fail)
    with pytest.raises(OSError):
        sinks.write_outputs(v, out)
    assert not os.path.exists(os.path.join(out, "manifest"))


def test_append_run(spark, tmp_dir):
    from tabvet.sources.sinks import append_run
    df = spark.createDataFrame([(2, "x"), (3, "")], "row_number long, v string")
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "v", "type": "string", "required": True}]}}}, "t")
    v = validate(df, rules, as_of="2024-01-01", row_number="row_number")
    path = os.path.join(tmp_dir, "runs")
    append_run(v, path, "job-1", "t", "default")
    append_run(v, path, "job-2", "t", "default")
    rows = sorted(spark.read.parquet(path).select("job_id", "total_rows", "valid_rows", "valid_percentage").collect())
    assert [tuple(r) for r in rows] == [("job-1", 2, 1, 50.0), ("job-2", 2, 1, 50.0)]


def test_empty_output_is_one_header_only_chunk(spark, tmp_dir):
    df = spark.createDataFrame([(2, ""), (3, "")], "row_number long, v string")
    rules = load_rules({"datasets": {"t": {"fields": [{"name": "v", "type": "string", "required": True}]}}}, "t")
    v = validate(df, rules, as_of="2024-01-01", row_number="row_number")
    out = os.path.join(tmp_dir, "out")
    m = sinks.write_outputs(v, out, chunk_rows=10, valid_only=True).collect()
    assert [(r.chunk_index, r.row_count, r.filename) for r in m if r.chunk_index is not None] == [(0, 0, "cleaned_part_0000.csv")]
    files = [f for f in os.listdir(os.path.join(out, "cleaned", "chunk_index=0")) if f.endswith(".csv")]
    assert len(files) == 1
    with open(os.path.join(out, "cleaned", "chunk_index=0", files[0])) as fh:
        assert fh.read().startswith("v,is_valid,error_summary")


def test_tsv_is_tab_separated(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t.tsv")
    with open(p, "w") as fh:
        fh.write("a\tb\n1\tx,y\n")
    df = read_delimited(spark, p, flag_malformed=False)
    assert [tuple(r) for r in df.collect()] == [("1", "x,y")]


def test_types_are_inferred_from_every_row(spark):
    rows = spark.range(30_000).selectExpr("CASE WHEN id = 29999 THEN 'x' ELSE cast(id AS string) END AS v")
    assert infer_types(rows) == {"v": "string"}
    assert coerce_inferred(rows).where("v IS NULL").count() == 0


def test_files_with_another_header_are_refused(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "mixed")
    os.makedirs(folder)
    for name, text in (("a.csv", "x,y\n1,a\n"), ("b.csv", "y,x\nb,2\n")):
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(text)
    for flag in (True, False):
        with pytest.raises(Exception, match="header"):
            read_delimited(spark, folder, flag_malformed=flag).collect()


def test_enum_with_numbers_compares_text(spark):
    rules = load_rules({"datasets": {"d": {"fields": [{"name": "k", "type": "enum", "constraints": {"allowed": [1, "2"]}}]}}}, "d")
    got = validate(spark.createDataFrame([(2, "1"), (3, "2")], "n int, k string"), rules, as_of="2024-01-01", row_number="n").errors()
    assert [(r["row_number"], r["error_code"]) for r in got.collect()] == [(2, "ENUM")]


def test_validate_runs_no_job(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(100).selectExpr("id", "cast(id AS string) AS k").join(spark.range(50), "id")
        rules = load_rules({"datasets": {"d": {"fields": [{"name": "k", "type": "string", "constraints": {"unique": True}}]}}}, "d")
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        validate(a, rules, as_of="2024-01-01", row_number="id").frame.schema  # noqa: B018
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
