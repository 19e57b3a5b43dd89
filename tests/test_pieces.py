"""Missing and merged upload pieces as ranges."""

import random

from pyspark.sql import functions as F

from tabvet.operators import ledger, pieces


def ranges(values):
    out = []
    for v in sorted(set(values)):
        if out and out[-1][1] == v - 1:
            out[-1][1] = v
        else:
            out.append([v, v])
    return [tuple(r) for r in out]


def random_sessions(seed, stretch):
    rng, sessions, held = random.Random(seed), [], []
    for i in range(60):
        n = rng.choice([1, 2, stretch - 1, stretch, stretch + 1, 3 * stretch, 5 * stretch + 3])
        keep = rng.choice([0, 0.1, 0.5, 0.95, 1])
        mine = [k for k in range(n) if rng.random() < keep]
        sessions.append((f"s{i}", n))
        held += [(f"s{i}", k) for k in mine for _ in range(rng.choice([1, 1, 2]))]
    return sessions, held + [("s1", -1), ("s1", 10**6), ("s2", None), ("nobody", 3)]


def test_ranges_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 8)
    for seed in (1, 2):
        sessions, held = random_sessions(seed, 8)
        s, p = spark.createDataFrame(sessions, "session_id string, chunk_count long"), spark.createDataFrame(held, "session_id string, chunk_index int")
        mine = {}
        for k, i in held:
            mine.setdefault(k, set()).add(i)
        want = [(k, *r) for k, n in sessions for r in ranges(set(range(n)) - mine.get(k, set()))]
        assert sorted(tuple(r) for r in pieces.missing_ranges(s, p).collect()) == sorted(want)
        a, b = p.where(F.col("chunk_index") % 3 > 0), p.where("chunk_index % 3 = 0 OR chunk_index % 2 = 0")
        inside = {k: {i for i in v if i is not None and (i % 3 or i % 2 == 0 or i % 3 == 0)} for k, v in mine.items()}
        got = sorted(tuple(r) for r in pieces.merged_ranges(a, b).collect())
        seen = {tuple(r) for r in a.unionByName(b).collect()}
        assert got == sorted((k, *r) for k in inside for r in ranges(i for x, i in seen if x == k))
        back = pieces.listed(pieces.merged_ranges(a, b), "first_piece", "last_piece")
        assert sorted(map(tuple, back.collect())) == sorted(seen)


def test_status_of_sessions(spark):
    mib = 1 << 20
    s = spark.createDataFrame([("a", 12 * mib, 5 * mib), ("b", 0, 5 * mib), ("c", 11 << 30, 1 << 30), ("d", 15 * mib, 5 * mib)],
                              "session_id string, file_size long, chunk_size long")
    p = spark.createDataFrame([("a", 0), ("a", 0), ("a", 2), ("a", 7), ("b", 0), ("d", 0), ("d", 1), ("d", 2)], "session_id string, chunk_index int")
    got = sorted(tuple(r) for r in ledger.missing_chunks(s, p).collect())
    assert got == [("a", 3, 2, 1, False, 1, False, 1, 1), ("b", 1, 1, 0, True, 0, False, None, None), ("c", 11, 0, 11, False, 0, True, 0, 10),
                   ("d", 3, 3, 0, True, 0, False, None, None)]


def test_a_session_of_ten_million_pieces(spark):
    n = 10_000_000
    s = spark.createDataFrame([("big", n)], "session_id string, chunk_count long")
    gone = F.col("id").isin(0, 70_000, 70_001, 131_071, 131_072, 9_999_999)
    p = spark.range(n).where(~gone).select(F.lit("big").alias("session_id"), F.col("id").alias("chunk_index"))
    assert sorted(tuple(r)[1:] for r in pieces.missing_ranges(s, p).collect()) == [(0, 0), (70_000, 70_001), (131_071, 131_072), (9_999_999, 9_999_999)]
    merged = pieces.merged_ranges(p.where("chunk_index % 2 = 0"), p.where("chunk_index % 2 = 1 OR chunk_index % 5 = 0"))
    assert sorted(tuple(r)[1:] for r in merged.collect()) == [(1, 69_999), (70_002, 131_070), (131_073, 9_999_998)]


def test_no_arrays_of_a_session(spark):
    s = spark.createDataFrame([("a", 10)], "session_id string, chunk_count long")
    p = spark.createDataFrame([("a", 1)], "session_id string, chunk_index int")
    for df in (pieces.missing_ranges(s, p), pieces.merged_ranges(p, p)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "collect_list" not in plan and "sequence" not in plan


def test_pieces_are_dealt_over_as_many_tasks_as_the_input_needs(spark, monkeypatch):
    """Shuffle partitions were merged down to the cores, so a task's memory grew with the table."""
    from tabvet import fixtures as fx
    from tabvet.catalog import QUERIES
    monkeypatch.setattr(fx, "SPLIT_BYTES", 2000)
    sf = "/root/testdata/sf0.001"
    n = fx.splits(spark, sf, "lineitem")
    plan = QUERIES["merge_chunks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert n > spark.sparkContext.defaultParallelism and plan.count(f", {n}), REPARTITION_BY_NUM") >= 2
    assert "Exchange hashpartitioning" not in "".join(x for x in plan.split("\n") if "ENSURE_REQUIREMENTS" in x and "stretch" in x)
