"""Hard-negative mining against a brute-force search over all pairs."""

import random

import pytest

pytest.importorskip("tabvet.llm")

import numpy as np
from pyspark.sql import functions as F

from tabvet.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor boolean, q string, row_block string, rank int"


def brute(rows, n_pos=5, n_neg=3, low=50, high=95, scale=256):
    """rows: (id, vector, label), ids unique and all usable."""
    width = max((len(v) for _, v, _ in rows), default=0)
    q = {i: np.array([*np.floor(scale * np.array(v, np.float32).astype(float)), *[0] * (width - len(v))], dtype=object) for i, v, _ in rows}
    label, out = {i: g for i, _, g in rows}, []
    for a in (i for i in q if i % 50 == 0):
        score = {i: int((q[i] * q[a]).sum()) if width else 0 for i in q}
        order = sorted(q, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and label[i] == label[a]][:n_pos]:
            fit = [i for i in order if label[i] != label[a] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:n_neg])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, False, "x", "y", 1) for r in rows], SCHEMA)
    out = negatives.mine(df, F.col("vec_id") % 50 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(out.dtypes)["rank"] == "int" and dict(out.dtypes)["anchor_id"] == "bigint"
    return sorted(map(tuple, out.collect()))


def clustered(rng, n, dims=24, labels=4, size=1.0):
    """Vectors around a few centres, some copies, labels partly wrong."""
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        c = int(rng.integers(6))
        v = centres[c] + rng.normal(size=dims) * rng.choice([0.0, 0.4, 1.2])
        out.append((i, [float(x) for x in np.float32(size * v / np.linalg.norm(v))], int(c % labels if rng.random() < 0.7 else rng.integers(labels))))
    return out


@pytest.mark.parametrize("seed,size", [(1, 1.0), (2, 1.0), (3, 300.0)])
def test_equals_brute_force(spark, seed, size):
    rows = clustered(np.random.default_rng(seed), 400, size=size)
    assert mined(spark, rows) == brute(rows)


def test_many_blocks_give_the_same(spark, monkeypatch):
    rows = clustered(np.random.default_rng(5), 500)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, n_positive=2, n_negative=7, low=10, high=90) == brute(rows, 2, 7, 10, 90)


def test_a_large_group_of_copies_and_ties(spark):
    rng = np.random.default_rng(7)
    rows = clustered(rng, 300)
    rows += [(i, rows[50][1], i % 3) for i in range(300, 800)]
    assert mined(spark, rows) == brute(rows)


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    good = clustered(np.random.default_rng(9), 120, dims=8)
    good += [(200, [], 1), (201, [], 1), (202, [0.0] * 8, 2), (250, [1.0, 0.5], 1), (251, [1.0], 2), (252, [1.0, 0.5, 0.25], 1)]
    bad = [(None, [1.0] * 8, 1), (300, None, 1), (350, [1.0] * 8, None), (400, [1.0, None], 1), (450, [nan] * 8, 1), (500, [inf, 1.0], 2),
           (550, [3e38] * 8, 1), (600, [1e6] * 8, 1)]
    again = [good[0], good[50], good[50], good[7]]
    assert mined(spark, good + bad + again) == brute(good)


def test_one_row_for_an_id_that_repeats(spark):
    rows = clustered(np.random.default_rng(11), 100)
    first = min([(rows[50][2], rows[50][1]), (rows[50][2], rows[51][1])])
    want = [r for r in rows if r[0] != 50] + [(50, first[1], first[0])]
    got = mined(spark, [*rows, (50, rows[51][1], rows[50][2])])
    scaled = min([np.floor(256 * np.float64(rows[50][1])).tolist(), np.floor(256 * np.float64(rows[51][1])).tolist()])
    assert np.floor(256 * np.float64(first[1])).tolist() == scaled and got == brute(want)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0, 2.0], 3)]) == []
    assert mined(spark, [(50, [1.0, 2.0], 3), (51, [2.0, 1.0], 4)]) == []


def test_rows_are_posted_in_fewer_dimensions_than_they_have():
    rng = np.random.default_rng(3)
    y = np.floor(256 * rng.normal(size=(500, 64)) / 8 * np.linspace(2, 0.05, 64))
    post = negatives.Postings(y, y[:10])
    seen = []
    post.search(np.arange(10), [post.row_tail[0].max() * post.anchor_tail[0] * 0.6],
                lambda c, r, s, active, t: seen.append(sorted(zip(c.tolist(), r.tolist(), s.tolist()))) or np.ones(len(active), bool))
    exact = (y @ y[:10].T).astype(int)
    t = post.row_tail[0].max() * post.anchor_tail[0] * 0.6
    assert seen[0] == sorted((c, r, int(exact[r, c])) for c in range(10) for r in range(500) if exact[r, c] >= t[c])
