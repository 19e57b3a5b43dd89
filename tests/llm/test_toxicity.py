"""The toxicity classifier: gradients, held-out accuracy, calibration and edge cases."""

import random

import numpy as np
import pytest

pytest.importorskip("tabvet.llm")

from pyspark.sql import functions as F

from tabvet.llm import toxicity as t

SCHEMA = "doc_id long, text string, lang string, source string, y int, z double, id long"
BAD = {"en": ["bozo", "dolt", "twit"], "de": ["dummkopf", "trottel"]}


def corpus(seed, n, start=0):
    rng, out = random.Random(seed), []
    for i in range(start, start + n):
        lang = rng.choice(["en", "de"])
        words = [f"{lang}{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD[lang]) + rng.choice(["", "s", "er", ","]))
        out.append((i, " ".join(words).capitalize(), lang, int(toxic)))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([(i, x, g, "s", 1, 2.0, 3) for i, x, g, _ in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, y, 0) for i, _, _, y in rows], "doc_id long, toxic int, y int")


def test_words_and_their_parts():
    texts = [b"ab cd ab", b"", b"  ", b"abcdef ab!"]
    w = t.Words(texts)
    assert w.length.tolist() == [3, 0, 0, 2]
    names = [w.ids[f:f + n].tolist() for f, n in zip(w.first, w.length)]
    assert names[0][0] == names[0][2] == names[3][1] != names[0][1]
    parts = [set(w.pieces[a:b].tolist()) for a, b in zip(w.piece_at, w.piece_at[1:])]
    assert [len(p) for p in parts] == [2, 2, 6]
    again = t.Words([b"abcdef", b"xabcdef"])
    shared = [set(again.pieces[a:b].tolist()) for a, b in zip(again.piece_at, again.piece_at[1:])]
    assert shared[0] == parts[2] and len(shared[0] & shared[1]) == 4


def test_step_follows_the_gradient():
    network, texts, y = t.Network(3), [b"a bb ccc dddd", b"eeeee a bb", b"zz"], np.array([1, 0, 0])
    network.table = network.table.astype(np.float64) * 20
    network.taps, network.out = [x.astype(np.float64) for x in network.taps], network.out.astype(np.float64)
    words = t.Words(texts)

    def loss():
        z = network.logits(words)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    before = [p.copy() for p in network.parameters()]
    memory = [np.full(p.shape, 1e30) for p in before]  # so large that a step is the gradient, scaled
    network._step(words, y, np.ones(3), memory, 1e15 * 1e-3)
    moved = [(a - b) / 1e-3 for a, b in zip(before, network.parameters())]
    for p, old in zip(network.parameters(), before):
        p[...] = old
    rng = np.random.default_rng(0)
    for k, p in enumerate(network.parameters()):
        flat, step = p.reshape(-1), moved[k].reshape(-1)
        some = np.flatnonzero(step)[rng.permutation(np.count_nonzero(step))[:8]]
        for i in some:
            kept = flat[i]
            flat[i] = kept + 1e-3
            up = loss()
            flat[i] = kept - 1e-3
            down = loss()
            flat[i] = kept
            assert (up - down) / 2e-3 == pytest.approx(step[i], rel=0.05, abs=2e-4)


def test_held_out_rows(spark):
    rows = corpus(1, 1600)
    docs, labels = tables(spark, rows)
    out = {r.doc_id: r for r in t.score(docs, labels, F.col("doc_id") < 1300).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [(out[i].predicted, y) for i, _, _, y in rows if i >= 1300]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([out[i].lang == g for i, _, g, _ in rows]) > 0.98


def test_only_the_text_enters_a_score(spark):
    rows = corpus(2, 500)
    docs, labels = tables(spark, rows)
    model = t.fit(docs, labels, F.lit(True))
    a = {r.doc_id: (r.z, r.lang) for r in t.logits(docs, model).collect()}
    other = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    b = {r.doc_id - 10_000: (r.z, r.lang) for r in t.logits(other, model).collect()}
    assert a.keys() == b.keys() and all(a[k][1] == b[k][1] and a[k][0] == pytest.approx(b[k][0], abs=1e-4) for k in a)
    assert t.fit(docs, labels, F.lit(True)) == model


def test_thresholds_by_language():
    bins = np.array([-40, -10, 0, 20, 30])
    assert t.best_threshold(bins, np.array([0, 0, 0, 5, 9]), np.array([9, 9, 3, 0, 0])) == pytest.approx((1 + 20) / 2 * t.STEP)
    assert t.best_threshold(bins, np.array([0, 0, 0, 1, 9]), np.array([9, 9, 3, 9, 0])) == pytest.approx((21 + 30) / 2 * t.STEP)


def test_thresholds_from_all_rows_of_a_language(spark):
    rows = [(i, 5.0 if i % 2 else -5.0, "en") for i in range(2000)] + [(5000 + i, 1.0 if i % 2 else -9.0, "de") for i in range(2000)] + [(9000, 3.0, "fr")]
    scored = spark.createDataFrame(rows, "doc_id long, z double, lang string")
    at = t.thresholds(scored, spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "id long, y int"))
    assert set(at) == {None, "en", "de"} and -5 < at["en"] < 5 and -9 < at["de"] < 1


def test_defined_cases(spark):
    rows = corpus(4, 300)
    docs, labels = tables(spark, rows)
    long = " ".join(f"en{i % 300}" for i in range(60_000))
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, long), (1004, long + " bozo dolt"), (None, "en1 bozo"), (5, "en1 en2"), (5, "en1 en2"), (1005, "x" * 100_000), (1006, "漢字 😀")]
    extra = spark.createDataFrame([(i, x, None, "s", 1, 2.0, 3) for i, x in odd], SCHEMA)
    noisy = labels.union(spark.createDataFrame([(None, 1, 0), (7, None, 0), (8, 1, 0), (8, 0, 0), (99_999, 1, 0)], "doc_id long, toxic int, y int"))
    out = t.score(docs.union(extra), noisy, F.lit(True)).collect()
    assert len(out) == len(rows) + len(odd)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert got[1000][0].score == got[1001][0].score == got[1002][0].score and got[1000][0].predicted == 0
    assert len(got[5]) == 3 and len(got[None]) == 1
    assert t.score(docs.limit(0), noisy, F.lit(True)).collect() == []
    one = t.score(docs, labels.where("toxic = 0"), F.lit(True)).collect()
    assert len(one) == len(rows) and {(r.score, r.predicted) for r in one} == {(0.0, 0)}
