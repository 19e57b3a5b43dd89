"""Collocations against a brute-force count."""

import collections
import random
import re

import numpy as np
import pytest

pytest.importorskip("tabvet.llm")

from tabvet.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, n long, l1 string, _part string"


def brute(rows, minimum=10, top=2000, share=50, longest=3):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        total = sum(v for k, v in counts.items() if len(k) == 1)
        cands = {k: v for k, v in counts.items() if 2 <= len(k) and v >= minimum}
        found = []
        for k, a in cands.items():
            inside = lambda big: any(big[i:i + len(k)] == k for i in range(len(big) - len(k) + 1))
            if any(len(x) > len(k) and 100 * v >= share * a and inside(x) for x, v in cands.items()):
                continue
            cuts = [(10**6 * a * a // (counts[k[:i]] * counts[k[i:]]), i) for i in range(1, len(k))]
            score, i = min(cuts)
            found.append((-score, -a, " ".join(k).encode(), counts[k[:i]], counts[k[i:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, total, -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, g, "x", 1, 2, "y", "z") for i, (t, g) in enumerate(rows)], SCHEMA)
    out = c.collocations(df, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in out.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    return sorted(map(tuple, out.collect()))


def corpus(seed, n=500):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "漢字", "The", "THE", "\xa0x", "a\x1cb"]
    texts = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(40))
        if rng.random() < 0.3:
            words += ["new", "York", "city"] if rng.random() < 0.8 else ["new", "york"]
        rng.shuffle(words) if rng.random() < 0.3 else None
        texts.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", ": "]) for w in words), rng.choice(["en", "de", None, "und"])))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert len(want) > 30 and mined(spark, rows) == want


def test_other_parameters_longer_phrases_and_small_chunks(spark):
    rows = corpus(3)
    assert mined(spark, rows, minimum=4, top=9, share=90, longest=4, chunk=700) == brute(rows, 4, 9, 90, 4)


def test_defined_cases(spark):
    rows = [(None, "en"), ("", "en"), (" \t.,;", "en"), ("one", None), ("a b", "en"), ("a b " * 30, "en"), ("x y z " * 9000, "fr"), ("w" * 300_000, "fr"), ("aa aa aa aa " * 20, "de")]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, chunk=1000) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en")]) == []


def test_scores_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_001, 3_000_000_000_017, 3_000_000_000_039)], "a long, l long, r long")
    a, l, r = df.first()
    assert df.select(c._score("a", "l", "r")).first()[0] == 10**6 * a * a // (l * r)


def test_full_filters_change_nothing():
    rows = [((x or "").encode().lower(), g or "und") for x, g in corpus(5)]
    ones = np.full(1 << (c.SLOTS - 3), 255, np.uint8)
    for n in (1, 2, 3):
        langs, phrases, counts = c.count_chunk(*map(list, zip(*rows)), n, [ones] * (n - 1))
        want = collections.Counter()
        for text, lang in rows:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.decode()):
                w = re.findall("[^ \t]+", piece)
                want.update((lang, " ".join(w[i:i + n])) for i in range(len(w) - n + 1))
        assert dict(zip(zip(langs, (p.decode() for p in phrases.to_pylist())), counts.tolist())) == want
