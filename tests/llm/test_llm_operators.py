"""The training-data operators against brute force, exact round trips and edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tabvet.llm")

from pyspark.sql import functions as F

from tabvet.llm import bpe, common, decontaminate, jaccard, language, licenses, lines, lm, orc_tokens, quality, sketch, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, key string, row string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(6000))


def table(spark, texts, langs=None, start=1):
    """A documents table with extra columns whose names operators use inside."""
    langs = langs or ["en"] * len(texts)
    rows = [(i + start, t, g, "s", len(t) if t is not None else None, "a", "b", "c") for i, (t, g) in enumerate(zip(texts, langs))]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


EDGE = [None, "", "   \n\t ", "one", "Two words", "two WORDS", "a b c d e f g", "a b c d e f g", "é ß 漢字 😀", LONG, LONG + " end"]


# --- shared hashing ---------------------------------------------------------------------

def test_word_hashes_follow_the_words():
    texts = ["A b\tc\n\x0bd\x0c\re", "", " lead and trail ", "a\xa0b \x1c c", "x" * 3_000_000 + " y"]
    h, at = common.word_hashes(texts)
    flat = [w for t in texts for w in t.encode().lower().split()]
    assert len(h) == len(flat) and list(np.diff(at)) == [len(t.encode().split()) for t in texts]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


# --- 7: parity sketches -----------------------------------------------------------------

def test_sets_within_the_bound_share_enough_keys():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 7, 15, 16, 40, 127, 128, 500, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
            most = int(sketch.max_difference(len(a), len(a), 75, 100))
            drop = rng.integers(0, most // 2 + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(1, 1 << 63, rng.integers(0, most // 2 + 1)).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            row, key = sketch.block_keys([a, b])
            shared = len(set(key[row == 0]) & set(key[row == 1]))
            assert shared >= sketch.shared_keys(sketch.max_difference(len(a), len(b), 75, 100))


def test_subsets_across_size_bands_share_enough_keys():
    rng = np.random.default_rng(15)
    for small, large in ((15, 20), (30, 40), (31, 41)):
        need = sketch.shared_keys(int(sketch.max_difference(small, large, 75, 100)))
        lost = 0
        for _ in range(3000):
            b = rng.integers(1, 1 << 63, large).astype(np.uint64)
            row, key = sketch.block_keys([np.sort(b[:small]), np.sort(b)])
            lost += len(np.intersect1d(key[row == 0], key[row == 1])) < need
        assert lost == 0, (small, large, lost)


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components_match_brute_force(spark):
    rng = random.Random(2)
    texts = list(EDGE)
    for size in (6, 12, 30, 60, 120):
        base = words(rng, size)
        for _ in range(12):  # a chain of near copies, some below the threshold
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(size)] = f"n{rng.random()}"
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    passage = words(rng, 20)
    texts += [" ".join(words(rng, 25) + passage) for _ in range(30)]
    df = table(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(list(enumerate(texts, 1)))
    kept = {r["doc_id"] for r in jaccard.keep_one(df).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}
    assert jaccard.keep_one(df).columns == df.columns
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


# --- 2 and 6: BPE -------------------------------------------------------------------------

PIECES = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "\xa0", "\x1c", " ", "<|endoftext|>", "1", "22", "!", "...", "漢字", "😀", "\x85", "the", "ing", ".", "\r\n", "́"]


def test_encoder_equals_the_library():
    enc, rng = bpe.encoder(bpe.default_path()), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(15)))
        ids = np.frombuffer(enc.encode(text), "<u4").tolist()
        assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert enc.decode(ids) == enc.tokenizer.decode(ids, skip_special_tokens=False)


def test_tree_concatenation_equals_the_library():
    enc, rng = bpe.Encoder(bpe.default_path(), leaf=16), random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "the", "ing", "tion", "éa", "x", "zz", "aaa"]) for _ in range(rng.randrange(10, 300)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip_with_long_documents(spark):
    texts = [*EDGE, "the quick\n" * 3000, "ab" * 30_000, LONG.replace(" ", "")[:40_000] + " tail <|endoftext|> x"]
    df = table(spark, texts)
    t = bpe.encoder(bpe.default_path()).tokenizer
    want = {}
    for i, text in enumerate(texts, 1):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    for segment in (500, 1 << 16):
        got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(df, segment=segment).collect()}
        assert got == want
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts, 1)}
    assert bpe.round_trip(table(spark, [])).count() == 0


def test_orc_tokens_round_trip_and_pruning(spark, tmp_dir):
    df = table(spark, EDGE).union(table(spark, ["again"], start=3))
    orc_tokens.write_tokens(df, f"{tmp_dir}/tokens")
    t, start, want = bpe.encoder(bpe.default_path()).tokenizer, 0, []
    rows = sorted([(i, x or "") for i, x in enumerate(EDGE, 1)] + [(3, "again")])
    got = sorted(tuple(r) for r in orc_tokens.token_index(spark, f"{tmp_dir}/tokens").collect())
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted(want)
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == start
        start += g[2]
    plan = orc_tokens.read_tokens(spark, f"{tmp_dir}/tokens").where("doc_id = 4")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,4)" in plan


# --- 1: decontamination -------------------------------------------------------------------

def brute_leaks(docs, items):
    def grams(w):
        return collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or collections.Counter([tuple(w)] if w else [])
    out = set()
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            for s in range(max(1, len(w) - len(v) + 1)) if v else ():
                a, b = grams(w[s:s + len(v)]), grams(v)
                if (n := sum((a & b).values())) and n >= 0.75 * (sum(a.values()) + sum(b.values()) - n):
                    out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    items = [words(rng, n, 300) for n in (3, 8, 20, 40, 40, 300)] + [["a"] * 12]
    texts = [*EDGE[:9], "a " * 40]
    for item in items:
        for edits in (0, 0, 1, 3):
            copy = list(item)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(words(rng, 30) + copy + words(rng, 10)))
    texts += [" ".join(words(rng, 60)) for _ in range(20)]
    bench = spark.createDataFrame([*((i, " ".join(w), "x") for i, w in enumerate(items)), (98, None, "x"), (99, " ", "x"), (0, " ".join(items[0]), "y")], "item_id long, text string, doc_id string")
    got = decontaminate.leaks(table(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(list(enumerate(texts, 1)), [(i, " ".join(w)) for i, w in enumerate(items)])
    clean = {r["doc_id"] for r in decontaminate.keep_clean(table(spark, texts), bench).collect()}
    assert clean == set(range(1, len(texts) + 1)) - {r["doc_id"] for r in got}
    assert decontaminate.leaks(table(spark, texts), bench.where("false")).count() == 0
    assert decontaminate.leaks(table(spark, []), bench).count() == 0


def test_simhash_counts_bits(spark):
    rng = np.random.default_rng(6)
    for n, lane in ((1, 8), (40, 8), (255, 8), (256, 16), (1000, 16)):
        h = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        got = spark.createDataFrame([(h.tolist(),)], "w array<long>").select(decontaminate.simhash(F.col("w"), lane).alias("f")).first()["f"] & ((1 << 64) - 1)
        u = h.astype(np.uint64)
        assert got == sum(1 << b for b in range(64) if 2 * int(((u >> np.uint64(b)) & np.uint64(1)).sum()) > n)


# --- 8: lines -----------------------------------------------------------------------------

def test_line_dedup_removes_later_runs_only(spark):
    rng = random.Random(7)
    line = lambda n=8: " ".join(words(rng, n))
    run, long_line = [line() for _ in range(5)], line(55)
    texts = [None, "", "\n\n", "\n".join([line(), *run, line()]), "\n".join([*run, "", line()]), "\n".join([line(), *run[:2], "", *run[2:], line()]),
             "\n".join([long_line, line()]), "\n".join([line(), long_line]), "\n".join(["same"] * 6), line(), run[0] + "\n" + line()]
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, texts), report=True).collect()}
    first = {}
    for i, text in enumerate(texts, 1):
        gone = set(got[i]["removed"])
        if text is None:
            assert got[i]["text"] is None and not gone
            continue
        split = text.split("\n")
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(split) if k not in gone)
        for k, x in enumerate(split):
            assert k not in gone or x in first
            if x.strip():
                first.setdefault(x, i)
    assert not got[4]["removed"] and got[5]["removed"] == [0, 1, 2, 3, 4] and got[6]["removed"] == [1, 2, 4, 5, 6]
    assert not got[7]["removed"] and got[8]["removed"] == [1] and got[9]["removed"] == [1, 2, 3, 4, 5]
    assert not got[10]["removed"] and not got[11]["removed"]
    assert got[5]["n_chars"] == len(got[5]["text"])
    assert lines.dedup_lines(table(spark, [])).columns == table(spark, []).columns


def test_single_repeated_lines_go(spark):
    rng = random.Random(20)
    line = lambda n=8: " ".join(words(rng, n))
    common_line = line(9)
    texts = ["\n".join([line(), common_line, line()]) for _ in range(30)]
    got = {r["doc_id"]: r["removed"] for r in lines.dedup_lines(table(spark, texts), report=True).collect()}
    assert got == {1: [], **{i: [1] for i in range(2, 31)}}


# --- 10: quality --------------------------------------------------------------------------

def test_an_item_with_two_texts_is_searched_by_both(spark):
    rng = random.Random(21)
    a, b, c = (" ".join(words(rng, 40)) for _ in range(3))
    items = spark.createDataFrame([(1, a), (1, b), (1, b), (2, c)], "item_id long, text string")
    docs = table(spark, [a, f"{c} tail", f"head {b} tail", " ".join(words(rng, 60))])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (3, 1)}


def test_texts_of_null_ids_link(spark):
    """The case of a null-id text near to documents 5 and 9, which are not near to each other's copies otherwise."""
    rng = random.Random(22)
    base = words(rng, 60)
    near = lambda n: " ".join(base[:-n] + words(rng, n))
    far = " ".join(words(rng, 60))
    rows = [(None, " ".join(base)), (5, near(2)), (9, near(3)), (7, far), (None, far), (None, " ".join(words(rng, 30)))]
    df = spark.createDataFrame([(i, x, "en") for i, x in rows], "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 56, 5), (5, 56, 5), (9, 56, 5), (7, 56, 7), (None, 56, 7), (None, 26, None)], key=str)


def test_quality_counts_and_adaptive_fence(spark):
    rng = random.Random(8)
    texts = [*EDGE, "x y z " * 30, "same line\n" * 5 + " ".join(words(rng, 30)), "# $ " + " ".join(words(rng, 25))]
    texts += [" ".join(words(rng, 40)) for _ in range(60)] + [" ".join(w + "###" for w in words(rng, 40))]
    got = {r["doc_id"]: r for r in quality.judge(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts, 1):
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        count = collections.Counter(windows)
        again = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(8)}
        full = [x for x in text.split("\n") if x.strip(quality.SPACES)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(full) - len(set(full)), len(again))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    clean = range(len(EDGE) + 4, len(EDGE) + 64)
    assert all(got[i]["kept"] for i in clean) and not got[len(texts)]["kept"]
    assert quality.judge(table(spark, [])).count() == 0


def test_quality_fence_follows_the_groups_spread(spark):
    """Outliers of a narrow group fail, the same rates in a wide group pass."""
    rng = random.Random(19)
    text = lambda n: " ".join(words(rng, 80 - n) + ["wide#"] * n)
    texts = [text(k % 3) for k in range(100)] + [text(k % 20) for k in range(100)] + [text(12), text(12)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(table(spark, texts, ["aa"] * 100 + ["bb"] * 100 + ["aa", "bb"])).collect()}
    assert not got[201] and got[202]
    assert sum(got[i] for i in range(1, 201)) >= 196
    junk = [text(k % 3) for k in range(100)] + [text(60) for _ in range(10)]  # more than the tail holds
    assert not any(r["kept"] for r in quality.judge(table(spark, junk)).collect() if r["doc_id"] > 100)


def test_symbol_fences_differ_by_group_and_no_fence_is_zero(spark):
    rng = random.Random(8)
    text = lambda symbols, again=0: "\n".join([" ".join(words(rng, 30)) for _ in range(8)] + ["same line here"] * (again + 1 if again else 0) + ["#" * symbols])
    texts = [text(0) for _ in range(180)] + [text(60 + k) for k in range(20)]  # aa: symbols are rare and many
    texts += [text(k % 4) for k in range(180)] + [text(200) for _ in range(20)]  # bb: a few symbols are usual
    texts += [text(0, 1) for _ in range(2)]  # one repeated line
    langs = ["aa"] * 200 + ["bb"] * 200 + ["aa", "bb"]
    df = table(spark, texts, langs)
    rows = quality.measure(df)
    fence = {r["lang"]: r for r in quality.fences(quality.sketches(rows), 4.0, 50).collect()}
    assert 0 < fence["aa"]["symbols_hi"] < 60 / 241 and fence["aa"]["symbols_hi"] != fence["bb"]["symbols_hi"]
    assert all(f[f"{r}_hi"] > 0 for f in fence.values() for r in quality.RATES)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    rate = {r["doc_id"]: r["n_symbols"] / r["n_words"] for r in rows.collect()}
    assert all(not got[i] for i in rate if rate[i] > fence[langs[i - 1]]["symbols_hi"])
    assert not any(got[i] for i in range(181, 201)) and not any(got[i] for i in range(381, 401)) and got[401] and got[402]
    assert sum(got[i] for i in range(1, 181)) >= 176 and sum(got[i] for i in range(201, 381)) >= 176


def test_kept_follows_the_fences(spark):
    """``kept`` against the rates and the fences, row by row, and the fences against exact percentiles."""
    rng = random.Random(12)
    texts = [" ".join(words(rng, rng.randrange(20, 60))) + " " + "#" * (rng.randrange(5, 50) if rng.random() < 0.2 else 0) for _ in range(300)]
    df = table(spark, texts, ["aa"] * 150 + ["bb"] * 150)
    rows = {r["doc_id"]: r for r in quality.measure(df).collect()}
    fence = {r["lang"]: r for r in quality.fences(quality.sketches(quality.measure(df)), 4.0, 50).collect()}
    for r in quality.judge(df).collect():
        m, f = rows[r["doc_id"]], fence["aa" if r["doc_id"] <= 150 else "bb"]
        inside = all(f[f"{n}_lo"] <= m[a] / max(1, m[b]) <= f[f"{n}_hi"] for n, (a, b, *_) in quality.RATES.items())
        assert r["kept"] == (not r["base_failed"] and inside)
    for lang, ids in (("aa", range(1, 151)), ("bb", range(151, 301))):
        v = np.array([rows[i]["n_symbols"] / rows[i]["n_words"] for i in ids])
        q1, q3 = np.quantile(v, [0.25, 0.75], method="inverted_cdf")
        want = max(q3 + 4 * (q3 - q1), 0.5 * np.quantile(v[v > 0], 0.05, method="inverted_cdf"))
        assert fence[lang]["symbols_hi"] == pytest.approx(want, rel=3 * quality.REL)


def test_sketches_merge_to_the_whole(spark):
    df = table(spark, [" ".join(["w" * (1 + k % 9)] * (20 + k)) for k in range(200)])
    rows = quality.measure(df)
    whole = quality.merge(quality.sketches(rows), "lang")
    parts = quality.merge(quality.sketches(rows.where("doc_id % 3 = 0")).union(quality.sketches(rows.where("doc_id % 3 <> 0"))), "lang")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    q = {r["rate"]: r for r in quality.quantiles(whole, "lang").collect()}
    exact = np.quantile([1 + k % 9 for k in range(200)], [0.25, 0.75], method="inverted_cdf")
    assert np.allclose([q["word_length"]["q1"], q["word_length"]["q3"]], exact, rtol=2 * quality.REL)


# --- 5: language --------------------------------------------------------------------------

def test_language_mixture(spark):
    rng = random.Random(9)
    voice = {"aa": ["the", "and", "with", "ing", "there"], "bb": ["und", "der", "nicht", "sch", "keit"]}
    speak = lambda g, n=40: " ".join(rng.choice(voice[g]) + rng.choice(voice[g]) for _ in range(n))
    train = table(spark, [speak(g) for g in ("aa", "bb") * 40], ["aa", "bb"] * 40)
    model = language.fit(train.union(table(spark, [None, "x"], [None, None], 500)))
    assert model[0] == ["aa", "bb"]
    texts = [None, "", "123 !?", speak("aa"), speak("bb"), speak("aa", 30) + " " + speak("bb", 10)]
    got = [(r["lang_pred"], r["score"]) for r in language.predict(table(spark, texts), model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3
    assert got[3][0] == "aa" and got[4][0] == "bb" and min(got[3][1], got[4][1]) > 0.95
    assert got[5][0] == "aa" and 0.6 < got[5][1] < 0.9
    none = table(spark, texts, [None] * len(texts))
    assert language.fit(none)[0] == [] and language.keep_identified(none).count() == len(texts)
    assert language.predict(table(spark, []), model).count() == 0


# --- 3: scores ----------------------------------------------------------------------------

def test_lm_scores(spark):
    rng = random.Random(10)
    texts = [*EDGE, *[" ".join(words(rng, 50, 60)) for _ in range(40)]]
    train = F.col("doc_id") % 4 != 1
    got = {r["doc_id"]: r for r in lm.score(table(spark, texts), train, top=20).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in enumerate(texts, 1)}
    c = collections.Counter(w for i, ws in tokens.items() if i % 4 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert got[i]["score"] < 0
    assert lm.score(table(spark, []), train).count() == 0


def test_lm_long_unseen_words_cost_by_their_length(spark):
    rng = random.Random(14)
    run = "".join(rng.choice("abcdefghijklmnop") for _ in range(10_000))
    texts = [*[" ".join(words(rng, 50, 60)) for _ in range(20)], run[:1000], run]
    got = {r["doc_id"]: r for r in lm.score(table(spark, texts), F.col("doc_id") <= 20).collect()}
    assert got[22]["score"] < 8 * got[21]["score"] and got[22]["bits_per_byte"] > 2


def test_lm_scores_depend_on_the_order_of_words(spark):
    rng = random.Random(16)
    names = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    run = lambda n: [names[(start + k) % 40] for start in [rng.randrange(40)] for k in range(n)]
    text = run(80)
    texts = [*[" ".join(run(80)) for _ in range(60)], " ".join(text), " ".join(rng.sample(text, 80))]
    got = {r["doc_id"]: r for r in lm.score(table(spark, texts), F.col("doc_id") <= 60).collect()}
    assert got[61]["base_score"] == pytest.approx(got[62]["base_score"])
    assert got[61]["bits_per_byte"] < 0.5 * got[62]["bits_per_byte"]


def _random_model(code):
    rng = np.random.default_rng(17)
    counts = rng.integers(0, 9, (lm.HASHED << lm.BITS, 2)).astype(np.uint16)
    w = rng.normal(0.3, 0.1, (lm.DEPTHS * lm.SURE, lm.HASHED + 1))
    return lm.Model(code, lm.BITS, lm._pack(counts), w)


def test_lm_token_bits_do_not_depend_on_grouping():
    rng = random.Random(17)
    names = {w: k for k, w in enumerate([b"", *sorted({w.encode() for w in words(rng, 300)})])}
    cost = _random_model(lm.Code.of([5 + k % 7 for k in range(len(names) + 1)])).ready()
    texts = [" ".join([*words(rng, n), "NeverSeen"][:n]) for n in (0, 1, 3, 9000)]

    def bits(group):
        out = []
        for part in lm.split_texts(group):
            symbol, contexts, offsets = lm.stream(*part, names.get, len(names))
            out += np.add.reduceat(cost(symbol, contexts), offsets[:-1]).tolist()
        return out

    assert bits(texts) == pytest.approx([bits([t])[0] for t in texts], rel=1e-5)


def test_lm_bits_are_a_distribution():
    """In any context the probabilities of all symbols of a code add to one, for words and for bytes."""
    for size in (1, 2, 257, 1000):
        code = lm.Code.of([1 + k * k % 97 for k in range(size)])
        contexts = np.repeat(np.array([[3], [5], [7]], np.uint64), size, 1)
        cost = _random_model(code).ready()(np.arange(size), contexts)
        assert np.sum(2.0 ** -cost) == pytest.approx(1.0, abs=1e-4)


def test_lm_counts_do_not_depend_on_splits(spark):
    rng = random.Random(18)
    texts = [" ".join(words(rng, 60, 80)) for _ in range(60)]
    cols = ("doc_id", "n_tokens", "n_known", "train_tokens")
    got = []
    for splits in (1, 16):
        out = lm.score(table(spark, texts).repartition(splits), F.col("doc_id") <= 50, top=30).collect()
        got.append({r["doc_id"]: r for r in out})
    for i, r in got[0].items():
        other = got[1][i]
        assert [r[c] for c in cols] == [other[c] for c in cols]
        assert r["base_score"] == pytest.approx(other["base_score"]) and r["score"] == pytest.approx(other["score"], rel=0.1)


def test_lm_branches_of_a_context_lie_together():
    """Three successive branches share a block of slots, and each bit of each symbol is there once, with its turn."""
    rng = np.random.default_rng(19)
    code = lm.Code.of((1 + rng.integers(0, 1000, 700) ** 2).tolist())
    symbols, contexts = rng.integers(0, 700, 900), rng.integers(0, 1 << 60, (lm.HASHED, 900)).astype(np.uint64)
    e = code.events(symbols, contexts, lm.BITS)
    assert sorted(e.order.tolist()) == list(range(900)) and sum(e.ms) == code.length[symbols].sum()
    turns, blocks = [[] for _ in symbols], [[set() for _ in symbols] for _ in range(lm.HASHED)]
    ends = np.cumsum([0, *e.ms])
    for a, m in zip(ends, e.ms):
        for j, token in enumerate(e.order[:m]):
            turns[token].append(int(e.bit[a + j]))
            for k in range(lm.HASHED):
                assert e.slots[k, a + j] >> lm.BITS == k
                blocks[k][token].add(int(e.slots[k, a + j]) // lm.GROUPED)
    by_symbol = {}
    for s, bits in zip(symbols.tolist(), turns):
        assert by_symbol.setdefault(s, bits) == bits and len(bits) == code.length[s]
    assert len({tuple(x) for x in by_symbol.values()}) == len(by_symbol)
    assert all(len(b) <= -(-len(t) // 3) for k in range(lm.HASHED) for b, t in zip(blocks[k], turns))


def test_lm_step_counts_every_bit_and_moves_each_gate():
    rng = np.random.default_rng(20)
    code = lm.Code.of((1 + rng.integers(0, 50, 90)).tolist())
    model = lm.Counted(code, lm.BITS)
    symbols, contexts = rng.integers(0, 90, 3000), rng.integers(1, 6, (lm.HASHED, 3000)).astype(np.uint64)
    model.learn(symbols, contexts)
    assert model.table.sum(0).sum() == lm.HASHED * code.length[symbols].sum()
    e, w = code.events(symbols, contexts, lm.BITS), model.w.copy()
    x, _, gate = lm.predictions(e, model.table.view(np.uint64)[:, 0])
    wrong = e.bit - 1 / (1 + np.exp(-np.clip((x * w[gate].T).sum(0), -20, 20)))
    times = np.maximum(np.bincount(gate, minlength=len(w)), 1)
    for k in range(lm.HASHED + 1):
        w[:, k] += lm.RATE / np.sqrt(times) * np.bincount(gate, x[k] * wrong, len(w))
    model._step(symbols, contexts)
    assert model.w == pytest.approx(w, abs=1e-4)


def test_lm_words_and_their_endings():
    texts = ["b Ünï a a.b x\x00y", "", None, "日本 b zz\nzz"]
    for k in range(1, 5):
        for count, at, found in lm.split_texts(texts[:k]):
            names = lm.spelled(found)
            assert names == found.dictionary.to_pylist() and len(at) == count + 1
            assert lm.endings(names).tolist() == [zlib.crc32(w[-2:]) % lm.ENDINGS for w in names]
    assert lm.spelled(next(lm.split_texts([""]))[2]) == [] and len(lm.endings([])) == 0


def test_lm_tables_add_up_beyond_32_bits(spark):
    block = np.zeros((lm.BLOCK, 2), np.uint32)
    block[5], block[7] = (2**32 - 1, 2**31), (3, 1)
    raw = bytearray(lm._pack(block))
    assert (lm._unpack(bytes(raw), np.uint32, block.size).reshape(-1, 2) == block).all()
    rows = spark.createDataFrame([(1, part, raw) for part in (0, 0, 0, 1)], lm.PARTS)
    counts = lm._unpack(lm._add(rows, lm.Code.of([1, 2]), lm.BITS).counts, np.uint16, 2 * lm.HASHED << lm.BITS).reshape(-1, 2)
    assert counts[lm.BLOCK + 5].tolist() == [65535, 32768] and counts[lm.BLOCK + 7].tolist() == [12, 4]
    assert counts.sum() == 65535 + 32768 + 16


# --- 4: WARC ------------------------------------------------------------------------------

def test_warc_round_trip_and_audit(spark, tmp_dir):
    rows = [(1, "http://a/\r\nx", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "z"), (2, None, None, "z"), (2, "u", "x" * 100_000, "z"), (None, "u", "", "z")]
    rows += [(k, f"http://h/{k}", f"<b>{k}</b>\r\n\r\n" * (k % 5), "z") for k in range(10, 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string").coalesce(2)
    out = f"{tmp_dir}/warc"
    warc.write_warc(df, out, records_per_file=50)
    index = warc.index(spark, out)
    want = collections.Counter((r["page_id"], hashlib.sha256(r["r"].encode()).hexdigest()) for r in df.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect())
    assert collections.Counter((r["page_id"], r["sha"]) for r in index.collect()) == want
    broken = lambda page, raw: raw[:-1] + b"?" if page in (2, 33, 150) else raw
    got = warc.fixity(spark, out, broken, fan=4).where("damaged").select("page_id").collect()
    assert sorted(r["page_id"] for r in got) == [2, 2, 33, 150]
    assert warc.fixity(spark, out).where("damaged").count() == 0


def test_warc_records_of_damaged_bytes():
    good = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nab"
    data = good + b"\r\n\r\n" + b"junk" + b"\r\n\r\n" + good + b"\r\n\r\n"
    assert [r for _, r in warc.records(data)] == [good, b"junk", good]
    assert list(warc.records(b"")) == []


# --- 9: licenses --------------------------------------------------------------------------

def test_license_scan_finds_edited_templates(spark):
    rng = random.Random(12)
    mit = licenses.TEMPLATES["mit"].split()
    edited = mit[:20] + ["inserted", "words"] + mit[20:60] + mit[63:]
    texts = [*EDGE, " ".join(words(rng, 20) + mit), " ".join(edited + words(rng, 20)), " ".join(mit[:30]), licenses.TEMPLATES["mit-line"].upper()]
    texts += [" ".join(words(rng, 40)) + "\n" + licenses.TEMPLATES["gpl-3.0-line"] + "\n" + licenses.TEMPLATES["gpl-3.0-line"]]
    got = sorted((r["doc_id"], r["template"], round(r["coverage"], 2), r["first_word"]) for r in licenses.scan(table(spark, texts)).collect())
    n = len(EDGE)
    assert [(d, t) for d, t, _, _ in got] == [(n + 1, "mit"), (n + 2, "mit"), (n + 4, "mit-line"), (n + 5, "gpl-3.0-line"), (n + 5, "gpl-3.0-line")]
    assert got[0][2] == 1.0 and got[0][3] == 20 and 0.9 < got[1][2] < 1.0
    assert licenses.scan(table(spark, [])).count() == 0


def test_license_with_inserted_clauses_is_found():
    rng = random.Random(18)
    index, other = licenses.Index(licenses.TEMPLATES), lambda n: words(rng, n)
    mit = licenses.TEMPLATES["mit"].split()
    third = len(mit) // 3
    shifted = mit[:third] + other(5) + mit[third:2 * third] + other(5) + mit[2 * third:]
    clause = mit[:third] + other(20) + mit[third:]
    chance = mit[10:13] + other(2) + mit
    twice = licenses.TEMPLATES["mit-line"].split() * 3
    for text, want in ((shifted, ["mit"]), (clause, ["mit"]), (chance, ["mit"]), (twice, ["mit-line"] * 3), (mit[:third], [])):
        h = licenses._hashes([" ".join(other(30) + text + other(30))])[0]
        got = licenses.matches(h, index, licenses.BAND, 0.8)
        assert [index.names[g[0]] for g in got] == want and all(g[1] == 1 for g in got)


# --- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(13)
    item, near = " ".join(words(rng, 30)), words(rng, 80)
    texts = [None, "12 34", " ".join(words(rng, 50)), " ".join(words(rng, 20)) + " " + item, " ".join(near), " ".join(near[:-1] + ["other"]),
             *[" ".join(words(rng, 30)) for _ in range(5)]]
    sf = f"{tmp_dir}/sf"
    table(spark, texts).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = common.documents(spark, sf)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = common.cut(out)
    assert sorted(r["doc_id"] for r in docs.collect()) == [3, 5, 7, 8, 9, 10, 11]
    got = {r["doc_id"]: r["decoded_sha256"] for r in pipeline.run(spark, sf).collect()}
    assert got == {i: hashlib.sha256(texts[i - 1].encode()).hexdigest() for i in (3, 5, 7, 8, 9, 10, 11)}


def test_queries_are_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
