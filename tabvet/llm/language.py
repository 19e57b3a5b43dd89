"""Language identification by a mixture over languages.

Per language, byte n-grams of lower-cased text are counted in hashed buckets, over at most
``per_lang`` training documents of each language (those with the smallest hash of their
id). Every word's likelihood under each language is the product over its n-grams (the space on
either side included). Expectation-maximisation estimates a document's language
proportions from its words. The language set is chosen by penalised likelihood (BIC):
languages are dropped one by one, smallest proportion first, and the best set wins. The
prediction is the set's largest proportion, the score that proportion.

Defined cases: null text and text without a letter are ``und`` with score 0, as is
everything when no labelled row exists; every input row gives one output row, repeated ids
included; a null id is never a training row; other columns are ignored; equal proportions
go to the first language in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabvet.llm.common import cut, frugal, only_ids, rows_of

BITS = 16  # 2^BITS buckets a language
SALTS = 64  # parts of a language that are ranked apart before the survivors are ranked together
PER_LANG = 4000  # training documents a language at most
MAX_LANGS = 256  # bounds the model: MAX_LANGS * 2^BITS floats
TOP = 8  # languages that enter the set search
_K = np.uint32(0x9E3779B1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the 4-gram that ends at each byte, start of each word, document of each
    word) for all texts; white space counts as one kind of byte."""
    parts = [b" " + t.lower().encode() + b" " for t in texts]
    a = np.frombuffer(b"   " + b"".join(parts), np.uint8)
    space = _SPACE[a]
    a = np.where(space, np.uint8(32), a).astype(np.uint32)
    code = a[3:] | a[2:-1] << np.uint32(8) | a[1:-2] << np.uint32(16) | a[:-3] << np.uint32(24)
    bucket = (code * _K >> np.uint32(32 - BITS)).astype(np.int64)
    space = space[3:]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.cumsum([len(p) for p in parts])
    return bucket, start, np.searchsorted(ends, start, side="right")


def _word_ends(start: np.ndarray, size: int) -> np.ndarray:
    return np.append(start[1:], size) if len(start) else start


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
        where: Column | None = None, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood table [buckets, languages]) from rows with a label."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and doc_id is not null and text is not null")
    if where is not None:
        rows = rows.where(where)
    order = [F.xxhash64("doc_id"), "doc_id"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).alias("salt")).withColumn("r", rank("lang", "salt")).where(F.col("r") <= per_lang)
    chosen = cut(few.withColumn("r", rank("lang")).where(F.col("r") <= per_lang).select("doc_id"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in total:
                    total[lang] = np.zeros(1 << BITS, np.int64)
                bucket, _, _ = _grams([text])
                total[lang] += np.bincount(bucket, minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["lang", "n"])

    def add(key, table):
        return pa.table({"lang": [key[0].as_py()], "n": pa.array([sum(x.values.to_numpy() for x in table.column("n"))], pa.list_(pa.int64()))})

    part = only_ids(rows, chosen).select("lang", "text").repartition(16).mapInArrow(frugal(count), "lang string, n array<long>")
    found = sorted(part.groupBy("lang").applyInArrow(add, "lang string, n array<long>").limit(MAX_LANGS + 1).toArrow().to_pylist(), key=lambda r: r["lang"])
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = np.array([r["n"] for r in found], float).reshape(len(found), 1 << BITS).T + 0.5
    return [r["lang"] for r in found], np.log(counts / counts.sum(0)).astype(np.float32)


def _em(e: np.ndarray, pi: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document after ``rounds`` of EM; ``e``: word
    likelihoods over their row maximum."""
    for _ in range(rounds):
        r = e * pi[doc]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, first, axis=0) / n[:, None]
    return pi, np.add.reduceat(np.log((e * pi[doc]).sum(1)), first)


def mixtures(texts: list[str], table: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Proportions [texts, languages] in the chosen language set; zeros without words."""
    langs = table.shape[1]
    out = np.zeros((len(texts), langs))
    bucket, start, doc = _grams(texts)
    if not len(start) or not langs:
        return out
    ll = np.add.reduceat(table[bucket], start, axis=0)  # a word with the space behind it, up to the next word
    ll = np.maximum(ll - ll.max(1, keepdims=True), -30)
    some, first, n = np.unique(doc, return_index=True, return_counts=True)
    at, e = np.repeat(np.arange(len(some)), n), np.exp(ll)
    pi = np.full((len(some), langs), 1 / langs)
    pi, like = _em(e, pi, at, first, n, rounds)
    if langs > TOP:
        pi = np.where(pi >= np.sort(pi, axis=1)[:, -TOP][:, None], pi, 0)
        pi, like = _em(e, pi / pi.sum(1, keepdims=True), at, first, n, rounds)
    cost = 0.5 * np.log(n + 1)
    best, value, size = pi, like - cost * (pi > 0).sum(1), min(langs, TOP)
    for left in range(size - 1, 0, -1):
        pi = pi.copy()
        pi[np.arange(len(pi)), np.where(pi > 0, pi, 2).argmin(1)] = 0
        if left > 1:
            pi, like = _em(e, np.maximum(pi, 1e-9 * (pi > 0)) / pi.sum(1, keepdims=True), at, first, n, rounds)
        else:  # the best single language
            one = np.add.reduceat(ll, first, axis=0)
            pi = np.zeros_like(pi)
            pi[np.arange(len(pi)), one.argmax(1)] = 1
            like = one.max(1)
        now = like - cost * left
        better = now > value
        best, value = np.where(better[:, None], pi, best), np.where(better, now, value)
    out[some] = best
    return out


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    names, shared = model[0], df.sparkSession.sparkContext.broadcast(model[1])

    def run(batches):
        for ids, texts in rows_of(batches, 256):
            pi = mixtures(texts, shared.value) if names else np.zeros((len(texts), 1))
            top = pi.argmax(1)
            known = [bool(p.any()) and any(map(str.isalpha, t)) for p, t in zip(pi, texts)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([names[k] if ok else "und" for k, ok in zip(top, known)], pa.string()),
                pa.array([min(1.0, float(p[k])) if ok else 0.0 for p, k, ok in zip(pi, top, known)], pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, min_score: float = 0.5) -> DataFrame:
    """The rows of ``df`` with a language that has at least ``min_score`` of the text; all
    rows if no row is labelled."""
    model = fit(df, id_col, text_col, lang_col)
    if not model[0]:
        return df
    poor = predict(df, model, id_col, text_col).where((F.col("lang_pred") == "und") | (F.col("score") < min_score)).select("doc_id")
    return only_ids(df, cut(poor, "rejected"), "left_anti", id_col)
