"""Quality rules with thresholds learned per language and source.

One pass counts each document's words, symbols, repeated lines and repeated 8-word
windows. The rates of the documents that pass the base rules go into logarithmic quantile
sketches (bucket counts; two sketches merge by adding counts, each quantile is within
``REL`` of its value). Sketches are kept per (lang, source); a group of fewer than
``min_docs`` documents takes the merged sketch of its language, or of all documents.
Word length has two fences, and the tighter holds: the 1st or 99th percentile (one document at least lies outside, so a
lone outlier can't set it) and a margin of ``TAIL`` of the distance from the median to it; and q1 - k*s or q3 + k*s with s =
q3 - q1. Both margins are ``k`` steps of the sketch at least. The other rates are 0 for most
documents, so percentiles of all documents say nothing: their fence is a share of what the group's documents have that have
any (half the 5th percentile for symbols, which clean texts hardly use; one and a half times the 95th for repeated lines and
windows), or q3 + k*s if that is more. A rate outside its group's fence fails the document.

Defined cases: null or empty text has no words and fails the base rules; null lang or
source is a group of its own; every input row gives one output row, repeated ids
included; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabvet.llm.common import cut, frugal, only_ids, rolling, word_hashes

REL = 0.01
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30
TAIL, MARKS = 0.5, ("q01", "q1", "q50", "q3", "q99", "few", "most")
#: rate -> (numerator, denominator, whether low values fail too, mark of the documents that have any and its factor)
RATES = {
    "symbols": ("n_symbols", "n_words", False, ("few", 0.5)),
    "word_length": ("word_chars", "n_words", True, None),
    "dup_lines": ("n_dup_lines", "n_lines", False, ("most", 1.5)),
    "repeats": ("n_repeat_words", "n_words", False, ("most", 1.5)),
}


def repeated_words(h: np.ndarray, k: int = WINDOW) -> int:
    """Words that lie in k-word windows which occur at least twice."""
    r = rolling(h, k)
    order = np.argsort(r, kind="stable")
    s = r[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(h) + 1, np.int64)
    at = order[twice]
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return int((np.cumsum(step) > 0).sum())


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts, rows = [t or "" for t in part.column(3).to_pylist()], []
                h, at = word_hashes(texts, lower=False)
                for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist()):
                    seen, lines, again = set(), 0, 0
                    for line in text.split("\n"):
                        if line.strip(SPACES):
                            lines += 1
                            again += line in seen
                            seen.add(line)
                    rows.append((b - a, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), lines, again, repeated_words(h[a:b])))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, pa.int64()) for c in zip(*rows))], names=names)

    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                     F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names[3:]))


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): the sketch of each rate in each group. Bucket b > 0
    holds values in (g^(b-1), g^b] of 1e-6 and up; bucket 0 holds smaller ones."""
    step = math.log((1 + REL) / (1 - REL))
    values = F.array(*[F.struct(F.lit(r).alias("rate"), (F.col(a) / F.greatest(F.col(b), F.lit(1))).alias("v")) for r, (a, b, *_) in RATES.items()])
    bucket = F.when(F.col("x.v") <= 1e-6, 0).otherwise(F.ceil(F.log(F.col("x.v") * 1e6) / step)).cast("long")
    return (measures.select("lang", "source", F.explode(values).alias("x"))
            .groupBy("lang", "source", F.col("x.rate").alias("rate"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, rate, docs, q1, q3, q01, q50, q99, few, most) of merged sketches: quantiles of all documents, and the 5th and 95th percentile
    of those whose rate isn't 0 (null without any). A group has at most a few thousand buckets."""
    by = Window.partitionBy(*keys, "rate")
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    gamma = (1 + REL) / (1 - REL)
    middle = F.when(F.col("bucket") == 0, 0.0).otherwise(F.pow(F.lit(gamma), F.col("bucket")) * 2e-6 / (1 + gamma))
    zeros = F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(by)
    ranked = sketch.select(*keys, "rate", middle.alias("v"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(by).alias("docs"), zeros.alias("zeros"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("docs") * q), F.col("v")))
    inner = F.greatest(F.floor(F.col("docs") * 0.99), F.lit(1))  # of the tails, so that one document at least is outside
    rank = lambda r: F.min(F.when(F.col("upto") >= r, F.col("v")))
    any_ = lambda q: F.min(F.when((F.col("v") > 0) & (F.col("upto") >= F.col("zeros") + F.ceil((F.col("docs") - F.col("zeros")) * q)), F.col("v")))
    return ranked.groupBy(*keys, "rate").agg(F.first("docs").alias("docs"), at(0.25).alias("q1"), at(0.75).alias("q3"),
                                             rank(F.col("docs") + 1 - inner).alias("q01"), at(0.5).alias("q50"), rank(inner).alias("q99"), any_(0.05).alias("few"), any_(0.95).alias("most"))


def fences(sketch: DataFrame, k: float, min_docs: int) -> DataFrame:
    """(lang, source, <rate>_lo, <rate>_hi): one row per group, learned at the finest level
    with enough documents."""
    sketch = cut(sketch, "sketch")
    level = lambda *keys: quantiles(merge(sketch, *keys), *keys)
    own, lang, every = level("lang", "source"), level("lang"), level()
    name = lambda d, p, *keys: d.select(*[F.col(c).alias(f"{p}_{c}") for c in (*keys, "rate", "docs", *MARKS)])
    all_levels = (own.join(name(lang, "l", "lang"), F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")))
                  .join(name(every, "e"), F.col("rate") == F.col("e_rate")))
    pick = lambda q: F.coalesce(F.when(F.col("docs") >= min_docs, F.col(q)), F.when(F.col("l_docs") >= min_docs, F.col(f"l_{q}")), F.col(f"e_{q}"))
    out = []
    for rate, (_, _, low, having) in RATES.items():
        of = lambda c: F.max(F.when(F.col("rate") == rate, c))  # noqa: B023, E731
        spread = (F.col("q3") - F.col("q1")) * k
        if having:  # rates that are 0 for most: a share of what the documents have that have any
            high = F.greatest(F.col("q3") + spread, F.coalesce(F.col(having[0]) * having[1], F.lit(float("inf"))))
        else:
            margin = lambda q: F.greatest(F.abs(F.col(q) - F.col("q50")) * TAIL, F.col(q) * (k * REL))
            high = F.least(F.col("q99") + margin("q99"), F.col("q3") + F.greatest(spread, F.col("q3") * (k * REL)))
        floor = F.greatest(F.col("q01") - F.greatest(F.abs(F.col("q01") - F.col("q50")) * TAIL, F.col("q01") * (k * REL)),
                           F.col("q1") - F.greatest(spread, F.col("q1") * (k * REL)))
        out += [of(floor if low else F.lit(float("-inf"))).alias(f"{rate}_lo"), of(high).alias(f"{rate}_hi")]
    return all_levels.select("lang", "source", "rate", *[pick(q).alias(q) for q in MARKS]).groupBy("lang", "source").agg(*out)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *,
          k: float = 4.0, min_docs: int = 50) -> DataFrame:
    """Every row's counts, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    rows = cut(measure(df, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed), "measures")
    limit = fences(sketches(rows.where("not base_failed")), k, min_docs).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "*").drop("lang", "source")
    both = rows.join(limit, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for rate, (a, b, *_) in RATES.items():
        inside &= (F.col(a) / F.greatest(F.col(b), F.lit(1))).between(F.col(f"{rate}_lo"), F.col(f"{rate}_hi"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep_good(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose document is kept."""
    return only_ids(df, cut(judge(df, id_col, **options).where("not kept").select("doc_id"), "poor"), "left_anti", id_col)
