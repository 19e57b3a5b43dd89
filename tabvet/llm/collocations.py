"""Phrase collocations from count streams kept in prefix and suffix order.

Counting: tasks cut texts into pieces and words, number the words of a chunk exactly through a dictionary, and
count phrases by sorting their numbers; chunk counts are then summed by phrase. Every part of a
phrase occurs at least as often as the phrase, so a phrase of n words is only counted
where both of its parts of n-1 words may reach the minimum. ``SLOTS`` bits for each length (a fixed
size, whatever the corpus) say so; a bit that is set by chance only costs time, since the minimum is
applied to the summed counts.

Estimation: the stream of phrases of n words is sorted by its first words and merge-joined in lockstep with
the shorter streams for the counts of its left parts, and sorted by its last words for those of its right parts;
the same two orders give the largest count of an extension to the right and to the left. These are sort-merge joins:
both sides stream in order, no side is hashed into memory or broadcast, and a frequent first or
last word makes a long run that is split between tasks. A longer phrase never occurs more often
than its parts, so extensions by one word decide about all longer ones.

Defined cases: a null text counts as empty, a null language as ``und``; texts that repeat count as often as they
occur; ids and other columns are ignored; an empty table gives an empty result. Languages
have streams of their own, phrases don't cross pieces. A very long text is counted in parts cut between pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import cut, frugal, mix, split_words, word_hashes

SLOTS = 26  # 2^26 bits (8 MB) for each phrase length
CHUNK = 1 << 22  # bytes of text counted at once: some 100 MB of a worker
SALTS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[bytes], list[str]]]:
    """Lower-cased texts and their languages, together at most ``size`` bytes unless one piece is longer."""
    texts, langs, held = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for unit in _units((text or "").encode().lower(), size):
                    if held + len(unit) > size and texts:
                        yield texts, langs
                        texts, langs, held = [], [], 0
                    texts.append(unit)
                    langs.append(lang)
                    held += len(unit)
    if texts:
        yield texts, langs


def _units(text: bytes, size: int) -> Iterator[bytes]:
    while len(text) > size:
        ends = np.flatnonzero(_KIND[np.frombuffer(text[:size], np.uint8)] == 2)
        at = int(ends[-1]) + 1 if len(ends) else 0
        if not at:
            later = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8)] == 2)
            at = int(later[0]) + 1 if len(later) else len(text)
        yield text[:at]
        text = text[at:]
    yield text


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) + 1)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - SLOTS)


def _longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(hashes * _ODD + last)


def count_chunk(texts: list[bytes], langs: list[str], n: int, seen: list[np.ndarray]) -> tuple[list[str], pa.Array, np.ndarray] | None:
    """(languages, phrases, counts) of the phrases of ``n`` words whose parts of 1 to n-1 words have their bits in ``seen``."""
    lengths = np.cumsum([len(t) + 1 for t in texts])
    a, start, words = split_words(texts, _KIND > 0)
    if not len(start):
        return None
    piece = np.cumsum(_KIND[a] == 2, dtype=np.int32)[start]
    names = sorted(set(langs))
    lang = np.searchsorted(names, langs)[np.searchsorted(lengths, start, side="left")]
    size = len(words.dictionary)
    keys, unit, counts = np.unique(lang.astype(np.int64) * size + words.indices.to_numpy(), return_inverse=True, return_counts=True)
    key_lang, key_word = keys // size, keys % size
    phrase = words.dictionary.take(pa.array(key_word))
    if n > 1:
        h = mix(word_hashes([b" ".join(words.dictionary.to_pylist())], lower=False)[0][key_word] + np.array([_lang_hash(x) for x in names])[key_lang] * _ODD)
        single, hashes, numbers, at = phrase, h, unit, np.arange(len(unit))
        for k in range(2, n + 1):
            fine = _bits(seen[k - 2], _slots(hashes))[numbers]
            at_ok = np.zeros(len(unit) + 1, bool)
            at_ok[at] = fine
            number = np.zeros(len(unit), np.int64)
            number[at] = numbers
            at = np.flatnonzero(at_ok[:-1] & at_ok[1:])
            at = at[at + k - 1 < len(unit)]
            at = at[piece[at] == piece[at + k - 1]]
            if not len(at):
                return None
            keys, numbers, counts = np.unique(number[at] * len(single) + unit[at + k - 1], return_inverse=True, return_counts=True)
            head, last = keys // len(single), keys % len(single)
            phrase = pc.binary_join_element_wise(phrase.take(pa.array(head)), single.take(pa.array(last)), pa.scalar(b" ", pa.large_binary()))
            hashes = _longer(hashes[head], h[last])
            key_lang = key_lang[head]
    return [names[x] for x in key_lang.tolist()], phrase, counts


def _bits(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counted(docs: DataFrame, n: int, seen: list, chunk: int) -> DataFrame:
    """(lang, phrase, a): the summed counts of phrases of ``n`` words."""
    def run(batches):
        maps = [np.frombuffer(b.value, np.uint8) for b in seen]
        for texts, langs in chunks(batches, chunk):
            got = count_chunk(texts, langs, n, maps)
            for k in range(0, len(got[2]) if got else 0, 1 << 16):
                z = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(got[0][z], pa.string()), got[1][z].cast(pa.binary()).cast(pa.string()),
                                                  pa.array(got[2][z], pa.int64())], names=["lang", "phrase", "a"])

    return docs.mapInArrow(frugal(run), "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def bitmap(phrases: DataFrame, n: int):
    """The bits of the given phrases of ``n`` words, broadcast: 2^SLOTS bits."""
    def run(batches):
        for batch in batches:
            texts = [x.encode() for x in batch.column(1).to_pylist()]
            lang = np.array([_lang_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
            h = mix(word_hashes(texts, lower=False)[0].reshape(-1, n) + lang[:, None] * _ODD)
            out = h[:, 0]
            for k in range(1, n):
                out = _longer(out, h[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(_slots(out).astype(np.int64) + 1)], names=["slot"])

    spark = phrases.sparkSession
    slots = phrases.select("lang", "phrase").mapInArrow(frugal(run), "slot long")
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(1 << (SLOTS - 3), np.uint8)
    for b, bits in rows:
        out[(b - 1) * 4096:b * 4096] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def _score(a: str, left: str, right: str) -> Column:
    exact = [f"cast({x} AS decimal(15,0))" for x in (a, left, right)]
    return F.expr(f"cast({exact[0]} * {exact[0]} * cast(1000000 AS decimal(7,0)) AS decimal(38,0)) div cast({exact[1]} * {exact[2]} AS decimal(38,0))")


def _part(first: int, n: int) -> Column:
    return F.concat_ws(" ", F.slice(F.split("phrase", " "), first, n))


def _merged(df: DataFrame, stream: DataFrame, part: Column, name: str, how: str = "inner") -> DataFrame:
    """``df`` with the count of its ``part`` from ``stream`` (lang, phrase, a): both are sorted by it and read in lockstep."""
    other = stream.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias(name)).hint("merge")
    return df.withColumn("_part", part).join(other, (F.col("lang") == F.col("_lang")) & (F.col("_part") == F.col("_phrase")), how).drop("_lang", "_phrase", "_part")


def collocations(df: DataFrame, *, longest: int = 3, minimum: int = 10, top: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang",
                 chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words by the score of their weakest cut;
    phrases are left out if a longer one has at least ``share`` per cent of their occurrences."""
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = cut(counted(docs, 1, [], chunk), "count_1")
    streams, seen = {1: words.where(F.col("a") >= minimum)}, []
    for n in range(2, longest + 1):
        seen.append(bitmap(streams[n - 1], n - 1))
        streams[n] = cut(counted(docs, n, seen, chunk).where(F.col("a") >= minimum), f"count_{n}")
    out = None
    for n in range(2, longest + 1):
        s = streams[n]
        for k in range(1, n):
            s = _merged(s, streams[k], _part(1, k), f"l{k}")
            s = _merged(s, streams[n - k], _part(k + 1, n - k), f"r{k}")
        best = F.array_min(F.array(*[F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
                                     for k in range(1, n)]))
        s = s.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        if n < longest:
            for first, name in ((1, "right"), (2, "left")):
                extended = streams[n + 1].select("lang", _part(first, n).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("a"))
                s = _merged(s, extended, F.col("phrase"), name, "left")
            s = s.where(F.coalesce(100 * F.greatest("left", "right") < share * F.col("a"), F.lit(True))).drop("left", "right")
        out = s if out is None else out.unionByName(s)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", "_salt").orderBy(*order)
    few = (out.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some))
           .where(F.col("rank") <= top).drop("_salt", "rank"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("a").alias("n"))
    return ranked.join(total, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
