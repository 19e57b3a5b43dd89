"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

1. Every document's words (A-Z lower-cased) give 5-word shingle hashes. A window whose
   weighted similarity to an item reaches the threshold shares shingles with it, so windows
   are laid only where a shingle of an item occurs: as long as the item, so placed that the
   shared shingle has the item's offset. All other windows are skipped without loss.
2. A window's fingerprint is the 64-bit SimHash of its words. Bit counts are kept in packed
   lanes: ``(hash >> j) & 0x0101..`` adds one to each of eight 8-bit counters, so a window
   is summed in eight longs (wider lanes for items of more than 255 words).
3. Multi-index: the fingerprint is cut into ``RADIUS + 1`` blocks. Fingerprints within
   ``RADIUS`` bits agree on a block, so an equi-join on (length, block number, block) finds
   every pair within the radius; the Hamming distance is then checked.
4. The candidates are verified by exact similarity of their shingles weighted by frequency
   (sum of minima over sum of maxima) against ``threshold``.

The benchmark side of a join is broadcast only if its counted size is within a bound.

Defined cases: null or empty documents and items match nothing; an item of fewer than five
words is one shingle; an item id with several texts is searched by each of them, and rows that repeat a
document id count as one document; null ids
never match; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import cut, only_ids, texts_of

SHINGLE = 5
RADIUS = 15
BROADCAST_SHINGLES = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def word_hashes(text: Column) -> Column:
    """array<long>: the hashes of a text's words; empty for null."""
    trimmed = F.btrim(F.translate(text, _UPPER, _LOWER), F.lit(_SPACES))
    words = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+", -1), lambda w: F.xxhash64(w))
    return F.when(F.length(trimmed) > 0, words).otherwise(F.array().cast("array<long>"))


def shingles(words: Column, k: int) -> Column:
    """array<long>: the hash of the k words from each position on."""
    at = lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)])
    return F.slice(F.transform(words, at), F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def simhash(words: Column, lane: int) -> Column:
    """The 64-bit SimHash of an array of hashes that has fewer than 2^lane elements."""
    ones = sum(1 << k for k in range(0, 64, lane))
    tops = F.lit(_signed(ones << (lane - 1)))
    half = F.floor(F.size(words) / 2).cast("long")
    add = (F.lit((1 << (lane - 1)) - 1) - half)  # lifts a count above half over the lane's top bit
    out = F.lit(0).cast("long")
    for j in range(lane):
        total = F.aggregate(words, F.lit(0).cast("long"), lambda a, x: _plus(a, F.shiftrightunsigned(x, j).bitwiseAND(F.lit(_signed(ones)))))  # noqa: B023
        high = F.shiftrightunsigned(_plus(total, _spread(add, lane)).bitwiseAND(tops), lane - 1)
        out = out.bitwiseOR(F.shiftleft(high, j))
    return out


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _plus(a: Column, b: Column) -> Column:
    """a + b mod 2^64 for lanes that don't carry into each other: added without the sign bits,
    which are put back by exclusive or, so ANSI mode sees no overflow."""
    low = F.lit((1 << 62) - 1)
    top = F.lit(_signed(3 << 62))
    s = a.bitwiseAND(low) + b.bitwiseAND(low)
    carry = F.shiftrightunsigned(s, 62)
    high = F.shiftrightunsigned(a.bitwiseAND(top), 62) + F.shiftrightunsigned(b.bitwiseAND(top), 62) + carry
    return s.bitwiseAND(low).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(3).cast("long")), 62))


def _spread(x: Column, lane: int) -> Column:
    """A small number in each lane."""
    out = x
    for k in range(lane, 64, lane):
        out = out.bitwiseOR(F.shiftleft(x, k))
    return out


def _blocks(fp: Column, radius: int) -> Column:
    """array of (number, bits): the fingerprint cut into radius + 1 blocks."""
    n, at, out = radius + 1, 0, []
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append(F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("bits")))
        at += width
    return F.array(*out)


def _times(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays: sum of least over sum of greatest counts."""
    both = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, x: n + F.least(_times(a, x), _times(b, x)))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", *, threshold: float = 0.75, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): each document's best window for each
    item it leaks; ``start`` counts words from 0."""
    docs = texts_of(docs, id_col, text_col).where("doc_id is not null")
    own = items.select(F.col(item_col).cast("long").alias("item_id"), word_hashes(F.col(item_text_col).cast("string")).alias("iw")).where("item_id is not null and size(iw) > 0")
    own = cut(own.distinct().withColumn("len", F.size("iw")).withColumn("tid", F.xxhash64("iw")), "items")
    stats = own.agg(F.max("len").alias("longest"), F.sum("len").alias("all"), F.collect_set(F.least("len", F.lit(SHINGLE))).alias("sizes")).first()
    small = (stats["all"] or 0) <= BROADCAST_SHINGLES
    light = F.broadcast if small else lambda d: d
    lane = next(w for w in (8, 16, 32) if (stats["longest"] or 0) < 1 << w)

    words = docs.select("doc_id", word_hashes(F.col("text")).alias("w"))
    found = None
    for k in sorted(stats["sizes"]):
        of = own.where(F.least("len", F.lit(SHINGLE)) == k)
        seeds = light(of.select("len", F.posexplode(shingles(F.col("iw"), k)).alias("off", "sh")).distinct())
        part = words.select("doc_id", F.posexplode(shingles(F.col("w"), k)).alias("pos", "sh")).join(seeds, "sh")
        part = part.select("doc_id", "len", (F.col("pos") - F.col("off")).alias("start"))
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start int, n_words int")
    places = cut(found.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("len", "start")).alias("places")), "places")

    near = only_ids(docs, places.select("doc_id")).join(places.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
    near = near.select("doc_id", word_hashes(F.col("text")).alias("w"), F.explode("places").alias("x"))
    first = F.greatest(F.col("x.start"), F.lit(0))
    window = F.slice("w", first + 1, F.greatest(F.col("x.start") + F.col("x.len") - first, F.lit(0)))
    windows = near.select("doc_id", F.col("x.len").alias("len"), first.alias("start"), window.alias("ww")).where("size(ww) > 0")
    windows = cut(windows.withColumn("fp", simhash(F.col("ww"), lane)), "windows")

    side = lambda d, fp, *more: d.select(*more, "len", F.col(fp), F.explode(_blocks(F.col(fp), radius)).alias("b")).select(*more, "len", fp, F.col("b.no").alias("no"), F.col("b.bits").alias("bits"))
    index = side(own.withColumn("ifp", simhash(F.col("iw"), lane)), "ifp", "item_id", "tid")
    keys = side(windows.select("len", "fp").distinct(), "fp")
    close = keys.join(light(index), ["len", "no", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("len", "fp", "item_id", "tid").distinct()
    pairs = windows.join(close, ["len", "fp"]).join(light(own.select("item_id", "tid", "iw")), ["item_id", "tid"])
    grams = lambda c: F.when(F.least("len", F.lit(SHINGLE)) == SHINGLE, shingles(F.col(c), SHINGLE)).otherwise(F.array(F.xxhash64(F.col(c))))
    scored = pairs.withColumn("similarity", similarity(grams("ww"), grams("iw"))).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"), F.size("ww").alias("n_words")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.similarity", (-F.col("x.at")).alias("start"), "x.n_words")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item."""
    return only_ids(docs, cut(leaks(docs, items, id_col, text_col, **options).select("doc_id").distinct(), "leaking"), "left_anti", id_col)
