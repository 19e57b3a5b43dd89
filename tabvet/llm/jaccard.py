"""N-gram Jaccard join by parity sketches.

1. One pass over the texts gives each document its number of distinct five-word shingles,
   two hashes that identify the set and a dense parity sketch (1024 bits); a second one
   the block keys of the pigeonhole join (:mod:`tabvet.llm.sketch`), without storing them
   first. Of copies that one task reads only the first emits keys.
2. Keys are shuffled once; a window finds keys of two or more different sets. Each set is
   paired with that set of its key whose keys are held most (a star, one row per set and
   key, not all pairs): of a text and its near copies that is the text they all resemble.
   Size and Hamming bounds and the number of shared keys drop most pairs (step 3 sees those
   that share more under other sets' stars), then the shingle sets are compared exactly.
3. Links give components. A second pass over the keys pairs only sets that are still in
   different components, again under the size and Hamming bounds inside the join, keeps
   those that share as many keys as sets that near must, and compares them exactly;
   their links join whole components, so few edges are left. So no link between different components is lost and a
   large group of near copies never becomes all its pairs.

Document copies are collapsed to one class by (size, two 64-bit set hashes).

Defined cases: null or empty text and text without words have no shingle and link with
nothing; fewer words than ``k`` are one shingle; rows that repeat a doc_id with
other texts are documents of their own, each in its own text's component; a text of rows with null ids links
like any other, and a null doc_id never names a component unless nothing else is in it; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabvet.llm.common import BROADCAST_IDS, cut, frugal, list_array, mix, only_ids, rows_of, shingle_sets, signed, texts_of
from tabvet.llm.graph import components
from tabvet.llm.sketch import block_keys, dense_sketch, shared_keys

SKETCH_WORDS = 16


def _class_hashes(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=np.uint64)) ^ len(s), int(np.bitwise_xor.reduce(s)) if len(s) else 0


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """Size, class hashes and dense sketch of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            sets, none = shingle_sets(texts, k), np.zeros(0, np.uint64)
            c = signed(np.array([_class_hashes(s) for s in sets], np.uint64).reshape(-1))
            sk = [dense_sketch(s, SKETCH_WORDS) if len(s) else none for s in sets]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(c[::2]), pa.array(c[1::2]),
                list_array(signed(np.concatenate(sk)), list(map(len, sk)), pa.int64()),
            ], names=["doc_id", "n", "c1", "c2", "sketch"])

    return docs.mapInArrow(frugal(run), "doc_id long, n long, c1 long, c2 long, sketch array<long>")


def _keys(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(c1, key) rows for the join; of the copies that one task reads only the first has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, texts in rows_of(batches):
            sets = {}
            for s in shingle_sets(texts, k):
                if len(s) and (c := _class_hashes(s)) not in seen:
                    seen.add(c)
                    sets[c] = s
            row, key = block_keys(list(sets.values()), p, q)
            c1 = np.array([c for c, _ in sets], np.uint64)[row] if sets else key
            yield pa.RecordBatch.from_arrays([pa.array(signed(c1)), pa.array(signed(key))], names=["c1", "key"])

    return docs.mapInArrow(frugal(run), "c1 long, key long")


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The labels (u, v) of the pairs (a, b) whose sets reach Jaccard p/q, counted exactly."""
    one = lambda side: sets.select(F.col("c1").alias(side), F.col("s").alias(f"s{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("u", "v", "sa", "sb")

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(u, v, assume_unique=True))
                if q * both >= p * (len(u) + len(v) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(frugal(run), "u long, v long").distinct()


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(c1, s): the class and the shingles of each (doc_id, text, c1) row whose text is of
    that class, or of any class if c1 is null; an id may be repeated with other texts."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = shingle_sets([t or "" for t in part.column(1).to_pylist()], k)
                c1 = pa.array(signed(np.array([_class_hashes(s)[0] for s in sets], np.uint64)))
                own = pc.coalesce(pc.equal(part.column(2), c1), True)
                yield pa.RecordBatch.from_arrays([c1, list_array(signed(np.concatenate(sets)), list(map(len, sets)), pa.int64())], names=["c1", "s"]).filter(own)

    return docs.mapInArrow(frugal(run), "c1 long, s array<long>")


def _near(a: str, b: str, p: int, q: int) -> F.Column:
    """Size and Hamming bounds on two classes' (n, sketch words)."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    hamming = sum((F.bit_count(F.col(f"w{a}{i}").bitwiseXOR(F.col(f"w{b}{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (F.least(na, nb) * q >= F.greatest(na, nb) * p) & (hamming * (q + p) <= (na + nb) * (q - p))


def _enough(n: F.Column, na: F.Column, nb: F.Column, p: int, q: int) -> F.Column:
    """Whether ``n`` shared keys are as many as near sets of these sizes have."""
    differ = F.floor((na + nb) * (q - p) / (q + p)).cast("long")
    return n >= shared_keys(0) + F.floor(differ / 8)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5,
                       p: int = 75, q: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents link when the Jaccard
    similarity of their ``k``-word shingle sets is at least p/q."""
    docs = texts_of(df, id_col, text_col)
    sig = cut(_signatures(docs, k), "signatures")
    classes = cut(sig.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")

    by_key = Window.partitionBy("key")
    live = cut(_keys(docs, k, p, q)
               .select("key", "c1", F.lag("c1").over(by_key.orderBy("c1")).alias("before"), F.min("c1").over(by_key).alias("lo"),
                       F.max("c1").over(by_key).alias("hi"), F.count(F.lit(1)).over(by_key).alias("held"))
               .where("lo <> hi and (before is null or before <> c1)").select("key", "c1", "held"), "live")
    fame = live.groupBy("c1").agg(F.sum("held").alias("fame"))
    by_fame = by_key.orderBy(F.desc("fame"), "c1")
    starred = live.join(fame, "c1").select("c1", F.first("c1").over(by_fame).alias("pivot")).where("c1 <> pivot")

    words = [F.col("sketch")[i] for i in range(SKETCH_WORDS)]
    side = lambda s: classes.select(F.col("c1").alias(s), F.col("n").alias(f"n{s}"), *[w.alias(f"w{s}{i}") for i, w in enumerate(words)])
    stars = starred.groupBy(F.col("pivot").alias("a"), F.col("c1").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    likely = _near("a", "b", p, q) & _enough(F.col("shared"), F.col("na"), F.col("nb"), p, q)
    stars = cut(stars.join(side("a"), "a").join(side("b"), "b").where(likely).select("a", "b"), "stars")
    first = cut(_links(stars.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v")), docs, classes, k, p, q), "links")
    roots = components(first, "u", "v")

    member = live.select("key", "c1").join(roots.withColumnRenamed("node", "c1"), "c1", "left").withColumn("root", F.coalesce("root", "c1"))
    member = cut(member, "members")
    mixed = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    part = member.join(mixed, "key", "left_semi")
    one = lambda s: part.select("key", F.col("c1").alias(s), F.col("root").alias(f"r{s}")).join(side(s), s)
    rest = one("a").join(one("b"), "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _near("a", "b", p, q))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    enough = _enough(F.count(F.lit(1)), F.first("na"), F.first("nb"), p, q)
    rest = rest.groupBy("a", "b").agg(enough.alias("enough"), F.first("ra").alias("u"), F.first("rb").alias("v")).where("enough").drop("enough")
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    second = cut(_links(rest, docs, classes, k, p, q), "links")
    merged = components(second, "u", "v").select(F.col("node").alias("root"), F.col("root").alias("last"))

    # A class is (c1, c2, n); sets that share c1 alone are told apart by the exact comparison's inputs below.
    member_of = classes.join(roots.withColumnRenamed("node", "c1"), "c1", "left").withColumn("root", F.coalesce("root", "c1"))
    member_of = member_of.join(merged, "root", "left").withColumn("root", F.coalesce("last", "root"))
    smallest = member_of.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member_of.join(smallest, "root").select("c1", "c2", F.col("n").alias("n_shingles"), "component_id")
    out = sig.select("doc_id", "c1", "c2", F.col("n").alias("n_shingles")).join(named, ["c1", "c2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, p: int, q: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("c1")).union(pairs.select(F.col("b").alias("c1"))).distinct()
    reps = cut(classes.join(wanted, "c1", "left_semi").where("rep is not null").select(F.col("rep").alias("doc_id"), "c1"), "reps")
    few = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    sets = _shingle_sets(docs.join(few, "doc_id").select("doc_id", "text", "c1"), k)
    nameless = classes.join(wanted, "c1", "left_semi").where("rep is null").select("c1")  # all their rows have null ids
    lost = _shingle_sets(docs.where("doc_id is null").withColumn("c1", F.lit(None).cast("long")), k).join(nameless, "c1", "left_semi")
    sets = sets.union(lost).groupBy("c1").agg(F.first("s").alias("s"))
    return _verified(pairs, sets, p, q)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without the near copies: of each component the smallest id stays.
    All columns are returned; documents without words stay."""
    found = cut(jaccard_components(df, id_col, text_col, **options).where("doc_id <> component_id").select("doc_id"), "copies")
    return only_ids(df, found, "left_anti", id_col)
