"""Line dedup by winnowing over line hashes.

A document is its sequence of non-blank lines (stripped, hashed). Its fingerprints are
2-line grams that are the minimum of a window of ``WINDOW`` neighbouring grams, every
2-line gram of ``LONG`` words or more, and every line of ``LINE`` words or more; shorter lines
repeat by chance and go only as part of a run. So two documents that share a run of three
lines, or a line of ``LINE`` words, share a fingerprint. Each fingerprint's first occurrence (smallest
doc_id, then position) is the source of all its later ones; a match is extended line by
line in both directions and the later run is deleted. Every deleted line equals one at an
earlier place, so the first copy of any line stays.

Defined cases: null or empty text has no lines and stays; blank lines are kept and don't
interrupt runs; rows that repeat an id with the same text are one document; rows with a
null id, or an id with different texts, stay as they are and are no source; a document
whose lines all go keeps its row with an empty text; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tabvet.llm.common import cut, free_name, frugal, list_array, mix, rows_of, signed, texts_of

WINDOW = 2
LONG = 50
LINE = 9
BROADCAST_LINES = 2_000_000  # line numbers; more are joined by shuffling
_SPACE = b" \t\n\x0b\x0c\r"


def fingerprints(h: np.ndarray, words: np.ndarray, window: int = WINDOW, long: int = LONG, line: int = LINE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the chosen grams of a document's lines."""
    one = np.flatnonzero(words >= min(line, long))
    grams = mix(h[:-1] * np.uint64(3) + mix(h[1:]))
    keep = words[:-1] + words[1:] >= long
    if 0 < len(grams) < window:
        keep[grams.argmin()] = True
    for k in range(len(grams) - window + 1):
        keep[k + int(grams[k:k + window].argmin())] = True
    two = np.flatnonzero(keep)
    return np.concatenate((mix(h[one] + np.uint64(1)), grams[two])), np.concatenate((one, two))


def _line_table(docs: DataFrame, window: int, long: int) -> DataFrame:
    """(doc_id, whole, h, at, fp, pos): line hashes with their line numbers, and fingerprints."""
    def run(batches):
        for ids, texts in rows_of(batches):
            h, at, fp, pos = [], [], [], []
            for text in texts:
                lines = [(k, x) for k, line in enumerate(text.encode().split(b"\n")) if (x := line.strip(_SPACE))]
                h.append(np.array([xxh3_64_intdigest(x) for _, x in lines], np.uint64))
                at.append(np.array([k for k, _ in lines], np.int32))
                f, p = fingerprints(h[-1], np.array([len(x.split()) for _, x in lines], np.int64), window, long)
                fp.append(f)
                pos.append(p.astype(np.int32))
            whole = [xxh3_64_intdigest(t.encode()) for t in texts]
            lists = [list_array(signed(np.concatenate(x)) if x[0].dtype == np.uint64 else np.concatenate(x), list(map(len, x)), kind)
                     for x, kind in ((h, pa.int64()), (at, pa.int32()), (fp, pa.int64()), (pos, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(signed(np.array(whole, np.uint64))), *lists], names=["doc_id", "whole", "h", "at", "fp", "pos"])

    return docs.mapInArrow(frugal(run), "doc_id long, whole long, h array<long>, at array<int>, fp array<long>, pos array<int>")


def _extend(matches: DataFrame) -> DataFrame:
    """(doc_id, removed): the line numbers of the maximal runs around matches (p, q)."""
    def run(batches):
        for batch in batches:
            docs, removed = [], []
            for doc, a, at, b, p, q in zip(*(batch.column(i) for i in range(6))):
                a, at, b = (x.values.to_numpy() for x in (a, at, b))
                gone, p, q = set(), p.values.to_numpy(), q.values.to_numpy()
                done: dict[int, int] = {}  # diagonal -> end of its last run
                for i, j in sorted(zip(p.tolist(), q.tolist())):
                    if i < done.get(i - j, 0) or i >= len(a) or j >= len(b) or a[i] != b[j]:
                        continue
                    lo, hi, d = i, i + 1, i - j
                    while lo > 0 and lo - d > 0 and a[lo - 1] == b[lo - 1 - d]:
                        lo -= 1
                    while hi < len(a) and hi - d < len(b) and a[hi] == b[hi - d]:
                        hi += 1
                    done[d] = hi
                    gone.update(at[lo:hi].tolist())
                docs.append(doc)
                removed.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([pa.array([d.as_py() for d in docs], pa.int64()), pa.array(removed, pa.list_(pa.int32()))], names=["doc_id", "removed"])

    return matches.select("doc_id", "h", "at", "src_h", "p", "q").mapInArrow(frugal(run), "doc_id long, removed array<int>")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(doc_id, removed): for documents with later copies of runs, their line numbers (from 0)."""
    raw = _line_table(texts_of(df, id_col, text_col).where("doc_id is not null and text is not null"), window, long)
    one = raw.groupBy("doc_id").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi"), *[F.first(c).alias(c) for c in ("h", "at", "fp", "pos")])
    lines = cut(one.where("lo = hi").drop("lo", "hi"), "lines")
    found = lines.select("doc_id", F.explode(F.arrays_zip("fp", "pos")).alias("x")).select("doc_id", F.col("x.pos").alias("pos"), F.col("x.fp").alias("fp"))
    firsts = (found.groupBy("fp").agg(F.min(F.struct("doc_id", "pos")).alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("fp", F.col("src.doc_id").alias("src_id"), F.col("src.pos").alias("src_pos")))
    later = found.join(firsts, "fp").where("doc_id <> src_id or pos <> src_pos")
    pairs = later.groupBy("doc_id", "src_id").agg(F.collect_list(F.struct("pos", "src_pos")).alias("m"))
    pairs = pairs.select("doc_id", "src_id", F.col("m.pos").alias("p"), F.col("m.src_pos").alias("q"))
    source = lines.select(F.col("doc_id").alias("src_id"), F.col("h").alias("src_h"))
    runs = _extend(pairs.join(source, "src_id").join(lines.select("doc_id", "h", "at"), "doc_id"))
    return runs.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, report: bool = False, **options) -> DataFrame:
    """``df`` with repeated lines cut from its text (and ``n_chars``, if it has that column,
    brought up to date); with ``report`` the removed line numbers as column ``removed``."""
    runs = cut(repeated_lines(df, id_col, text_col, **options).where("size(removed) > 0"), "runs")
    total = runs.agg(F.sum(F.size("removed") + 4).alias("n")).first()["n"] or 0
    key, gone = (free_name(df, c) for c in ("_id", "_removed"))
    right = runs.select(F.col("doc_id").alias(key), F.col("removed").alias(gone))
    if total <= BROADCAST_LINES:
        right = F.broadcast(right)
    out = df.join(right, df[id_col].cast("long") == right[key], "left")
    rest = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    cols = [text.alias(c) if c == text_col else
            F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(text)).cast(df.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in df.columns]
    return out.select(*cols, *([F.coalesce(F.col(gone), F.array().cast("array<int>")).alias("removed")] if report else []))
