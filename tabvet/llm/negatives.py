"""Hard-negative mining by a threshold join over integer vectors.

Rows and anchors meet in blocks of bounded size. Inside a block the dimensions are put in
order of energy and kept as posting blocks (``GROUP`` dimensions each); a row is posted only
in as many of them as its suffix norm demands: what is left out cannot reach the threshold by
itself. Partial scores are accumulated from the postings, pairs whose partial score plus the
product of the remaining norms stays below the threshold are pruned, and the rest are completed
exactly, pruned again after each block of dimensions. An anchor's threshold is lowered, which posts
more dimensions, until its windows are full or the threshold has reached their floor. The
first join (rows of the anchor's label) fills the positives; the second fills, for each
positive, the window of scores below it with rows of other labels. Each block pair returns
a bounded number of rows an anchor, and a ranked merge takes the best over all blocks.

Each component x becomes ``floor(scale * x)``; a score is the integer inner product, in
which missing dimensions of a shorter vector count as 0. All sums stay below 2^53, so they are exact.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take
no part, nor do vectors whose scaled norm is above 2^26 (their scores would not be exact).
Of rows that share an id the one with the least (label, vector) stands for it. An empty vector
scores 0. Ties go to the smaller id. An anchor without positives gives no rows. Other
columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import cut

GROUP = 8  # dimensions of a posting block
NORM = float(1 << 26)
LEAST_ROWS, MOST_ROWS = 4096, 65536  # rows of a block
ANCHORS = 16384  # anchors of a block
PAIRS = 1 << 21  # partial scores held at once
_FOUND = "anchor_id long, id long, score long"
_NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def vectors(df: DataFrame, is_anchor: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, q, anchor): one row an id, components scaled and floored."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= NORM))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    usable = F.when(F.coalesce(finite, F.lit(False)), norm <= NORM * NORM).otherwise(False)
    rows = (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                      F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable))
    q = F.transform(v, lambda x: F.floor(x * scale).try_cast("int"))
    return (rows.select("vec_id", F.struct("label", q.alias("q"), "anchor").alias("r"))
            .groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q", "r.anchor"))


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """The list column as rows of numbers, shorter lists filled up with 0."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Postings:
    """Rows posted by blocks of dimensions, the ones of most energy first."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        order = np.argsort(-(rows * rows).sum(0), kind="stable")
        rows, anchors = rows[:, order], anchors[:, order]
        self.groups = [slice(k, k + GROUP) for k in range(0, rows.shape[1], GROUP)]
        self.row_tail, self.anchor_tail = self._tails(rows), self._tails(anchors)
        exact = np.float32 if self.row_tail[0].max(initial=0) * self.anchor_tail[0].max(initial=0) < 1 << 24 else np.float64
        self.rows, self.anchors = rows.astype(exact), anchors.astype(exact)

    def _tails(self, x: np.ndarray) -> np.ndarray:
        """Norms of what lies beyond the first 0, 1, 2, ... blocks of dimensions."""
        squares = np.array([(x[:, g] ** 2).sum(1) for g in self.groups] + [np.zeros(len(x))])
        return np.sqrt(squares[::-1].cumsum(0)[::-1])

    def search(self, which: np.ndarray, levels: list[np.ndarray], settle: Callable) -> None:
        """For the anchors ``which``, find all pairs at or above the threshold of each level in turn.
        ``settle(anchors, rows, scores, active, thresholds)`` takes them and says which of the active anchors are done."""
        n = len(self.rows)
        acc = np.zeros((n, len(which)), self.rows.dtype)
        posted = np.zeros(n, np.int64)
        active = np.arange(len(which))
        every = np.arange(n)
        for level in levels:
            t = level[active]
            tail = self.anchor_tail[:, which[active]]
            covered = self.row_tail * tail.max(1)[:, None] < t.min()
            need = np.where(covered.any(0), covered.argmax(0), len(self.groups))
            for k, g in enumerate(self.groups):
                new = np.flatnonzero((posted <= k) & (k < need))
                if len(new):
                    acc[new] += self.rows[new, g] @ self.anchors[which, g].T
            posted = np.maximum(posted, need)
            bound = acc[:, active] + self.row_tail[posted, every][:, None] * tail[posted]
            r, a = np.nonzero(bound >= t - 1)
            r, a, s = self._complete(r, a, acc[r, active[a]].astype(np.float64), posted, which[active], t)
            left = ~settle(active[a], r, s.astype(np.int64), active, t)
            active = active[left]
            if not len(active):
                return

    def _complete(self, r, a, s, posted, anchors, t):
        """Add the dimensions that weren't posted, block by block, and prune by what remains."""
        for k, g in enumerate(self.groups):
            open_ = np.flatnonzero(posted[r] <= k)
            if len(open_):
                for at in range(0, len(open_), PAIRS // GROUP):
                    o = open_[at:at + PAIRS // GROUP]
                    s[o] += np.einsum("ij,ij->i", self.rows[r[o], g], self.anchors[anchors[a[o]], g])
                rest = np.where(posted[r] <= k + 1, self.row_tail[k + 1, r] * self.anchor_tail[k + 1, anchors[a]], np.inf)
                keep = s + rest >= t[a] - 1
                r, a, s = r[keep], a[keep], s[keep]
        keep = s >= t[a]
        return r[keep], a[keep], s[keep]


def _first(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each anchor's first ``k`` by score, ties by the smaller id."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return order[rank < k]


def _slabs(n_anchors: int, n_rows: int):
    step = max(1, PAIRS // max(1, n_rows))
    return (np.arange(k, min(n_anchors, k + step)) for k in range(0, n_anchors, step))


def _columns(schema: str, parts: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _columns(_FOUND, [])
        a = matrix(anchors.column("anchor_q"))
        y = matrix(rows.column("q"), a.shape[1])
        a = np.pad(a, ((0, 0), (0, y.shape[1] - a.shape[1])))
        post, parts = Postings(y, a), []
        row_id, anchor_id = rows.column("vec_id").to_numpy(), anchors.column("anchor_id").to_numpy()
        reach = post.row_tail[0].max() * post.anchor_tail[0]
        for which in _slabs(len(a), len(y)):
            def settle(c, r, s, active, t):
                other = row_id[r] != anchor_id[which[c]]
                c, r, s = c[other], r[other], s[other]
                done = (np.bincount(c, minlength=len(which))[active] >= k) | (t == -np.inf)
                keep = np.isin(c, active[done])
                c, r, s = c[keep], r[keep], s[keep]
                best = _first(c, s, row_id[r], k)
                parts.append((anchor_id[which[c[best]]], row_id[r[best]], s[best]))
                return done
            levels = [reach[which] * 0.75 ** n for n in range(1, 11)]
            post.search(which, [*levels, np.full(len(which), -np.inf)], settle)
        return _columns(_FOUND, parts)
    return run


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _columns(_NEGATIVES, [])
        a = matrix(anchors.column("anchor_q"))
        y = matrix(rows.column("q"), a.shape[1])
        a = np.pad(a, ((0, 0), (0, y.shape[1] - a.shape[1])))
        post, parts = Postings(y, a), []
        row_id, row_label = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        anchor_id, label = anchors.column("anchor_id").to_numpy(), anchors.column("anchor_label").to_numpy()
        found = anchors.column("positives").to_pylist()
        n = max(len(p) for p in found)
        score = np.array([[x["score"] for x in p] + [-1] * (n - len(p)) for p in found], np.int64)
        ids = np.array([[x["id"] for x in p] + [0] * (n - len(p)) for p in found], np.int64)
        lo, hi = -(-low * score // 100), high * score // 100
        open_ = (score >= 0) & (lo <= hi)
        for which in _slabs(len(a), len(y)):
            which = which[open_[which].any(1)]
            if not len(which):
                continue
            live, floor = open_[which], np.where(open_[which], lo[which], np.iinfo(np.int64).max)
            top, bottom = np.where(live, hi[which], np.iinfo(np.int64).max).min(1), floor.min(1)

            def settle(c, r, s, active, t):
                other = row_label[r] != label[which[c]]
                c, r, s = c[other], r[other], s[other]
                inside = [live[c, w] & (s >= lo[which[c], w]) & (s <= hi[which[c], w]) for w in range(n)]
                full = [~live[active, w] | (t <= floor[active, w]) | (np.bincount(c[i], minlength=len(which))[active] >= k) for w, i in enumerate(inside)]
                done = np.all(full, axis=0)
                ready = np.zeros(len(which), bool)
                ready[active[done]] = True
                for w, i in enumerate(inside):
                    i = np.flatnonzero(i & ready[c])
                    i = i[_first(c[i], s[i], row_id[r[i]], k)]
                    x = which[c[i]]
                    parts.append((anchor_id[x], ids[x, w], score[x, w], row_id[r[i]], s[i]))
                return done
            levels = [np.maximum(np.floor(top * f), bottom).astype(np.float64) for f in (0.9, 0.8, 0.7, 0.6)]
            post.search(which, [*levels, bottom.astype(np.float64)], settle)
        return _columns(_NEGATIVES, parts)
    return run


def _best(df: DataFrame, by: list[str], score: str, row_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), row_id)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, *, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best ``n_positive`` rows
    of the same label, the best ``n_negative`` rows of other labels whose score is ``low`` to ``high`` per cent of the positive's."""
    rows = cut(vectors(df, is_anchor, scale, id_col, vector_col, label_col), "vectors")
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    size = min(MOST_ROWS, max(LEAST_ROWS, -(-n // 64)))
    n_rows, n_anchors = max(1, -(-n // size)), max(1, -(-m // ANCHORS))
    row_block = F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).alias("row_block")
    anchor_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_anchors)).alias("anchor_block")
    every_row, every_anchor = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long"))) for x in (n_rows, n_anchors))
    dealt = rows.select("vec_id", "label", "q", row_block, every_anchor.alias("anchor_block"))
    anchors = rows.where("anchor").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("q").alias("anchor_q"),
                                          anchor_block, every_row.alias("row_block"))
    block = ["row_block", "anchor_block"]

    found = (dealt.groupBy("label", *block).cogroup(anchors.groupBy("anchor_label", *block)).applyInArrow(_positives(n_positive), _FOUND))
    positives = cut(_best(found, ["anchor_id"], "score", "id", n_positive).groupBy("anchor_id")
                    .agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")
    with_windows = anchors.join(positives, "anchor_id")
    near = dealt.groupBy(*block).cogroup(with_windows.groupBy(*block)).applyInArrow(_negatives(n_negative, low, high), _NEGATIVES)
    best = _best(near, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negative)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
