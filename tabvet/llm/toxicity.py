"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the scaled sum of hashed embeddings: of the word itself and of its four-byte grams, so that
inflected forms share parts. Filters of several widths run over the word vectors; each filter's
maximum over the whole text (0 at least) feeds one logistic output. Gradients flow
through the places of the maxima only, a share of the words is left out at random, updates are AdaGrad. Since filters are linear, a filter tap is applied once
to each distinct word of a batch and looked up for each place.

The network is fitted on at most ``PER_CLASS`` labelled documents a class (those of the smallest hash of their id), in
one task, on three quarters of the labelled ids. The thresholds cover all labelled rows of the remaining
quarter: their logits are counted in narrow bins by language, and each language's threshold is where F1
is best. The language is inferred from the text, from word frequencies of the same sample, so that
nothing but the text enters a score. A score is the logistic function of the logit minus the threshold: 0.5 is the threshold.

Defined cases: a null text counts as empty; an empty text has the score of a text whose filters all stay at 0; a null id is never learned from;
of labels that repeat an id the largest counts; null labels aren't learned from. Without both
classes among the labelled rows the score is 0 for all. Languages with fewer than ``LEAST`` rows of
either class among the calibration rows take the threshold of all languages together. Other columns are ignored, an empty
table gives an empty result, very long texts are read whole.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import cut, frugal, mix, rows_of, split_words

PER_CLASS = 3000  # documents of a class that the network is fitted on
BUCKETS = 1 << 16
DIMS, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY, INIT, DROP = 6, 16, 0.08, 0.7, 0.02, 0.3
LEAST = 25
STEP, RANGE = 0.05, 60.0  # of the calibration's bins of logits
BYTES = 1 << 22  # of text scored at once
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E), *b".,;:!?\"'()[]{}<>|/\\#*$%&=+~^_`@-"]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts: number 0 is padding, two of which follow each text."""

    def __init__(self, texts: list[bytes]):
        _, start, words = split_words(texts, _GAP)
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends, start, side="left")
        counts = np.bincount(text, minlength=len(texts))
        pad = max(WIDTHS) - 1
        self.first = np.concatenate(([0], np.cumsum(counts + pad)))[:-1]
        self.length = counts
        self.ids = np.zeros(len(start) + pad * len(texts) + max(WIDTHS), np.int64)
        self.ids[np.arange(len(start)) + pad * text] = words.indices.to_numpy() + 1
        self.pieces, self.piece_at = _pieces(words.dictionary)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        sizes = np.diff(self.piece_at)
        sums = np.add.reduceat(table[self.pieces], self.piece_at[:-1], axis=0) if len(sizes) else np.zeros((0, table.shape[1]), table.dtype)
        return np.vstack([np.zeros((1, table.shape[1]), table.dtype), sums / np.sqrt(sizes)[:, None].astype(table.dtype)])


def _pieces(dictionary: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each distinct word's parts: the word, then its four-byte grams with borders; and where each word's begin."""
    n = len(dictionary)
    lengths = np.diff(np.frombuffer(dictionary.buffers()[1], np.int64)[dictionary.offset:dictionary.offset + n + 1]) if n else np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join([b"<" + w + b">" for w in dictionary.to_pylist()]) + b"\0\0\0", np.uint8).astype(np.uint64)
    size = lengths + 2
    begin = np.concatenate(([0], np.cumsum(size)))
    gram = raw[:-3] | raw[1:-2] << np.uint64(8) | raw[2:-1] << np.uint64(16) | raw[3:] << np.uint64(24)
    inside = np.arange(len(gram)) + 4 <= np.repeat(begin[1:], size)
    place = mix(np.arange(1, len(gram) + 1, dtype=np.uint64) - np.repeat(begin[:-1], size).astype(np.uint64) + _ODD)
    whole = mix(np.add.reduceat(mix(raw[:-3] + place), begin[:-1])) if n else np.zeros(0, np.uint64)
    grams = np.add.reduceat(inside, begin[:-1]) if n else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(grams + 1)))
    out = np.empty(at[-1], np.int64)
    is_word = np.zeros(at[-1], bool)
    is_word[at[:-1]] = True
    out[is_word] = (whole >> np.uint64(32)).astype(np.int64) % BUCKETS
    out[~is_word] = (mix(gram[inside]) >> np.uint64(32)).astype(np.int64) % BUCKETS
    return out, at


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.table = (r.normal(size=(BUCKETS, DIMS)) * INIT).astype(np.float32)
        self.taps = [(r.normal(size=(w, DIMS, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (np.abs(r.normal(size=len(WIDTHS) * FILTERS)) * np.tile([1, -1], len(WIDTHS) * FILTERS // 2) * 0.3).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def responses(self, words: Words, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the filters' responses at all places; 0 at padding."""
        n = len(words.ids) - max(WIDTHS)
        for taps, bias in zip(self.taps, self.bias):
            out = np.zeros((n, FILTERS), np.float32)
            for j, tap in enumerate(taps):
                out += (vectors @ tap)[words.ids[j:n + j]]
            out += bias
            out[words.ids[:n] == 0] = 0
            yield out

    def logits(self, words: Words) -> np.ndarray:
        pooled = [np.maximum(np.maximum.reduceat(r, words.first, axis=0), 0) for r in self.responses(words, words.vectors(self.table))]
        return np.hstack(pooled) @ self.out + self.base[0]

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 2) -> None:
        rng, memory = np.random.default_rng(seed), [np.full_like(p, 1e-3) for p in self.parameters()]
        share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        for epoch in range(EPOCHS):
            self.table *= DECAY if epoch else 1
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                rows = order[k:k + BATCH]
                words = Words([texts[i] for i in rows])
                words.ids[rng.random(len(words.ids)) < DROP] = 0
                self._step(words, labels[rows], share[rows], memory, RATE / (1 + epoch))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.taps, *self.bias, self.out, self.base]

    def _step(self, words: Words, y: np.ndarray, share: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
        vectors, places, pooled = words.vectors(self.table), [], []
        for r in self.responses(words, vectors):
            at = np.array([f + r[f:f + n].argmax(0) if n else np.full(FILTERS, f) for f, n in zip(words.first, words.length)])
            places.append(at)
            pooled.append(np.maximum(r[at, np.arange(FILTERS)], 0))
        h = np.hstack(pooled)
        z = h @ self.out + self.base[0]
        dz = ((1 / (1 + np.exp(-z)) - y) * share / len(y)).astype(np.float32)
        gradients = {len(memory) - 2: h.T @ dz, len(memory) - 1: dz.sum(keepdims=True)}
        dv = np.zeros_like(vectors)
        dh = dz[:, None] * self.out * (h > 0)
        for i, at in enumerate(places):
            g = dh[:, i * FILTERS:(i + 1) * FILTERS]
            gradients[1 + len(WIDTHS) + i] = g.sum(0)
            d = np.empty_like(self.taps[i])
            for j in range(WIDTHS[i]):
                ids = words.ids[at + j]
                d[j] = np.einsum("bf,bfd->df", g, vectors[ids])
                np.add.at(dv, ids.ravel(), (g[:, :, None] * self.taps[i][j].T).reshape(-1, DIMS))
            gradients[1 + i] = d
        touched = np.flatnonzero(np.abs(dv[1:]).sum(1))
        sizes = np.diff(words.piece_at)[touched]
        flat = np.repeat(words.piece_at[:-1][touched], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        buckets, inverse = np.unique(words.pieces[flat], return_inverse=True)
        grad = np.zeros((len(buckets), DIMS), np.float32)
        np.add.at(grad, inverse, np.repeat(dv[1:][touched] / np.sqrt(sizes)[:, None], sizes, axis=0))
        memory[0][buckets] += grad ** 2
        self.table[buckets] -= rate * grad / np.sqrt(memory[0][buckets])
        for i, p in enumerate(self.parameters()[1:], 1):
            memory[i] += gradients[i] ** 2
            p -= rate * gradients[i] / np.sqrt(memory[i])


class Model:
    """The network and the word frequencies by language."""

    def __init__(self, network: Network, langs: list[str], words: np.ndarray):
        self.network, self.langs, self.words = network, langs, words

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, list[str | None]]:
        words = Words(texts)
        z = self.network.logits(words)
        if not self.langs:
            return z, [None] * len(texts)
        likely = np.vstack([np.zeros((1, len(self.langs)), np.float32), self.words[words.pieces[words.piece_at[:-1]]]])
        sums = np.add.reduceat(likely[words.ids[:-max(WIDTHS)]], words.first, axis=0)
        return z, [self.langs[k] if n else None for k, n in zip(sums.argmax(1), words.length)]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.network.parameters(), self.words, np.array(self.langs, dtype="U"))
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        parts = [v for _, v in np.load(io.BytesIO(raw)).items()]
        network = Network()
        network.table, n = parts[0], len(WIDTHS)
        network.taps, network.bias, network.out, network.base = parts[1:1 + n], parts[1 + n:1 + 2 * n], parts[1 + 2 * n], parts[2 + 2 * n]
        return Model(network, parts[-1].tolist(), parts[-2])


def train(rows: list[tuple[str | None, str | None, int]]) -> Model:
    """From (text, language, label) rows."""
    texts = [(t or "").encode().lower() for t, _, _ in rows]
    network = Network()
    network.fit(texts, np.array([y for _, _, y in rows]))
    langs = sorted({g for _, g, _ in rows if g is not None})
    counts = np.full((BUCKETS, len(langs)), 0.1)
    for k, g in enumerate(langs):
        for i in range(0, len(rows), 64):
            words = Words([t for t, r in zip(texts[i:i + 64], rows[i:i + 64]) if r[1] == g])
            used = words.ids[words.ids > 0] - 1
            np.add.at(counts[:, k], words.pieces[words.piece_at[:-1][used]], 1)
    return Model(network, langs, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32))


def fit(df: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        label_col: str = "toxic") -> bytes | None:
    """A stored model from at most ``per_class`` documents of each label, None without both labels. ``learn`` is a condition on ``labels``."""
    known = known_labels(labels, learn, id_col, label_col).where(~for_calibration())
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = docs.join(F.broadcast(picked), F.col("doc") == F.col("id")).select("doc", "text", "lang", "y")

    def run(batches):
        rows = sorted(((d, t, g, y) for b in batches for d, t, g, y in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        if {r[3] for r in rows} == {0, 1}:
            yield pa.RecordBatch.from_arrays([pa.array([train([r[1:] for r in rows]).dump()], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(frugal(run), "model binary").first()
    return got and bytes(got[0])


def known_labels(labels: DataFrame, learn: Column, id_col: str, label_col: str) -> DataFrame:
    rows = labels.where(learn).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    return rows.where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))


def for_calibration() -> Column:
    return F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 3


def logits(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, z, lang) of every row; ``lang`` is inferred."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = Model.load(shared.value)
        for ids, texts in rows_of(batches, 1024):
            raw = [t.encode().lower() for t in texts]
            at = np.cumsum([0, *map(len, raw)]) // BYTES
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(at[:-1])) + 1, [len(raw)])).tolist()
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    z, langs = m.judge(raw[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(z.astype(float)), pa.array(langs, pa.string())], names=["doc_id", "z", "lang"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(frugal(run), "doc_id long, z double, lang string")


def best_threshold(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit above which F1 is best: the middle of the best stretch between occupied bins."""
    order = np.argsort(bins)
    bins, toxic, clean = bins[order], toxic[order], clean[order]
    hit, wrong = toxic[::-1].cumsum()[::-1], clean[::-1].cumsum()[::-1]
    k = int(np.argmax(2 * hit / (hit + wrong + toxic.sum())))
    low = bins[k - 1] + 1 if k else bins[k]
    return float((low + bins[k]) / 2 * STEP)


def thresholds(scored: DataFrame, known: DataFrame) -> dict[str | None, float]:
    """A threshold for each inferred language, and one for all (None), from all labelled calibration rows."""
    near = F.floor(F.greatest(F.least("z", F.lit(RANGE)), F.lit(-RANGE)) / STEP).cast("int").alias("b")
    rows = (scored.join(known.where(for_calibration()), F.col("doc_id") == F.col("id")).groupBy("lang", near)
            .agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).collect())
    parts: dict[str | None, list] = {}
    for lang, b, toxic, clean in rows:
        parts.setdefault(lang, []).append((b, toxic, clean))
    every: dict[int, list[int]] = {}
    for b, toxic, clean in (x for p in parts.values() for x in p):
        old = every.setdefault(b, [0, 0])
        every[b] = [old[0] + toxic, old[1] + clean]
    table = lambda rows: [np.array(c) for c in zip(*rows)]
    out = {None: best_threshold(*table([(b, *c) for b, c in every.items()])) if any(c[0] for c in every.values()) else 0.0}
    for lang, rows in parts.items():
        b, toxic, clean = table(rows)
        if lang is not None and min(toxic.sum(), clean.sum()) >= LEAST:
            out[lang] = best_threshold(b, toxic, clean)
    return out


def score(df: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "toxic") -> DataFrame:
    """(doc_id, score, predicted, lang) of every row of ``df``, learned from the rows of ``labels`` that meet ``learn``."""
    model = fit(df, labels, learn, per_class=per_class, id_col=id_col, text_col=text_col, lang_col=lang_col, label_col=label_col)
    if model is None:
        return df.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast("string").alias("lang"))
    scored = cut(logits(df, model, id_col, text_col), "logits")
    at = thresholds(scored, known_labels(labels, learn, id_col, label_col))
    threshold = F.lit(at[None])
    for lang, t in at.items():
        if lang is not None:
            threshold = F.when(F.col("lang") == lang, F.lit(t)).otherwise(threshold)
    value = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), threshold - F.col("z")))))
    out = scored.select("doc_id", value.alias("score"), "lang")
    return out.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "lang")
