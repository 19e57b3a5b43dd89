"""Byte-level BPE encoding and decoding with a ``tokenizers`` file.

Exactness rests on three facts. (1) No pre-token holds white space behind another
character, so the place before a white-space character that follows another character
always separates pre-tokens: texts are cut there, the pieces of a batch are numbered by an exact
dictionary, and each distinct piece is encoded once; a worker keeps a bounded number of them.
(2) Inside a pre-token an encoding is the one sequence whose neighbouring tokens are all
stable as pairs. (3) So two encoded halves may be joined by re-encoding a window around
the join that starts and ends at token borders: if its first token is the left half's and
its last the right half's, every pair in the joined sequence is stable. Otherwise the
window grows. A very long pre-token is encoded as a tree of such joins.

Long documents are cut into segments and leaves that are encoded as rows of their own, in
parallel, and put together per document.

Defined cases: null text is empty and gives no ids; every input row gives one output row,
repeated ids included; a null doc_id stays null; other columns are ignored; an empty table
gives an empty result. Special tokens that occur in a text become their ids, as in the
library with ``add_special_tokens=False``.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import frugal, rows_of, texts_of

LEAF = 4096  # bytes of a pre-token that are encoded at once
SEGMENT = 1 << 16  # characters of a text above which it is encoded as several rows
CACHE = 20_000  # entries of a cache generation; a worker holds a few (some 10 MB)
KNOWN = 1 << 18  # short pieces that a worker keeps with their ids, in flat arrays (some 20 MB)
BYTES = 1 << 22  # of text encoded at once
BLOCK = 1 << 11  # bytes of distinct pieces given to the library at once
_TOUCH = re.compile(r"\s[ \n]|[ \n]\s")
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LIKE_SPACE = np.zeros(256, bool)  # last bytes of characters that may be white space
_LIKE_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_encoders: dict[str, Encoder] = {}


def behind_space(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters before the places ``at`` of some UTF-8 bytes are white space, Unicode's included."""
    out = _LIKE_SPACE[a[at - 1]]
    some = np.flatnonzero(out & (a[at - 1] >= 0x80))
    for k in some.tolist():
        out[k] = a[max(0, at[k] - 4):at[k]].tobytes().decode("utf-8", "ignore")[-1:].isspace()
    return out


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept for as long as the worker lives."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Cache(dict):
    """The latest entries: when full, they become ``old`` and make room for the next."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def put(self, key: str, ids: bytes) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = ids


class Encoder:
    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        kind = type(t.pre_tokenizer).__name__
        if kind != "ByteLevel" or t.normalizer is not None or t.pre_tokenizer.add_prefix_space:
            raise ValueError(f"{path}: a byte-level BPE without normalizer and prefix space is needed, not {kind}")
        self.leaf, self.model = leaf, t.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: these bytes stand for themselves
        other = [b for b in range(256) if b not in plain]
        to_char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.chars = "".join(to_char[b] for b in range(256))
        to_byte = {c: b for b, c in to_char.items()}
        added = {i: a.content for i, a in t.get_added_tokens_decoder().items()}
        self.added = re.compile("(" + "|".join(sorted(map(re.escape, added.values()), key=len, reverse=True)) + ")") if added else None
        self.strings = {i: s for s, i in t.get_vocab().items()}
        self.bytes = {i: added[i].encode() if i in added else bytes(to_byte[c] for c in s) for i, s in self.strings.items()}
        self.size_of = np.zeros(max(self.bytes, default=0) + 1, np.int64)
        self.size_of[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        self.known = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.pieces, self.tokens, self.other = Cache(CACHE), Cache(CACHE), Cache(CACHE // 10)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _TOUCH.search(text):
            return b"".join([self._cached(k, self.other, self._ids) for k in _SAFE.split(text)])
        first, *rest = text.replace("\n", " \n").split(" ")
        known = self.pieces.get  # a piece stands for itself behind a space, or for a line's first word
        out = [known(k) or self._cached(k, self.pieces, self._behind_space) for k in rest]
        return (self._ids(first) if first else b"") + b"".join(out)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin, with the end."""
        raw = [t.encode() for t in texts]
        begin = np.concatenate(([0], np.cumsum([len(b) for b in raw], dtype=np.int64)))
        a = np.frombuffer(b"".join(raw), np.uint8)
        if not len(a):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        space = _SPACE[a]
        safe = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        cuts = np.zeros(len(a) + 1, bool)
        cuts[safe[~behind_space(a, safe)]] = True
        cuts[begin] = True
        at = np.flatnonzero(cuts)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(a)]).dictionary_encode()
        first, counts, pool = self._known(pieces.dictionary)
        which = pieces.indices.to_numpy()
        sizes = counts[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = pool[np.repeat(first[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(at, begin)]

    def _known(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_distinct``; pieces of the batches before, short ones and at most ``KNOWN``, are looked up."""
        old, old_first, old_counts, old_pool = self.known
        place = pc.index_in(pieces, value_set=old)
        new = pieces.filter(place.is_null())
        new_first, new_counts, new_pool = self._distinct(new)
        pool = np.concatenate((old_pool, new_pool))
        place = place.fill_null(-1).to_numpy()
        first, counts = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        hit = place >= 0
        first[hit], counts[hit] = old_first[place[hit]], old_counts[place[hit]]
        first[~hit], counts[~hit] = new_first + len(old_pool), new_counts
        keep = pc.less_equal(pc.binary_length(pieces), 64).to_numpy(zero_copy_only=False)
        if len(old) + (keep & ~hit).sum() <= KNOWN:
            extra = keep & ~hit
            self.known = pa.concat_arrays([old, pieces.filter(pa.array(extra))]), np.concatenate((old_first, first[extra])), np.concatenate((old_counts, counts[extra])), pool
        else:
            keep &= np.cumsum(keep) <= KNOWN
            ends = np.cumsum(counts[keep])
            begins = ends - counts[keep]
            ids = pool[np.repeat(first[keep] - begins, counts[keep]) + np.arange(ends[-1] if len(ends) else 0)]
            self.known = pieces.filter(pa.array(keep)), begins, counts[keep], ids
        return first, counts, pool

    def _distinct(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's ids begin in a pool of ids, how many they are, and the pool. Pieces that start with white space and end
        without are put together, encoded at once and told apart by the byte lengths of the tokens."""
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        a = np.frombuffer(pieces.buffers()[2], np.uint8)
        plain = _SPACE[a[at[:-1]]] & ~behind_space(a, at[1:]) & (np.diff(at) <= self.leaf)
        first, counts, pool, held = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        for k in np.flatnonzero(~plain).tolist():
            ids = np.frombuffer(self._ids(a[at[k]:at[k + 1]].tobytes().decode()), "<u4")
            first[k], counts[k] = held, len(ids)
            pool.append(ids)
            held += len(ids)
        plain = np.flatnonzero(plain)
        ends = np.cumsum(np.diff(at)[plain])
        blocks = [x for x in np.split(plain, np.searchsorted(ends, np.arange(BLOCK, ends[-1] if len(ends) else 0, BLOCK))) if len(x)]
        texts = [b"".join([a[x:y].tobytes() for x, y in zip(at[some].tolist(), at[some + 1].tolist())]).decode() for some in blocks]
        if texts:
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            last = np.searchsorted(reached := np.cumsum(self.size_of[ids]), ends)
            if len(reached) <= last[-1] or not np.array_equal(reached[last], ends):
                raise ValueError("a token crosses a safe place of the text")
            counts[plain] = np.diff(last + 1, prepend=0)
            first[plain] = held + last + 1 - counts[plain]
            pool.append(ids)
        return first, counts, np.concatenate(pool) if pool else np.zeros(0, "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def _cached(self, key: str, cache: Cache, make: Callable[[str], bytes]) -> bytes:
        ids = cache.get(key) or cache.old.get(key) or make(key)
        if len(key) <= 64:
            cache.put(key, ids)
        return ids

    def _behind_space(self, piece: str) -> bytes:
        return self._ids(piece if piece[:1] == "\n" else " " + piece)

    def _ids(self, key: str) -> bytes:
        core = key.rstrip(".,;:!?")  # a run of these is one pre-token behind a letter
        body = core[1:] if core[:1] in (" ", "\n") else core
        if body.isalpha() and len(body) <= 64 and (body.isascii() or _LATIN.fullmatch(body)):
            head = [core] if core[:1] != "\n" else ["\n", body]
            return b"".join([self._cached(x, self.tokens, self._token) for x in [*head, key[len(core):]] if x])
        if len(key) > self.leaf:
            return self._long(key)
        return array("I", self.tokenizer.encode(key, add_special_tokens=False).ids).tobytes()

    def _token(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.chars))]).tobytes()

    def _model(self, mapped: str) -> list[int]:
        return [t.id for t in self.model.tokenize(mapped)]

    def long_parts(self, key: str) -> Iterator[tuple[bytes | None, str]]:
        """(ids, '') of short pre-tokens and added tokens, (None, pre-token) of long ones."""
        for i, part in enumerate(self.added.split(key) if self.added else [key]):
            if i % 2:
                yield np.array([self.tokenizer.token_to_id(part)], "<u4").tobytes(), ""
            elif part:
                for mapped, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    if len(mapped) <= self.leaf:
                        yield np.array(self._model(mapped), "<u4").tobytes(), ""
                    else:
                        yield None, mapped

    def _long(self, key: str) -> bytes:
        return b"".join(ids if ids is not None else np.array(self.tree(mapped), "<u4").tobytes() for ids, mapped in self.long_parts(key))

    def leaves(self, mapped: str) -> list[str]:
        """Halves of halves, down to leaves."""
        if len(mapped) <= self.leaf:
            return [mapped]
        half = len(mapped) // 2
        return self.leaves(mapped[:half]) + self.leaves(mapped[half:])

    def tree(self, mapped: str) -> list[int]:
        return self.join_all([self._model(x) for x in self.leaves(mapped)])

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """The encoding of what neighbouring encoded parts of a pre-token stand for."""
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Re-encode a growing window around the join until both sides agree with it."""
        width = 4
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self._model("".join(map(self.strings.__getitem__, left[i:] + right[:j])))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            width *= 2


def segments(text: str, size: int) -> list[str]:
    """The text cut at safe places into pieces of at least ``size`` characters, where it has
    such places; a stretch without any stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) lists of about ``BYTES`` characters, or one longer text."""
    for ids, texts in rows_of(batches, 1024):
        a = held = 0
        for k, text in enumerate(texts):
            if held and held + len(text) > BYTES:
                yield ids[a:k], texts[a:k]
                a, held = k, 0
            held += len(text)
        yield ids[a:], texts[a:]


Finish = Callable[[bytes], tuple]


def encode_with(df: DataFrame, finish: Finish, schema: str, path: str | None = None, id_col: str = "doc_id",
                text_col: str = "text", *, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, *finish(ids)) of every row; ``finish`` gets the ids as little-endian unsigned
    32-bit integers and returns a value for each column of ``schema``."""
    path = path or default_path()
    docs = texts_of(df, id_col, text_col)
    full = f"doc_id long, {schema}"
    out_type = _arrow_schema(df.sparkSession, full)

    def batch_of(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *zip(*rows)] if rows else [[]] * len(out_type), out_type)], schema=out_type)

    def short(batches):
        enc = encoder(path)
        for ids, texts in groups(batches):
            flat, at = enc.encode_many(texts)
            yield batch_of(ids, [finish(flat[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())])

    def cut_up(batches):
        enc = encoder(path)
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                units = []
                for part in segments(text, segment):
                    if len(part) <= 2 * segment:
                        units.append((part, 0))
                        continue
                    for n, (ids, mapped) in enumerate(enc.long_parts(part)):
                        units += [(ids, 0)] if ids is not None else [(x, n + 1) for x in enc.leaves(mapped)]
                done = [u[0] if isinstance(u[0], bytes) else None for u in units]
                raw = [None if isinstance(u[0], bytes) else u[0] for u in units]
                n = len(units)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int64()),
                                                  pa.array([u[1] for u in units], pa.int64()), pa.array(raw, pa.string()), pa.array(done, pa.binary())],
                                                 names=["row", "doc_id", "unit", "tree", "raw", "ids"])

    def encode_units(batches):
        enc = encoder(path)
        for batch in batches:
            _, _, _, tree, raw, ids = (c.to_pylist() for c in batch.columns)
            got = [i if r is None else np.array(enc._model(r), "<u4").tobytes() if t else enc.encode(r) for t, r, i in zip(tree, raw, ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, pa.binary())], names=["row", "doc_id", "unit", "tree", "ids"])

    def put_together(key, table):
        enc, out, open_tree, leaves = encoder(path), [], 0, []
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("unit", "tree", "ids"))))
        for _, tree, ids in [*rows, (0, 0, b"")]:
            if leaves and tree != open_tree:
                out.append(np.array(enc.join_all(leaves), "<u4").tobytes())
                leaves = []
            open_tree = tree
            if tree:
                leaves.append(np.frombuffer(ids, "<u4").tolist())
            else:
                out.append(ids)
        return pa.Table.from_batches([batch_of([table.column("doc_id")[0].as_py()], [finish(b"".join(out))])])

    is_long = F.coalesce(F.length("text") > segment, F.lit(False))
    long = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(is_long)
    units = long.mapInArrow(frugal(cut_up), "row long, doc_id long, unit long, tree long, raw string, ids binary").repartition("row", "unit")
    encoded = units.mapInArrow(frugal(encode_units), "row long, doc_id long, unit long, tree long, ids binary")
    return docs.where(~is_long).mapInArrow(frugal(short), full).union(encoded.groupBy("row").applyInArrow(put_together, full))


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, ids) of every row."""
    return encode_with(df, lambda b: (np.frombuffer(b, "<i4"),), "ids array<int>", path, id_col, text_col, **options)


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row; null ids give an empty text."""
    path = path or default_path()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(frugal(run), "doc_id long, text string")


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text
    that they decode to, taken in the task that encodes."""
    path = path or default_path()

    def finish(b: bytes) -> tuple:
        ids = np.frombuffer(b, "<u4").tolist()
        return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(encoder(path).decode(ids).encode()).hexdigest())

    return encode_with(df, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, id_col, text_col, **options)
