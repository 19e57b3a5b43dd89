"""Helpers shared by the training-data operators.

Words are the runs ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` cuts at exactly those six
characters and ``bytes.lower()`` lower-cases exactly A-Z, so both are used on the UTF-8
bytes inside tasks. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python a thousand rows at a time: with Spark's 10,000 a batch of long texts takes tens of megabytes in
    the executor and again in each worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def frugal(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving the memory that it has freed back to the machine when its task ends; workers are
    reused, and would keep the most that any stage took."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only a local session that names none
    gets a scratch folder; a cluster must name one that all its nodes share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"/tmp/tabvet-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tabvet-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files,
    which survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text): the two columns an operator reads, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


BROADCAST_IDS = 500_000  # ids; at most 16 MB. Larger id sets are joined by shuffling


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores behind, so that ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


def only_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id is (``left_semi``) or isn't (``left_anti``) in the stored
    one-column table ``ids``, which is broadcast only if its counted size is within the bound."""
    key = free_name(df, "_id")
    right = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    if ids.count() <= BROADCAST_IDS:
        right = F.broadcast(right)
    return df.join(right, df[id_col].cast("long") == right[key], how)


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) lists of bounded slices of Arrow batches; null texts become ''."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: near-independent bits from structured integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_CHUNK = 1 << 18
_powers: list[np.ndarray] = []


def _hash_chunk(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a byte array that starts and ends with white space.
    A word's hash is a polynomial over its bytes (mod 2^64, odd base), taken from prefix
    sums and shifted back by the inverse base, then mixed with its length."""
    if not _powers or len(_powers[0]) < len(a):
        size = max(_CHUNK * 2, len(a))
        inverse = np.uint64(pow(int(_M1), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.full(size, base, np.uint64)) for base in (_M1, inverse)]
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    total = np.cumsum(_BYTE[a] * _powers[0][:len(a)])
    return start, mix((total[end - 1] - total[start - 1]) * _powers[1][start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str] | list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts (A-Z lower-cased, if ``lower``) and the offsets of each text's
    words in them. Long inputs are hashed in pieces cut at white space."""
    parts = [t.encode() if isinstance(t, str) else t for t in texts]
    parts = [t.lower() for t in parts] if lower else parts
    buf = b"\n" + b"\n".join(parts) + b"\n"
    ends = np.cumsum([len(x) + 1 for x in parts])
    a = np.frombuffer(buf, np.uint8)
    starts, hashes, k = [], [], 0
    while k < len(a) - 1:
        z = len(a) - 1
        if z - k > _CHUNK:
            cut_at = np.flatnonzero(_SPACE[a[k + 1:k + _CHUNK]])
            far = cut_at[-1] if len(cut_at) else np.argmax(_SPACE[a[k + _CHUNK:]]) + _CHUNK - 1
            z = k + 1 + int(far)
        s, h = _hash_chunk(a[k:z + 1])
        starts.append(s + k)
        hashes.append(h)
        k = z
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(([0], np.searchsorted(start, ends)))


def split_words(texts: list[bytes], gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """For texts cut at the bytes that ``gap`` (256 flags, line feed among them) marks: all bytes behind a line feed, the place of each word
    among them, and the words as an exact dictionary."""
    a = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    out = gap[a]
    edge = np.flatnonzero(out[1:] != out[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(a[~out])])
    return a, start, words.dictionary_encode()


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each window of ``k`` successive hashes (none for fewer)."""
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = s * _M1 + h[i:i + n]
    return mix(s)


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word ``k``-shingles; a text of fewer
    words is one shingle, one without words has none."""
    h, at = word_hashes(texts)
    r, out = rolling(h, k), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        s = np.sort(r[a:b - k + 1]) if b - a >= k else rolling(np.append(h[a:b], np.uint64(b - a)), b - a + 1) if b > a else h[:0]
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
