"""Helpers for tasks that work on whole texts with numpy.

Texts are handled as one byte array with document boundaries; hashes are 64-bit
polynomial prefix sums (modulo 2**64, odd base, random value per byte), so the
hash of any stretch is one subtraction and one multiplication.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
LONG_WORD = 64
U = np.uint64


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = np.asarray(values, U) + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.cumprod(out)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[i:j] times powers of the base."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(np.asarray(values, U) * powers(BASE, len(values))[: len(values)], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of values[start:stop] that do not depend on where they lie."""
    return (prefix[stop] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def byte_values(data: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix(np.arange(256), 1000 + seed)[data]


# -- texts -----------------------------------------------------------------

def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the n + 1 boundaries."""
    texts = one_array(pc.fill_null(column, ""))
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def texts_of(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The reverse of utf8()."""
    n = len(bounds) - 1
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop byte of each word [^\\x20\\x09-\\x0D]+, and the first word of each text (n + 1)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = bounds[1:]
    after[ends[ends > 0] - 1] = False
    stop = np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; hashes of different seeds are independent.

    Texts can be made for which any polynomial modulo 2**64 collides, but only
    long ones: words of more than LONG_WORD bytes are digested instead.
    """
    size = stop - start
    out = mix(stretch_hash(prefix_hash(byte_values(data, seed)), start, stop) + size.astype(U), seed)
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(np.ascontiguousarray(data[start[i]: stop[i]]), digest_size=8, salt=bytes([seed]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def windows(first: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of so many items that stay inside their text."""
    n = int(first[-1])
    inside = np.zeros(n + 1, np.int64)
    low, high = first[:-1], np.maximum(first[1:] - length + 1, first[:-1])
    np.add.at(inside, low, 1)
    np.add.at(inside, high, -1)
    return np.flatnonzero(np.cumsum(inside)[:n] > 0)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of that length at one of the starts."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    stop = np.bincount(np.minimum(starts + length, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge - stop)[:n] > 0


# -- packing numbers into binary columns -----------------------------------

def pack(values: np.ndarray) -> bytes:
    """Integers as compressed differences, one plane per byte."""
    values = np.asarray(values, np.int64)
    steps = np.diff(values, prepend=0).view(U)
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel())


def ordered_ids(column: pa.Array) -> np.ndarray:
    """Identifiers as int64; null comes after all others."""
    return one_array(pc.fill_null(column, np.iinfo(np.int64).max)).to_numpy(zero_copy_only=False).astype(np.int64)


# -- chunks of documents ---------------------------------------------------

def parts(docs: DataFrame, weight: Column, size: int) -> tuple[int, int]:
    """Total weight of all rows, and into how many hash parts of about that size to deal them.

    At least four parts for each shuffle partition, so that the partitions are even.
    """
    total = docs.agg(F.sum(weight).alias("n")).first().n or 0
    return int(total), max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // size))


def chunked(docs: DataFrame, id_col: str, text_col: str, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns chunk, doc_id, text and those to keep (keep_...); a document's rows share a chunk."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("long").alias("chunk"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        *(F.col(c).alias(f"keep_{c}") for c in keep))


def in_order(table: pa.Table) -> pa.Table:
    """Rows by (doc_id, text), nulls last."""
    return table.take(pc.sort_indices(
        table.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end"))
