"""Substring dedup on words: count-min prefilter, then exact grouping.

Documents are dealt into chunks by a hash of their id; the texts are shuffled
once and read three times from that one exchange.

1. Each chunk sketches its windows: ``depth`` rows of a count-min sketch, whose
   width follows the size of the corpus.  A chunk fills few of the cells, so a
   partition's sketch is sent as its sorted cells, by block of cells.
2. The sketches of a block are merged (counts saturate at 2, all that matters).
   Each chunk gets one bit back per cell it filled: estimated repeated or not.
   Estimates are never too low, so no repeated window is lost.
3. Windows estimated repeated in all rows go on with a 96-bit fingerprint, once
   per chunk, and are grouped exactly; the earliest of a group stays.
4. Each chunk learns which of its windows start earlier elsewhere, marks
   its own later repeats, and removes the words they cover.

No window, however frequent, is sent more than once per chunk, and a block, a
bucket and a chunk all have bounded sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import packed as k

WINDOW = 20
DEPTH = 2
CHUNK_BYTES = 4 << 20
BLOCK_BITS = 24


def fingerprints(table: pa.Table, length: int):
    """The texts' words, the valid window starts and two hashes of each window."""
    data, bounds = k.utf8(table["text"])
    start, stop, first = k.words_of(data, bounds)
    at = k.windows(first, length)
    one, two = (
        k.mix(k.stretch_hash(k.prefix_hash(k.word_hashes(data, start, stop, seed)), at, at + length), 1 + 2 * seed)
        for seed in (0, 1))
    two = two >> k.U(32)
    return (data, bounds, start, stop, first), at, one, two


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (k.mix(hashes, 10 + row) >> k.U(64 - bits)).astype(np.int64)


def later_repeats(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which entries have an equal one before them."""
    order = np.lexsort((two, one)) if len(one) else np.zeros(0, np.int64)
    same = np.zeros(len(one), bool)
    a, b = one[order], two[order]
    same[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return same


def find_repeats(
    docs: DataFrame, length: int, depth: int, buckets: int, bits: int,
) -> DataFrame:
    """Per chunk, packed window numbers that start earlier in another chunk: chunk, n, at."""
    block_bits = min(bits, BLOCK_BITS)

    def sketch(key, table):
        _, _, one, _ = fingerprints(k.in_order(table), length)
        out = []
        for row in range(depth):
            cell, count = np.unique(cells_of(one, row, bits), return_counts=True)
            block, first = np.unique(cell >> block_bits, return_index=True)
            for b, i, j in zip(block, first, [*first[1:], len(cell)]):
                out.append((row, b, key[0].as_py(), j - i, k.pack(cell[i:j] & ((1 << block_bits) - 1)),
                            np.packbits(count[i:j] > 1).tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*out) if out else [[]] * 6,
            (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
            names=["row", "block", "chunk", "n", "cells", "twice"])

    def merge(table):
        count = np.zeros(1 << block_bits, np.uint8)
        cells = []
        for n, data, twice in zip(*(table[c].to_pylist() for c in ("n", "cells", "twice"))):
            cell = k.unpack(data, n).astype(np.int32)
            more = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=n)
            count[cell] = np.minimum(count[cell] + more, 2)
            cells.append(cell)
        return pa.Table.from_arrays(
            [table["chunk"], table["row"], table["block"],
             pa.array([np.packbits(count[c] > 1).tobytes() for c in cells], pa.binary())],
            names=["chunk", "row", "block", "mask"])

    def suspects(key, table, masks):
        table = k.in_order(table)
        (_, _, _, _, first), at, one, two = fingerprints(table, length)
        alive = np.ones(len(one), bool)
        known = dict(zip(zip(masks["row"].to_pylist(), masks["block"].to_pylist()), masks["mask"].to_pylist()))
        for row in range(depth):
            cell, back = np.unique(cells_of(one, row, bits), return_inverse=True)
            block, low = np.unique(cell >> block_bits, return_index=True)
            flags = [np.unpackbits(np.frombuffer(known[row, b], np.uint8), count=j - i)
                     for b, i, j in zip(block.tolist(), low, [*low[1:], len(cell)])]
            if flags:
                alive &= np.concatenate(flags)[back] > 0
        own = np.flatnonzero(alive)
        own = own[~later_repeats(one[own], two[own])]
        ids = k.ordered_ids(table["doc_id"])[np.searchsorted(first, at[own], "right") - 1]
        bucket = ((one[own] >> k.U(20)) % k.U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, ids, bucket = own[order], ids[order], bucket[order]
        value, low = np.unique(bucket, return_index=True)
        cuts = list(zip(low, [*low[1:], len(own)]))
        return pa.Table.from_arrays([
            pa.array([key[0].as_py()] * len(value), pa.int64()), pa.array(value, pa.int64()),
            pa.array([j - i for i, j in cuts], pa.int64()),
            *(pa.array([f(i, j) for i, j in cuts], pa.binary()) for f in (
                lambda i, j: one[own[i:j]].tobytes(), lambda i, j: two[own[i:j]].astype(np.uint32).tobytes(),
                lambda i, j: k.pack(ids[i:j]), lambda i, j: k.pack(own[i:j])))],
            names=["chunk", "bucket", "n", "one", "two", "ids", "at"])

    def group(table):
        n = table["n"].to_pylist()
        one = np.frombuffer(b"".join(table["one"].to_pylist()), k.U)
        two = np.frombuffer(b"".join(table["two"].to_pylist()), np.uint32)
        ids, at = (np.concatenate([k.unpack(d, m) for d, m in zip(table[c].to_pylist(), n)]) for c in ("ids", "at"))
        order = np.lexsort((at, ids, two, one))
        later = np.zeros(len(one), bool)
        later[order[1:]] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        edge = np.cumsum([0, *n])
        found = [(chunk, at[i:j][later[i:j]]) for chunk, i, j in zip(table["chunk"].to_pylist(), edge, edge[1:])]
        found = [(chunk, f) for chunk, f in found if len(f)]
        return pa.Table.from_arrays(
            [pa.array([c for c, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()),
             pa.array([k.pack(f) for _, f in found], pa.binary())], names=["chunk", "n", "at"])

    by_chunk = docs.groupBy("chunk")
    masks = (
        by_chunk.applyInArrow(sketch, "row int, block long, chunk long, n long, cells binary, twice binary")
        .groupBy("row", "block").applyInArrow(merge, "chunk long, row int, block long, mask binary"))
    sent = by_chunk.cogroup(masks.groupBy("chunk")).applyInArrow(
        suspects, "chunk long, bucket long, n long, one binary, two binary, ids binary, at binary")
    return sent.groupBy("bucket").applyInArrow(group, "chunk long, n long, at binary")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW, depth: int = DEPTH,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text): words without repeated windows.

    A word is removed if a window of ``length`` words covers it whose words also
    start earlier (smaller id, or same document and earlier).  Windows are judged
    on the input.  Kept words are joined by one space.

    Null texts have no words; texts shorter than a window lose nothing.  Rows
    that repeat an id are ordered by text; rows without id come after all
    others.  Other columns are ignored; an empty table gives no rows.
    """
    # Cells: two to four times the bytes over two, a bound on the number of words.
    total, chunks = k.parts(docs, F.octet_length(F.col(text_col)), chunk_bytes)
    bits = max(10, int(total).bit_length())
    dealt = k.chunked(docs, id_col, text_col, chunks)
    repeats = find_repeats(dealt, length, depth, max(1, total // (2 * chunk_bytes)), bits)

    def clean(table, found):
        table = k.in_order(table)
        (data, bounds, start, stop, first), at, one, two = fingerprints(table, length)
        later = later_repeats(one, two)
        for n, packed in zip(found["n"].to_pylist(), found["at"].to_pylist()):
            later[k.unpack(packed, n)] = True
        gone = k.covered(at[later], length, len(start))
        kept = np.flatnonzero(~gone)
        doc = np.searchsorted(first, kept, "right") - 1
        inner = np.zeros(len(kept), bool)
        inner[:-1] = doc[:-1] == doc[1:]
        stay = np.zeros(len(data) + 1, np.int8)
        stay[start[kept]] += 1
        stay[stop[kept]] -= 1
        stay = np.cumsum(stay[:-1], dtype=np.int8).astype(bool)
        text = data.copy()
        text[stop[kept[inner]]] = 32
        stay[stop[kept[inner]]] = True
        size = np.concatenate([[0], np.cumsum(stay)])[bounds]
        n_gone = np.concatenate([[0], np.cumsum(gone)])[first]
        return pa.Table.from_arrays(
            [table["doc_id"], pa.array(np.diff(first)), pa.array(np.diff(n_gone)), k.texts_of(text[stay], size).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"])

    return dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(
        clean, "doc_id long, n_words long, n_removed long, kept string")
