"""Packing documents into sequences by large-item matching and best fit.

Documents become token ids and one end id; those longer than a sequence are cut.
How pieces are packed depends on their lengths alone, and there are at most as
many lengths as a sequence has tokens, so the plan is made for counts of lengths:

* Pieces above one third of the capacity are large; a sequence holds two at most.
  From the longest down, each is matched with the longest partner that fits.  For
  large pieces alone this needs the fewest sequences possible.
* Shorter pieces, from the longest down, go where the least room is left that
  still takes them; a new sequence is opened only if there is none.

Equal sequences are handled as one run of sequences, so the plan is a small table
of runs, however many documents there are.  Every piece finds its place from its
rank among the pieces of its length; ranks are sums over ranges of a hash plus
numbers within one range, so no length goes through one task.
"""

from __future__ import annotations

import bisect
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm.packed import utf8, words_of
from mailgrain.sources.workspace import stored

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY = 2048
END = 0
SLICE_BYTES = 4 << 20
MEMO_TOKENS = 4_000_000
BYTES = np.arange(256)
DIGITS = (BYTES >= 48) & (BYTES <= 57)
CAPITALS = (BYTES >= 65) & (BYTES <= 90)
LETTERS = CAPITALS | (BYTES >= 97) & (BYTES <= 122)
MARKS = (BYTES > 32) & (BYTES < 127) & ~DIGITS & ~LETTERS


# -- tokens ----------------------------------------------------------------

def breaks(data: np.ndarray) -> np.ndarray:
    """Where an ASCII mark follows a letter or digit (ASCII or Latin-1): words may be split there as well.

    Not before a vertical bar, which is inside the vocabulary's special tokens.
    """
    before = (LETTERS | DIGITS)[data]
    before[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return np.flatnonzero(before[:-1] & MARKS[data[1:]] & (data[1:] != ord("|"))) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals in lower case, if no combining mark may join one and no special token's look-alike may become one."""
    if ((data == 0xCC) | (data == 0xCD)).any() or ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any():
        return data
    return data + CAPITALS[data] * np.uint8(32)


class Encoder:
    """Token ids of texts for a vocabulary in lower case that splits at white space, and between letters and marks.

    Each different part of a word is encoded once and remembered (until the memory is full).
    """

    def __init__(self, vocabulary: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(vocabulary), end
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        for a in range(0, len(new), 4096):
            part = new[a:a + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
            n, size = len(self.known), np.array([len(f) for f in found])
            ids = np.array([i for f in found for i in f], np.uint32)
            while n + len(part) > len(self.first):
                self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.first[n:n + len(part)] = self.used + np.cumsum(size) - size
            self.size[n:n + len(part)] = size
            self.ids[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            self.known.update(zip(part, range(n, n + len(part))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the n + 1 boundaries."""
        data, bounds = utf8(texts)
        start, stop, _ = words_of(data, bounds)
        data = lowered(data)
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        cuts = breaks(data)
        cuts = cuts[~edge[cuts]]
        start, stop = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([stop, cuts]))
        first = np.searchsorted(start, bounds)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[start] = 1
        inside[stop] -= 1
        letters = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        edge = np.concatenate([[0], np.cumsum(stop - start)])
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(letters))])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.used > MEMO_TOKENS:
            self.clear()
        self.learn(distinct)
        number = np.array([self.known[w] for w in distinct], np.int64)[np.asarray(coded.indices)] if len(distinct) else np.zeros(0, np.int64)
        # The end ids are words of their own, of one token each.
        ends = first[1:] + np.arange(len(texts))
        is_end = np.zeros(len(number) + len(texts), bool)
        is_end[ends] = True
        size, at = np.ones(len(is_end), np.int64), np.zeros(len(is_end), np.int64)
        size[~is_end], at[~is_end] = self.size[number], self.first[number]
        last = np.cumsum(size)
        spot = np.repeat(at - (last - size), size) + np.arange(int(last[-1]) if len(last) else 0)
        ids = self.ids[spot]
        ids[last[ends] - 1] = self.end
        return ids, np.concatenate([[0], last[ends]])


def slices(batch: pa.RecordBatch, text_col: str):
    """Runs of rows with bounded text bytes (one row at least)."""
    _, bounds = utf8(batch.column(text_col))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def cut(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of all pieces."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast({"vocabulary": spark.read.text(vocabulary, wholetext=True).first().value})

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # A worker's copy of the broadcast outlives a task, and so does what it remembers.
        encoder = model.value.get("encoder") or model.value.setdefault("encoder", Encoder(model.value["vocabulary"], end))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encoder.encode(part.column("text"))
                size = np.diff(bounds)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                edge = np.concatenate([[0], np.cumsum(length)])
                raw = pa.Array.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(4 * edge), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     raw.cast(pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


# -- the plan --------------------------------------------------------------

class Plan:
    """Runs of pieces: (length, first rank, pieces, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.taken, self.runs, self.sequences = dict.fromkeys(counts, 0), [], 0
        self.rooms: list[int] = []
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.match_large()
        for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
            self.best_fit(length)

    def put(self, length: int, pieces: int, sequence: int, per: int, offset: int) -> None:
        """The next pieces of a length, so many to each sequence from that one on."""
        self.runs.append((length, self.taken[length], pieces, sequence, per, offset))
        self.taken[length] += pieces
        self.left[length] -= pieces

    def keep(self, room: int, sequence: int, n: int) -> None:
        """So many sequences have that room left."""
        if room and n:
            if room not in self.free:
                bisect.insort(self.rooms, room)
            self.free.setdefault(room, []).append((sequence, n))

    def match_large(self) -> None:
        """From the longest down, each large piece with the longest other that fits."""
        large = sorted(n for n in self.left if 3 * n > self.capacity)
        for length in reversed(large):
            while self.left[length]:
                room, n = self.capacity - length, self.left[length]
                i = bisect.bisect_right(large, min(room, length)) - 1
                while i >= 0 and (not self.left[large[i]] or (large[i] == length and n == 1)):
                    i -= 1
                partner = large[i] if i >= 0 else None
                pairs = n if partner is None else n // 2 if partner == length else min(n, self.left[partner])
                first = self.sequences
                self.sequences += pairs
                if partner == length:
                    self.put(length, 2 * pairs, first, 2, 0)
                else:
                    self.put(length, pairs, first, 1, 0)
                    if partner:
                        self.put(partner, pairs, first, 1, length)
                self.keep(room - (partner or 0), first, pairs)

    def fill(self, length: int, room: int, first: int, n: int) -> None:
        """As many pieces as fit or are left into sequences with that room; these no longer count as free."""
        per, offset = room // length, self.capacity - room
        whole = min(n, self.left[length] // per)
        if whole:
            self.put(length, whole * per, first, per, offset)
            self.keep(room - per * length, first, whole)
        some = self.left[length] if whole < n else 0
        if some:
            self.put(length, some, first + whole, some, offset)
            self.keep(room - some * length, first + whole, 1)
        self.keep(room, first + whole + bool(some), n - whole - bool(some))

    def best_fit(self, length: int) -> None:
        while self.left[length]:
            i = bisect.bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                first, n = self.free[room].pop()
                if not self.free[room]:
                    del self.free[room], self.rooms[i]
                self.fill(length, room, first, n)
            else:
                n = -(-self.left[length] // (self.capacity // length))
                self.sequences += n
                self.fill(length, self.capacity, self.sequences - n, n)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
    end: int = END, keep: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset of every piece, and what is to be kept of its ids.

    A document is its token ids and the end id; only one longer than the capacity
    is cut, into pieces of the capacity and a last one that may be shorter.  Pieces
    of a sequence lie side by side from offset 0.  ``keep`` names expressions over
    the pieces' columns; without it they keep ``ids``, their token ids as
    little-endian unsigned 32-bit numbers.

    Null and blank texts are the end id alone.  Rows without id and rows that
    repeat an id are documents of their own.  Other columns are ignored; an empty
    table gives no rows.  The vocabulary's path is read by Spark.
    """
    keep = {"ids": F.col("ids")} if keep is None else keep
    pieces = stored(cut(docs, id_col, text_col, capacity, vocabulary, end).select(
        "doc_id", "piece", "start", "length", *(c.alias(n) for n, c in keep.items())), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = sorted(Plan(counts, capacity).runs)
    length, rank, size, sequence, per, offset = np.array(runs, np.int64).reshape(-1, 6).T
    below = np.cumsum(size) - size

    # Where a row lies in the stored table deals a length's pieces into ranges, also rows that are all alike.
    n = sum(counts.values())
    row = F.xxhash64(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), "_metadata.row_index")
    rows = pieces.withColumn("_row", row).withColumn("_range", F.pmod("_row", F.lit(max(1, math.isqrt(n)))))
    keys = ["length", "_range"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_row", "doc_id", "piece")) - 1
    ranked = rows.withColumn("_number", number).join(sums, keys).withColumn("_rank", F.col("_before") + F.col("_number")).select(
        *pieces.columns, "_rank")
    starts = dict(zip(reversed(length.tolist()), reversed(below.tolist())))

    def place(batches):
        values = np.array(sorted(starts), np.int64)
        first = np.array([starts[v] for v in values.tolist()], np.int64)
        for batch in batches:
            own = np.asarray(batch.column("length"))
            spot = first[np.searchsorted(values, own)] + np.asarray(batch.column("_rank"))
            run = np.searchsorted(below, spot, "right") - 1
            nth = spot - below[run]
            where = [pa.array(sequence[run] + nth // per[run]), pa.array(offset[run] + nth % per[run] * own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *where], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
