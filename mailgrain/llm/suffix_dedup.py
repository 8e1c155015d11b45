"""Substring dedup on bytes with a hash-compared suffix sort.

Sorting all suffixes of a corpus is not needed to find its repeated strings of
``length`` bytes.  Every such string contains one leftmost smallest (by hash)
half-length string, its anchor; equal strings have equal anchors at equal
offsets.  Neighbouring starts with one anchor form a region.

1. Texts are dealt into chunks, shuffled once.  A chunk sends each distinct region
   as (anchor hash, region hash).  Of equal regions only the earliest is
   undecided; in all others every string starts earlier elsewhere.  Large groups
   of copies end here.
2. Undecided regions that share their anchor with a different one, the ends of
   passages, are sent with their bytes and suffix-sorted by anchor: prefix
   polynomial hashes and a binary search give the common extension of two
   suffixes, a merge sort with such comparisons orders them, and neighbours that
   agree in all bytes (which is verified byte by byte) are repeats.  If very many
   regions share an anchor, their strings are dealt by their own hash.
3. Chunks learn which strings start earlier elsewhere and remove their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import packed as k
from mailgrain.llm.window_dedup import later_repeats

LENGTH = 100
CHUNK_BYTES = 4 << 20
SEGMENT = 1 << 20
SORT_BYTES = 2 << 20
CROWD = 4096
PLACE = (1 << 28) - 1


def valid_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """For every byte, whether a string of that length starts there inside its text."""
    inside = np.zeros(int(bounds[-1]) + 1, np.int8)
    low, high = bounds[:-1], np.maximum(bounds[1:] - length + 1, bounds[:-1])
    some = low < high
    inside[low[some]] += 1
    inside[high[some]] -= 1
    return np.cumsum(inside[:-1], dtype=np.int8) > 0


def regions(data: np.ndarray, bounds: np.ndarray, length: int):
    """first start, last start, anchor position, anchor hash and region hash, by position."""
    inside, half, out = valid_starts(bounds, length), length // 2, []
    for s in range(0, len(data), SEGMENT):
        piece = data[s: s + SEGMENT + length - 1]
        start = np.flatnonzero(inside[s: s + SEGMENT])
        if not len(start):
            continue
        prefix, back = k.prefix_hash(k.byte_values(piece)), k.powers(k.INVERSE, len(piece) + 1)
        gram = k.mix((prefix[half:] - prefix[:-half]) * back[: len(piece) - half + 1], 60)
        least = (gram & k.U(~PLACE & k.MASK)) | np.arange(len(gram), dtype=k.U)
        width, want = 1, length - half + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        anchor = (least[start] & k.U(PLACE)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(anchor) != 0)]))
        first, last, anchor = start[cut], start[np.append(cut[1:], len(start)) - 1], anchor[cut]
        shape = k.mix((((last - first) << 20) + anchor - first).astype(k.U), 61)
        whole = k.mix((prefix[last + length] - prefix[first]) * back[first] ^ shape, 62)
        out.append((first + s, last + s, anchor + s, gram[anchor], whole))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (int, int, int, k.U, k.U)]


def spread_out(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All starts of the regions, and the number of the region of each."""
    size = last - first + 1
    of = np.repeat(np.arange(len(size)), size)
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(int(size.sum())), of


class Suffixes:
    """Comparison of strings of one byte array by their prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix, self.back = k.prefix_hash(k.byte_values(data)), k.powers(k.INVERSE, len(data) + 1)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of common first bytes, at most length, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        pa_, pb, ba, bb = self.prefix[a], self.prefix[b], self.back[a], self.back[b]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = (self.prefix[a + middle] - pa_) * ba == (self.prefix[b + middle] - pb) * bb
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = self.extension(a, b)
        last = np.minimum(common, self.length - 1)
        return (common < self.length) & (self.data[a + last] < self.data[b + last])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Stable merge sort of the strings at those places inside each group of neighbours; gives the order.

        All runs of one width are merged at once: an element's place is its own
        rank plus its rank in the sibling run.
        """
        order = np.arange(len(at))
        start = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - start
        rank, width = order - start, 1
        while True:
            some = np.flatnonzero(size > width)
            if not len(some):
                return order
            r, s, n = rank[some], start[some], size[some]
            run = r // width
            left = run % 2 == 0
            low = np.minimum((run ^ 1) * width, n)
            base, high = low.copy(), np.minimum(low + width, n)
            own = at[order[some]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                other = at[order[s[open_] + middle]]
                mine = own[open_]
                # Left elements go before equal ones of the right run.
                is_left = left[open_]
                less = self.less(np.where(is_left, other, mine), np.where(is_left, mine, other))
                ahead = np.where(is_left, less, ~less)
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            new = s + (run // 2) * 2 * width + r % width + (low - base)
            merged = order.copy()
            merged[new] = order[some]
            order, width = merged, width * 2

    def repeats(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which strings equal an earlier one of their group (verified byte by byte)."""
        order = self.sort(at, group)
        a, b = at[order[:-1]], at[order[1:]]
        near = np.flatnonzero(group[order[:-1]] == group[order[1:]])
        near = near[self.extension(a[near], b[near]) == self.length]
        for i in range(0, len(near), 1 << 14):
            part = near[i: i + (1 << 14)]
            step = np.arange(self.length)
            same = (self.data[a[part][:, None] + step] == self.data[b[part][:, None] + step]).all(axis=1)
            near[i: i + (1 << 14)] = np.where(same, part, -1)
        out = np.zeros(len(at), bool)
        out[order[near[near >= 0] + 1]] = True
        return out


def gather(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    spot, _ = spread_out(first, stop - 1)
    return data[spot]


def lists(tables, names, counts):
    """Concatenated packed columns of all rows."""
    return [np.concatenate([np.zeros(0, np.int64), *(k.unpack(d, n) for d, n in zip(
        tables[c].to_pylist(), tables[m].to_pylist()) if n)]) for c, m in zip(names, counts)]


def strings_of(data, found, closed, crowded, length):
    """Starts in crowded regions, their hashes, and which repeat an earlier one of the chunk."""
    first, last = found[0][crowded], found[1][crowded]
    starts, _ = spread_out(first, last)
    hashes = np.zeros(len(starts), k.U)
    for i in range(0, len(starts), 1 << 18):
        a = starts[i: i + (1 << 18)]
        low = int(a[0])
        prefix = k.prefix_hash(k.byte_values(data[low: int(a[-1]) + length]))
        hashes[i: i + (1 << 18)] = k.mix(k.stretch_hash(prefix, a - low, a - low + length), 63)
    return starts, hashes, later_repeats(hashes, np.zeros(len(hashes), np.uint8))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    chunk_bytes: int = CHUNK_BYTES, crowd: int = CROWD, whole_characters: bool = False, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes): texts without repeated strings.

    A byte is removed if a string of ``length`` bytes covers it that also starts
    earlier (smaller id, or same document and earlier).  Strings do not cross
    documents and are judged on the input.  ``n_spans`` counts maximal removed runs.

    Null texts count as empty; texts shorter than ``length`` lose nothing.  Rows
    that repeat an id are ordered by text; rows without id come after all others.
    What is kept may cut through a character, so it is binary; with
    ``whole_characters`` the rest of such characters is dropped from it (and only
    from it).  Columns named in ``keep`` follow as they are, others are ignored; an
    empty table gives no rows.
    """
    total, chunks = k.parts(docs, F.octet_length(F.col(text_col)), chunk_bytes)
    buckets = max(1, total // (4 * chunk_bytes))
    dealt = k.chunked(docs, id_col, text_col, chunks, keep)

    def deal(bucket, *columns):
        """Rows by bucket: its number, how many, and each column's function of the chosen numbers."""
        order = np.argsort(bucket, kind="stable")
        value, low = np.unique(bucket[order], return_index=True)
        cuts = [order[i:j] for i, j in zip(low, [*low[1:], len(order)])]
        return [pa.array(value, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()),
                *(pa.array([f(c) for c in cuts], pa.binary()) for f in columns)]

    def owner(table, bounds, first):
        return k.ordered_ids(table["doc_id"])[np.searchsorted(bounds, first, "right") - 1]

    def send_regions(key, table):
        table = k.in_order(table)
        data, bounds = k.utf8(table["text"])
        first, _, _, gram, whole = regions(data, bounds, length)
        own = np.flatnonzero(~later_repeats(gram, whole))
        ids = owner(table, bounds, first[own])
        gram, whole = gram[own], whole[own]
        columns = deal((gram % k.U(buckets)).astype(np.int64), lambda c: gram[c].tobytes(), lambda c: whole[c].tobytes(),
                       lambda c: k.pack(ids[c]), lambda c: k.pack(own[c]))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(columns[0]), pa.int64()), *columns],
                                    names=["chunk", "bucket", "n", "gram", "whole", "ids", "at"])

    def judge_regions(table):
        n = table["n"].to_pylist()
        gram, whole = (np.frombuffer(b"".join(table[c].to_pylist()), k.U) for c in ("gram", "whole"))
        ids, at = lists(table, ("ids", "at"), ("n", "n"))
        order = np.lexsort((at, ids, whole, gram))
        new_gram = np.concatenate([[True], np.diff(gram[order]) != 0])
        new = new_gram | np.concatenate([[True], np.diff(whole[order]) != 0])
        kinds = np.bincount(np.cumsum(new_gram) - 1, weights=new)[np.cumsum(new_gram) - 1]
        closed, contested, crowded = (np.zeros(len(gram), bool) for _ in range(3))
        closed[order] = ~new
        contested[order] = new & (kinds > 1) & (kinds <= crowd)
        crowded[order] = new & (kinds > crowd)
        edge, out = np.cumsum([0, *n]), []
        for chunk, i, j in zip(table["chunk"].to_pylist(), edge, edge[1:]):
            part = [at[i:j][flag[i:j]] for flag in (closed, contested, crowded)]
            if any(map(len, part)):
                out.append((chunk, *(x for p in part for x in (len(p), k.pack(p)))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out) if out else [[]] * 7, [pa.int64(), *[pa.int64(), pa.binary()] * 3])],
            names=["chunk", "n_closed", "closed", "n_contested", "contested", "n_crowded", "crowded"])

    def send_strings(key, table, judged):
        table = k.in_order(table)
        data, bounds = k.utf8(table["text"])
        contested, crowded = (np.sort(x) for x in lists(
            judged, ("contested", "crowded"), ("n_contested", "n_crowded")))
        parts = []
        if len(contested) or len(crowded):
            found = regions(data, bounds, length)
            starts, hashes, later = strings_of(data, found, None, crowded, length)
            starts, hashes = starts[~later], hashes[~later]
            first = np.concatenate([found[0][contested], starts])
            stop = np.concatenate([found[1][contested], starts]) + length
            middle = np.concatenate([found[2][contested] - found[0][contested], np.zeros(len(starts), np.int64)])
            gram = np.concatenate([found[3][contested], hashes])
            ids = owner(table, bounds, first)
            parts = deal((k.mix(gram, 64) % k.U(buckets)).astype(np.int64), lambda c: gram[c].tobytes(),
                         lambda c: k.pack(ids[c]), lambda c: k.pack(first[c]), lambda c: k.pack(stop[c] - first[c]),
                         lambda c: k.pack(middle[c]), lambda c: gather(data, first[c], stop[c]).tobytes())
        names = ["bucket", "n", "gram", "ids", "first", "size", "middle", "data"]
        parts = parts or [pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 6)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(parts[0]), pa.int64()), *parts], names=["chunk", *names])

    def sort_strings(table):
        n = table["n"].to_pylist()
        chunk = np.repeat(np.arange(len(n)), n)
        gram = np.frombuffer(b"".join(table["gram"].to_pylist()), k.U)
        ids, first, size, middle = lists(table, ("ids", "first", "size", "middle"), "nnnn")
        data = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8)
        place = np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((first, ids, gram))
        new = np.flatnonzero(np.concatenate([[True], np.diff(gram[order]) != 0]))
        weight = np.concatenate([[0], np.cumsum(size[order])])[np.append(new, len(order))]
        removed = [[] for _ in n]
        i = 0
        while i < len(new):
            j = max(i + 1, int(np.searchsorted(weight, weight[i] + SORT_BYTES, "right")) - 1)
            own = order[new[i]: new[j] if j < len(new) else len(order)]
            part = gather(data, place[own], place[own] + size[own])
            at = np.concatenate([[0], np.cumsum(size[own])])[:-1]
            starts, of = spread_out(at, at + size[own] - length)
            offset = starts - at[of]
            # Only strings with the anchor at the same offset can be equal.
            label = np.unique(gram[own], return_inverse=True)[1][of] * (2 * length) + middle[own][of] - offset
            label_order = np.argsort(label, kind="stable")
            starts, of, offset, label = (x[label_order] for x in (starts, of, offset, label))
            alone = np.concatenate([[True], np.diff(label) != 0]) & np.concatenate([np.diff(label) != 0, [True]])
            starts, of, offset, label = (x[~alone] for x in (starts, of, offset, label))
            if len(starts):
                later = Suffixes(part, length).repeats(starts, label)
                whose, where = own[of[later]], offset[later]
                sort = np.argsort(chunk[whose], kind="stable")
                value, low = np.unique(chunk[whose][sort], return_index=True)
                for c, a, b in zip(value.tolist(), low, [*low[1:], len(sort)]):
                    removed[c].append((first[whose] + where)[sort[a:b]])
            i = j
        out = [(c, np.unique(np.concatenate(x))) for c, x in zip(table["chunk"].to_pylist(), removed) if x]
        return pa.Table.from_arrays(
            [pa.array([c for c, _ in out], pa.int64()), pa.array([len(x) for _, x in out], pa.int64()),
             pa.array([k.pack(x) for _, x in out], pa.binary())], names=["chunk", "n_starts", "starts"])

    def clean(table, told):
        table = k.in_order(table)
        data, bounds = k.utf8(table["text"])
        found = regions(data, bounds, length)
        closed, crowded, more = lists(told, ("closed", "crowded", "starts"), ("n_closed", "n_crowded", "n_starts"))
        gone = later_repeats(found[3], found[4])
        gone[closed] = True
        local, _, later = strings_of(data, found, None, np.sort(crowded), length)
        starts = np.concatenate([spread_out(found[0][gone], found[1][gone])[0], more, local[later]])
        hit = k.covered(starts, length, len(data))
        edge = hit.copy()
        edge[1:] &= ~hit[:-1]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        edge[inner] = hit[inner]
        n_gone, n_spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (hit, edge))
        if whole_characters and hit.any():
            character = np.cumsum((data & 0xC0) != 0x80)
            hit = np.bincount(character[hit], minlength=int(character[-1]) + 1)[character] > 0
        kept = k.texts_of(data[~hit], np.concatenate([[0], np.cumsum(~hit)])[bounds])
        return pa.Table.from_arrays(
            [table["doc_id"], pa.array(np.diff(bounds)), pa.array(n_gone), pa.array(n_spans),
             kept.view(pa.large_binary()).cast(pa.binary()), *(table[f"keep_{c}"] for c in keep)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *keep])

    by_chunk = dealt.groupBy("chunk")
    judged = by_chunk.applyInArrow(
        send_regions, "chunk long, bucket long, n long, gram binary, whole binary, ids binary, at binary"
    ).groupBy("bucket").applyInArrow(
        judge_regions, "chunk long, n_closed long, closed binary, n_contested long, contested binary, "
                       "n_crowded long, crowded binary")
    starts = by_chunk.cogroup(judged.groupBy("chunk")).applyInArrow(
        send_strings, "chunk long, bucket long, n long, gram binary, ids binary, first binary, size binary, "
                      "middle binary, data binary"
    ).groupBy("bucket").applyInArrow(sort_strings, "chunk long, n_starts long, starts binary")
    told = judged.select("chunk", "n_closed", "closed", "n_crowded", "crowded", F.lit(0).cast("long").alias("n_starts"),
                         F.lit(None).cast("binary").alias("starts")).unionByName(starts.select(
        "chunk", *(F.lit(0).cast("long").alias(n) if n[0] == "n" else F.lit(None).cast("binary").alias(n)
                   for n in ("n_closed", "closed", "n_crowded", "crowded")), "n_starts", "starts"))
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(
        clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + "".join(
            f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep))
