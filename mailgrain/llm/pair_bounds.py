"""Ranked lexical search: MaxScore with bounds for pairs of terms.

* ``index`` turns chunks of documents into inverted lists: for each term of a
  chunk the documents that hold it and how often.  It knows no query.
* ``weigh`` turns the lists of a block of queries' terms into impacts (weight
  times saturated frequency) and intersects, for neighbouring terms of every query
  in order of weight, their lists: the documents that hold both, their joint
  impacts, and the largest of these.
* ``search`` bounds what a document of a chunk can reach.  Two terms of a pair
  give no more than the larger of their own maxima and their joint maximum, often
  far less than the sum of their maxima; disjoint pairs along the order of weight
  are chosen so that the sum of bounds is least.  A chunk whose bound is below the
  k-th best score so far is skipped.  Otherwise groups with the smallest bounds,
  together below that score, bring no candidates of their own; they are looked up
  for the candidates of the others, until these fall below it as well.

A task keeps the best documents of each query over all its chunks and sends those
only.  It starts from a score that k documents of some chunk reach by one pair or
term alone.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm.packed import one_array, pack, unpack, utf8
from mailgrain.sources.workspace import stored

K = 20
SLICE_BYTES = 4 << 20
QUERY_BYTES = 4 << 20
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
BYTES = np.arange(256, dtype=np.uint8)
LETTERS = (BYTES >= 128) | np.isin(BYTES, np.frombuffer(
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
LOWER_BYTES = BYTES + np.where((BYTES >= 65) & (BYTES <= 90), 32, 0).astype(np.uint8)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    return [t.encode() for t in TERM.findall((text or "").translate(LOWER))]


# -- the index -------------------------------------------------------------

def binaries(letters: np.ndarray, size: np.ndarray) -> pa.Array:
    edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(letters))])


def inverted(texts: pa.Array):
    """(terms, lengths of lists, documents, frequencies, documents' sizes); lists lie in the order of terms."""
    data, bounds = utf8(texts)
    inside = LETTERS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    coded = binaries(LOWER_BYTES[data[inside]], stop - start).dictionary_encode()
    doc = np.searchsorted(bounds, start, "right") - 1
    key, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * len(texts) + doc, return_counts=True)
    term, place = np.divmod(key, max(len(texts), 1))
    return (coded.dictionary, np.bincount(term, minlength=len(coded.dictionary)), place, tf,
            np.bincount(doc, minlength=len(texts)))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Inverted lists of all documents, stored; one row for each chunk of documents, of about so many bytes of text.

    Null texts and texts without a term have no list entries.  Rows without id
    and rows that repeat an id are documents of their own.  Other columns are
    ignored; an empty table gives an empty index.
    """
    def run(batches):
        for batch in batches:
            _, bounds = utf8(batch.column("text"))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + slice_bytes, "right")) - 1)
                part = batch.slice(first, last - first)
                first = last
                terms, df, place, tf, size = inverted(part.column("text"))
                edge = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset:terms.offset + len(terms) + 1] if len(terms) else [0]
                letters = b"".join(terms.to_pylist())
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_pylist([{
                    "n_docs": int((size > 0).sum()), "n_terms": int(size.sum()), "ids": ids.to_pylist(), "sizes": pack(size),
                    "letters": letters, "lengths": pack(np.diff(edge)), "terms": len(terms), "df": pack(df),
                    "entries": len(place), "places": pack(place), "tf": pack(tf),
                }], INDEX)

    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "n_docs long, n_terms long, ids array<long>, sizes binary, letters binary, lengths binary, terms long, df binary, "
             "entries long, places binary, tf binary"), "lists")


INDEX = pa.schema([
    ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("letters", pa.binary()),
    ("lengths", pa.binary()), ("terms", pa.int64()), ("df", pa.binary()), ("entries", pa.int64()), ("places", pa.binary()),
    ("tf", pa.binary())])


def known_terms(row: dict, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a chunk's terms that the vocabulary has, their numbers there, and the lengths of all lists."""
    terms = binaries(np.frombuffer(row["letters"], np.uint8), unpack(row["lengths"], row["terms"]))
    code = pc.index_in(terms, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(code >= 0)
    return own, code[own].astype(np.int64), unpack(row["df"], row["terms"])


def frequencies(lists: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """How many documents hold each term of the vocabulary; one row a task and term is shuffled."""
    def run(batches):
        terms, total = pa.array(vocabulary, pa.large_binary()), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own, code, df = known_terms(row, terms)
                total[code] += df[own]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    rows = lists.select("letters", "lengths", "terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(
        F.sum("df").alias("df")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        out[r["term"]] = r["df"]
    return out


# -- queries ---------------------------------------------------------------

class Queries:
    """A block of queries: their terms by falling weight, and the pairs of neighbours in that order.

    ``terms`` and ``times`` have a row for each query, filled up by -1 and 0;
    ``pairs`` holds the number of the pair of a term and the next one, or -1.
    """

    def __init__(self, rows: list[tuple[int, dict[int, int]]], weight: np.ndarray):
        self.ids = [i for i, _ in rows]
        own = [sorted(counts, key=lambda t: (-weight[t], t)) for _, counts in rows]
        shape = len(rows), max(map(len, own), default=0)
        self.terms, self.times = np.full(shape, -1), np.zeros(shape, np.int64)
        self.pairs = np.full((shape[0], max(shape[1] - 1, 0)), -1)
        number: dict[tuple[int, int, int, int], int] = {}
        for q, ((_, counts), order) in enumerate(zip(rows, own)):
            self.terms[q, :len(order)] = order
            self.times[q, :len(order)] = [counts[t] for t in order]
            for i, (t, u) in enumerate(zip(order, order[1:])):
                self.pairs[q, i] = number.setdefault((t, counts[t], u, counts[u]), len(number))
        self.members = np.array(list(number), np.int64).reshape(-1, 4)


def joint(docs: int, start: np.ndarray, key: np.ndarray, impact: np.ndarray, members: np.ndarray):
    """(pair, document, joint impact) of all documents that hold both terms of a pair."""
    t, a, u, b = members.T
    size = np.diff(start)
    swap = size[t] > size[u]
    short, long = np.where(swap, u, t), np.where(swap, t, u)
    of_short, of_long = np.where(swap, b, a), np.where(swap, a, b)
    n = np.where(size[long] > 0, size[short], 0)
    pair = np.repeat(np.arange(len(members)), n)
    entry = np.repeat(start[short] - (np.cumsum(n) - n), n) + np.arange(len(pair))
    place = key[entry] - short[pair] * docs
    wanted = long[pair] * docs + place
    at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
    hit = np.flatnonzero(key[at] == wanted) if len(key) else at
    pair, at, entry = pair[hit], at[hit], entry[hit]
    return pair, place[hit], impact[entry] * of_short[pair] + impact[at] * of_long[pair]


def kth_best(group: np.ndarray, value: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The k-th highest value of each group (0 with fewer); groups ascend."""
    order = np.lexsort((-value, group))
    spot = np.searchsorted(group, np.arange(groups)) + k - 1
    out = np.zeros(groups, np.int64)
    there = np.bincount(group, minlength=groups) >= k
    out[there] = value[order][spot[there]]
    return out


WEIGHED = ("ids array<long>, docs long, lengths binary, entries long, places binary, impacts binary, floors binary, "
           "sizes binary, joint_entries long, joint_places binary, joint_impacts binary")


def weigh(lists: DataFrame, queries: Queries, vocabulary: list[bytes], weight: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """Impacts of the vocabulary's terms and joint impacts of the queries' pairs, by chunk; stored."""
    members = queries.members

    def run(batches):
        terms = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            for row in batch.to_pylist():
                own, code, df = known_terms(row, terms)
                docs = len(row["ids"])
                order = np.argsort(code)
                own, code = own[order], code[order]
                length = np.zeros(len(vocabulary), np.int64)
                length[code] = df[own]
                start = np.concatenate([[0], np.cumsum(length)])
                entry = np.repeat((np.cumsum(df) - df)[own] - start[code], df[own]) + np.arange(start[-1])
                place, tf = unpack(row["places"], row["entries"])[entry], unpack(row["tf"], row["entries"])[entry]
                m = 75 + 25 * unpack(row["sizes"], docs) * n // total
                term = np.repeat(np.arange(len(vocabulary)), length)
                impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
                pair, at, both = joint(docs, start, term * docs + place, impact, members)
                order = np.lexsort((at, pair))
                pair, at, both = pair[order], at[order], both[order]
                floors = np.concatenate([kth_best(term, impact, len(vocabulary), k), kth_best(pair, both, len(members), k)])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                    (row["ids"], pa.list_(pa.int64())), (docs, pa.int64()), (pack(length), pa.binary()), (len(place), pa.int64()),
                    (pack(place), pa.binary()), (pack(impact), pa.binary()), (pack(floors), pa.binary()),
                    (pack(np.bincount(pair, minlength=len(members))), pa.binary()), (len(pair), pa.int64()),
                    (pack(at), pa.binary()), (pack(both), pa.binary()))], names=[c.split()[0] for c in WEIGHED.split(", ")])

    return stored(lists.mapInArrow(run, WEIGHED), "impacts")


def floors_of(weighed: DataFrame, queries: Queries, terms: int) -> np.ndarray:
    """For each query a score that k documents reach by one term or one pair of it alone (0 without)."""
    size = terms + len(queries.members)

    def run(batches):
        best = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column("floors").to_pylist():
                best = np.maximum(best, unpack(value, size))
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], names=["at", "floor"])

    best = np.zeros(size + 1, np.int64)
    for r in weighed.select("floors").mapInArrow(run, "at long, floor long").groupBy("at").agg(F.max("floor").alias("floor")).collect():
        best[r["at"]] = r["floor"]
    alone = np.where(queries.terms >= 0, best[queries.terms] * queries.times, 0).max(axis=1, initial=0)
    pairs = np.where(queries.pairs >= 0, best[terms + queries.pairs], 0).max(axis=1, initial=0)
    return np.maximum(alone, pairs)


# -- search ----------------------------------------------------------------

def pairing(most: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least sum of bounds over disjoint neighbouring pairs, and which pairs are taken, for each query.

    ``most`` bounds single terms, ``joined`` a term together with the next one.
    """
    queries, terms = most.shape
    saved = most[:, :-1] + most[:, 1:] - joined
    best = np.zeros((queries, terms + 1), np.int64)
    for i in range(2, terms + 1):
        best[:, i] = np.maximum(best[:, i - 1], best[:, i - 2] + saved[:, i - 2])
    taken = np.zeros(joined.shape, bool)
    at = np.full(queries, terms)
    for i in range(terms, 1, -1):
        here = (at == i) & (best[:, i] > best[:, i - 1])
        taken[:, i - 2] = here
        at = np.where(here, i - 2, np.where(at == i, i - 1, at))
    return most.sum(axis=1) - best[:, terms], taken


class Chunk:
    """Lists and joint lists of one chunk."""

    def __init__(self, row: dict, terms: int, pairs: int):
        self.ids, self.docs = row["ids"], row["docs"]
        self.start = np.concatenate([[0], np.cumsum(unpack(row["lengths"], terms))])
        self.place, self.impact = unpack(row["places"], row["entries"]), unpack(row["impacts"], row["entries"])
        self.first = np.concatenate([[0], np.cumsum(unpack(row["sizes"], pairs))])
        self.both, self.joint = (unpack(row[c], row["joint_entries"]) for c in ("joint_places", "joint_impacts"))
        self.most, self.most_joint = self.highest(self.impact, self.start), self.highest(self.joint, self.first)

    @staticmethod
    def highest(value: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The highest value of each stretch; 0 for empty ones, and one more 0 at the end, which number -1 means."""
        out = np.zeros(len(edge), np.int64)
        some = np.flatnonzero(np.diff(edge))
        if len(some):
            out[some] = np.maximum.reduceat(value, edge[some])
        return out

    def entries(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.start[term], self.start[term + 1])
        return self.place[own], self.impact[own]

    def joint_entries(self, pair: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[pair], self.first[pair + 1])
        return self.both[own], self.joint[own]


def looked_up(wanted: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of ascending places at those wanted; 0 where there is none."""
    if not len(places):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
    return np.where(places[at] == wanted, values[at], 0)


def candidates(chunk: Chunk, terms, times, pairs, taken, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of all documents of a chunk that reach the floor."""
    groups, i = [], 0
    while i < len(terms) and terms[i] >= 0:
        if i < len(taken) and taken[i]:
            own = [(terms[i], times[i]), (terms[i + 1], times[i + 1])]
            bound = max(*(chunk.most[t] * n for t, n in own), chunk.most_joint[pairs[i]])
            groups.append((bound, pairs[i], own))
        else:
            groups.append((chunk.most[terms[i]] * times[i], None, [(terms[i], times[i])]))
        i += len(groups[-1][2])
    groups = sorted((g for g in groups if g[0]), key=lambda g: g[0])
    below, bound = 0, 0
    while below < len(groups) and bound + groups[below][0] < floor:
        bound += groups[below][0]
        below += 1
    score = np.zeros(chunk.docs, np.int64)
    for _, _, own in groups[below:]:
        for term, n in own:
            place, impact = chunk.entries(term)
            score[place] += impact * n
    place = np.flatnonzero(score)
    score = score[place]
    for most, pair, own in reversed(groups[:below]):
        keep = score + bound >= floor
        place, score = place[keep], score[keep]
        bound -= most
        more = np.zeros(len(place), np.int64)
        if pair is not None:
            more = looked_up(place, *chunk.joint_entries(pair))
        for term, n in own:
            # A document in a joint list has both terms' impacts from there.
            more = np.where(more, more, looked_up(place, *chunk.entries(term)) * n)
        score = score + more
    keep = score >= floor
    return place[keep], score[keep]


def search_block(weighed: DataFrame, queries: Queries, terms: int, floors: np.ndarray, k: int) -> DataFrame:
    """item_id, doc_id, score: at most k rows for each query and task."""
    def run(batches):
        floor = np.maximum(floors, 1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in queries.ids]
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, terms, len(queries.members))
                ids = np.array([i or 0 for i in chunk.ids], np.int64)
                blank = np.array([i is None for i in chunk.ids], bool)
                most = chunk.most[queries.terms] * queries.times
                joined = np.maximum(np.maximum(most[:, :-1], most[:, 1:]), chunk.most_joint[queries.pairs])
                reach, taken = pairing(most, joined)
                for q in np.flatnonzero(reach >= floor).tolist():
                    place, score = candidates(
                        chunk, queries.terms[q].tolist(), queries.times[q].tolist(), queries.pairs[q].tolist(), taken[q], floor[q])
                    if len(place):
                        score, own, empty = (np.concatenate(x) for x in zip(found[q], (score, ids[place], blank[place])))
                        order = np.lexsort((own, empty, -score))[:k]
                        found[q] = score[order], own[order], empty[order]
                        if len(order) == k:
                            floor[q] = max(floor[q], score[order[-1]])
        size = [len(f[0]) for f in found]
        score, own, empty = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(queries.ids, np.int64), size)), pa.array(own, mask=empty.astype(bool)), pa.array(score)],
            names=["item_id", "doc_id", "score"])

    return weighed.mapInArrow(run, "item_id long, doc_id long, score long")


def search(
    lists: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = K, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents of an index, all with a score above 0 if fewer.

    With N documents that have a term, L terms in all of them, n terms in one of
    them, m = 75 + 25 * n * N div L and a term's weight
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), the score is the sum over the
    query's terms, repeats included, of
    w * (1000000000 * tf div (1000 * tf + 12 * m)).  Equal scores go by ascending
    id, documents without id last.

    Queries without id take no part; if an id repeats, its greatest text is asked.
    Null texts and texts without a term find nothing.  Queries go in blocks of about
    ``query_bytes`` of text, which tasks get whole.  Other columns are ignored; an
    empty index or no queries give no rows.
    """
    spark = lists.sparkSession
    asked = queries.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.col(text_col).cast("string")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    n, total = lists.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found = [spark.createDataFrame([], "item_id long, doc_id long, score long")]
    for block in range(blocks if n else 0):
        rows = [(r.id, terms_of(r.text)) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()]
        vocabulary = sorted({t for _, own in rows for t in own})
        if not vocabulary:
            continue
        df = frequencies(lists, vocabulary)
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df], np.int64)
        number = {t: i for i, t in enumerate(vocabulary)}
        counts = []
        for i, own in rows:
            times: dict[int, int] = {}
            for t in own:
                if df[number[t]] and weight[number[t]]:
                    times[number[t]] = times.get(number[t], 0) + 1
            counts.append((i, times))
        block_queries = Queries(counts, weight)
        weighed = weigh(lists, block_queries, vocabulary, weight, n, total, k)
        found.append(search_block(weighed, block_queries, len(vocabulary), floors_of(weighed, block_queries, len(vocabulary)), k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
