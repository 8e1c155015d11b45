"""Quality classifier: a factorisation machine on hashed words, text structure and metadata.

    score = sigmoid(b + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j)

The pair sum is half of |sum x_i v_i|**2 - sum x_i**2 |v_i|**2, so scoring is
linear in the number of a text's distinct features.  The machine is fitted by
AdaGrad on a bounded sample of labelled documents and is small enough to be sent
to all tasks (its size is fixed by WORDS and FACTORS).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import packed as k

WORDS = 1 << 16
LEVELS = 16
FACTORS = 8
SAMPLE = 8000
UPDATES = 750
BATCH = 64
SLICE_BYTES = 1 << 20
THRESHOLD = 0.7
# Byte classes: upper, lower, digit, white space, line end, bar, sentence end, other punctuation, not ASCII.
CLASSES = np.full(256, 7, np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[128:] = 0, 1, 2, 8
CLASSES[[9, 11, 12, 13, 32]], CLASSES[10], CLASSES[124] = 3, 4, 5
CLASSES[[33, 46, 63, 44, 59, 58]] = 6
STATS = 9 + 6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def structure(data, bounds, start, stop, first, distinct) -> np.ndarray:
    """Statistics of each text, all between 0 and 1."""
    size = np.maximum(np.diff(bounds), 1)
    words = np.maximum(np.diff(first), 1)
    kind = CLASSES[data]

    def share(flags, edge, of):
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[edge]) / of

    length = stop - start
    edge_kind = kind[stop - 1] if len(stop) else kind[:0]
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] != 3)
    lone = np.isin(edge_kind, (5, 7))
    return np.stack([
        *(share(kind == c, bounds, size) for c in range(9)),
        np.minimum(share(length, first, words) / 20, 1), distinct / words, share(lone, first, words),
        share(length == 1, first, words), share(same, bounds, size), np.minimum(np.log1p(np.diff(first)) / 12, 1)], axis=1)


def features(texts: pa.Array, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts, and the n + 1 boundaries.

    Word weights have length 1 per text; every statistic and every metadata
    column (its logarithm; -1 for null) sets one of LEVELS features.
    """
    data, bounds = k.utf8(texts)
    start, stop, first = k.words_of(data, bounds)
    n = len(texts)
    word = (k.word_hashes(LOWER[data], start, stop) % k.U(WORDS)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    spot, times = np.unique(doc * WORDS + word, return_counts=True)
    of, value = spot // WORDS, np.log1p(times)
    edge = np.searchsorted(of, np.arange(n + 1))
    norm = np.sqrt(np.bincount(of, value * value, minlength=n))
    stats = np.hstack([structure(data, bounds, start, stop, first, np.diff(edge)), metadata])
    level = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * LEVELS).astype(np.int64), LEVELS - 1)
    level = WORDS + np.arange(stats.shape[1]) * (LEVELS + 1) + np.where(stats < 0, LEVELS, level)
    index = np.insert(spot % WORDS, np.repeat(edge[1:], stats.shape[1]), level.ravel())
    weight = np.insert(value / norm[of], np.repeat(edge[1:], stats.shape[1]), 1 / np.sqrt(stats.shape[1]))
    return index.astype(np.int32), weight.astype(np.float32), edge + np.arange(n + 1) * stats.shape[1]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def parts(self, index, value, edge):
        x = value[:, None]
        v = self.factor[index]
        total = np.add.reduceat(x * v, edge[:-1], axis=0)
        square = np.add.reduceat((x * v) ** 2, edge[:-1], axis=0)
        line = np.add.reduceat(value * self.weight[index], edge[:-1])
        return self.bias + line + (total ** 2 - square).sum(axis=1) / 2, total, v

    def score(self, index, value, edge) -> np.ndarray:
        if len(edge) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.parts(index, value, edge)[0].astype(np.float64), -30, 30)))


def fit(index, value, edge, label, size: int, updates: int = UPDATES, batch: int = BATCH, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Logistic loss, AdaGrad on so many batches in a fixed random order."""
    random = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(size, np.float32), random.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    if not len(label):
        return m
    seen_w, seen_v, seen_b = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    while updates > 0:
        order = random.permutation(len(label))
        for at in range(0, len(order), batch)[:updates]:
            updates -= 1
            own = order[at: at + batch]
            n = edge[own + 1] - edge[own]
            cut = np.concatenate([[0], np.cumsum(n)])
            pick = np.repeat(edge[own] - cut[:-1], n) + np.arange(cut[-1])
            i, x = index[pick], value[pick]
            raw, total, v = m.parts(i, x, cut)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[own]).astype(np.float32)
            g = np.repeat(slope, n) * x
            gv = g[:, None] * (np.repeat(total, n, axis=0) - x[:, None] * v)
            there, back = np.unique(i, return_inverse=True)
            gw = np.bincount(back, g, minlength=len(there)) / len(own) + decay * m.weight[there]
            gf = np.stack([np.bincount(back, gv[:, f], minlength=len(there)) for f in range(FACTORS)], 1) / len(own)
            gf += decay * m.factor[there]
            seen_w[there] += gw ** 2
            seen_v[there] += gf ** 2
            m.weight[there] -= rate * gw / np.sqrt(seen_w[there])
            m.factor[there] -= rate * gf / np.sqrt(seen_v[there])
            gb = float(slope.mean())
            seen_b += gb * gb
            m.bias -= rate * gb / seen_b ** 0.5
    return m


def prepared(docs: DataFrame, id_col: str, text_col: str, metadata, keep=()) -> DataFrame:
    logs = [F.coalesce(F.when(F.col(c) >= 0, F.least(F.log1p(F.col(c).cast("double")) / 20, F.lit(1.0))), F.lit(-1.0))
            for c in metadata]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.array(*logs).cast("array<double>").alias("metadata"), *(F.col(c).alias(f"keep_{c}") for c in keep if c != text_col))


def by_slice(batch: pa.RecordBatch, width: int):
    _, bounds = k.utf8(batch.column("text"))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, "right")) - 1)
        part = batch.slice(first, last - first)
        meta = np.asarray(part.column("metadata").flatten(), np.float64).reshape(len(part), width)
        yield part, features(part.column("text"), meta)
        first = last


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    metadata=("n_chars",), sample: int = SAMPLE, updates: int = UPDATES,
) -> Machine:
    """A machine fitted on at most ``sample`` labelled documents, those with the smallest hash of their id.

    Of rows that repeat an id one is learned from; of its labels the highest counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col)).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    width = len(metadata)

    def run(batches):
        for batch in batches:
            for part, (index, value, edge) in by_slice(batch, width):
                cuts = list(zip(edge, edge[1:]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array([index[i:j].tobytes() for i, j in cuts], pa.binary()),
                     pa.array([value[i:j].astype(np.float16).tobytes() for i, j in cuts], pa.binary())],
                    names=["doc_id", "label", "index", "value"])

    # At most ``sample`` rows of two numbers are broadcast, and one row of each of these ids comes back.
    rows = prepared(docs, id_col, text_col, metadata).join(F.broadcast(chosen), "doc_id").mapInArrow(
        run, "doc_id long, label double, index binary, value binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("index", "value", "label")).alias("row")).select("doc_id", "row.*")
    got = sorted(rows.collect(), key=lambda r: r.doc_id)
    index = np.frombuffer(b"".join(bytes(r["index"]) for r in got), np.int32)
    value = np.frombuffer(b"".join(bytes(r["value"]) for r in got), np.float16).astype(np.float32)
    edge = np.concatenate([[0], np.cumsum([len(r["index"]) // 4 for r in got], dtype=np.int64)])
    label = np.array([r.label for r in got], np.float32)
    return fit(index, value, edge, label, WORDS + (STATS + width) * (LEVELS + 1), updates)


def score(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata=("n_chars",),
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Score (0 to 1) of every row, after it the columns named in ``keep``.

    Null and empty texts are scored by their structure and metadata; null
    metadata has a feature of its own.  Rows that repeat an id are scored each.
    Other columns are ignored; an empty table gives no rows.
    """
    width = len(metadata)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            for part, x in by_slice(batch, width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(model.value.score(*x)), *(part.column("text" if c == text_col else f"keep_{c}") for c in keep)],
                    names=["score", *keep])

    fields = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return prepared(docs, id_col, text_col, metadata, keep).mapInArrow(run, f"score double{fields}")


def held_out(id_: Column) -> Column:
    """Documents whose labels are never learned."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2
