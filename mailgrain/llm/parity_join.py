"""N-gram Jaccard join with parity sketches.

A document is its set of word shingles.  Hashing every shingle to one bit and
XOR-ing gives a parity sketch; the Hamming distance of two sketches is at most
the size of the symmetric difference of the sets, which for a similarity of 3/4
is at most (a + b) / 7 for sizes a and b.

* Size bands are powers of two; a document near the upper edge also enters the
  next band.  The sketch of band j has 2**j pieces.  Equal non-empty pieces of
  two linked documents number more than the pieces of either less that
  distance, so by pigeonhole some equal piece is among the first distance + 1
  pieces of both in any common order: those with most shingles, the most
  selective, come first.  A piece is sent as the XOR of its set bits' hashes.
  A document whose pieces are too few also sends its shingles as pieces.
* Documents with equal sets count once from here on.  First, every document of
  a piece is compared with the smallest one and the one before, if sizes and the
  Hamming distance of their sketches allow a link.  Components of those links are
  found; then, within each piece, documents of different components are compared:
  in the first round as many as may join the components, in the second all that
  are left.  Documents of one component need no comparison, so large groups of
  copies cost no pairs.
* Sets are compared exactly (48-bit shingle hashes, shipped once per candidate).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import packed as k
from mailgrain.llm.components import components
from mailgrain.sources.workspace import stored

SHINGLE = 5
SLICE_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
LEAST_BITS = 9
BLOCK = 4096
GROUP_ROWS = 16_384
FULL, PAIRS, GROUPS = 8, 0, 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch, text_col: str):
    """Runs of rows with bounded text bytes (one row at least)."""
    _, bounds = k.utf8(batch.column(text_col))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def shingles(texts: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted per text, and the n + 1 boundaries."""
    data, bounds = k.utf8(texts)
    data = LOWER[data]
    start, stop, first = k.words_of(data, bounds)
    prefix = k.prefix_hash(k.word_hashes(data, start, stop))
    at = k.windows(first, length)
    doc = np.searchsorted(first, at, "right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < length))
    value = np.concatenate([k.stretch_hash(prefix, at, at + length), k.stretch_hash(prefix, first[short], first[short + 1])])
    value, doc = k.mix(value, 5), np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(value: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """The parity sketch of each text: a power of two of bits, two to four times the shingles."""
    size = np.diff(edge)
    bits = np.int64(1) << np.maximum(LEAST_BITS, np.frexp(size.astype(np.float64))[1] + 1)
    base = np.concatenate([[0], np.cumsum(bits)])
    spot = np.repeat(base[:-1], size) + (k.mix(value, 6) & np.repeat(bits - 1, size).astype(k.U)).astype(np.int64)
    spot, times = np.unique(spot, return_counts=True)
    flags = np.zeros(int(base[-1]), np.uint8)
    flags[spot[times % 2 == 1]] = 1
    data = np.packbits(flags, bitorder="little").tobytes()
    return [data[i:j] for i, j in zip(base // 8, base[1:] // 8)]


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The same parities in a smaller sketch: halves of the last axis XOR-ed."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    words = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(axis=-1, dtype=np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) // 7


def piece_keys(value: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each text's leading sketch pieces in its size bands, and the text's number."""
    size = np.diff(edge)
    own = np.frexp(size.astype(np.float64))[1] - 1
    upper = np.flatnonzero((size > 0) & (100 * size >= 75 * (np.int64(1) << (own + 1).clip(0))))
    keys, docs = [], []
    for chosen, band in ((np.flatnonzero(size > 0), own), (upper, own + 1)):
        n = size[chosen]
        doc = np.repeat(np.arange(len(chosen)), n)
        spot = np.repeat(edge[chosen] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(len(doc))
        bit, level = value[spot], band[chosen]
        piece = (bit >> k.U(1)) >> (63 - level)[doc].astype(k.U)
        cut = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else doc
        if not len(cut):
            continue
        most = np.minimum(4 * n // 3, (np.int64(1) << (level + 1)) - 1)
        allowed = distance(n, most)
        for coarse in (True, False):
            if coarse:
                key = k.mix(np.bitwise_xor.reduceat(k.mix(bit, 7), cut) ^ k.mix(piece[cut], 8))
                of, weight = doc[cut], np.diff(np.append(cut, len(doc)))
                few = np.bincount(of, minlength=len(chosen)) <= allowed
            else:
                rest = few[doc]
                key, of, weight = k.mix(bit[rest], 9), doc[rest], np.ones(int(rest.sum()), np.int64)
            key = k.mix(key ^ level[of].astype(k.U), 30 + coarse)
            order = np.lexsort((key, -weight, of))
            key, of = key[order], of[order]
            lead = np.arange(len(of)) - np.searchsorted(of, of) <= allowed[of]
            keys.append(key[lead])
            docs.append(chosen[of[lead]])
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, k.U), np.zeros(0, np.int64))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, two hashes of the set, and its sketch; a row for each row of (doc_id, text)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, edge = shingles(part.column("text"))
                sums = [np.concatenate([np.zeros(1, k.U), np.cumsum(v, dtype=k.U)]) for v in (k.mix(value, 20), k.mix(value, 21))]
                one, two = (k.mix((s[edge[1:]] - s[edge[:-1]]) ^ np.diff(edge).astype(k.U)).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(edge)), pa.array(one), pa.array(two),
                     pa.array(sketches(value, edge), pa.binary())], names=["doc_id", "n", "one", "two", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, one long, two long, sketch binary")


def send(ids, keys, buckets):
    bucket = (keys % k.U(buckets)).astype(np.int64)
    order = np.lexsort((ids, bucket))
    keys, ids, bucket = keys[order], ids[order], bucket[order]
    value, low = np.unique(bucket, return_index=True)
    cuts = list(zip(low, [*low[1:], len(keys)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(value, pa.int64()), pa.array([j - i for i, j in cuts], pa.int64()),
         pa.array([keys[i:j].tobytes() for i, j in cuts], pa.binary()),
         pa.array([k.pack(ids[i:j]) for i, j in cuts], pa.binary())], names=["bucket", "n", "keys", "ids"])


def candidates(docs: DataFrame, buckets: int) -> DataFrame:
    """kind, n, x, y, z: packed pairs of a piece's documents with its smallest and with the one before;
    members of pieces with three or more."""
    def keys(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, edge = shingles(part.column("text"))
                key, doc = piece_keys(value, edge)
                yield send(k.ordered_ids(part.column("doc_id"))[doc], key, buckets)

    def meet(table):
        n = table["n"].to_pylist()
        key = np.frombuffer(b"".join(table["keys"].to_pylist()), k.U)
        ids = np.concatenate([k.unpack(d, m) for d, m in zip(table["ids"].to_pylist(), n)])
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[new], ids[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        low, rest = np.repeat(ids[first], size), np.ones(len(ids), bool)
        rest[first] = False
        pair = np.unique(np.concatenate([
            np.stack([low[rest], ids[rest]], 1), np.stack([ids[:-1][rest[1:]], ids[rest]], 1)]), axis=0)
        to = (k.mix(pair[:, 0].view(k.U) ^ k.mix(pair[:, 1].view(k.U), 40), 41) % k.U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        pair, to = pair[order], to[order]
        value, cut = np.unique(to, return_index=True)
        out = [(PAIRS, v, j - i, k.pack(pair[i:j, 0]), k.pack(pair[i:j, 1]), None)
               for v, i, j in zip(value.tolist(), cut, [*cut[1:], len(pair)])]
        label = k.mix(np.add.reduceat(k.mix(ids.view(k.U), 42), first) ^ size.astype(k.U), 43)
        many = np.flatnonzero(size > 2)
        label, pick = np.unique(label[many], return_index=True)
        many = many[pick]
        if len(many):
            count = size[many]
            spot = np.repeat(first[many] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
            out.append((GROUPS, 0, len(many), label.tobytes(), k.pack(count), k.pack(ids[spot])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (
            pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
            names=["kind", "bucket", "n", "x", "y", "z"])

    return docs.mapInArrow(keys, "bucket long, n long, keys binary, ids binary").groupBy("bucket").applyInArrow(
        meet, "kind int, bucket long, n long, x binary, y binary, z binary")


def distinct_pairs(found: DataFrame) -> DataFrame:
    def join(table):
        n = table["n"].to_pylist()
        a, b = (np.concatenate([k.unpack(d, m) for d, m in zip(table[c].to_pylist(), n)]) for c in "xy")
        pair = np.unique(np.stack([a, b], 1), axis=0)
        return pa.Table.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return found.where(F.col("kind") == PAIRS).select("bucket", "n", "x", "y").groupBy("bucket").applyInArrow(
        join, "a long, b long")


def members(found: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for n, x, y, z in zip(*(batch.column(c).to_pylist() for c in "nxyz")):
                count = k.unpack(y, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.frombuffer(x, np.int64), count)), pa.array(k.unpack(z, int(count.sum())))],
                    names=["piece", "doc_id"])

    return found.where(F.col("kind") == GROUPS).select("n", "x", "y", "z").mapInArrow(run, "piece long, doc_id long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, n, items: packed sorted shingle hashes of the wanted documents."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, edge = shingles(part.column("text"))
                value = (value >> k.U(16)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(edge)),
                     pa.array([k.pack(value[i:j]) for i, j in zip(edge, edge[1:])], pa.binary())],
                    names=["doc_id", "n", "items"])

    return docs.join(wanted, "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, items binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are at least 75 % alike."""
    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_pylist() for c in ("na", "nb"))
            x, y = batch.column("x"), batch.column("y")
            keep = []
            for i in range(batch.num_rows):
                both = len(np.intersect1d(k.unpack(x[i].as_buffer(), n[i]), k.unpack(y[i].as_buffer(), m[i]), assume_unique=True))
                keep.append(100 * both >= 75 * (n[i] + m[i] - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(
        (100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb"))
    ).select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to be linked."""
    def run(batches):
        for batch in batches:
            n, m = (k.one_array(batch.column(c)).to_numpy() for c in ("na", "nb"))
            far = np.array([hamming(np.frombuffer(x, k.U), np.frombuffer(y, k.U)) for x, y in zip(
                batch.column("x").to_pylist(), batch.column("y").to_pylist())], np.int64)
            keep = pa.array(far <= distance(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    left = sketched.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = sketched.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")
    ).select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def allowed_pairs(ids, root, n, raw, forest: bool) -> np.ndarray:
    """Pairs of one piece's documents, in the order of size; see :func:`across`."""
    root = root.copy()
    words = np.array([len(r) // 8 for r in raw])
    kinds, low = np.unique(words, return_index=True)
    high = [*low[1:], len(ids)]
    blocks = [np.frombuffer(b"".join(raw[i:j]), k.U).reshape(j - i, -1) for i, j in zip(low, high)]
    out = []
    for i in range(len(ids)):
        last = int(np.searchsorted(300 * n, 400 * n[i], "right"))
        kind = int(np.searchsorted(kinds, words[i]))
        mine = blocks[kind][i - low[kind]]
        near = []
        for c in range(kind, len(kinds)):
            a, b = max(i + 1, low[c]), min(last, high[c])
            if a < b:
                j = a + np.flatnonzero(root[a:b] != root[i])
                if len(j):
                    near.append(j[hamming(blocks[c][j - low[c]], mine) <= distance(n[i], n[j])])
        j = np.concatenate(near) if near else np.zeros(0, np.int64)
        if forest and len(j):
            merged, first = np.unique(root[j], return_index=True)
            j = j[first]
            root[np.isin(root, merged)] = root[i]
        out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
    return np.concatenate(out)


def across(members: DataFrame, forest: bool) -> DataFrame:
    """piece, a, b: pairs of different components within a piece that sizes and sketches allow.

    members: piece, size and low (number of documents and smallest one of the
    piece), doc_id, root, n, sketch.  With ``forest``, only as many pairs of a piece
    as join its components if all of them are links; else every such pair, with
    one of its pieces.

    Pieces with the same smallest document, which mostly belong to one family, are
    looked at together, so that a pair they share is given once.
    """
    def run(table):
        piece, ids, root, n = (k.one_array(table[c]).to_numpy() for c in ("piece", "doc_id", "root", "n"))
        order = np.lexsort((ids, n, piece))
        piece, ids, root, n = piece[order], ids[order], root[order], n[order]
        raw = table["sketch"].take(pa.array(order)).to_pylist()
        cut = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        found = [(p, allowed_pairs(ids[i:j], root[i:j], n[i:j], raw[i:j], forest))
                 for p, i, j in zip(piece[cut], cut, [*cut[1:], len(piece)])]
        of = np.repeat(piece[cut], [len(x) for _, x in found])
        pair = np.concatenate([x for _, x in found])
        if not forest:
            pair, first = np.unique(pair, axis=0, return_index=True)
            of = of[first]
        return pa.Table.from_arrays([pa.array(of), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["piece", "a", "b"])

    # Pieces with very many documents are cut into blocks, and every pair of blocks is dealt by itself.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    parts = members.groupBy("low").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))
    dealt = members.join(parts, "low").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({
        "part": F.pmod(F.xxhash64("piece"), F.col("parts")), "from": F.least("own", "other"), "to": F.greatest("own", "other")})
    # The join leaves rows dealt by ``low``, which would do for these groups but keep a family in one task.
    keys = ["low", "part", "from", "to"]
    return dealt.repartition(*keys).groupBy(*keys).applyInArrow(run, "piece long, a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Words are lower-cased (A-Z); a document with fewer than five is one shingle.
    Documents link when 100 * intersection >= 75 * union; component_id is the
    smallest id reachable by links.  A document without words is its own
    component.

    Null texts count as empty.  Rows without id get their size and no component.
    Ids should be unique: rows that repeat an id are linked by equal sets, and by
    sets that are merely alike as far as these link to the id's largest set.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total, _ = k.parts(rows, F.octet_length("text"), BUCKET_BYTES)
    facts = stored(describe(rows), "sets")
    usable = rows.where("doc_id IS NOT NULL")
    found = stored(candidates(usable, max(1, -(-total // BUCKET_BYTES))), "pieces")

    known = facts.where("doc_id IS NOT NULL AND n > 0")
    first = known.groupBy("one", "two").agg(F.min("doc_id").alias("rep"))
    # One set per document id from here on.
    of = stored(known.join(first, ["one", "two"]).groupBy("doc_id", "rep").agg(F.max("n").alias("n")), "copies")
    name = of.select("doc_id", "rep")
    sketched = stored(known.groupBy("doc_id").agg(F.max(F.struct("n", "sketch")).alias("s")).join(
        name.where("doc_id = rep").select("doc_id").distinct(), "doc_id").select("doc_id", "s.n", "s.sketch"), "sketches")
    pairs = stored(possible(
        distinct_pairs(found).join(name.toDF("a", "ra"), "a").join(name.toDF("b", "rb"), "b")
        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(),
        sketched), "pairs")
    groups = stored(members(found).join(name, "doc_id").select("piece", F.col("rep").alias("doc_id")).distinct(), "members")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(groups.select("doc_id")).distinct()
    sets = stored(sets_of(usable, wanted), "shingles")
    links = stored(verified(pairs, sets), "links")
    roots = components(links).withColumnRenamed("node", "rep")
    for forest in (True, False):
        placed = stored(groups.join(roots.withColumnRenamed("rep", "doc_id"), "doc_id", "left").withColumn(
            "root", F.coalesce("root", "doc_id")), "placed")
        mixed = placed.groupBy("piece").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                            F.min("doc_id").alias("first"), F.count("*").alias("size")
        ).where("low < high").select("piece", "size", F.col("first").alias("low"))
        allowed = stored(across(placed.join(mixed, "piece").join(sketched, "doc_id"), forest), "allowed")
        more = stored(allowed.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        new = stored(verified(more, sets), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links).withColumnRenamed("node", "rep")
        # A piece without an allowed pair has none later either, when fewer components are left.
        pairs, groups = pairs.unionByName(more), groups.join(allowed.select("piece").distinct(), "piece", "left_semi")

    rep = facts.join(first, ["one", "two"], "left").join(roots, "rep", "left")
    return rep.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
