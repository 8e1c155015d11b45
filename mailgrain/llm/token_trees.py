"""Edit-aware token counts with pre-token segment trees.

A text is split into pre-tokens, whose byte-pair tokens are counted on their own;
a segment tree over the pre-tokens holds sums of counts, its root the text's
number of tokens.  An edit re-encodes only the region it touches: from the last
pre-token boundary that cannot feel the edit to the first boundary after it that
was one before.  Their count replaces the old leaves, and only sums above them
change.

The pattern never looks back, so a text may be split anew from any boundary.  It
looks ahead by one character, or to the end of white space and one character, so a
boundary after other characters stands if the character after it does.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 300_000
EDITS = "array<struct<start:long,stop:long,text:string>>"


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """The vocabulary's ranks, read through Spark, so the path may be in any store."""
    lines = spark.read.text(path).where("value <> ''").collect()
    return {base64.b64decode(a): int(b) for a, b in (row.value.split() for row in lines)}


class Counter:
    """Pre-tokens of texts and their token counts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        new = [p for p in set(pieces) if p not in memo]
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(set(pieces))
            memo.update((p, len(self.encoding.encode_ordinary(p))) for p in new)
        return [memo[p] for p in pieces]

    def split(self, text: str, start: int = 0):
        return self.pattern.finditer(text, start)


class Tree:
    """Sums over leaves, by level; the last level is the root."""

    def __init__(self, leaves):
        level = np.asarray(leaves, np.int64)
        self.levels = [level]
        while len(level) > 1:
            level = np.add.reduceat(level, np.arange(0, len(level), 2))
            self.levels.append(level)

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[-1]) else 0

    def replace(self, first: int, last: int, count: int) -> None:
        """Leaves first..last now hold this count together; updates the sums above them."""
        self.levels[0][first] = count
        self.levels[0][first + 1: last + 1] = 0
        for below, level in zip(self.levels, self.levels[1:]):
            first, last = first // 2, last // 2
            part = below[2 * first: 2 * last + 2]
            level[first: last + 1] = np.add.reduceat(part, np.arange(0, len(part), 2))


def in_bounds(edits, size: int) -> list[tuple[int, int, str]]:
    """Edits by start, clipped to the text; one that begins inside an earlier one begins at its end."""
    out, done = [], 0
    for e in sorted((e for e in edits or () if e is not None), key=lambda e: (e["start"] or 0, e["stop"] or 0)):
        start = min(max(e["start"] or 0, done), size)
        stop = min(max(e["stop"] if e["stop"] is not None else start, start), size)
        out.append((start, stop, e["text"] or ""))
        done = stop
    return out


def apply(counter: Counter, text: str, ends: np.ndarray, tree: Tree, edits) -> tuple[str, int]:
    """The edited text; updates the tree.  Also how many pre-tokens were encoded anew.

    ``ends`` are the pre-tokens' ends in the old text.
    """
    edits, pieces, at, shift = in_bounds(edits, len(text)), [], 0, []
    for start, stop, new in edits:
        pieces += [text[at:start], new]
        shift.append((stop, sum(map(len, pieces)) - stop))
        at = stop
    edited = "".join([*pieces, text[at:]])
    bounds = np.concatenate([[0], ends])

    def settled(position: int) -> int:
        """Number of the last boundary before a change there that stands: its next character stays, and it is not in white space."""
        n = max(int(np.searchsorted(bounds, position, "left")) - 1, 0)
        while n and text[bounds[n] - 1].isspace():
            n -= 1
        return n

    firsts = [settled(start) for start, _, _ in edits]
    encoded, i = 0, 0
    while i < len(edits):
        first, last, region = firsts[i], len(ends) - 1, []
        for match in counter.split(edited, int(bounds[first]) + (shift[i - 1][1] if i else 0)):
            region.append(match.group())
            while i + 1 < len(edits) and match.end() > edits[i + 1][0] + shift[i][1] - 1:
                i += 1
            old = match.end() - shift[i][1]
            if old > edits[i][1] or (old == edits[i][1] and old < len(text)):
                n = int(np.searchsorted(bounds, old))
                if n < len(bounds) and bounds[n] == old and n > first:
                    if i + 1 < len(edits) and firsts[i + 1] < n:
                        i += 1
                    else:
                        last = n - 1
                        break
        encoded += len(region)
        count = sum(counter.counts(region))
        if len(ends):
            tree.replace(first, max(last, first), count)
        else:
            tree.__init__([count])
        i += 1
    return edited, encoded


def recount(
    docs: DataFrame, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str = VOCABULARY, tree_col: str | None = None,
) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, edited, edited_tokens, n_encoded, tree.

    ``edits`` is an array of (start, stop, text) in code points of the old text:
    text[start:stop] becomes text.  ``n_encoded`` pre-tokens were encoded for the
    edits.  ``tree`` holds the pre-tokens' lengths and counts of the old text; where
    ``tree_col`` has it from an earlier run, the old text is not split again.

    Null texts count as empty, null edits or fields as no edit, position 0 or
    empty text.  Edits are clipped to the text and to the end of the one before.
    Rows that repeat an id are rows of their own.  Other columns are ignored; an
    empty table gives no rows.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, vocabulary))

    def run(batches):
        counter = Counter(ranks.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = []
                for text, edits, tree in zip(*(part.column(c).to_pylist() for c in ("text", "edits", "tree"))):
                    text = text or ""
                    if tree is None:
                        pieces = counter.pattern.findall(text)
                        sizes, leaves = list(map(len, pieces)), counter.counts(pieces)
                        tree = np.array([sizes, leaves], np.int32).tobytes()
                    sizes, leaves = np.frombuffer(tree, np.int32).reshape(2, -1)
                    sums = Tree(leaves.astype(np.int64))
                    before = sums.total
                    edited, encoded = apply(counter, text, np.cumsum(sizes, dtype=np.int64), sums, edits)
                    out.append((before, len(sizes), edited, sums.total, encoded, tree))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())))],
                    names=["doc_id", "n_tokens", "n_pretokens", "edited", "edited_tokens", "n_encoded", "tree"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(edits_col).cast(EDITS).alias("edits"),
        (F.col(tree_col) if tree_col else F.lit(None)).cast("binary").alias("tree"),
    ).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, edited string, edited_tokens long, "
                      "n_encoded long, tree binary")
