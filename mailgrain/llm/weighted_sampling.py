"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A text is a bag of words, the weight of a word is its count.  Sample k of a text
has, for each word of weight S, r and c drawn from Gamma(2, 1) and b uniform,
all fixed by a hash of the word and k:

    t = floor(ln S / r + b)    ln y = r (t - b)    ln a = ln c - ln y - r

and is the pair (word, t) of the smallest a.  Two texts agree in a sample with
the probability of their generalised Jaccard similarity (sum of minima over sum
of maxima of the weights).  A Gamma(2, 1) value is -ln of a product of two uniform ones.

Texts are shuffled once, into runs of consecutive ids; every later step groups
by run and stays in the same tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
TOGETHER = 16
ROWS_PER_RUN = 512
MOST_RUNS = 100_000
PARTITION_BYTES = 4 << 20
BLANK = r"[\x20\x09-\x0D]+"


def constants(values, kind: str) -> Column:
    """A literal array, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def with_last_at_most(rows: DataFrame, bounds: Column, n: int, value: str, out: str) -> DataFrame:
    """Add the number of sorted bounds that are at most the value: a binary search, one projection a step."""
    rows = rows.withColumn(out, F.lit(0))
    for i in reversed(range(n.bit_length())):
        at = F.col(out) + (1 << i)
        rows = rows.withColumn(out, F.when(F.get(bounds, at - 1) <= F.col(value), at).otherwise(F.col(out)))
    return rows


def run_bounds(docs: DataFrame, id_col: str, rows_per_run: int) -> list[int]:
    """First ids of runs of consecutive ids, about equally long; at most MOST_RUNS."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL")
    n = min(MOST_RUNS, max(1, -(-ids.count() // rows_per_run)))
    dealt = ids.repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("run")).agg(F.min("id").alias("id"))
    return sorted({row.id for row in dealt.collect()})


def in_runs(docs: DataFrame, id_col: str, text_col: str, bounds: list[int], partitions: int) -> DataFrame:
    """run, place, guest, doc_id, text, following: rows with the text of the next id.

    The first row of a run is also sent to the run before it, as a guest, so that
    no row has to look beyond its run.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    edges, n = constants(bounds, "bigint") if bounds else F.array().cast("array<bigint>"), len(bounds)
    run = F.when(
        F.col("doc_id").isNull(), -F.pmod(F.xxhash64("text"), F.lit(max(n, 1) * 4)).cast("int")).otherwise(F.col("run"))
    first = F.get(edges, F.col("run") - 1) == F.col("doc_id")
    before = F.when(F.col("run") == 1, F.lit(n)).otherwise(F.col("run") - 1)
    places = F.when(first, F.array(
        F.struct(F.col("run"), F.lit(False).alias("guest")), F.struct(before.alias("run"), F.lit(True).alias("guest"))
    )).otherwise(F.array(F.struct(F.col("run"), F.lit(False).alias("guest"))))
    order = Window.partitionBy("run").orderBy("guest", "doc_id", "text")
    rows = with_last_at_most(rows, edges, n, "doc_id", "run")
    return rows.withColumn("run", run).withColumn("to", F.explode(places)).select(
        "to.run", "to.guest", "doc_id", "text").repartition(partitions, "run").select(
        "run", F.row_number().over(order).alias("place"), "guest", "doc_id", "text",
        F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order)).alias("following"))


def edited_text() -> Column:
    """The text with its last half replaced by the beginning of the following one."""
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half),
        F.substring(F.coalesce("following", F.lit("")), F.lit(1), half))


def uniform(random: Column, shift: int) -> Column:
    """21 bits of a hash as a number between 0 and 1."""
    return (F.shiftrightunsigned(random, shift).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21)


def sample(word: Column, log_weight: Column, k: Column) -> Column:
    """One long per sample: ln a in the upper half, a hash of (word, t) in the lower; the smallest counts."""
    one, two = F.xxhash64(word, k), F.xxhash64(k, word)
    r = -F.ln(uniform(one, 0) * uniform(one, 21))
    log_c = F.ln(-F.ln(uniform(two, 0) * uniform(two, 21)))
    b = uniform(one, 42)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b) - r
    upper = F.floor((F.greatest(F.least(log_a, F.lit(63.9)), F.lit(-63.9)) + 64) * float(1 << 24))
    return F.shiftleft(upper, 32) + F.xxhash64(word, k, t).bitwiseAND(F.lit(0xFFFFFFFF))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and signature (array of samples, in order) of every text with a word.

    If texts are partitioned by one of the keys, nothing is shuffled.
    """
    blocks = samples // TOGETHER
    words = texts.select(*keys, F.explode(F.split("text", BLANK)).alias("word")).where("word != ''")
    counted = words.groupBy(*keys, F.xxhash64("word").alias("word")).count()
    each = counted.select(
        *keys, "word", F.ln("count").alias("log_weight"),
        F.explode(F.array(*(F.lit(j) for j in range(blocks)))).alias("block"))
    least = each.groupBy(*keys, "block").agg(*(
        F.min(sample(F.col("word"), F.col("log_weight"), F.col("block") * TOGETHER + i)).alias(f"s{i}")
        for i in range(TOGETHER)))
    whole = F.array(*(f"s{i}" for i in range(TOGETHER)))
    return least.groupBy(*keys).agg(F.concat(*(
        F.max(F.when(F.col("block") == j, whole)) for j in range(blocks))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike, one without is unlike the others."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(both / F.size(a))


def written(signature: Column) -> Column:
    """A signature as text: eight hexadecimal digits per sample, empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda s: F.lpad(
        F.lower(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(""))


def fingerprint(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
    rows_per_run: int = ROWS_PER_RUN,
) -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    ``edited`` has the last half of the text replaced by as many code points of
    the document with the next id (after the last: the first).  ``near_edited``
    and ``near_next`` are the likeness of the fingerprint to those of the edited
    text and of the next document.

    Null texts count as empty; a text without words has an empty fingerprint.
    Rows that repeat an id are ordered by text.  Rows without id have no next
    document: their edited text is their first half, near_next is null.
    Other columns are ignored; an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    bounds = run_bounds(docs, id_col, rows_per_run)
    rows = in_runs(docs, id_col, text_col, bounds, partitions).withColumn("edited", edited_text())
    variants = rows.select("run", "place", F.explode(F.array(
        F.struct(F.lit(False).alias("changed"), F.col("text")),
        F.struct(F.lit(True).alias("changed"), F.col("edited").alias("text")))).alias("v"))
    signed = signatures(
        variants.select("run", "place", "v.changed", "v.text"), ["run", "place", "changed"], samples)
    pairs = signed.groupBy("run", "place").agg(
        F.max(F.when(~F.col("changed"), F.col("signature"))).alias("own"),
        F.max(F.when(F.col("changed"), F.col("signature"))).alias("changed"))
    # Not a join: that would shuffle the texts again, as it needs partitions by both keys.
    nothing = F.lit(None)
    both = rows.select("run", "place", "guest", "doc_id", "text", "edited", *(
        nothing.cast("array<bigint>").alias(c) for c in ("own", "changed"))).unionByName(pairs.select(
            "run", "place", *(nothing.cast(t).alias(c) for c, t in (
                ("guest", "boolean"), ("doc_id", "bigint"), ("text", "string"), ("edited", "string"))), "own", "changed"))
    here = Window.partitionBy("run", "place")
    joined = both.select("run", "place", "guest", "doc_id", "text", "edited", *(
        F.first(c, ignorenulls=True).over(here).alias(c) for c in ("own", "changed"))).where("guest IS NOT NULL")
    joined = joined.select("*", F.lead("own").over(Window.partitionBy("run").orderBy("place")).alias("next"))
    return joined.where(~F.col("guest")).select(
        "doc_id", "text", "edited", written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        F.when(F.col("doc_id").isNotNull(), likeness(F.col("own"), F.col("next"))).alias("near_next"))
