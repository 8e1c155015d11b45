"""The registered query of each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.llm import (
    bit_planes, block_labeller, curriculum, large_item_packing, length_buckets, pair_bounds, parity_join, quality_machine, suffix_dedup,
    token_trees, topk_search, weighted_sampling, window_dedup,
)
from mailgrain.sources.workspace import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def n_words(text) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# -- 1 ----------------------------------------------------------------------

@query
def op1_substring_dedup(spark, folder):
    rows = window_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op1_substring_dedup"] = rf"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts
), starts AS (
    SELECT doc_id, word, p,
           string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead = 20 AS whole
    FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), ranked AS (
    SELECT doc_id, word, p, whole AND row_number() OVER (PARTITION BY whole, s ORDER BY doc_id, p) > 1 AS later
    FROM starts
), judged AS (
    SELECT doc_id, word, p, max(CAST(later AS INTEGER)) OVER (
        PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM ranked
), counted AS (
    SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
           string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY p) AS kept
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counted USING (doc_id)
"""


# -- 2 ----------------------------------------------------------------------

@query
def op2_html_extraction(spark, folder):
    pages = table(spark, folder, "pages")
    return block_labeller.extract(pages, block_labeller.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


# -- 3 ----------------------------------------------------------------------

@query
def op3_topk_search(spark, folder):
    return topk_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op3_topk_search"] = """
WITH valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


# -- 4 ----------------------------------------------------------------------

@query
def op4_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, folder, "labels").where(~quality_machine.held_out(F.col("doc_id")))
    scored = quality_machine.score(docs, quality_machine.train(docs, labels))
    return scored.select(
        "doc_id", quality_machine.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality_machine.THRESHOLD).cast("int").alias("predicted"))


# -- 5 ----------------------------------------------------------------------

@query
def op5_fingerprints(spark, folder):
    signed = weighted_sampling.fingerprint(table(spark, folder, "documents").select("doc_id", "text"))
    return signed.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


# -- 6 ----------------------------------------------------------------------

def sample_edits(text: Column) -> Column:
    """Two edits: the middle third's beginning is cut, and its end gets a new line with the text's first words."""
    third = F.floor(F.length(text) / 3).cast("long")
    return F.array(
        F.struct(third.alias("start"), (third + 40).alias("stop"), F.lit(" ").alias("text")),
        F.struct((2 * third).alias("start"), (2 * third).alias("stop"),
                 F.concat(F.lit("\n"), F.substring(text, 1, 30)).alias("text")))


@query
def op6_token_counts(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", sample_edits(F.coalesce("text", F.lit(""))).alias("edits"))
    return token_trees.recount(docs).select(
        "doc_id", "n_tokens", "n_pretokens", "edited_tokens", "n_encoded", F.sha2("edited", 256).alias("edited_sha256"))


# -- 7 ----------------------------------------------------------------------

@query
def op7_mixing(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("text_hash"))
    mixed = curriculum.mix(stored(docs, "sizes"))
    first = F.try_element_at("positions", F.lit(1))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position")
    ).orderBy("first_position", "doc_id")


SQL["op7_mixing"] = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
           3 * source_size AS most
    FROM sources
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (
                  ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), aimed AS (
    SELECT source, source_size, turn, least(CAST(most AS DOUBLE),
           max(CASE WHEN level * weight <= most THEN level END) OVER () * weight) AS target
    FROM levels
), run AS (
    SELECT doc_id, s.source, size, coalesce(sum(size) OVER (
        PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE
        AS middle
    FROM sized s
), taken AS (
    SELECT r.*, source_size, target, turn,
           CASE WHEN source_size = 0 THEN 1
                ELSE CAST(greatest(floor((target - middle) / source_size) + 1, 0) AS INTEGER) END AS copies
    FROM run r JOIN aimed a ON r.source IS NOT DISTINCT FROM a.source
), placed AS (
    SELECT *, 2 * (CASE WHEN target = 0 THEN 0 ELSE middle / target END) *
              CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS twice,
           CASE turn WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w,
           CASE turn WHEN 0 THEN -5.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope
    FROM taken
)
SELECT doc_id, size, source_size, target, copies * size AS taken, CAST(copies AS INTEGER) AS copies,
       CASE WHEN copies > 0 THEN twice / (w + sqrt(greatest(w * w + slope * twice, 0))) END AS first_position
FROM placed
"""


# -- 8 ----------------------------------------------------------------------

@query
def op8_suffix_dedup(spark, folder):
    rows = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op8_suffix_dedup"] = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
    SELECT doc_id, k, n, h[2000 * k + 1:2000 * k + 2198] AS part
    FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, (len(h) // 2 + 999) // 1000)) AS k FROM texts)
), bytes AS (
    SELECT doc_id, k, n, part, unnest(range(0, least(1000, n - 1000 * k))) AS i FROM blocks
), starts AS (
    SELECT doc_id, 1000 * k + i AS p, part[2 * i + 1:2 * i + 2] AS b,
           CASE WHEN n - 1000 * k - i >= 100 THEN md5(part[2 * i + 1:2 * i + 200]) END AS s
    FROM bytes
), ranked AS (
    SELECT doc_id, p, b, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS later FROM starts
), judged AS (
    SELECT doc_id, p, b, max(CAST(later AS INTEGER)) OVER (
        PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
    FROM ranked
), edged AS (
    SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS edge FROM judged
), counted AS (
    SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, count(*) FILTER (WHERE edge) AS n_spans,
           string_agg(CASE WHEN gone = 0 THEN b END, '' ORDER BY p) AS kept
    FROM edged GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN counted USING (doc_id)
"""


# -- 9 ----------------------------------------------------------------------

@query
def op9_jaccard_join(spark, folder):
    return parity_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


SQL["op9_jaccard_join"] = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 75 * (x.n + y.n - common)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT a AS doc_id, b AS other FROM edges
    UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) USING (doc_id)
"""


# -- 10 ---------------------------------------------------------------------

@query
def op10_packing(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", n_words("text").alias("length"), F.xxhash64("text").alias("text_hash"))
    return length_buckets.pack(stored(docs, "lengths")).select(
        "doc_id", "length", "bucket", "bound", "batch", "padding")


# -- 11 ---------------------------------------------------------------------

@query
def op11_clusters(spark, folder):
    members, centroids = bit_planes.cluster(table(spark, folder, "embeddings"))
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return members.join(centroids.select("cluster", "cluster_inertia", "inertia", digest), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(clusters: int = bit_planes.CLUSTERS, rounds: int = bit_planes.ROUNDS) -> str:
    """One pair of steps a round: nearest centroids, then floors of means (empty clusters keep their centroid)."""
    steps = [rf"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
    FROM (SELECT v, sha256('2:' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT {clusters})
)"""]
    for r in range(rounds + 1):
        steps.append(f"""
, a{r} AS (
    SELECT vec_id, v, cluster, distance FROM (
        SELECT vec_id, v, cluster, distance, row_number() OVER (PARTITION BY n ORDER BY distance, cluster) AS place FROM (
            SELECT n, vec_id, v, cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))
                   AS BIGINT) AS distance
            FROM (SELECT *, row_number() OVER () AS n FROM kept) CROSS JOIN c{r}
        )
    ) WHERE place = 1
)""")
        if r < rounds:
            steps.append(f"""
, m{r} AS (
    SELECT cluster, list(m ORDER BY i) AS c FROM (
        SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
        FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY cluster, i
    ) GROUP BY cluster
), c{r + 1} AS (
    SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster)
)""")
    return "".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


SQL["op11_clusters"] = clusters_sql()


# -- 12 ---------------------------------------------------------------------

@query
def op12_large_item_packing(spark, folder):
    return large_item_packing.pack(
        table(spark, folder, "documents").select("doc_id", "text"), keep={"ids_crc32": F.crc32("ids")}
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# -- 13 ---------------------------------------------------------------------

@query
def op13_ranked_search(spark, folder):
    lists = pair_bounds.index(table(spark, folder, "documents").select("doc_id", "text"))
    return pair_bounds.search(lists, table(spark, folder, "benchmark"))


SQL["op13_ranked_search"] = r"""
WITH found AS (
    SELECT doc_id, t, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT doc_id, text, row_number() OVER () AS t FROM documents)
), postings AS (
    SELECT doc_id, t, term, count(*) AS tf FROM found GROUP BY ALL
), sizes AS (
    SELECT t, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY t
), whole AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), scaled AS (
    SELECT t, 75 + (25 * n * n_docs) // n_terms AS m FROM sizes CROSS JOIN whole
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings CROSS JOIN whole GROUP BY term, n_docs
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, max(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
), scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN scaled USING (t) GROUP BY item_id, t, doc_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
