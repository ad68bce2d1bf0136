"""The registered ``opN_*`` queries: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from .centroid_clustering import centroid_clusters, digest
from .common import read
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_text import html_text
from .lm_scoring import lm_score
from .packing import best_fit_packing
from .pii import KINDS, pii
from .sentencepiece_bpe import encode_decode
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import held_out, toxicity

#: For the test tables.  A run on real documents sets ``spark.flowlens.pseudonym.key``.
TEST_KEY = "flowlens-pseudonym-key"

LLM_QUERIES = {}
LLM_ORACLES = {}


def pseudonym_key(spark) -> str:
    return spark.conf.get("spark.flowlens.pseudonym.key", TEST_KEY)


def op(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@op
def op8_exact_dedup(spark, sf_dir):
    """Exact deduplication of ``documents``: one row per document with the copy that stays."""
    return exact_dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


LLM_ORACLES["op8_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""


@op
def op4_simhash(spark, sf_dir):
    """SimHash near-duplicate groups of ``documents``: 3-word shingles, at most 3 differing bits."""
    return simhash_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@op
def op10_pii(spark, sf_dir):
    """``documents`` with personal data replaced by format-preserving pseudonyms, and how many of each kind."""
    found = pii(read(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))
    count = [F.expr(f"size(filter(pii, f -> f.kind = '{k}'))").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", "text", F.size("pii").alias("n_replaced"), *count)


@op
def op7_toxicity(spark, sf_dir):
    """Toxicity of every document by a chain fitted on four fifths of ``labels``."""
    found = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


@op
def op1_best_fit_packing(spark, sf_dir):
    """``documents`` in sequences of at most 2048 tokens."""
    return best_fit_packing(read(spark, sf_dir, "documents"))


@op
def op3_suffix_dedup(spark, sf_dir):
    """Bytes of ``documents`` covered by 400-byte strings that occur again, removed."""
    found = suffix_dedup(read(spark, sf_dir, "documents"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")  # a cut inside a character leaves U+FFFD


@op
def op5_embedding_dedup(spark, sf_dir):
    """Near-duplicate ``embeddings`` of equal label at cosine 0.93."""
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


@op
def op9_lm_scoring(spark, sf_dir):
    """Stupid-backoff score of every document under the n-gram counts of all others."""
    return lm_score(read(spark, sf_dir, "documents"))


@op
def op2_sentencepiece(spark, sf_dir):
    """SentencePiece ids of every text, and the text decoded from them."""
    return encode_decode(read(spark, sf_dir, "documents"))


@op
def op6_html_extraction(spark, sf_dir):
    """Visible text of every page of ``pages``."""
    return html_text(read(spark, sf_dir, "pages")).select("page_id", "title", "text", F.length("text").cast("long").alias("n_chars"))


@op
def op11_centroid_clustering(spark, sf_dir):
    """Clusters of ``embeddings``: 40 centroids, five rounds over integer components."""
    rows, centroids = centroid_clusters(read(spark, sf_dir, "embeddings"))
    names = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")  # one row a centroid
    return rows.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    floor = "(sum(q[{d}]) - ((sum(q[{d}]) % count(*)) + count(*)) % count(*)) // count(*)"
    mean = "[" + ", ".join(f"CAST({floor.format(d=d)} AS BIGINT)" for d in range(1, dims + 1)) + "]"
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
      WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS INTEGER) AS c, q AS m FROM v
      QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), q) <= {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
          SELECT row_id, vec_id, q, c, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q, m)]) AS BIGINT) AS d
          FROM (SELECT *, row_number() OVER () AS row_id FROM v) CROSS JOIN c{r}) GROUP BY row_id, vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN
              (SELECT c, {mean} AS m FROM a{r} GROUP BY c) n ON n.c = c{r}.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} z ON z.c = a.c"""


LLM_ORACLES["op11_centroid_clustering"] = _cluster_sql()


@op
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of ``embeddings``: every 50th row against all rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


LLM_ORACLES["op12_hard_negatives"] = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
       CAST(list_sum([z[1] * z[2] for z in list_zip(a.q, r.q)]) AS BIGINT) AS score
       FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.q) = len(r.q)),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
       QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""


@op
def op13_substring_dedup(spark, sf_dir):
    """Words of ``documents`` covered by 50-word passages of documents with smaller ids, removed."""
    found = substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


LLM_ORACLES["op13_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 w AS (SELECT r, doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50),
 h AS MATERIALIZED (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM w),
 f AS MATERIALIZED (SELECT r, i FROM h JOIN (SELECT g, min(doc_id) AS m FROM h GROUP BY g) USING (g) WHERE doc_id > m),
 t AS MATERIALIZED (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM d),
 c AS (SELECT t.r, t.i, t.x, max(f.i) OVER (PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
       FROM t LEFT JOIN f ON f.r = t.r AND f.i = t.i),
 k AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS text FROM c GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(k.text, '') AS text
FROM d LEFT JOIN k ON k.r = d.r
"""
