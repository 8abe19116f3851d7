"""The registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    alignment,
    crosspolytope,
    fingerprint,
    langid,
    linededup,
    mixing,
    negatives,
    packing,
    quality,
    secrets,
    simhash,
    topk,
    toxicity,
)
from .common import documents

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark, sf):
    """Expected severity grade of each document, learned from the labelled ones."""
    docs = documents(spark, sf)
    return toxicity.predict(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query
def op2_language(spark, sf):
    """Language of each document, learned from the documents that are not held out."""
    docs = documents(spark, sf)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(F.coalesce(~held_out, F.lit(True))))
    marked = langid.predict(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return marked.select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_fingerprints(spark, sf):
    """Fingerprints of each document and of its edited text, and their likeness."""
    return fingerprint.compared(documents(spark, sf))


@query
def op4_simhash(spark, sf):
    """Fingerprint of each document and the smallest id that near fingerprints reach."""
    found = simhash.near_groups(documents(spark, sf))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query
def op5_secrets(spark, sf):
    """Secret spans of each document: by pattern, and by the Markov models learned from the documents."""
    docs = documents(spark, sf)
    found = secrets.scan(docs, secrets.fit(secrets.labelled_strings(docs)))
    return found.select(
        "doc_id",
        *[F.col(c).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(secrets.all_spans()).alias("spans"),
    )


@query
def op6_packing(spark, sf):
    """All documents as pieces of sequences of at most 1024 tokens."""
    return packing.pack_documents(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_line_dedup(spark, sf):
    """Each document without the lines found in ten or more documents."""
    docs = documents(spark, sf)
    kept = linededup.LineIndex.build(docs, min_docs=10, min_chars=1).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op7_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), frequent AS (
  SELECT line_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.line_key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (line_key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op8_top_products(spark, sf):
    """The five highest integer inner products of each row whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


ORACLE["op8_top_products"] = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query
def op9_quality(spark, sf):
    """Quality of each document by two views that teach each other."""
    docs = documents(spark, sf)
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    return scored.select("doc_id", "p_text", "p_meta", "quality_score", "keep")


@query
def op10_mix(spark, sf):
    """How many words of each document the mix to target weights takes."""
    mixed = mixing.mix(documents(spark, sf))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


@query
def op11_negatives(spark, sf):
    """Ten hard negatives for each of the five positives of each row whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE["op11_negatives"] = """
WITH ints AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


@query
def op12_alignment(spark, sf):
    """Tokens of two public tokenizers aligned over every whole text."""
    found = alignment.align_documents(
        documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return found.documents


@query
def op13_neighbours(spark, sf):
    """The five nearest rows by cosine that are found for each row whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return crosspolytope.nearest(vectors, vectors.where("vec_id % 50 = 0"))
