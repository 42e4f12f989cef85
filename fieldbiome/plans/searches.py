"""Queries that search: alignment of texts' letters, and vectors by metric partitioning, with SQL where it can state the result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbiome.operators import alignment, metric, similarity
from fieldbiome.plans import tables as t
from fieldbiome.plans.registry import _NEAR, _SIMS, _TOPK, query
from fieldbiome.plans.tables import table

#: Texts are full of common syllables: long words with near neighbours only.
_LONG_WORDS = alignment.Search(word=7, least=36)


def _sequences(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """(id, seq): the letters of each text that stand for residues."""
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), F.upper(F.regexp_replace("text", "[^A-Za-z]|[BJOUXZbjouxz]", "")).alias("seq"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.search(_sequences(spark, sf_dir, "documents", "doc_id"), _sequences(spark, sf_dir, "benchmark", "item_id"), _LONG_WORDS, evalue=1e-5)


@query()
def alignment_hits(spark, sf_dir):
    return _hits(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("pident", "bitscore")})


@query()
def alignment_best(spark, sf_dir):
    return alignment.best_hits(_hits(spark, sf_dir)).select("qseqid", "sseqid", F.round("pident", 6).alias("pident"), "length", F.round("bitscore", 6).alias("bitscore"))


@query(r"""WITH q AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]|[BJOUXZbjouxz]', '', 'g')) AS a FROM documents),
s AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]|[BJOUXZbjouxz]', '', 'g')) AS b FROM benchmark)
SELECT doc_id AS qseqid, item_id AS sseqid, CAST(length(b) AS BIGINT) AS length FROM q JOIN s ON contains(a, b) WHERE b <> ''""")
def alignment_contained(spark, sf_dir):
    """Hits over the whole subject without a difference: passages that documents contain, short and masked ones too."""
    db = _sequences(spark, sf_dir, "benchmark", "item_id")
    whole = db.select(F.col("id").alias("sseqid"), F.length("seq").cast("long").alias("n"))
    # E-values rule out nothing here, so they need no composition, which not every database's scores allow.
    hits = alignment.search(_sequences(spark, sf_dir, "documents", "doc_id"), db, _LONG_WORDS, math.inf, alignment.Statistics(1.0, 1.0, 1.0), whole=True)
    return hits.join(whole, "sseqid").where("length = n and mismatch = 0 and gapopen = 0").select("qseqid", "sseqid", "length")


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 9) AS sim FROM e x JOIN e y ON x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.4""")
def metric_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return metric.similar_pairs(e, 0.4, block_rows=128).rows.withColumn("sim", F.round("sim", 9))


@query(f"WITH {_SIMS}, {_NEAR}, {_TOPK} SELECT query_id, db_id, pident, pred_nearest, pred_topk FROM near JOIN top USING (query_id)")
def metric_topk(spark, sf_dir):
    q, d = t.query_db(spark, sf_dir)
    parts = metric.best_parts(q.select("query_id", "v"), d, 9, block_rows=128).rows
    return similarity.both_predicted(parts).select("query_id", F.round(100 * F.col("sim"), 6).alias("pident"), "pred_nearest", "pred_topk", "db_id")
