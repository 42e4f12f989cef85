"""Queries over sequences: k-mers, assembly, open reading frames, called genes and read quality, over the letters of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbiome.functions.scratch import new_path
from fieldbiome.operators import assembly, genes
from fieldbiome.plans.registry import query
from fieldbiome.plans.tables import table
from fieldbiome.sources import fastq

_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"
_BASES = f"translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_FROM}', '{_TO}')"


def _bases() -> Column:
    """A base for each letter of a text."""
    return F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), _FROM, _TO)


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _bases().alias("seq"))


@query(f"""WITH s AS (SELECT {_BASES} AS seq FROM documents), m AS (SELECT unnest(list_transform(range(1, length(seq) - 13), lambda i: substr(seq, i, 15))) AS m FROM s WHERE length(seq) >= 15),
c AS (SELECT least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS k, count(*) AS n FROM m GROUP BY 1) SELECT CAST(n AS BIGINT) AS n, count(*) AS kmers FROM c GROUP BY n""")
def kmer_spectrum(spark, sf_dir):
    return assembly.kmer_counts(_dna(spark, sf_dir), 15).groupBy("n").agg(F.count("*").alias("kmers"))


@query()
def assembled_unitigs(spark, sf_dir):
    """Reads of 60 bases, one each 6, of the benchmark's texts, on either strand, put together again."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), _bases().alias("s")).where(F.length("s") >= 60)
    cuts = b.select("id", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 59, F.lit(6))).alias("i"))
    read = F.substring("s", F.col("i"), F.lit(60))
    return assembly.assembled(cuts.select("id", F.when(F.col("i") % 2 == 0, assembly.reverse_complement(read)).otherwise(read).alias("seq")), k=31, least=2)


@query(f"""WITH s AS (SELECT doc_id AS id, {_BASES} AS seq FROM documents),
sides AS (SELECT id, 1 AS strand, seq AS own, length(seq) AS n FROM s UNION ALL SELECT id, -1, reverse(translate(seq, 'ACGT', 'TGCA')), length(seq) FROM s),
c AS (SELECT id, strand, n, f, k, substr(own, f + 3 * k + 1, 3) AS c FROM (SELECT *, unnest(range(0, (n - f) // 3)) AS k FROM (SELECT *, unnest([0, 1, 2]) AS f FROM sides WHERE n >= 3))),
m AS (SELECT *, sum(CASE WHEN c IN ('TAA', 'TAG', 'TGA') THEN 1 ELSE 0 END) OVER (PARTITION BY id, strand, f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM c),
o AS (SELECT id, strand, f, n, min(k) FILTER (c = 'ATG') AS a, max(k) FILTER (c IN ('TAA', 'TAG', 'TGA')) AS b FROM m GROUP BY id, strand, f, n, coalesce(g, 0))
SELECT id, CAST(strand AS BIGINT) AS strand, CASE WHEN strand = 1 THEN f + 3 * a + 1 ELSE n - (f + 3 * b + 2) END AS first, CASE WHEN strand = 1 THEN f + 3 * b + 3 ELSE n - (f + 3 * a) END AS last
FROM o WHERE a < b AND 3 * (b - a + 1) >= 90""")
def open_reading_frames(spark, sf_dir):
    return genes.open_frames(_dna(spark, sf_dir), 90)


@query()
def gene_calls(spark, sf_dir):
    """Hexamers are learned from the frames of 240 bases and more, as long frames are rare by chance."""
    dna = _dna(spark, sf_dir)
    long_frames = genes.strand_of(dna, genes.open_frames(dna, 240))
    return genes.called(dna, genes.hexamer_scores(long_frames, dna), 90).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT item_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM benchmark), c AS (SELECT unnest(range(1, length(t) + 1)) AS p, t FROM s)
SELECT CAST(p AS INT) AS position, CAST(ascii(substr(t, p, 1)) % 41 AS INT) AS quality, count(*) AS n FROM c GROUP BY ALL""")
def read_quality(spark, sf_dir):
    """Letters stand for qualities, @ among them; written as FASTQ and read back."""
    path = new_path(spark, "reads")
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    signs = F.array_join(F.transform(F.split(F.col("t"), ""), lambda c: F.char(F.ascii(c) % 41 + 33)), "")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), letters.alias("t")).where("t <> ''")
    fastq.write(b.select("read_id", F.col("t").alias("seq"), signs.alias("quality")), path)
    return fastq.quality_counts(fastq.records(spark, path))
