"""FASTQ files by byte ranges, and quality by position.

Files are cut at line ends before an @, so tasks share a large file. A quality line may begin with an @ too; there a record falls
into a head (header, sequence and plus line) and a tail (the rest of its quality line). Tails follow their heads: within a task as
the next row, between two tasks as the first row of the next range; only such rows are matched with each other. So any size of
ranges gives the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq, quality) of four-line records; a record whose quality is not as long as its sequence raises when it is read."""
    chunk = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n+$", "")
    raw = spark.read.option("lineSep", "\n@").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), chunk.alias("c"))
    lines = raw.withColumn("l", F.split("c", "\n"))
    whole = lines.where(F.size("l") == 4)
    # A quality of one @ leaves an empty tail; one that follows no head is a blank line before the first record. Of a head and a tail, the tail's first sign is the @ that was cut away.
    head = lines.where(F.size("l") == 3).select("file", "start", "row", "l")
    tail = lines.where(F.size("l") == 1).select(F.col("file").alias("tf"), F.col("start").alias("ts"), F.col("row").alias("tr"), F.concat(F.lit("@"), F.col("l")[0]).alias("q"))
    odd = lines.where(~F.size("l").isin(1, 3, 4)).select(F.raise_error(F.concat(F.lit("no FASTQ record: "), F.substring("c", 1, 80))).cast("string").alias("read_id"), F.lit("").alias("seq"), F.lit("").alias("quality"))
    beside = head.join(tail, (F.col("file") == F.col("tf")) & (F.col("row") + 1 == F.col("tr")), "left")
    here = beside.where("q is not null").select("l", "q")
    lone = beside.where("q is null").select("file", "start", "row", "l", F.lit(None).cast("string").alias("q"))
    taken = head.select(F.col("file").alias("hf"), F.col("row").alias("hr"))
    orphans = tail.join(taken, (F.col("tf") == F.col("hf")) & (F.col("tr") == F.col("hr") + 1), "left_anti").select(F.col("tf").alias("file"), F.col("ts").alias("start"), F.col("tr").alias("row"), F.lit(None).cast("array<string>").alias("l"), "q")
    order = Window.partitionBy("file").orderBy("start", "row")  # two rows a range at most
    across = lone.unionByName(orphans).withColumn("q2", F.lead("q").over(order)).where("l is not null").select("l", F.coalesce("q2", F.lit("")).alias("q"))
    both = whole.select("l", F.col("l")[3].alias("q")).unionByName(here).unionByName(across)
    seq, header = F.col("l")[1], F.regexp_replace(F.col("l")[0], "^@", "")
    bad = F.raise_error(F.concat(F.lit("quality and sequence differ in length: "), header)).cast("string")
    fine = (F.length(seq) == F.length("q")) & F.col("l")[2].startswith("+")
    return both.select(F.regexp_extract(header, r"^(\S*)", 1).alias("read_id"), seq.alias("seq"), F.when(fine, F.col("q")).otherwise(bad).alias("quality")).unionByName(odd)


def quality_counts(reads: DataFrame, base: int = 33) -> DataFrame:
    """(position, quality, n): how many reads have which quality at each position from 1. Counts of parts add up."""
    codes = F.transform(F.split("quality", ""), lambda c: F.ascii(c) - base)
    return reads.where("quality <> ''").select(F.posexplode(codes).alias("p", "quality")).groupBy((F.col("p") + 1).alias("position"), "quality").agg(F.count("*").alias("n"))


def quality_summary(counts: DataFrame) -> DataFrame:
    """(position, n, mean, q1, median, q3) of quality_counts; a position has as many rows as there are qualities."""
    upto = Window.partitionBy("position").orderBy("quality")
    total = F.sum("n").over(Window.partitionBy("position"))
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", total)
    at = lambda share, name: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("quality"))).alias(name)
    return ranked.groupBy("position").agg(F.sum("n").alias("n"), (F.sum(F.col("quality") * F.col("n")) / F.sum("n")).alias("mean"), at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"))


def write(df: DataFrame, path: str) -> None:
    """Writes (read_id, seq, quality) as four-line records, in parts."""
    df.select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("quality"))).write.mode("overwrite").text(path)
