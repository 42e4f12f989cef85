"""Sequences: k-mers, hashed features and seeded mutation."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbiome.functions.text import clean_sequence


def kmers(seq: Column, k: int) -> Column:
    """All overlapping substrings of length k; none if the sequence is shorter."""
    places = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(seq, i, F.lit(k)))


def exploded_kmers(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, token, n). Counted before anything else: the tokens themselves don't travel."""
    cleaned = df.select(F.col(key), clean_sequence(F.col(seq)).alias("s"))
    return cleaned.select(key, F.explode(kmers(F.col("s"), k)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def crc_features(df: DataFrame, key: str, seq: str, ks: tuple[int, ...] = (3, 4), dim: int = 4096) -> DataFrame:
    """Signed hashed features as sparse rows (key, idx, v): place crc32('k:token') mod dim, sign by crc32('sk:token').

    Divided by the number of tokens, then by the Euclidean norm. A vector that cancels out to zero has no rows.
    """
    if dim < 16:
        raise ValueError("dim is 16 at least")
    parts = None
    for k in ks:
        name = F.concat(F.lit(f"{k}:"), F.col("token"))
        sign = F.when(F.crc32(F.concat(F.lit("s"), name).cast("binary")) % 2 == 0, 1).otherwise(-1)
        part = exploded_kmers(df, key, seq, k).select(key, (F.crc32(name.cast("binary")) % dim).cast("int").alias("idx"), (sign * F.col("n")).alias("x"), "n")
        parts = part if parts is None else parts.union(part)
    cells = parts.groupBy(key, "idx").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    totals = cells.groupBy(key).agg(F.sum("n").alias("tokens"), F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))).alias("norm"))
    # Dividing by the tokens first and by the norm then leaves x / norm of the counts.
    return cells.where("x <> 0").join(totals, key).select(key, "idx", (F.col("x") / F.col("norm")).alias("v"))


def md5_features(df: DataFrame, key: str, seq: str, k: int = 3, dim: int = 128) -> DataFrame:
    """Hashed frequencies as sparse rows (key, idx, v): place by the first 8 bytes of md5(token), mod dim; they sum to 1."""
    place = (F.conv(F.substring(F.md5("token"), 1, 16), 16, 10).cast("decimal(20,0)") % dim).cast("int")
    cells = exploded_kmers(df, key, seq, k).groupBy(key, place.alias("idx")).agg(F.sum("n").alias("n"))
    totals = cells.groupBy(F.col(key).alias("__k")).agg(F.sum("n").alias("tokens"))
    return cells.join(totals, F.col(key) == F.col("__k")).select(key, "idx", (F.col("n") / F.col("tokens")).alias("v"))


def dense(features: DataFrame, key: str, dim: int) -> DataFrame:
    """Sparse rows as one array a key."""
    by_place = F.map_from_entries(F.collect_list(F.struct("idx", "v")))
    packed = features.groupBy(key).agg(by_place.alias("m"))
    return packed.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))


#: Fixed value: the residues that mutate.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def _seeded(text: str) -> random.Random:
    return random.Random(int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big"))


def mutated(df: DataFrame, rates: list[float], copies: int, seed: int = 42) -> DataFrame:
    """Point-mutated copies of (seq_id, label, seq): each residue becomes another one with a chance of the rate.

    The random numbers are Python's, seeded by seed, id, rate and copy, so that results don't depend on the partitioning.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        others = {a: [b for b in RESIDUES if b != a] for a in RESIDUES}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for rate in rates:
                    for copy in range(copies):
                        rng = _seeded(f"{seed}|{r.seq_id}|{rate}|{copy}")
                        seq = [others[c][rng.randrange(19)] if c in others and rng.random() < rate else c for c in r.seq.upper()]
                        rows.append((f"{r.seq_id}_mut{round(rate * 100):02d}_{copy + 1}", r.label, "".join(seq)))
            yield pd.DataFrame(rows, columns=["seq_id", "label", "seq"])

    return df.select("seq_id", "label", "seq").where("seq is not null").mapInPandas(run, "seq_id string, label string, seq string")
