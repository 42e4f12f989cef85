"""FASTQ records by ranges of any size."""

import random

import pytest

from fieldbiome.sources import fastq


@pytest.mark.parametrize("width", [40, 137, 1000, 1 << 20])
def test_any_ranges_give_the_same_records(spark, tmp_path, width):
    rng = random.Random(5)
    reads = []
    for k in range(150):
        n = rng.choice([1, 5, 30, 80])
        quality = "".join(rng.choice("@@+!IJK#") for _ in range(n))
        reads.append((f"r{k}", "".join(rng.choice("ACGTN") for _ in range(n)), quality))
    for part in range(2):
        ends = "\r\n" if part else "\n"
        text = "".join(f"@{i} lane {part}{ends}{s}{ends}+{i if part else ''}{ends}{q}{ends}" for i, s, q in reads[part::2])
        (tmp_path / f"{part}.fq").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = fastq.records(spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(reads)
        counts = {(r["position"], r["quality"]): r["n"] for r in fastq.quality_counts(got).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert counts[1, ord("@") - 33] == sum(q[0] == "@" for _, _, q in reads)
    assert sum(counts.values()) == sum(len(q) for _, _, q in reads)


def test_summaries_and_broken_records(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nACGT\n+\nII!I\n@b\nAC\n+\n@@\n")
    rows = {r["position"]: r for r in fastq.quality_summary(fastq.quality_counts(fastq.records(spark, str(tmp_path)))).collect()}
    assert rows[1]["n"] == 2 and rows[1]["mean"] == (40 + 31) / 2 and (rows[1]["q1"], rows[1]["q3"]) == (31, 40) and rows[3]["median"] == 0
    (tmp_path / "x.fq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        fastq.records(spark, str(tmp_path)).collect()
    (tmp_path / "x.fq").write_text("")
    assert fastq.records(spark, str(tmp_path)).count() == 0
