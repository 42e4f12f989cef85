"""Unitigs against a brute-force contraction, and reads that give back the sequences they were cut from."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldbiome.operators import assembly

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(TURN)[::-1]


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def contracted(kmers, k):
    """Unitigs of a set of canonical k-mers, walked one by one."""
    canon = lambda s: min(s, rc(s))
    onward = lambda s: [s[1:] + c for c in "ACGT" if canon(s[1:] + c) in kmers]

    def follow(s):
        nxt = onward(s)
        if len(nxt) != 1:
            return None
        back = onward(rc(nxt[0]))
        return nxt[0] if len(back) == 1 and canon(nxt[0]) != canon(s) else None

    seen, out = set(), []
    for m in sorted(kmers):
        if m in seen:
            continue
        start = m
        while (p := follow(rc(start))) is not None and rc(p) != m:
            start = rc(p)
        if p is not None:  # a ring: opened before its least k-mer
            start = m
        path, at = start, start
        seen.add(canon(at))
        while (n := follow(at)) is not None and canon(n) not in seen:
            path, at = path + n[-1], n
            seen.add(canon(at))
        out.append(min(path, rc(path)))
    return sorted(out)


def table(spark, seqs):
    return spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "id long, seq string").repartition(3)


@pytest.mark.parametrize("k", [5, 7])
def test_unitigs_equal_the_contraction(spark, k):
    rng = random.Random(k)
    base = dna(rng, 120)
    reads = [base, rc(base[30:90]), base[:40] + dna(rng, 30), dna(rng, 25) * 2, None, "", "AC", "acgtN" + base[10:30].lower(), "A" * 12, base[:20] + "N" + base[50:80]]
    counts = Counter()
    for r in reads:
        for part in "".join(c if c in "ACGT" else " " for c in (r or "").upper()).split():
            counts.update(min(part[i : i + k], rc(part[i : i + k])) for i in range(len(part) - k + 1))
    nodes = assembly.kmer_counts(table(spark, reads), k)
    got = {r["m"]: r["n"] for r in nodes.select(assembly.letters_of(nodes.node, k).alias("m"), "n").collect()}
    assert got == dict(counts)
    rows = assembly.unitigs(nodes, k).collect()
    assert sorted(r["seq"] for r in rows) == contracted(set(counts), k)
    assert sum(r["kmers"] for r in rows) == len(counts) and all(r["kmers"] == len(r["seq"]) - k + 1 for r in rows)


def test_reads_give_back_their_sequences(spark):
    rng = random.Random(9)
    genomes = [dna(rng, 300), dna(rng, 220)]
    reads = []
    for g in genomes:
        reads += [g[i : i + 50] if rng.random() < 0.5 else rc(g[i : i + 50]) for i in range(0, len(g) - 49, 4)]
        reads += [g[:50], g[-50:]] * 2
    for _ in range(12):  # errors: bubbles and tips
        r = list(rng.choice(reads))
        r[rng.randrange(len(r))] = rng.choice("ACGT")
        reads.append("".join(r))
    twice = [genomes[0][100:140] + dna(rng, 8)] * 2  # a tip that the counts don't rule out
    got = [r["seq"] for r in assembly.assembled(table(spark, reads + twice), k=21).collect()]
    assert sorted(got) == sorted(min(g, rc(g)) for g in genomes)


def test_rings_and_nothing(spark):
    rng = random.Random(2)
    ring = dna(rng, 40)
    got = assembly.unitigs(assembly.kmer_counts(table(spark, [ring + ring[:20]]), 11), 11).collect()
    assert [(len(r["seq"]), r["kmers"]) for r in got] == [(50, 40)] and (got[0]["seq"][:40] in ring * 2 or rc(got[0]["seq"][:40]) in ring * 2)
    assert assembly.assembled(table(spark, []), 21).count() == 0
    with pytest.raises(ValueError):
        assembly.kmer_counts(table(spark, ["ACGT"]), 4)


def test_kmers_are_counted_as_numbers_where_they_are_made(spark):
    turn = str.maketrans("ACGT", "TGCA")
    seqs = ["ACGTTGCAACG" * 3, "acgNNacgtt", "", "AC", None, "ACGTé" + "TTTTT"]
    got = assembly.kmer_counts(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), 5)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each k-mer
    mers = [m for s in seqs if s for m in (s.upper()[i : i + 5] for i in range(len(s) - 4)) if set(m) <= set("ACGT")]
    want = Counter(min(m, m.translate(turn)[::-1]) for m in mers)
    assert {r["m"]: r["n"] for r in got.select(assembly.letters_of(got.node, 5).alias("m"), "n").collect()} == want


@pytest.mark.parametrize("k", [3, 5, 15, 17, 31])
def test_long_sequences_are_cut_and_what_ranges_get_adds_up(k, monkeypatch):
    monkeypatch.setattr(assembly, "LETTERS", 50)
    rng = random.Random(k)
    seqs = ["", "AC", dna(rng, 49), dna(rng, 50), dna(rng, 51), dna(rng, 400), "ACGT" * 40, "A" * 120, "N".join(dna(rng, 60) for _ in range(4)), dna(rng, 30).lower()]
    seqs.append(rc(seqs[5]))
    want = Counter(min(m, rc(m)) for s in seqs for m in (s.upper()[i : i + k] for i in range(len(s) - k + 1)) if "N" not in m)
    held = []
    for some in (seqs[:6], seqs[6:]):
        pieces = list(assembly._joined(pa.array(some), k))
        assert max(map(len, pieces)) < 2 * 50 + k + 2
        batch = assembly._packed([assembly._scattered(assembly._canonical(x, k), k) for x in pieces], k)
        held += [(part, assembly._unpacked(mers, part, pa.py_buffer(packed), k)) for part, mers, packed in zip(*(c.to_pylist() for c in batch.columns))]
    got = {}
    for part in {p for p, _ in held}:
        places, n = assembly._summed([x for p, x in held if p == part])
        got |= dict(zip(assembly._gathered(places, k).tolist(), n.tolist(), strict=True))
    number = lambda m: int(m.translate(str.maketrans("ACGT", "0123")), 4)
    assert got == {number(m): n for m, n in want.items()}


def test_kmers_travel_packed_by_ranges(spark):
    rng = np.random.default_rng(5)
    plan = assembly.kmer_counts(table(spark, ["ACGTTGCAACG"]), 15)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(node" not in plan  # no row for each k-mer
    batch = assembly._packed([rng.integers(0, 4**15, 2_000_000, np.uint32)], 15)
    assert batch.num_rows == 4096 and batch.nbytes < 2 * 2_000_000  # bytes; a row of two numbers takes 16 and more
