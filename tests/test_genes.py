"""Open reading frames and called genes against exhaustive search."""

import random
import re
from itertools import combinations

import numpy as np

from fieldbiome.operators import genes

TURN = str.maketrans("ACGT", "TGCA")


def frames_by_hand(seq, least):
    out = set()
    for strand in (1, -1):
        own = seq if strand == 1 else seq.translate(TURN)[::-1]
        for frame in range(3):
            codons = [own[i : i + 3] for i in range(frame, len(own) - 2, 3)]
            first = None
            for k, c in enumerate(codons):
                if c == "ATG" and first is None:
                    first = k
                if c in genes.STOPS:
                    if first is not None and 3 * (k - first + 1) >= least:
                        a, b = frame + 3 * first, frame + 3 * k + 2
                        out.add((strand, a + 1, b + 1) if strand == 1 else (strand, len(own) - b, len(own) - a))
                    first = None
    return out


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def gene(rng, codons):
    """A gene of few codons, so that its hexamers tell it."""
    return "ATG" + "".join(rng.choice(["GCT", "GAA", "AAA", "CTG", "GGT"]) for _ in range(codons)) + "TAA"


def table(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "id long, seq string").repartition(2)


def test_frames_equal_the_walk(spark):
    rng = random.Random(1)
    seqs = [dna(rng, rng.randrange(400)) for _ in range(30)] + ["", "ATG", "ATGTAA", "ATGNNNTAA", None, "atgaaatga" * 9]
    got = genes.open_frames(table(spark, seqs), 12).collect()
    for k, s in enumerate(seqs):
        mine = [(r["strand"], r["first"], r["last"]) for r in got if r["id"] == k]
        assert len(mine) == len(set(mine)) and set(mine) == (frames_by_hand(s.upper(), 12) if s else set())
    spans = genes.open_frames(table(spark, seqs), 12)
    assert all(re.fullmatch("ATG.*(TAA|TAG|TGA)", r["seq"]) for r in genes.strand_of(table(spark, seqs), spans).collect())


def test_the_set_is_the_best_of_all_sets():
    rng = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(9)):
            a = rng.randrange(100)
            found.append((a, a + rng.randrange(5, 40), rng.choice([-3.0, 1.0, 2.5, 4.0, 7.0])))
        overlap = rng.choice([0, 3, 10])
        best = 0.0
        for n in range(1, len(found) + 1):
            for some in combinations(sorted(found, key=lambda f: (f[1], f[0])), n):
                if all(x[1] - y[0] + 1 <= overlap for x, y in zip(some, some[1:])):
                    best = max(best, sum(f[2] for f in some))
        got = [found[k] for k in genes.chosen(found, overlap)]
        assert all(x[1] - y[0] + 1 <= overlap for x, y in zip(got, got[1:])) and abs(sum(f[2] for f in got) - best) < 1e-9


def test_planted_genes_are_called(spark):
    rng = random.Random(7)
    known = table(spark, [gene(rng, 60) for _ in range(40)])
    scores = genes.hexamer_scores(known, table(spark, [dna(rng, 3000) for _ in range(5)]))
    assert scores.shape == (4096,) and np.isfinite(scores).all()
    seqs, planted = [], []
    for k in range(8):
        parts, at = [dna(rng, 200)], 200
        for _ in range(3):
            g = gene(rng, rng.randrange(40, 90))
            strand = rng.choice([1, -1])
            planted.append((k, strand, at + 1, at + len(g)))
            parts += [g if strand == 1 else g.translate(TURN)[::-1], dna(rng, 150)]
            at += len(g) + 150
        seqs.append("".join(parts))
    got = {(r["id"], r["strand"], r["last"] if r["strand"] == 1 else r["first"]) for r in genes.called(table(spark, seqs), scores).collect()}
    ends = {(k, s, b if s == 1 else a) for k, s, a, b in planted}  # a start may lie further up in chance
    assert len(ends & got) >= 0.95 * len(ends) and len(got - ends) <= 4
    assert genes.called(table(spark, []), scores).count() == 0


def test_frames_of_many_sequences_at_once_are_those_of_each():
    rng = random.Random(31)
    seqs = ["", *[dna(rng, rng.randrange(300)) for _ in range(40)], "", "ATGAAATAA", "", "ATG", "TAA", ""]
    letters = [genes._LETTER[np.frombuffer(s.encode(), np.uint8)] for s in seqs]
    which, strand, first, last = genes._frames(np.concatenate(letters), np.cumsum([0, *map(len, seqs[:-1])]), 9)
    for k, s in enumerate(seqs):
        assert set(zip(strand[which == k].tolist(), (first[which == k] + 1).tolist(), (last[which == k] + 1).tolist())) == frames_by_hand(s, 9)
