"""Alignment search against full matrices, its statistics, masks and seeds."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from fieldbiome.operators import alignment as al

HOW = al.Search()
#: Background frequencies of residues, in the order of RESIDUES.
BACKGROUND = [0.07805, 0.05129, 0.04487, 0.05364, 0.01925, 0.04264, 0.06295, 0.07377, 0.02199, 0.05142, 0.09019, 0.05744, 0.02243, 0.03856, 0.05203, 0.07120, 0.05841, 0.01330, 0.03216, 0.06441]


def protein(rng, n):
    return "".join(rng.choices(al.RESIDUES, BACKGROUND, k=n))


def mutant(rng, seq, rate, gaps=0):
    out = [rng.choice(al.RESIDUES) if rng.random() < rate else c for c in seq]
    for _ in range(gaps):
        at = rng.randrange(len(out))
        if rng.random() < 0.5:
            del out[at : at + rng.randrange(1, 4)]
        else:
            out[at:at] = protein(rng, rng.randrange(1, 4))
    return "".join(out)


def full_matrix(q, s, how=HOW):
    """The best score of a local alignment with affine gaps, over the full matrix, cell by cell."""
    a, b = al.codes(q), al.codes(s)
    first, more = how.opening + how.extension, how.extension
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[-9999] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[-9999] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i][j - 1] - first, e[i][j - 1] - more)
            f[i][j] = max(h[i - 1][j] - first, f[i - 1][j] - more)
            h[i][j] = max(0, h[i - 1][j - 1] + int(al.SCORES[a[i - 1], b[j - 1]]), e[i][j], f[i][j])
    return max(map(max, h))


def test_score_table_and_statistics():
    assert (al.SCORES == al.SCORES.T).all() and al.SCORES[:20, :20].trace() == 116
    freq = al.score_frequencies(np.array(BACKGROUND), np.array(BACKGROUND))
    got = al.karlin_altschul(freq)
    w = np.array(list(freq.values())) / sum(freq.values())
    assert abs((w * np.exp(got.lam * np.array(list(freq)))).sum() - 1) < 1e-12
    assert got.lam == pytest.approx(0.3176, abs=5e-4) and got.k == pytest.approx(0.134, abs=3e-3) and got.h == pytest.approx(0.4012, abs=2e-3)
    # Scores of +1 and -1: lambda is ln(q/p), K follows in closed form.
    coin = al.karlin_altschul({1: 0.3, -1: 0.7})
    assert coin.lam == pytest.approx(math.log(7 / 3), rel=1e-12)
    assert coin.k == pytest.approx((0.7 - 0.3) ** 2 / 0.7, rel=1e-6)
    e = [got.evalue(s, 200, 10_000, 50) for s in (60, 80, 120)]
    assert all(a / b == pytest.approx(2 ** (got.bits(y) - got.bits(x)), rel=1e-9) for (a, x), (b, y) in zip(zip(e, (60, 80, 120)), zip(e[1:], (80, 120))))
    taken = got.length_taken(200, 10_000, 50)
    assert taken == pytest.approx(math.log(got.k * (200 - taken) * (10_000 - 50 * taken)) / got.h, abs=1e-6)
    with pytest.raises(ValueError):
        al.karlin_altschul({1: 0.6, -1: 0.4})


def test_masked_windows_give_no_words():
    rng = random.Random(3)
    for _ in range(40):
        seq = al.codes(protein(rng, rng.randrange(40)) + "AQ" * rng.randrange(12) + protein(rng, rng.randrange(40)))
        want = np.zeros(len(seq), bool)
        for k in range(len(seq) - 11):
            c = np.bincount(seq[k : k + 12], minlength=21) / 12
            if -sum(x * math.log2(x) for x in c if x) < 2.2 - 1e-12:
                want[k : k + 12] = True
        assert (al.masked(seq, 12, 2.2) == want).all()
        at, _ = al.words(seq, HOW)
        assert at.tolist() == [k for k in range(len(seq) - 4) if not want[k : k + 5].any()]
    assert len(al.words(al.codes("PQPQPQPQPQPQPQPQPQPQPQ"), HOW)[0]) == 0
    assert al.words(al.codes("ARNXDCQEG"), HOW)[0].tolist() == [4]


def test_neighbourhoods_are_all_words_of_the_score():
    how = al.Search(word=3, least=13)
    rng = random.Random(4)
    found = np.unique([rng.randrange(8000) for _ in range(12)] + [0])
    owner, word = al.neighbours(found, how)
    letters = lambda w: [w // 400, w // 20 % 20, w % 20]
    for k, x in enumerate(found.tolist()):
        want = {w for w in range(8000) if sum(int(al.SCORES[a, b]) for a, b in zip(letters(x), letters(w))) >= 13} | {x}
        mine = word[owner == k].tolist()
        assert len(mine) == len(set(mine)) and set(mine) == want


def test_bands_equal_full_matrices():
    rng = random.Random(6)
    queries, subjects = [], []
    for _ in range(60):
        s = protein(rng, rng.randrange(1, 60))
        queries.append(mutant(rng, s, rng.choice([0, 0.2, 0.5]), rng.randrange(3)) or "A")
        subjects.append(s)
    subjects[3], queries[4], subjects[5] = "X" * 20, "", "W"
    m, band = 60, 200  # wide enough for all diagonals
    q, s = np.full((60, m + band - 1), al.PAST, np.uint8), np.full((60, m), al.PAST, np.uint8)
    for k in range(60):
        s[k, : len(subjects[k])] = al.codes(subjects[k])
        q[k, 70 : 70 + len(queries[k])] = al.codes(queries[k])
    got = al.aligned(q, s, HOW)
    for k in range(60):
        assert got["score"][k] == full_matrix(queries[k], subjects[k])
        if not got["score"][k]:
            continue
        # What is traced back is an alignment of that score, from residue to residue.
        a = q[k, got["q_start"][k] : got["q_end"][k] + 1]
        b = s[k, got["s_start"][k] : got["s_end"][k] + 1]
        assert al.PAST not in a and al.PAST not in b
        assert full_matrix("".join(al.RESIDUES[x] if x < 20 else "X" for x in a), "".join(al.RESIDUES[x] if x < 20 else "X" for x in b)) == got["score"][k]
        gaps = 2 * got["length"][k] - len(a) - len(b)
        assert 0 <= got["same"][k] <= got["length"][k] - gaps and (gaps > 0) == (got["opens"][k] > 0)
    exact = al.aligned(np.pad(al.codes("MKVLAW")[None], ((0, 0), (1, 2)), constant_values=al.PAST), al.codes("MKVLAW")[None], HOW)
    assert (exact["length"][0], exact["same"][0], exact["q_start"][0], exact["s_start"][0]) == (6, 6, 1, 0)


def test_search_finds_planted_mutants(spark):
    rng = random.Random(11)
    db = [(f"s{k}", protein(rng, rng.randrange(80, 220))) for k in range(30)] + [("empty", ""), ("none", None), ("poor", "AQ" * 60)]
    queries, origin = [], {}
    for k in range(40):
        name, seq = db[rng.randrange(30)]
        piece = seq[rng.randrange(20) :][: rng.randrange(50, 150)]
        queries.append((f"q{k}", protein(rng, rng.randrange(60)) + mutant(rng, piece, 0.15, rng.randrange(3)) + protein(rng, rng.randrange(60))))
        origin[f"q{k}"] = name
    queries += [("alone", protein(rng, 150)), ("nothing", None), ("short", "MK"), ("repeats", "AQ" * 60), (None, None)]
    make = lambda rows: spark.createDataFrame(rows, "id string, seq string")
    hits = {(r["qseqid"], r["sseqid"]): r for r in al.search(make(queries), make(db), evalue=1e-3).collect()}
    seq_of, subject_of = dict(queries), dict(db)
    assert all((q, s) in hits for q, s in origin.items())
    assert not any(q in ("nothing", "short", "repeats") or s == "poor" for q, s in hits)
    for (q, s), r in hits.items():
        assert r["score"] == full_matrix(seq_of[q], subject_of[s]), (q, s)
        a, b = seq_of[q][r["qstart"] - 1 : r["qend"]], subject_of[s][r["sstart"] - 1 : r["send"]]
        assert full_matrix(a, b) == r["score"] and r["evalue"] <= 1e-3
        assert r["pident"] <= 100 and r["mismatch"] + round(r["pident"] * r["length"] / 100) <= r["length"]
    best = {r["qseqid"]: r["sseqid"] for r in al.best_hits(al.search(make(queries), make(db))).collect()}
    assert all(best[q] == s for q, s in origin.items())
    assert al.search(make([]), make(db)).count() == 0 and al.search(make(queries), make([])).count() == 0


def test_pairs_without_two_seeds_are_not_touched(spark):
    rows = [("q", "s", 0, 10), ("q", "s", 0, 13), ("q", "t", 5, 10), ("q", "t", 5, 15), ("q", "u", 7, 0), ("q", "u", 7, 60), ("q", "v", -3, 0), ("q", "v", -2, 20)]
    found = spark.createDataFrame(rows, "q string, s string, diagonal int, at int")
    assert [tuple(r) for r in al.candidates(found, HOW).collect()] == [("q", "t", 0)]


def test_words_of_the_database_are_not_broadcast_and_the_filter_loses_none(spark):
    rng = random.Random(21)
    db = [(k, protein(rng, 60)) for k in range(6)]
    queries = [(100 + k, protein(rng, 20) + mutant(rng, s, 0.2) + protein(rng, 20)) for k, s in db]
    d, q = (spark.createDataFrame(rows, "id long, seq string") for rows in (db, queries))
    found = al.seeds(q, d, HOW)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for s, text in db:
        at, w = al.words(al.codes(text), HOW)
        owner, near = al.neighbours(w, HOW)
        for i, other in queries:
            there, v = al.words(al.codes(other), HOW)
            want += [(i, s, int(there[x] - at[owner[y]]), int(there[x])) for x in range(len(v)) for y in np.flatnonzero(near == v[x])]
    assert sorted(map(tuple, found.collect())) == sorted(want) and want


def test_whole_subjects_are_found_short_and_masked_ones_too(spark, tmp_path):
    rng = random.Random(31)
    poor = "".join(rng.choice("EHT") for _ in range(70))  # windows of low entropy: no words
    items = ["ISEEDINGTHERERRERYENNDN" + poor, poor[:40], "AQ" * 20, "M", "MK", "ARND", "A" * 9, protein(rng, 64), protein(rng, 33), protein(rng, 128), "b. o, j", "", None, "Rn d-C"]
    items += [items[7][:40] + protein(rng, 10), items[7]]  # the same start, and a copy
    long = items[8]
    docs = [protein(rng, 30) + "".join(c for c in x or "" if c.isalpha()) + protein(rng, 30) for x in items]
    docs += [poor * 3, "A" * 300, long[:32] + "W" + long[1:], long[:-1] + protein(rng, 9) + long[1:], "mk", "", None, ". " + items[9].lower() * 2]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        pq.write_table(pa.table({key: range(len(rows)), "text": rows}), tmp_path / f"{name}.parquet")
    sql = entry.oracle_sql()["alignment_contained"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'").replace("FROM benchmark", f"FROM '{tmp_path}/benchmark.parquet'")
    want = duckdb.execute(sql).fetchall()
    got = [tuple(r) for r in entry.queries()["alignment_contained"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {s for _, s, _ in want} == set(range(len(items))) - {10, 11, 12}
    assert (docs.index(poor * 3), 1) in {r[:2] for r in got} and 33 == dict((r[1], r[2]) for r in got)[8]


def test_words_of_doubled_lengths_are_equal_where_letters_are():
    rng = random.Random(32)
    text = "".join(rng.choice("AR") for _ in range(300))
    for n, found in al.doubled(al.codes(text)):
        pieces = [text[k : k + n] for k in range(len(text) - n + 1)]
        assert len(found) == len(pieces) and len(set(zip(pieces, found.tolist()))) == len(set(pieces)) == len(set(found.tolist()))
    assert n == 256 and not list(al.doubled(al.codes("")))
