"""Core operators on literal rows, on published values, and against plain Python twins."""

import io
import math
import os
import random
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbiome.functions import coerce, text
from fieldbiome.functions.scratch import shared_dir
from fieldbiome.functions.settings import Bins, edges_of, lengths_of, rates_of
from fieldbiome.operators import abundance, augment, cohort, graph, learn, linear, metrics, panel, ranking, selection, sequence, similarity
from fieldbiome.sources import readers, web, writers
from fieldbiome.streaming import events

# A published panel of three studies (study, order, mge, entropy, arg_total, depth) and a 2 x 2 cohort.
PANEL = {
    "studyA": "0.12 1.90 5.0 2200000,0.14 1.93 5.3 2150000,0.16 1.95 5.7 2300000,0.18 1.97 6.1 2250000,0.20 2.00 6.6 2400000,0.23 2.03 7.0 2350000,0.25 2.05 7.4 2450000,0.27 2.07 7.9 2380000,0.30 2.09 8.3 2500000,0.32 2.12 8.8 2460000,0.34 2.14 9.2 2550000,0.36 2.16 9.7 2520000",
    "studyB": "0.08 1.70 3.9 1800000,0.09 1.72 4.1 1760000,0.11 1.74 4.4 1850000,0.12 1.76 4.7 1900000,0.14 1.78 5.0 1880000,0.16 1.81 5.4 1940000,0.18 1.83 5.8 1980000,0.20 1.85 6.2 2010000,0.22 1.87 6.6 2050000,0.24 1.90 7.0 2100000,0.26 1.92 7.4 2140000,0.28 1.94 7.8 2190000",
    "studyC": "0.13 2.15 5.1 2600000,0.15 2.18 5.5 2550000,0.17 2.20 5.9 2620000,0.19 2.22 6.3 2670000,0.21 2.25 6.8 2700000,0.24 2.28 7.2 2720000,0.26 2.30 7.6 2750000,0.29 2.33 8.1 2790000,0.31 2.35 8.5 2810000,0.33 2.37 8.9 2850000,0.35 2.40 9.4 2890000,0.38 2.43 9.9 2920000",
}
COHORT = [
    (1, 1, 1808292635542.974121), (1, 1, 3006917521787.530273), (1, 0, 124186230657.129852), (1, 0, 10220360943.080973),
    (1, 1, 1819168985.614191), (1, 1, 1454724397658.295898), (1, 0, 30431255031.984520), (1, 0, 3142134778.839891),
    (1, 1, 684104481674.605591), (1, 1, 1095212642826.021973), (1, 0, 119200443387.836945), (1, 0, 7549937920.606977),
    (0, 1, 396978615232.560242), (0, 1, 1286045448691.293213), (0, 0, 2024890172822.139160), (0, 0, 337846697352.672058),
]


@pytest.fixture(scope="module")
def study(spark):
    rows = [(s, k, *map(float, r.split())) for s, v in PANEL.items() for k, r in enumerate(v.split(","), 1)]
    return spark.createDataFrame(rows, "study string, `order` int, mge_abundance double, entropy double, arg_total double, sequencing_depth double")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_counts_round_half_to_even_and_read_back(spark):
    df = spark.createDataFrame([("999600",), ("2500",), ("2.5K",), ("1.2B",), ("abc",), (None,), (" 3m ",)], "x string")
    got = rows_of(df.select(coerce.short_count(F.col("x")), coerce.count_or_zero(F.col("x")), coerce.count_or_null(F.col("x"))))
    assert got == [("1000K", 999600, 999600), ("2K", 2500, 2500), ("NA", 2500, 2500), ("NA", 1200000000, 1200000000), ("NA", 0, None), ("NA", 0, None), ("NA", 3000000, 3000000)]


def test_floats_follow_python(spark):
    df = spark.createDataFrame([("1_000",), ("1d",), ("nan",), ("inf",), ("",), (None,), (" 2.5 ",)], "x string")
    got = [r[0] for r in df.select(coerce.float_or_zero(F.col("x"))).collect()]
    assert got[0] == 1000 and got[1] == 0 and math.isnan(got[2]) and math.isinf(got[3]) and got[4:] == [0, 0, 2.5]
    assert rows_of(spark.range(1).select(coerce.fixed(F.lit(5e-7)), coerce.fixed(F.lit(None).cast("double")), coerce.fixed(F.lit(12345.5), 1))) == [("0.000000", "NA", "12345.5")]


def test_texts(spark):
    df = spark.createDataFrame([("Upstream of untreated sewage 2019-05, day 12", "gb|X|ARO:3000123|g ARO:7")], "t string, h string")
    got = df.select(text.environment_of(F.col("t")), text.treatment_of(F.col("t")), text.year_of(F.col("t")), text.year_of(F.col("t"), "reference"), text.timepoint_of(F.col("t")), text.slug(F.lit("  (St. John's) ")), text.slug(F.lit("--")), text.aro_id(F.col("h")), text.first_of_list(F.lit("a ; b")), text.panel_title(F.lit("studyB")), text.time_code(F.lit("WB12")), text.treatment_code(F.lit("Wascana Creek, site 3")), text.prefixed_slug(F.lit(None).cast("string"), F.lit("AB1")))
    assert rows_of(got) == [("wastewater", "treated", "2019", "NA", "day12", "St_John_s", "UNKNOWN_PLANT", "ARO:3000123", "a", "Study B", "1", "1", "unknown_site_AB")]


def test_settings():
    assert edges_of("20,30,40") == [20, 30, 40] and lengths_of("4,3,4") == [3, 4] and rates_of("0.1") == [0.1]
    for f, x in ((edges_of, "3"), (edges_of, "3,3"), (lengths_of, "0"), (rates_of, "1")):
        with pytest.raises(ValueError):
            f(x)
    assert Bins((20.0, 26.374)).rows[0][0] == "20_to_26.374"


def test_diversity_joins_and_quirks(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 5), ("c", "x", 2)], "sample_id string, arg_id string, n long")
    meta = spark.createDataFrame([("a", "soil", 10), ("b", "river", 0)], "sample_id string, environment string, read_count long")
    m = {r["sample_id"]: r for r in abundance.sample_metrics(counts, meta).collect()}
    assert set(m) == {"a", "b"} and m["b"]["arg_diversity"] == 0 and m["b"]["arg_total_normalised"] == 0
    assert abs(m["a"]["arg_diversity"] + sum(p * math.log(p) for p in (0.75, 0.25))) < 1e-12
    assert {r["sample_id"] for r in abundance.normalised(counts, meta).collect()} == {"a", "b", "c"}
    assert abundance.missing_metadata(counts, meta).first()[0] == 1
    assert rows_of(abundance.wide_matrix(counts, ["y", "x"]).orderBy("sample_id"))[1] == ("b", 5, 0)
    assert [r["result"] for r in abundance.dataset_checks(counts, meta, (2, 3), 5, 2).collect()] == ["PASS", "FAIL", "PASS"]
    assert abundance.last_wins(spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "k string, v int, o int"), "k", F.col("o")).first()["v"] == 2
    assert sum(r["n"] for r in abundance.histogram(counts, "n").collect()) == 4


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(20.0, 1), (30.0, 0), (100.0, 1), (99.0, 1)], "p double, ok int")
    b = Bins((20.0, 30.0, 50.0, 100.0))
    got = {r["identity_bin"]: (r["n"], r["m_recall"]) for r in metrics.binned_recall(df, b, "p", {"m": "ok"}).collect()}
    assert got == {"20_to_30": (1, 1.0), "30_to_50": (1, 0.0), "50_to_100": (1, 1.0)}
    r = metrics.regime_recall(df, b, "p", {"m": "ok"}, 50, 50).first()
    assert (r["overall_recall"], r["low_id_recall"], r["high_id_recall"]) == (0.75, 0.5, 1.0)
    empty = metrics.binned_recall(df.where("p > 40"), b, "p", {"m": "ok"}).where("n = 0").first()
    assert empty["m_recall"] is None


def test_weighted_metrics_twin(spark):
    rng = random.Random(1)
    pairs = [(rng.choice("abc"), rng.choice("abd")) for _ in range(60)]
    got = metrics.weighted_metrics(spark.createDataFrame(pairs, "t string, p string"), "t", "p").first()
    n = len(pairs)
    want = [0.0, 0.0, 0.0]
    for c in set("abcd"):
        s, m, h = sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs), sum(t == p == c for t, p in pairs)
        pr, rc = (h / m if m else 0), (h / s if s else 0)
        for k, v in enumerate((pr, rc, 2 * pr * rc / (pr + rc) if pr + rc else 0)):
            want[k] += s * v / n
    assert np.allclose([got["precision"], got["recall"], got["f1"]], want)
    assert abs(got["recall"] - sum(t == p for t, p in pairs) / n) < 1e-12


def test_hashed_features_twin(spark):
    seqs = [("q1", "MKVLAAGIMKVLAA"), ("q2", "mk-vl"), ("q3", "AB")]
    got = {}
    for r in sequence.crc_features(spark.createDataFrame(seqs, "id string, s string"), "id", "s", dim=64).collect():
        got.setdefault(r["id"], np.zeros(64))[r["idx"]] = r["v"]
    for name, s in seqs:
        s = "".join(c for c in s.upper() if c.isalpha())
        v, n = np.zeros(64), 0
        for k in (3, 4):
            for i in range(len(s) - k + 1):
                key = f"{k}:{s[i : i + k]}"
                v[zlib.crc32(key.encode()) % 64] += 1 if zlib.crc32(f"s{key}".encode()) % 2 == 0 else -1
                n += 1
        if np.linalg.norm(v) > 0:
            assert np.allclose(got[name], v / np.linalg.norm(v))
        else:
            assert name not in got
    packed = sequence.dense(sequence.md5_features(spark.createDataFrame(seqs[:1], "id string, s string"), "id", "s"), "id", 128).first()
    assert abs(sum(packed["embedding"]) - 1) < 1e-6


def test_mutation_is_seeded(spark):
    df = spark.createDataFrame([("s1", "l", "ACDXYZ" * 20)], "seq_id string, label string, seq string")
    a, b = rows_of(sequence.mutated(df, [0.2], 2)), rows_of(sequence.mutated(df.repartition(3), [0.2], 2))
    assert sorted(a) == sorted(b) and len(a) == 2 and a[0][0] == "s1_mut20_1" and all(x[2][i] == "X" for x in a for i in range(3, 120, 6))


def test_predictors_and_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, v array<double>")
    d = spark.createDataFrame([(5, [2.0, 0.0], 1), (4, [3.0, 0.0], 2), (6, [0.0, 1.0], 1)], "db_id long, v array<double>, label int")
    assert similarity.pair_similarities(q, d, block_rows=1).count() == 6
    s = similarity.class_parts(q, d, k=1, block_rows=1)
    near = {r["query_id"]: (r["db_id"], r["sim"]) for r in similarity.nearest(s).collect()}
    assert near == {1: (4, 1.0), 2: (4, 0.0)}
    top = {(r["query_id"], r["label"]): r["score"] for r in similarity.class_scores(s, "class_topk", k=1, penalty=0.0).collect()}
    assert top[(1, 1)] == 1.0 and top[(1, 2)] == 1.0
    assert {r["query_id"]: r["pred_label"] for r in similarity.predicted(similarity.class_scores(s, "class_topk", 1, 0.0)).collect()} == {1: 1, 2: 1}
    both = {r["query_id"]: (r["pred_nearest"], r["pred_topk"]) for r in similarity.both_predicted(s, 1, 0.0).collect()}
    assert both == {1: (2, 1), 2: (2, 1)}
    c = {(r["query_id"], r["label"]): r["score"] for r in similarity.centroid_scores(q, d, 0.0).collect()}
    assert abs(c[(1, 1)] - math.sqrt(0.5)) < 1e-9


def test_blocks_give_what_all_pairs_give(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    x[7] = x[3]
    x[9] = 0
    rows = [(k, v.tolist(), int(k % 4)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    q, d = df.where("id < 15").select(F.col("id").alias("query_id"), "v"), df.select(F.col("id").alias("db_id"), "v", "label")
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    sims = unit @ unit.T
    for block_rows in (7, 1000):
        parts = {(r["query_id"], r["label"]): r for r in similarity.class_parts(q, d, 5, block_rows).collect()}
        assert len(parts) == 60
        for (i, label), r in parts.items():
            at = np.arange(label, 60, 4)
            assert r["size"] == 15 and np.allclose(r["top"], np.sort(sims[i, at])[::-1][:5]) and r["best_id"] == at[np.argmax(np.round(sims[i, at], 12))]
        got = {(r["a"], r["b"]) for r in similarity.pairs_over(df.select("id", "v"), 0.5, block_rows).collect()}
        assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if sims[i, j] >= 0.5}
    one = df.where("id in (3, 9)").select("v").collect()
    assert {r[0] for r in df.where("id = 9").select(similarity.cosine(F.col("v"), F.col("v")), similarity.cosine(F.col("v"), F.col("v"), -1.0)).collect()} == {0.0} and len(one) == 2
    assert similarity.class_parts(q.limit(0), d).count() == 0 and similarity.pairs_over(df.limit(0).select("id", "v"), 0.5).count() == 0


def test_vectors_from_a_provider(spark):
    df = spark.createDataFrame([("a", "MKV"), ("b", "AC")], "id string, seq string")
    got = {r["id"]: r["embedding"] for r in similarity.embed_with(df, "id", "seq", lambda: lambda texts: np.array([[len(t), t.count(" ")] for t in texts]), max_length=2).collect()}
    assert got == {"a": [3.0, 1.0], "b": [3.0, 1.0]}


def test_places_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1000), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = {r["k"]: r["place"] for r in ranking.placed(df, [F.desc("v"), F.col("k")], ["g"]).collect()}
    for g in ("a", "b", None):
        mine = sorted(((-v, k) for x, v, k in rows if x == g))
        assert [got[k] for _, k in mine] == list(range(1, len(mine) + 1))
    total, before = 0, {r["k"]: r["s"] for r in ranking.running_before(df, [F.col("k")], "v", "s").collect()}
    for _, v, k in rows:
        assert before[k] == total
        total += v
    top = {r["k"]: r["place"] for r in ranking.top_of(df, [F.col("v"), F.col("k")], ["g"], 3, ["k"], shares=4).collect()}
    assert top == {k: p for g in ("a", "b", None) for p, (_, k) in enumerate(sorted((v, k) for x, v, k in rows if x == g)[:3], 1)}


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=3000)] + [("b", 1.0)] * 10 + [("c", 2.0), ("c", 5.0), (None, 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in abundance.exact_quantiles(df, "g", "v", [0.25, 0.5, 0.75], accuracy=50).collect()}
    for g in ("a", "b", "c", None):
        assert np.allclose(got[g], np.quantile([v for x, v in rows if x == g], [0.25, 0.5, 0.75]))
    assert "d" not in got


@pytest.mark.parametrize("small", [0, 200_000])
def test_clusters_of_random_graphs(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(8)
    n = 300
    order = rng.sample(range(n), n)
    pairs = list(zip(order[:120], order[1:121])) + [(rng.choice(order[121:]), rng.choice(order[121:])) for _ in range(70)]  # a long chain, and a loose graph
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(rows_of(graph.clusters(spark.range(n), spark.createDataFrame(pairs, "a long, b long"))))
    assert got == dict(enumerate(root))
    assert dict(rows_of(graph.clusters(spark.range(3), spark.createDataFrame([], "a long, b long")))) == {0: 0, 1: 1, 2: 2}


def test_components_leave_what_the_result_needs(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 0)
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = graph.clusters(spark.range(200), spark.createDataFrame([(k, k + 1) for k in range(199)], "a long, b long"))
    assert found.where("cluster_id = 0").count() == 200
    assert len(set(os.listdir(folder)) - before) <= 2  # the edges and the labels


def test_clusters_of_chains_and_cycles(spark):
    ids = [f"n{k:02d}" for k in range(20)]
    pairs = [(ids[k], ids[k + 1], 80.0) for k in range(9)] + [("n12", "n13", 90.0), ("n13", "n14", 70.0), ("n14", "n12", 70.0), ("n01", "zz", 99.0), ("n15", "n16", 69.9)]
    members = spark.createDataFrame([(i,) for i in ids], "id string")
    e = graph.identity_edges(spark.createDataFrame(pairs, "query_id string, subject_id string, pident double"), members, 70.0)
    got = dict(rows_of(graph.clusters(members, e)))
    assert all(got[ids[k]] == "n00" for k in range(10)) and got["n14"] == "n12" and got["n16"] == "n16" and len(got) == 20
    split = selection.cluster_split(spark.createDataFrame(list(got.items()), "id string, cluster_id string"), "cluster_id", 0.4)
    by = {r["id"]: r["split"] for r in split.collect()}
    assert all(by[ids[k]] == "test" for k in range(10)) and by["n12"] == "train"
    assert dict(rows_of(selection.split_summary(split, "cluster_id")))["n_test"] == 10


def test_published_lag_results(spark, study):
    got = {r["lag"]: (round(r["correlation"], 6), r["n"]) for r in panel.lag_correlations(study).collect()}
    assert got == {0: (0.996761, 36), 1: (0.995173, 33), 2: (0.992825, 30)}
    fits = linear.lag_models(study)
    f = fits["forward"]
    assert (round(f["coef"][1], 6), round(f["se"][1], 6), round(f["r2"], 6), round(f["adj_r2"], 6), f["n"]) == (18.553611, 0.589673, 0.998303, 0.998060, 33)
    r = fits["reverse"]
    assert (round(r["coef"][1], 6), round(r["se"][1], 6), round(r["r2"], 6)) == (0.053645, 0.001446, 0.998569)
    assert (round(fits["enriched"]["r2"], 6), round(fits["enriched"]["adj_r2"], 6)) == (0.998676, 0.998431)
    d = fits["difference"]
    assert (round(d["coef"][1], 6), round(d["se"][1], 6), round(d["r2"], 6), d["n"], round(d["p"][1], 8)) == (4.545455, 2.334786, 0.119225, 30, 0.06164897)
    g = fits["added_value"]
    assert (round(g["f"], 6), round(g["p"], 8), round(g["delta_r2"], 6)) == (0.823097, 0.37230257, 0.000027)
    assert "C(study)[T.studyB]" in writers.model_summary(f, "Forward")


def test_published_did(spark):
    df = spark.createDataFrame(COHORT, "treatment int, time int, y double")
    got = {r["term"]: r for r in linear.did(df).collect()}
    assert np.isclose(got["treatment:time"]["coef"], 1632579817418.07, rtol=1e-12) and np.isclose(got["treatment:time"]["std_err"], 889845769956.21, rtol=1e-12)
    t, g = F.col("treatment"), F.col("time")
    fit = linear.ols(*linear.design(df, {"treatment": t, "time": g, "treatment:time": t * g}, [], F.col("y")))
    assert np.allclose(fit["coef"], [got[k]["coef"] for k in fit["names"]]) and np.allclose(fit["p"], [0.05097888760182751, 0.09712255585977103, 0.6670451838373328, 0.09145220409186246], rtol=1e-9)
    robust = linear.ols(*linear.design(df, {"treatment": t, "time": g, "treatment:time": t * g}, [], F.col("y")), robust="HC3")
    assert np.allclose(robust["se"], [r["std_err"] for r in sorted(linear.did(df, robust=True).collect(), key=lambda r: fit["names"].index(r["term"]))])


def test_did_table_and_summary_of_the_published_model(spark):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(COHORT)], "treatment int, time int, y double, k int")
    got = {r["term"]: r for r in linear.did_table(df).collect()}
    x = got["treatment:time"]
    assert (round(x["t"], 3), round(x["p_value"], 5), round(x["r2"], 3), round(x["adj_r2"], 3), x["nobs"]) == (1.835, 0.09145, 0.432, 0.290, 16)
    assert np.allclose([x["ci_low"], x["ci_high"]], [-3.06e11, 3.57e12], rtol=5e-3)
    logged = {r["term"]: r["coef"] for r in linear.did_table(df, log_outcome=True).collect()}
    assert abs(logged["Intercept"] - np.mean([math.log1p(y) for g, t, y in COHORT if g == t == 0])) < 1e-9
    with pytest.raises(Exception, match="negative"):
        linear.did_table(df.withColumn("y", -F.col("y")), log_outcome=True)
    t, g = F.col("treatment"), F.col("time")
    rows, names = linear.design(df, {"treatment": t, "time": g, "treatment:time": t * g}, [], F.col("y"), ["k"])
    fit = linear.ols(rows, names)
    # The published summary of this model (its rows are in another order there, which only moves Durbin-Watson).
    extras = linear.summary_extras(rows, fit, "k")
    want = {"omnibus": 2.906, "omnibus_p": 0.234, "skew": 0.423, "kurtosis": 3.856, "durbin_watson": 1.742, "jarque_bera": 0.967, "jb_p": 0.617, "condition": 9.89, "f": 3.047, "f_p": 0.0701, "loglik": -458.33, "aic": 924.7, "bic": 927.7}
    assert all(abs(extras[c] - v) <= 0.51 * 10 ** -len(str(v).partition(".")[2]) for c, v in want.items()), extras
    assert "Durbin-Watson: 1.742" in writers.model_summary(fit, "DiD", extras)


def test_demeaned_equals_dummies(spark, study):
    rows = linear.demeaned(panel.lagged(study).where("arg_t1 is not null"), "study", ["mge_abundance", "arg_t1"])
    slope = linear.simple_regression(rows, "arg_t1", "mge_abundance").first()["slope"]
    fit = linear.ols(*linear.design(panel.lagged(study), {"m": F.col("mge_abundance")}, ["study"], F.col("arg_t1")))
    assert abs(slope - fit["coef"][1]) < 1e-9


def test_components_of_variance_equal_numpy(spark):
    x = np.random.default_rng(3).normal(size=(40, 5)) * [5, 3, 1, 1, 1]
    got = learn.pca_2d(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), "id", "v").orderBy("id").collect()
    c = x - x.mean(0)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    sign = np.sign(v[np.arange(2), np.abs(v[:2]).argmax(1)])
    assert np.allclose([[r["pc1"], r["pc2"]] for r in got], (u * s)[:, :2] * sign, atol=1e-9)


def test_forest_learns_and_needs_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(k, (rng.normal(size=4) + 3 * (k % 2)).tolist()) for k in range(60)]
    v = spark.createDataFrame(rows, "row_index long, embedding array<double>")
    labels = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(60)] + [(99, "a"), (3, " ")], "row_index long, label string")
    known = learn.labelled(v, labels)
    assert known.count() == 60 and learn.forest_metrics(known, "row_index", "embedding", "label", trees=20).first()["f1"] > 0.9
    with pytest.raises(ValueError):
        learn.labelled(v.limit(5), labels)


def test_anova_balanced_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(a, b, float(rng.normal() + (a == "x") * 2 + (b == "u"))) for a in "xyz" for b in "uv" for _ in range(5)]
    got = {r["factor"]: r for r in linear.anova_type2(spark.createDataFrame(rows, "p string, e string, y double"), "p", "e", "y").collect()}
    y = np.array([r[2] for r in rows])
    assert np.isclose(sum(r["sum_sq"] for r in got.values()), ((y - y.mean()) ** 2).sum())
    assert np.isclose(sum(r["variance_percent"] for r in got.values()), 100)


def test_distributions():
    assert abs(linear.t_quantile(0.975, 12) - 2.178812829667) < 1e-9
    assert abs(linear.f_upper(4.0, 1, 12) - linear.t_two_sided(2.0, 12)) < 1e-12


def test_depth_filter_raises_if_nothing_is_left(spark):
    m = spark.createDataFrame([("a", "564K"), ("b", "10"), ("c", "x")], "sample_id string, read_count string")
    assert rows_of(cohort.deep_enough(m, 1000)) == [("a", 564000)]
    with pytest.raises(Exception, match="no sample has 1000000 reads"):
        cohort.deep_enough(m, 1_000_000).select("sample_id").collect()


def test_trends_and_ranks(spark, study):
    assert {r["word"] for r in panel.trends(study, "arg_total").collect()} == {"up"}
    assert [(r["study"], r["label"].split()[0]) for r in panel.baseline_ranks(study, "arg_total").orderBy("rank").collect()] == [("studyB", "lowest"), ("studyA", "middle"), ("studyC", "highest")]


def test_selection(spark):
    df = spark.createDataFrame([("r1", "soil", 1), ("r1", "river", 2), ("r2", "river", 3), ("r3", "river", 4)], "run string, env string, o int")
    claimed = selection.first_claim(df, "run", [F.col("o")])
    assert {(r["run"], r["env"]) for r in claimed.collect()} == {("r1", "soil"), ("r2", "river"), ("r3", "river")}
    targets = spark.createDataFrame([("soil", 3), ("river", 1)], "env string, target int")
    taken = selection.fill_quota(claimed, "env", [F.col("o")], targets)
    assert {r["run"] for r in taken.collect()} == {"r1", "r2"}
    assert rows_of(selection.quota_shortfall(taken, "env", targets)) == [("soil", 3, 1, 2)]
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "method string, f1 double")
    assert sorted(rows_of(selection.upsert(old, spark.createDataFrame([("b", 3.0), (" ", 4.0), ("c", 5.0)], "method string, f1 double"), "method"))) == [("a", 1.0), ("b", 3.0), ("c", 5.0)]
    table = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1), ("c", 3.0, 2)], "method string, f1 double, o int")
    put = spark.createDataFrame([("z", 9.0, 0), ("b", 5.0, 1), ("y", 8.0, 2)], "method string, f1 double, o int")
    assert [(r["method"], r["f1"]) for r in selection.upsert(table, put, "method", "o").orderBy("o").collect()] == [("a", 1.0), ("b", 5.0), ("c", 3.0), ("z", 9.0), ("y", 8.0)]
    one = spark.createDataFrame([("i", "AC", 0), ("j", "G", 1)], "id string, seq string, ord int")
    two = spark.createDataFrame([("i", "GT", 0), ("j", "GGG", 1), ("k", "", 2)], "id string, seq string, ord int")
    assert {(r["id"], r["seq"]) for r in selection.merged_longest(one, two, ["id"], "seq").collect()} == {("i", "AC"), ("j", "GGG"), ("k", "")}
    assert [r["run"] for r in selection.head_by(df, [F.desc("o")], 2).collect()] == ["r3", "r2"]
    split = selection.stratified_split(spark.range(50).withColumn("label", F.col("id") % 5), "label", "id", 0.2)
    assert {r["n"] for r in split.where("in_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {2}


def test_oversampling(spark):
    df = spark.createDataFrame([(k, 21.0 + k / 10) for k in range(5)] + [(9, 60.0)], "id int, p double")
    out = augment.oversampled(df, Bins((20.0, 30.0, 40.0, 70.0)), "p", "id", 8, 40.0)
    got = {r["b"]: r["n"] for r in out.groupBy(Bins((20.0, 30.0, 40.0, 70.0)).key(F.col("p")).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert got == {"20_to_30": 8, "30_to_40": 8, "40_to_70": 1}
    assert out.where("synthetic and p < 30").select("p").distinct().join(df, "p", "left_anti").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    for name, content in (("a/hits.tsv", "q1\tgeneA\nq2\tgeneA\n\nq3\n\tx\ty\n"), ("b/hits.tsv", ""), ("z/a/hits.tsv", "q\tgeneZ\n")):
        (tmp_path / "h" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "h" / name).write_text(content)
    paths = f"{tmp_path}/h/*/hits.tsv"
    assert sorted(rows_of(readers.sample_hits(spark, paths))) == [("a", "geneA"), ("a", "geneA"), ("a", "y")]
    assert {r["sample_id"] for r in readers.sample_files(spark, paths).collect()} == {"a", "b"}
    (tmp_path / "x.fa").write_bytes(b">s1 one\r\nACG\r\n\r\nTT\r\n>s2\nGG\n>s1 two\nCC\n")
    assert sorted(rows_of(readers.last_of_id(readers.fasta(spark, f"{tmp_path}/x.fa")))) == [("s1", "CC"), ("s2", "GG")]
    assert sorted(r["seq"] for r in readers.fasta_records(spark, f"{tmp_path}/x.fa").collect()) == ["ACGTT", "CC", "GG"]
    (tmp_path / "m.csv").write_text('﻿sample_id,country\ns1,"Russia: Moscow, region"\n', "utf-8")
    assert rows_of(readers.csv_strings(spark, f"{tmp_path}/m.csv", required=["sample_id"])) == [("s1", "Russia: Moscow, region")]
    np.save(tmp_path / "e.npy", np.arange(6.0).reshape(3, 2))
    assert [r["embedding"] for r in readers.npy_rows(spark, f"{tmp_path}/e.npy").orderBy("row_index").collect()] == [[0, 1], [2, 3], [4, 5]]
    with tarfile.open(tmp_path / "c.tar.bz2", "w:bz2") as t:
        info = tarfile.TarInfo("./d/aro.tsv")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    assert readers.tar_members(spark, f"{tmp_path}/c.tar.bz2", ["aro.tsv"]).first()["text"] == "hi"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>A</t></si><si><t>B</t></si></sst>")
        cell = lambda v, s="": f'<c{s}><v>{v}</v></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row>{cell("9")}</row><row>{cell(0, " t=" + chr(34) + "s" + chr(34))}{cell(1, " t=" + chr(34) + "s" + chr(34))}</row><row>{cell(1)}{cell(2.5)}</row><row>{cell(7)}</row></sheetData></worksheet>')
    assert rows_of(readers.xlsx_table(spark, f"{tmp_path}/w.xlsx", "S", ["A", "B"])) == [("1", "2.5")]
    writers.fasta(spark.createDataFrame([("s", "A" * 81)], "seq_id string, seq string"), f"{tmp_path}/out")
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == ">s\n" + "A" * 80 + "\nA\n"
    counts = spark.createDataFrame([("s1", "g2", 2), ("s0", "g1", 1)], "sample_id string, arg_id string, n long")
    writers.matrix(counts, f"{tmp_path}/wide")
    assert next((tmp_path / "wide").glob("part*")).read_bytes().decode() == "Sample,g1,g2\r\ns0,1,0\r\ns1,0,2\r\n"
    assert web.batches(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]]
    xml = spark.createDataFrame([('<B><Attribute attribute_name="Geo">  x </Attribute><Attribute attribute_name="geo">y</Attribute></B>',)], "x string")
    assert readers.sample_attributes(xml, "x").first()["attributes"] == {"geo": "x"}
    run = spark.createDataFrame([("Run,Size\nR1,5\n\nR2,6\n",), ('Run,Title,Size\r\nR3,"a, ""b""\r\nc",7\r\n ,x,8\r\nR4,y\r\n',), (None,)], "t string")
    got = {r["run"]: r["fields"] for r in readers.runinfo(run, "t").collect()}
    assert set(got) == {"R1", "R2", "R3", "R4"} and got["R3"]["Title"] == 'a, "b"\nc' and got["R3"]["Size"] == "7" and got["R4"]["Size"] == ""
    (tmp_path / "b.tsv").write_text("q\ts\t99.5\nq2\ts\t1\textra\n\n")
    assert rows_of(readers.blast_hits(spark, f"{tmp_path}/b.tsv")) == [("q", "s", 99.5), ("q2", "s", 1.0)]
    with pytest.raises(Exception, match="has not 3 fields"):
        readers.blast_hits(spark, f"{tmp_path}/b.tsv", strict=True).collect()
    (tmp_path / "i.csv").write_text("id,v,w\n1,NA,2.5\n2,nan,\n")
    assert rows_of(readers.csv_inferred(spark, f"{tmp_path}/i.csv")) == [(1, None, 2.5), (2, None, None)]
    assert rows_of(readers.first_column(spark, f"{tmp_path}/i.csv")) == [("1",), ("2",)]
    writers.npy(spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "row_index long, embedding array<double>"), f"{tmp_path}/out.npy")
    assert np.load(tmp_path / "out.npy").tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        writers.npy(spark.createDataFrame([(1, [3.0])] * 3, "row_index long, embedding array<double>"), f"{tmp_path}/no.npy", most_rows=2)
    assert not writers.empty_notice(counts, f"{tmp_path}/notice") and writers.empty_notice(counts.limit(0), f"{tmp_path}/notice", "none")
    long_ = abundance.long_of_wide(spark.createDataFrame([("s", 1, 0)], "Sample string, g1 int, g2 int"), abundance.sample_column(["x", "Sample"]))
    assert sorted(rows_of(long_)) == [("s", "g1", 1), ("s", "g2", 0)]


def test_web_errors_warn_and_waits_grow(monkeypatch):
    import urllib.error

    waits, tries = [], []
    monkeypatch.setattr(web.time, "sleep", waits.append)

    def refuse(url, timeout):
        tries.append(url)
        raise urllib.error.HTTPError(url, 429 if len(tries) < 9 else 500, "no", {}, None)

    monkeypatch.setattr(web.urllib.request, "urlopen", refuse)
    with pytest.raises(urllib.error.HTTPError):
        web.get("u")
    assert len(tries) == 5 and waits == [1.5, 3.0, 4.5, 6.0]
    tries += ["x"] * 5
    with pytest.warns(UserWarning):
        assert web.or_nothing(web.get, "u") == ""
    assert len(tries) == 11


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(k, f"2024-01-0{1 + k % 3} 10:00:00", k % 2, "view", 1.5) for k in range(12)], "event_id long, t string, user_id long, event_type string, value double")
    src.withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, user_id long, event_type string, value double, ts timestamp").parquet(f"{tmp_path}/in")
    q = events.windowed(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [4, 4, 4]
    u = events.upserted(stream.select("user_id", "value"), f"{tmp_path}/t", "user_id", f"{tmp_path}/c")
    u.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/t/v=0").count() == 2


def test_keyed_upserts_keep_the_latest(spark, tmp_path):
    schema = "k string, v int, ts int"
    for n, rows in enumerate([[("a", 1, 10), ("a", 2, 12), ("b", 3, 5)], [("a", 9, 11), ("c", 4, 1)], [("b", 7, 6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events.upserted(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", "k", f"{tmp_path}/c", "ts").awaitTermination(60)
    got = {r["k"]: r["v"] for r in events.newest(spark, f"{tmp_path}/t").collect()}
    assert got == {"a": 2, "b": 7, "c": 4}  # the late event of a doesn't put the later one back
    assert len(list((tmp_path / "t").glob("v=*"))) == 2


def test_sessions_and_first_events(spark):
    rows = [(1, 7, "2024-01-01 10:00:00"), (2, 7, "2024-01-01 10:20:00"), (3, 7, "2024-01-01 12:00:00"), (4, 8, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["user_id"], r["n"]) for r in events.sessions(df).collect()) == [(7, 1), (7, 2), (8, 1)]
    assert events.first_seen(df, "user_id").count() == 2


def test_oversampling_works_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(40).selectExpr("id as k", "cast(id as double) as v").mapInArrow(counted, "k long, v double")
    got = augment.oversampled(rows, Bins((0.0, 10.0, 20.0, 40.0)), "v", "k", 12, 20).groupBy("synthetic").count().collect()
    assert {r["synthetic"]: r["count"] for r in got} == {False: 40, True: 4} and seen.value == 40
