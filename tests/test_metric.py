"""Joins and searches by metric partitioning against all pairs."""

import numpy as np
import pytest

from fieldbiome.operators import metric, similarity


def clustered(rng, n, groups, dims=8, spread=0.05):
    centers = rng.normal(size=(groups, dims))
    return centers[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dims))


def table(spark, x, first=0, label=None):
    rows = [(first + k, [float(y) for y in v] if v is not None else None, *([label[k]] if label is not None else [])) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + (", label int" if label is not None else "")).repartition(3)


@pytest.mark.parametrize("block_rows", [7, 2048])
@pytest.mark.parametrize("kind", ["clustered", "plain"])
def test_similar_pairs_equal_all_pairs(spark, kind, block_rows):
    rng = np.random.default_rng(3)
    x = clustered(rng, 150, 9) if kind == "clustered" else rng.normal(size=(150, 5))
    x = list(x) + [x[0], x[0], np.zeros(x.shape[1]), None]
    df = table(spark, x)
    for threshold in (0.99, 0.8, 0.0):
        want = {(r["a"], r["b"]): r["sim"] for r in similarity.pairs_over(df.where("v is not null"), threshold).collect()}
        got = metric.similar_pairs(df, threshold, block_rows, most=12)
        rows = got.rows.collect()
        assert len(rows) == len(want) and {(r["a"], r["b"]): r["sim"] for r in rows} == pytest.approx(want)
        compared, pairs = got.compared.first()
        assert compared <= pairs == 153 * 152 // 2
    assert metric.similar_pairs(df.limit(0), 0.9).rows.count() == 0


def test_clustered_rows_are_compared_less_than_all(spark):
    shares, counts = [], []
    for n in (300, 1200):
        rng = np.random.default_rng(8)
        got = metric.similar_pairs(table(spark, clustered(rng, n, n // 15, dims=16, spread=0.02)), 0.95, block_rows=128)
        compared, pairs = got.compared.first()
        shares.append(compared / pairs)
        counts.append(compared)
    assert shares[1] < 0.5 * shares[0] and counts[1] / counts[0] < 9  # four times the rows; all pairs are 16 times as many


@pytest.mark.parametrize("kind", ["clustered", "plain"])
def test_best_parts_equal_class_parts(spark, kind):
    rng = np.random.default_rng(5)
    x = clustered(rng, 240, 12) if kind == "clustered" else rng.normal(size=(240, 6))
    x = list(x) + [x[1], x[1], np.zeros(x.shape[1]), np.zeros(x.shape[1])]
    label = rng.integers(4, size=len(x)).tolist()
    db = table(spark, x, label=label).withColumnRenamed("id", "db_id")
    ask = [*x[:20], x[30] + 0.01, -x[31], np.zeros(x[0].shape), None]
    queries = table(spark, ask, first=1000).withColumnRenamed("id", "query_id")
    want = {(r["query_id"], r["label"]): r for r in similarity.class_parts(queries.where("v is not null"), db, 3).collect()}
    got = metric.best_parts(queries, db, 3, block_rows=16)
    rows = got.rows.collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["query_id"], r["label"]]
        assert (r["size"], r["best_id"]) == (w["size"], w["best_id"]) and r["best"] == pytest.approx(w["best"]) and r["top"] == pytest.approx(w["top"])
    compared, pairs = got.compared.first()
    assert compared <= pairs and (kind == "plain" or compared < 0.7 * pairs)
    assert metric.best_parts(queries, db.limit(0), 3).rows.count() == 0 and metric.best_parts(queries.limit(0), db, 3).rows.count() == 0


def test_vectors_without_structure_travel_to_few_blocks(spark, monkeypatch):
    """Cells rule nothing out there: visits to each of them would move a row many times."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    db = table(spark, x, label=rng.integers(3, size=len(x)).tolist()).withColumnRenamed("id", "db_id")
    queries = table(spark, rng.normal(size=(300, 64)), first=5000).withColumnRenamed("id", "query_id")
    met = []
    monkeypatch.setattr(metric, "_in_blocks", lambda *a, **k: met.append(a))
    got = {(r["query_id"], r["label"]): (r["best_id"], r["size"]) for r in metric.best_parts(queries, db, 9, block_rows=128).rows.collect()}
    want = {(r["query_id"], r["label"]): (r["best_id"], r["size"]) for r in similarity.class_parts(queries, db, 9).collect()}
    assert got == want and metric.similar_pairs(table(spark, x), 0.4, block_rows=128).rows.count() > 0 and not met


def test_links_join_what_pairs_join(spark):
    rng = np.random.default_rng(12)
    for x in (clustered(rng, 400, 30), rng.normal(size=(400, 4)), np.ones((400, 4))):
        df = table(spark, x)
        pairs = [(r["a"], r["b"]) for r in metric.similar_pairs(df, 0.95, block_rows=64).rows.collect()]
        links = [(r["a"], r["b"]) for r in metric.similar_pairs(df, 0.95, block_rows=64, joined=True).rows.collect()]
        roots = [dict(zip(*(c.tolist() for c in similarity.forest(*np.array(some).T)), strict=True)) for some in (pairs, links)]
        assert roots[0] == roots[1] and len(links) <= len(pairs) and len(links) < 400 * 30


def test_nearest_rows_are_summed_for_few_pairs(monkeypatch):
    """Products of floats rule out most pairs, and copies are compared once; what is left equals the sums of all pairs."""
    rng = np.random.default_rng(13)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, y = unit(rng.normal(size=(300, 64))), unit(rng.normal(size=(5000, 64)))
    y[2000:4000], y[4000:] = y[rng.integers(40, size=2000)], 0
    x[:50] = y[:50]
    ids, kernel = rng.permutation(len(y)), similarity._sums
    summed = []
    monkeypatch.setattr(similarity, "_sums", lambda a, b, at, to: (summed.append(len(at)), kernel(a, b, at, to))[1])
    sims = np.einsum("ij,kj->ik", x, y)
    for k in (1, 9):
        best, best_id, top = similarity.tops(x, y, ids, k)
        assert (best == sims.max(1)).all() and (top == -np.sort(-sims, 1)[:, :k]).all()
        assert best_id.tolist() == [ids[s == s.max()].min() for s in sims]
    assert 0 < sum(summed) < 0.05 * x.shape[0] * y.shape[0]


def test_blocks_stay_as_many_as_tables_grow():
    assert [-(-n // similarity.rows_of_block(n, 64, 2048)) for n in (100_000, 600_000, 780_000)] == [8, 8, 8]


def test_cells_move_no_row_too_often():
    """Cells that rule out much are left where each row would visit more than a set number of them."""
    assert metric._blocks_do(100_000, 400_000, 64, 128, False, metric.MOVES * 500_001, 0.0)
    assert metric._blocks_do(500_000, 500_000, 64, 128, True, metric.MOVES * 500_001, 0.0)


def test_joined_rows_are_not_compared_again(monkeypatch):
    """Beyond what joins a component, its pairs are left out; copies link to the first one."""
    rng = np.random.default_rng(14)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    product, n = similarity.products, []
    monkeypatch.setattr(similarity, "products", lambda a, b: (n.append(len(a) * len(b)), product(a, b))[1])
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 100)
    for x, threshold, share in ((unit(rng.normal(size=(1500, 6))), 0.7, 0.3), (unit(rng.normal(size=(1500, 64)))[rng.integers(90, size=1500)], 0.9, 0.02), (unit(rng.normal(size=(1500, 64))), 0.999, 1.1)):
        a, b = np.arange(700), np.arange(700, 1500)
        del n[:]
        got = similarity.links(a, b, x[:700], x[700:], threshold, False)
        assert sum(n) <= share * 700 * 800
        own = [similarity.links(s, s, x[s], x[s], threshold, True) for s in (a, b)]
        low, high = np.nonzero(np.triu(np.einsum("ij,kj->ik", x, x) >= threshold, 1))
        linked = [np.concatenate([t[c].to_numpy() for t in (got, *own)]) for c in "ab"]
        roots = [dict(zip(*(c.tolist() for c in similarity.forest(*some)), strict=True)) for some in ((low, high), linked)]
        assert roots[0] == roots[1] and got.num_rows < 1500


def test_metric_topk_compares_once(spark):
    from fieldbiome.plans import searches

    found = searches.metric_topk(spark, "/root/testdata/sf0.001")
    assert found.columns == ["query_id", "pident", "pred_nearest", "pred_topk", "db_id"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
