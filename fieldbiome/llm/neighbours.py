"""Approximate nearest neighbours by learned partitions.

On a bounded sample of a part (at first, of all vectors of one length): a neighbour graph, its balanced partitioning by recursive
bisection (a smoothed random vector split at its median, then refined by swaps that cut fewer edges), and a softmax classifier
from vectors to the parts. Every row goes to its most probable part. Parts that still hold many rows are split again in the same
way, so their number grows with the table; models and rows meet in blocks of bounded size.

A query goes to its most probable parts, until their probability sums to what held-out sample points need for the recall asked
for: one part where the classifier is sure, more near a border. All rows there are reranked by exact cosine in double precision.
A query that finds too few rows is answered from all parts of its length.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors meet those of
their own length only, as no cosine is defined between lengths. Ties go to the smaller id. Repeated ids count once (the least
vector stands). An empty table gives an empty result. Extra columns aren't carried.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.llm.common import cut, release

#: Rows of a part, about; rows of a block, about; rows that a part's model is fitted on, about.
PART_ROWS, BLOCK_ROWS, SAMPLE_ROWS = 4096, 4096, 8192
#: Parts of a split; rows from which a table is split at all; times that a part can be split.
LEAST_PARTS, MOST_PARTS, LEAST_ROWS, MOST_LEVELS = 8, 256, 64, 8
GRAPH_NEIGHBOURS = 10


def usable(vector: Column) -> Column:
    inf = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other points of each point (unit vectors), in blocks."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for one half of the nodes; the halves differ by one node at most."""
    inside = np.full(len(graph), -1)
    inside[nodes] = np.arange(len(nodes))
    near = inside[graph[nodes]]
    src = np.repeat(np.arange(len(nodes)), near.shape[1])[near.ravel() >= 0]
    dst = near.ravel()[near.ravel() >= 0]
    a, b = np.r_[src, dst], np.r_[dst, src]  # undirected
    degree = np.bincount(a, minlength=len(nodes)) + 1e-9
    v = rng.standard_normal(len(nodes))
    for _ in range(40):
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], len(nodes)) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.abs(v).max() + 1e-12
    side = np.zeros(len(nodes), bool)
    side[np.argsort(v, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(8):  # swap the nodes that gain most, as many on either side
        other = np.bincount(a, side[a] != side[b], len(nodes))
        gain = 2 * other - degree
        up, down = np.flatnonzero(~side), np.flatnonzero(side)
        up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
        n = min(len(up), len(down))
        m = int((gain[up[:n]] + gain[down[:n]] > 1e-6).sum()) // 2
        if not m:
            break
        side[up[:m]], side[down[:m]] = True, False
    return side


def partition(x: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """The part of each point: balanced halves of the neighbour graph, halved again until there are `parts` (a power of two)."""
    rng = np.random.default_rng(seed)
    graph = _graph(x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    label = np.zeros(len(x), np.int64)
    step = 1
    while step < parts:
        for p in range(step):
            at = np.flatnonzero(label == p)
            if len(at) > 1:
                label[at[_bisect(at, graph, rng)]] += step
        step *= 2
    return label


class Router:
    """A softmax classifier with one hidden layer of rectified units, from unit vectors to parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d) * np.sqrt(d) / 4, np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                i = order[at : at + 256]
                h = np.maximum(x[i] @ self.p[0] + self.p[1], 0)
                g = self._softmax(h @ self.p[2] + self.p[3])
                g[np.arange(len(i)), part[i]] -= 1
                g /= len(i)
                back = (g @ self.p[2].T) * (h > 0)
                grads = [x[i].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ g + 1e-4 * self.p[2], g.sum(0)]
                t += 1
                for k, gr in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr**2
                    self.p[k] = self.p[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square is out of range: cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def parts_for(n: int) -> int:
    """Parts that n rows are split into: a power of two."""
    return int(min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, math.ceil(math.log2(n / PART_ROWS))))))


def fit(x: np.ndarray, parts: int, k: int, recall: float) -> tuple[Router, float]:
    """(router, reach) from a sample's unit vectors: the probability of the parts before one that a query still visits."""
    while parts > 2 and len(x) < 8 * parts:
        parts //= 2
    rng = np.random.default_rng(11)
    held = rng.random(len(x)) < 0.25
    label = partition(x, parts)
    router = Router(x[~held], label[~held], parts)
    p = router.probabilities(x)
    order = np.argsort(-p, 1, kind="stable")
    before = np.zeros_like(p)  # by part: the probability of the parts that come before it
    sums = np.cumsum(np.take_along_axis(p, order, 1), 1)
    np.put_along_axis(before, order[:, 1:], sums[:, :-1], 1)
    near = _graph(x, min(k, len(x) - 1))
    need = before[np.flatnonzero(held)[:, None], order[near[held], 0]].ravel()
    return router, float(np.quantile(need, recall, method="higher")) + 1e-9 if len(need) else 1.0


def _models(index: DataFrame, split: DataFrame, k: int, recall: float) -> DataFrame:
    """(part, model): for each part of split (part, n), what fit() learns from about SAMPLE_ROWS of its rows, taken by a hash of the id."""
    chance = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    some = index.join(split.withColumnRenamed("part", "p"), F.col("part") == F.col("p")).where(chance < F.lit(float(SAMPLE_ROWS)) / F.col("n"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = _unit(_vectors(group.column("v"), group.num_rows))
        model = fit(x, parts_for(group.column("n")[0].as_py()), k, recall) if len(x) >= 16 else None
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.string()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    return some.select("part", "n", "id", "v").groupBy("part").applyInArrow(run, "part string, model binary")


def _blocked(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a block number, blocks (part, block)): blocks of about BLOCK_ROWS rows of a part; sizes: (part, n)."""
    of = sizes.select(F.col("part").alias("p"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = rows.join(of, F.col("part") == F.col("p")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    return placed.drop("p", "blocks"), of.select(F.col("p").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))


def _routed(rows: DataFrame, models: DataFrame, many: bool) -> DataFrame:
    """rows (id, v, part) with their most probable parts within part: one, or (many) as many as the model's reach asks for."""
    placed, blocks = _blocked(rows, rows.groupBy("part").agg(F.count("*").alias("n")))
    sent = blocks.join(models.withColumnRenamed("part", "p"), F.col("part") == F.col("p")).select(F.col("part").alias("mpart"), F.col("block").alias("mblock"), "model")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        model = pickle.loads(right.column("model")[0].as_py()) if right.num_rows else None  # noqa: S301  written by _models
        if model is None or not n:
            at, parts = np.arange(n), left.column("part").to_pylist()
        else:
            p = model[0].probabilities(_unit(_vectors(left.column("v"), n)))
            order = np.argsort(-p, 1, kind="stable")
            sums = np.cumsum(np.take_along_axis(p, order, 1), 1)
            wanted = np.c_[np.ones(n, bool), sums[:, :-1] < model[1]] if many else np.arange(p.shape[1])[None] < np.ones((n, 1))
            at, place = np.nonzero(wanted)
            top = left.column("part")[0].as_py()
            parts = [f"{top}/{c}" for c in order[at, place].tolist()]
        taken = left.select(["id", "v"]).take(pa.array(at))
        return taken.append_column("part", pa.array(parts, pa.string()))

    return placed.select("part", "block", "id", "v").groupBy("part", "block").cogroup(sent.groupBy("mpart", "mblock")).applyInArrow(run, "id long, v array<double>, part string")


def search(table: DataFrame, k: int = 5, every: int = 50, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = table.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    index = cut(rows.withColumn("part", F.size("v").cast("string")), "vectors")
    queries = index.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    asks = queries
    lengths = cut(index.groupBy("part").agg(F.count("*").alias("n")), "lengths")
    sizes = lengths
    # Each level has its share of what may be missed.
    n = lengths.agg(F.max("n")).first()[0] or 1
    depth = max(1, math.ceil(math.log(max(n / PART_ROWS, 1)) / math.log(MOST_PARTS)))
    for level in range(MOST_LEVELS):
        split = cut(sizes.where(F.col("n") > (2 * PART_ROWS if level else LEAST_ROWS)), "split")
        if not split.limit(1).count():
            break
        models = cut(_models(index, split, k, recall ** (1 / depth)), "models")
        # Parts that aren't split have no model, and their rows stay where they are.
        index, asks = cut(_routed(index, models, False), "index"), cut(_routed(asks, models, True), "asks")
        sizes = cut(index.groupBy("part").agg(F.count("*").alias("n")), "sizes")
        release(split, models)
    found = cut(_scan(asks, index, sizes, k), "found")
    # Queries that found fewer rows than there are to find go through all parts of their length.
    got = found.groupBy("query_id").agg(F.count("*").alias("c")).withColumnRenamed("query_id", "q")
    want = queries.join(lengths.select(F.col("part").alias("l"), "n"), F.col("part") == F.col("l")).select("id", "v", "l", F.least(F.lit(k), F.col("n") - 1).alias("want"))
    short = cut(want.join(got, F.col("id") == F.col("q"), "left").where(F.coalesce("c", F.lit(0)) < F.col("want")).select("id", "v", "l"), "short")
    if short.limit(1).count():
        every_part = sizes.select("part", F.substring_index("part", "/", 1).alias("of"))
        found = found.union(_scan(short.join(every_part, F.col("l") == F.col("of")).select("id", "v", "part"), index, sizes, k)).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(asks: DataFrame, index: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The k nearest rows in each block of each part that a query (id, v, part) visits: (query_id, vec_id, score).

    Blocks of queries meet blocks of rows, so that neither side of a group grows with the tables.
    """
    asked = asks.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("askers")).withColumnRenamed("part", "p")
    shape = cut(sizes.join(asked, F.col("part") == F.col("p")).select("p", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), "askers"), "shape")
    rows = index.join(shape, F.col("part") == F.col("p")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("part", "block", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"), "id", "v")
    asks = asks.join(shape, F.col("part") == F.col("p")).withColumn("asker", F.pmod(F.xxhash64("id", F.lit(1)), F.col("askers")).cast("int"))
    asks = asks.select(F.col("part").alias("qpart"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qblock"), F.col("asker").alias("qasker"), F.col("id").alias("qid"), F.col("v").alias("qv"))

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        qs, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if q.num_rows and r.num_rows:
            x, y = _scaled(_vectors(q.column("qv"), q.num_rows)), _scaled(_vectors(r.column("v"), r.num_rows))
            qi, ri = q.column("qid").to_numpy(), r.column("id").to_numpy()
            xn, yn = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            for at in range(0, len(x), 512):
                s = (x[at : at + 512] @ y.T) / xn[at : at + 512, None] / yn[None]
                s[qi[at : at + 512, None] == ri[None]] = -np.inf
                m = min(k, s.shape[1])
                floor = np.partition(s, s.shape[1] - m, 1)[:, s.shape[1] - m] - 1e-9
                for i in range(len(s)):
                    near = np.flatnonzero((s[i] >= floor[i]) & (s[i] > -np.inf))
                    exact = (x[at + i] * y[near]).sum(1) / (xn[at + i] * yn[near])  # equal vectors get equal scores
                    top = np.lexsort((ri[near], -exact))[:k]
                    qs.append(np.full(len(top), qi[at + i]))
                    ids.append(ri[near[top]])
                    scores.append(exact[top])
        return pa.table({"query_id": np.concatenate(qs), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    return asks.groupBy("qpart", "qblock", "qasker").cogroup(rows.groupBy("part", "block", "asker")).applyInArrow(run, "query_id long, vec_id long, score double")
