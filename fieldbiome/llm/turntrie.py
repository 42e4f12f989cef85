"""Prefix trie of conversations: every distinct sequence of first turns is a node, with its members, children, leaves and savings.

A turn is known by two 64-bit hashes and the code points of its text, so texts don't travel. Equal conversations are brought
down to one row first. These rows are dealt out by ranges of their sequences, so any prefix, however common, is shared by as many
tasks as its rows need. Blocks of neighbouring rows become succinct tries: nodes in level order, a LOUDS bitvector (for each node a
1 for each child, then a 0) and label arrays; parents are read from the bitvector, and members, leaves and savings roll up by
add.at over the levels from the deepest. Only nodes on the paths to a block's first and last rows can go on in another block: these
upper levels are summed separately, by prefix, and rolled up along the paths.

Defined results: turns stand in the order of turn (null first), then role, then the SHA-256 of the text; null role or text is empty. Rows without
conv_id are left out; repeated rows are turns of their own. An empty table gives the root alone, without members (conv_id null).
A task holds the turns of a block of BLOCK conversations at a time, as numbers; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.llm.common import cut

#: Conversations of one base share its first turns, FEWEST - 1 of them at most.
BASE, FEWEST = 100, 6
#: Distinct conversations of a block, and bits of a conv_id within the ranges of ids that are written as one text.
BLOCK, ID_BITS = 20_000, 12
#: Rows that the small table of upper nodes is repeated for, so that its children's rows meet it in many tasks.
SALTS = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
_COUNTS = ("n", "kids", "leaves", "saved")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (a, b, len)): the first h turns of the base conversation, then the own turns after the first h."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    label = [F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"), F.length(text).cast("long").alias("len")]
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"), role.alias("role"), F.sha2(text, 256).alias("tie"), *label)
    rows = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["len"].alias("len")))
    own = rows.groupBy("conv_id").agg(ordered.alias("own"))
    base = own.where(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, FEWEST - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % FEWEST).cast("int")
    both = own.withColumn("of", F.col("conv_id") - F.col("conv_id") % BASE).join(base, F.col("of") == F.col("base"), "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint,len:bigint>>")
    tail = F.when(F.size("own") > h, F.slice("own", h + 1, F.size("own"))).otherwise(none)
    return both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), none), tail).alias("turns"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(turns, n, low, ends_sha256): each distinct sequence, how many conversations are it, the least conv_id, and the digest of all.

    Ids are joined to texts by ranges of ids, and a digest goes over these texts one after another, so no list is ever whole.
    """
    seq = F.col("turns")
    rows = conversations.select("conv_id", "turns", F.xxhash64(seq).alias("k1"), F.xxhash64(F.lit(1), F.size(seq), seq).alias("k2"), F.shiftright("conv_id", ID_BITS).alias("range"))
    parts = rows.groupBy("k1", "k2", "range").agg(F.any_value("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, digest = None, None, None
        for batch in batches:
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            n, low, ids = (batch.column(c).to_pylist() for c in ("n", "low", "ids"))
            done = []
            for i, k in enumerate(keys):
                if k == key:
                    digest.update(b"," + ids[i].encode())
                    held[1] += n[i]
                    held[2] = min(held[2], low[i])
                    continue
                if key is not None:
                    done.append((*held, digest.hexdigest()))
                key, held, digest = k, [batch.column("turns").slice(i, 1), n[i], low[i]], hashlib.sha256(ids[i].encode())
            if done:
                yield _sequences(done)
        if key is not None:
            yield _sequences([(*held, digest.hexdigest())])

    ordered = parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "range")
    return ordered.mapInArrow(run, "turns array<struct<a:bigint,b:bigint,len:bigint>>, n long, low long, ends_sha256 string")


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    turns, n, low, shas = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(turns), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(shas, pa.string())], ["turns", "n", "low", "ends_sha256"])


class Louds:
    """A trie of sorted distinct sequences, given as label arrays and lengths, nodes in level order; node 0 is the root.

    bits: LOUDS, after a 1 and a 0 for the root's own place. depth, row: each node's level and the first sequence under it.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray):
        n = self.rows = len(sizes)
        first = np.concatenate([[0], np.cumsum(sizes)])
        shared = np.zeros(n, np.int64)  # first turns shared with the row before
        alive = np.arange(1, n)
        d = 0
        while len(alive):
            alive = alive[(sizes[alive] > d) & (sizes[alive - 1] > d)]
            x, y = first[alive] + d, first[alive - 1] + d
            alive = alive[(a[x] == a[y]) & (b[x] == b[y])]
            d += 1
            shared[alive] = d
        new = sizes - shared
        row = np.repeat(np.arange(n), new)
        depth = shared[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new)
        order = np.lexsort((row, depth))
        self.row = np.concatenate([[0], row[order]])
        self.depth = np.concatenate([[0], depth[order]])
        self.levels = np.searchsorted(self.depth, np.arange(self.depth[-1] + 2))
        at = first[self.row[1:]] + self.depth[1:] - 1
        self.a, self.b = np.concatenate([[0], a[at]]), np.concatenate([[0], b[at]])  # labels, the root without one
        self.at = np.concatenate([[-1], at])
        self.place = self.depth * (n + 1) + self.row  # ascends
        degree = np.zeros(len(self.row), np.int64)
        np.add.at(degree, self.node_of(self.depth[1:] - 1, self.row[1:]), 1)
        self.bits = np.ones(2 * len(degree) + 1, bool)
        self.bits[1] = False
        self.bits[2 + np.cumsum(degree + 1) - 1] = False

    def node_of(self, depth: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The nodes of these levels under which these rows are; a row must be as long as its level."""
        return np.searchsorted(self.place, depth * (self.rows + 1) + row, "right") - 1

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 for the root: the zeros before a node's 1 are the nodes whose children were listed before."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1

    def path(self, row: int, size: int) -> np.ndarray:
        """The nodes from the root to a row's end."""
        return self.node_of(np.arange(size + 1), np.full(size + 1, row))


def block_rollup(turns: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, n: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of a block of sequences: depth, row, parent, n, low, kids, leaves, saved, open and the row that ends there (or -1).

    Open nodes lie on the path to the first or last row: what they hold is what this block adds to them, and of kids, leaves and
    saved only what comes from children that are not open.
    """
    a, b, lens = turns
    t = Louds(a, b, sizes)
    parent, degree, count = t.parents(), t.degrees(), len(t.row)
    ends = t.node_of(sizes, np.arange(len(sizes)))
    out = {"n": np.zeros(count, np.int64), "low": np.full(count, np.iinfo(np.int64).max), "kids": degree.copy(), "leaves": (degree == 0).astype(np.int64), "saved": np.zeros(count, np.int64)}
    np.add.at(out["n"], ends, n)
    np.minimum.at(out["low"], ends, low)
    open_ = np.zeros(count, bool)
    for row in (0, len(sizes) - 1):
        open_[t.path(row, int(sizes[row]))] = True
    own = np.concatenate([[0], lens[t.at[1:]]])
    for d in range(len(t.levels) - 2, 0, -1):
        here = np.arange(t.levels[d], t.levels[d + 1])
        np.add.at(out["n"], parent[here], out["n"][here])
        np.minimum.at(out["low"], parent[here], out["low"][here])
        out["saved"][here] += np.where(open_[here], 0, (out["n"][here] - 1) * own[here])
        shut = here[~open_[here]]
        for c in ("leaves", "saved"):
            np.add.at(out[c], parent[shut], out[c][shut])
    onward = np.flatnonzero(open_[1:]) + 1
    np.subtract.at(out["kids"], parent[onward], 1)
    out["leaves"][open_ & (degree == 0)] = 0  # another block may have children of it
    end_row = np.full(count, -1)
    end_row[ends] = np.arange(len(sizes))
    return out | {"depth": t.depth, "row": t.row, "parent": parent, "open": open_, "end_row": end_row, "has_kids": degree > 0, "len": own, "first_path": t.path(0, int(sizes[0])), "last_path": t.path(len(sizes) - 1, int(sizes[-1]))}


_NODE = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("has_kids", pa.bool_()), ("len", pa.int64()), ("path", pa.int64())])


def prefix_keys(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """A key for each prefix of a sequence of labels, the empty one first."""
    digest, out = hashlib.blake2b(digest_size=16), []
    for x in np.column_stack([a, b]).astype("<i8"):
        out.append(digest.digest())
        digest.update(x.tobytes())
    return [*out, digest.digest()]


def _block(rows: pa.Table, path: int) -> pa.RecordBatch:
    """The nodes of a block: those that end here as results (key null), open ones with their keys and a path's number."""
    turns = rows.column("turns").combine_chunks()
    flat = turns.flatten()
    a, b, lens = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    sizes = np.diff(turns.offsets.to_numpy()).astype(np.int64)
    got = block_rollup((a, b, lens), sizes, rows.column("n").to_numpy(), rows.column("low").to_numpy())
    first = np.concatenate([[0], np.cumsum(sizes)])
    key: dict[int, bytes] = {}
    for name, row in (("last_path", len(sizes) - 1), ("first_path", 0)):
        key |= dict(zip(got[name].tolist(), prefix_keys(a[first[row] : first[row + 1]], b[first[row] : first[row + 1]]), strict=True))
    head = set(got["first_path"].tolist())
    both = [i for i in got["last_path"].tolist() if i in head] if len(sizes) > 1 else []
    # Nodes on both paths come a second time, for the last path, adding nothing.
    count = len(got["parent"])
    at = np.concatenate([np.arange(count), np.array(both, np.int64)])
    of_path = [path if i in head else path + 1 if i in key else None for i in range(count)] + [path + 1] * len(both)
    once = np.arange(len(at)) < count
    shas = rows.column("ends_sha256").to_pylist()
    parent = got["parent"][at]
    open_parent = got["open"][parent]
    up = np.where((parent >= 0) & ~open_parent, got["low"][parent], -1)
    columns = [
        got["low"][at], got["depth"][at], pa.array(up, mask=(parent < 0) | open_parent), *(np.where(once, got[c][at], 0) for c in _COUNTS),
        [NO_ENDS if r < 0 else shas[r] for r in got["end_row"][at].tolist()],
        [key.get(i) for i in at.tolist()], [key.get(i) if i >= 0 else None for i in parent.tolist()],
        got["has_kids"][at], got["len"][at], of_path,
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)


def _blocks(batches: Iterator[pa.RecordBatch], part: int, block: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    number, rows = 0, 0
    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, block - rows)
            batch = batch.slice(piece.num_rows)
            held.append(piece)
            rows += piece.num_rows
            if rows == block:
                yield _block(pa.Table.from_batches(held), (part << 32) + 2 * number)
                held, rows, number = [], 0, number + 1
    if held:
        yield _block(pa.Table.from_batches(held), (part << 32) + 2 * number)


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    seqs = cut(distinct_sequences(rebuilt(conversations)), "sequences")
    parts = max(1, -(-seqs.count() // (4 * block)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, TaskContext.get().partitionId(), block)

    kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, has_kids boolean, len long, path long"
    nodes = cut(seqs.repartitionByRange(parts, "turns").sortWithinPartitions("turns").mapInArrow(run, kinds), "nodes")
    upper = cut(_upper(nodes.where("key is not null")), "upper")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    within = nodes.where("key is null and parent_key is null").select(*result)
    parents = upper.select(F.col("key").alias("of"), F.col("conv_id").alias("up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = nodes.where("key is null and parent_key is not null").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    below = salted.join(parents, (F.col("parent_key") == F.col("of")) & (F.col("salt") == F.col("s"))).withColumn("parent_conv_id", F.col("up")).select(*result)
    named = upper.join(upper.select(F.col("key").alias("of"), F.col("conv_id").alias("up")), F.col("parent_key") == F.col("of"), "left").withColumn("parent_conv_id", F.col("up")).select(*result)
    root = spark.range(1).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), *[F.lit(v).cast("long").alias(c) for c, v in (("n_convs", 0), ("n_children", 0), ("n_leaves", 1), ("saved_tokens", 0))], F.lit(NO_ENDS).alias("ends_sha256"))
    found = within.unionByName(below).unionByName(named)
    return found if seqs.limit(1).count() else found.unionByName(root)


def _upper(parts: DataFrame) -> DataFrame:
    """The open nodes, summed over their blocks and rolled up: (key, parent_key, conv_id, depth, n_convs, ..., ends_sha256).

    A node's own leaves and savings are laid on one of the paths that go through it; running sums along each path, from its end
    up, then give each node on it what lies below, and the paths' sums add up.
    """
    ends = F.min(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256")))
    sums = parts.groupBy("key").agg(
        F.any_value("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(ends, F.lit(NO_ENDS)).alias("ends_sha256"), F.max("has_kids").alias("has_kids"), F.max("len").alias("len"), F.min("path").alias("home"),
    )
    sums = cut(sums, "upper-sums")
    leaf, saved = F.col("n_leaves") + (~F.col("has_kids")).cast("long"), F.col("saved_tokens") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("len")).otherwise(0)
    homes = sums.select(F.col("key").alias("k"), F.col("home").alias("h"), leaf.alias("leaf"), saved.alias("save"))
    below = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.select("key", "path", "depth").join(homes, (F.col("key") == F.col("k")) & (F.col("path") == F.col("h")), "left")
    run = placed.select("key", F.sum(F.coalesce("leaf", F.lit(0))).over(below).alias("leaves"), F.sum(F.coalesce("save", F.lit(0))).over(below).alias("saves"))
    total = run.groupBy(F.col("key").alias("tk")).agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))
    kids = sums.where("parent_key is not null").groupBy(F.col("parent_key").alias("pk")).agg(F.count("*").alias("more"))
    both = sums.join(total, F.col("key") == F.col("tk")).join(kids, F.col("key") == F.col("pk"), "left")
    return both.select("key", "parent_key", "conv_id", "depth", "n_convs", (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saves").alias("saved_tokens"), "ends_sha256")
