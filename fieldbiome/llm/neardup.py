"""MinHash near-dedup by a signature-coordinate inverted join.

Each document's set of word shingles gets a MinHash signature of K coordinates. Documents are posted under coordinate-value
pairs; pairs of documents that agree in at least T of the K coordinates are candidates (T = 36 of 64 misses a pair of
similarity 0.8 with a chance of about 1e-5), and every link is confirmed on the full sets. How it stays linear:

* Equal sets collapse to their least document first, so exact copies are never paired.
* Skip: values posted once can't collide; a document with fewer than T shared values has no partner and goes, and what it
  leaves behind is counted anew.
* Each posting list names a leader (by one of FAMILIES hashes, so that lists of one group mostly name the same few), and its
  members are compared with leaders only: a group of near copies becomes one component through its leaders without its square
  of pairs.
* What leaders leave is exact too: lists that still hold more than one component are posted again, rarest first, up to the
  prefix that any pair of T agreements must share, cut into chunks of bounded size, and only pairs of different components
  are counted and confirmed there; the largest component of a list is never compared within itself.

Rows are known by (doc_id, hash of the text); classes of equal sets by numbers in the order of their least row, so the least
class of a component holds its least document.

Defined results: null, blank and empty texts have the empty set and link with nothing; a text with fewer words than a shingle is
one shingle. Rows of one doc_id with other texts are one document for link (what links to any of them links to all); keep_one
judges each of them alone. An empty table gives an empty result. Rows without a doc_id link with nothing: link gives them no
component, keep_one keeps them. Repeated rows give repeated rows in link; keep_one keeps one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbiome.llm.common import SPACE_CHARS, components, cut, free_name, release

K, LEAST = 64, 36
#: Bins of the second sketch (the least hash of each bin, a byte of it), and the share of the bins held by either set in which
#: a pair must agree: 0.8 less five standard errors of 256 bins.
BINS, AGREE = 256, 0.66
#: Half of each hash of a set of so many shingles at most goes along too, and tells the similarity of two such sets (never too
#: low), so that only similar pairs leave the comparison; the sketch tells it where either set is larger. Sets of up to NO_SKETCH
#: have no sketch, which chance would fill.
HALVES, NO_SKETCH = 1024, 64
#: Half hashes that are compared at once.
CELLS = 4_000_000
#: Documents of a posting list that are compared with as many others in one group; pairs that are compared at once.
CHUNK, PAIRS = 256, 100_000
#: Families of lists that name their leader by the same hash: a document tries some leaders of each, not one for each of its lists.
FAMILIES = 8

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, K, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(w))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = h * _STEP + w[k : len(w) - n + 1 + k]
    h = _mixed(h + np.uint64(n))
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def signature(sets: np.ndarray) -> np.ndarray:
    """K minima of a set's hashes, as 32-bit values."""
    out = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        out = np.minimum(out, (sets[None, at : at + 4096] * _MUL[:, None] + _ADD[:, None]).min(1))
    return (out >> np.uint64(32)).astype("<u4")


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t (hash of the text), n, s1 and s2 (digest of the set), sig."""
    names = ["doc_id", "t", "n", "s1", "s2", "sig"]
    schema = T.StructType([T.StructField(x, T.LongType()) for x in names[:5]] + [T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                n, s1, s2, sig = [], [], [], []
                for t in batch.column("text").to_pylist():
                    h = shingles(t, width)
                    d = xxhash.xxh3_128_digest(h.tobytes())
                    n.append(len(h))
                    s1.append(int.from_bytes(d[:8], "little", signed=True))
                    s2.append(int.from_bytes(d[8:], "little", signed=True))
                    sig.append(signature(h).tobytes() if len(h) else b"")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, schema)


def sketch(sets: np.ndarray) -> np.ndarray:
    """BINS bytes: of each bin of the hash's top bits, a byte (not 0) of its least hash; 0 for an empty bin. sets is sorted."""
    bins = (sets >> np.uint64(56)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]] if len(bins) else np.zeros(0, bool)
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = 1 + (_mixed(sets[first]) % np.uint64(255)).astype(np.uint8)
    return out


def _agrees(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of sketches agree enough to be similar."""
    held = ((x > 0) | (y > 0)).sum(-1)
    return ((x == y) & (x > 0)).sum(-1) >= AGREE * held


class Marks:
    """What tells, without the full sets, which pairs of rows may be similar: sizes, sketches, and half hashes."""

    def __init__(self, sizes: pa.ChunkedArray, sketches: pa.ChunkedArray, halves: pa.ChunkedArray, percent: int):
        self.n, self.percent = sizes.to_numpy(), percent
        none = bytes(BINS)
        self.sketch = np.frombuffer(b"".join(r or none for r in sketches.to_pylist()), np.uint8).reshape(-1, BINS)
        held = halves.to_pylist()
        self.flat = np.frombuffer(b"".join(held) + bytes(4), "<u4")
        lengths = np.fromiter(map(len, held), np.int64, len(held)) // 4
        self.start = np.cumsum(lengths) - lengths

    def _padded(self, rows: np.ndarray, width: int, odd: int) -> np.ndarray:
        """The rows' half hashes; empty places hold numbers that no other place has, nor the other side's empty places."""
        at = np.arange(width)
        inside = at[None] < self.n[rows][:, None]
        pad = np.uint32(0xFFFFFFFF - odd) - 2 * at.astype(np.uint32)
        return np.where(inside, self.flat[np.where(inside, self.start[rows][:, None] + at[None], 0)], pad[None])

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of row numbers, whether it may be similar."""
        nx, ny = self.n[x], self.n[y]
        out = 100 * np.minimum(nx, ny) >= self.percent * np.maximum(nx, ny)
        exact = (nx <= HALVES) & (ny <= HALVES)
        known = np.flatnonzero(out & ~exact & (nx > NO_SKETCH) & (ny > NO_SKETCH))
        for at in range(0, len(known), 20_000):
            k = known[at : at + 20_000]
            out[k] = _agrees(self.sketch[x[k]], self.sketch[y[k]])
        exact = np.flatnonzero(out & exact)
        exact = exact[np.argsort(np.maximum(nx, ny)[exact], kind="stable")]
        while len(exact):
            first = int(max(nx[exact[0]], ny[exact[0]]))
            few = max(1, CELLS // (4 * first))
            k, exact = exact[:few], exact[few:]
            width = int(max(nx[k].max(), ny[k].max()))
            both = np.concatenate([self._padded(x[k], width, 0), self._padded(y[k], width, 1)], 1)
            both.sort(1)
            same = (both[:, 1:] == both[:, :-1]).sum(1)
            out[k] = 100 * same >= self.percent * (nx[k] + ny[k] - same)
        return out


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """Of (rep, text): rep, n, its set (as bytes of sorted hashes), and its marks: sketch and half hashes."""
    names = ["rep", "n", "set", "sketch", "halves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
                sketches = [sketch(h).tobytes() if len(h) > NO_SKETCH else b"" for h in sets]
                halves = [(h >> np.uint64(32)).astype("<u4").tobytes() if len(h) <= HALVES else b"" for h in sets]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(list(map(len, sets)), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array(sketches, pa.binary()), pa.array(halves, pa.binary())], names)

    return texts.select("rep", "text").mapInArrow(run, "rep long, n long, set binary, sketch binary, halves binary")


def _postings(signed: DataFrame) -> DataFrame:
    """(key, doc): one row for each coordinate; key holds the coordinate above 32 bits of value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, K)
                keys = (np.arange(K, dtype=np.int64) << 32)[None] | sig.astype(np.int64)
                docs = np.repeat(batch.column("rep").to_numpy(), K)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(docs)], ["key", "doc"])

    return signed.select("rep", "sig").mapInArrow(run, "key long, doc long")


def _agreeing(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and marks of both ends) that agree in LEAST coordinates and in their marks, as (a, b, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, K) for c in ("sig_a", "sig_b"))
            hits = (x == y).sum(1)
            both = lambda c: pa.chunked_array([batch.column(f"{c}_a"), batch.column(f"{c}_b")])
            near = np.flatnonzero(hits >= LEAST)
            marks = Marks(both("n"), both("sketch"), both("halves"), percent)
            ok = near[marks.similar(near, near + batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok)), pa.array(hits[ok].astype(np.int64))], ["a", "b", "hits"])

    columns = [f"{c}_{side}" for c in ("sig", "n", "sketch", "halves") for side in "ab"]
    return pairs.select("a", "b", *columns).mapInArrow(run, "a long, b long, hits long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    a = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _rest(lists: DataFrame, label: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different components, from lists (key, doc) that leaders left mixed; marks: (rep, sig, n, sketch, halves)."""
    held = lists.join(label, lists.doc == label.node).select("key", "doc", "component")
    mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select(F.col("key").alias("k"), "n")
    open_ = cut(held.join(cut(mixed, "mixed"), F.col("key") == F.col("k")).select("key", "doc", "component", "n"), "open")
    able = open_.groupBy("doc").agg(F.count("*").alias("m"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("rarest")).where(F.col("m") >= LEAST)
    # At most K keys a document: its rarest m - LEAST + 1 hold one of the LEAST that any partner shares.
    able = able.select("doc", F.slice("rarest", 1, F.col("m") - LEAST + 1).alias("prefix"))
    able = able.withColumn("mask", F.aggregate("prefix", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x["key"], 32).cast("int")))))
    able = able.join(label, able.doc == label.node).drop("node")
    able = cut(able, "able")
    full = able.select("doc", "component", "mask").join(marks.withColumnRenamed("rep", "doc"), "doc")
    posted = able.select("doc", "component", F.explode("prefix").alias("p")).select("doc", "component", F.col("p.key").alias("key"))
    # A list's largest component needs no comparison within itself: its rows meet the others' chunks only, usually one.
    by_part = posted.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = by_part.groupBy("key").agg(F.max(F.struct("n", "component")).alias("x"), F.sum("n").alias("n")).where(F.col("n") > F.col("x.n"))
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    sizes = cut(sizes.select(F.col("key").alias("k"), F.col("x.component").alias("main"), chunks(F.col("x.n")).alias("mains"), chunks(F.col("n") - F.col("x.n")).alias("others")), "sizes")
    posted = posted.join(sizes, F.col("key") == F.col("k"))
    chunk = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda inner, i, j, c: F.struct(F.lit(inner).alias("inner"), i.alias("i"), j.alias("j"), c.alias("c"))
    main = F.transform(every("others"), lambda d: block(False, chunk("mains"), d, F.lit(0)))
    other = F.concat(
        F.transform(every("mains"), lambda d: block(False, d, chunk("others"), F.lit(1))),
        F.transform(every("others"), lambda d: block(True, F.least(chunk("others"), d), F.greatest(chunk("others"), d), chunk("others"))),
    )
    posted = posted.select("doc", "key", F.explode(F.when(F.col("component") == F.col("main"), main).otherwise(other)).alias("g")).select("doc", "key", "g.*")
    group = ["key", "inner", "i", "j"]
    rows = posted.join(full, "doc").select(*group, "c", "doc", "component", "mask", "sig", "n", "sketch", "halves")
    dealt = rows.repartition(*group).sortWithinPartitions(*group, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of the last group so far: the next batch may go on with it
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            last = int(_group_starts(table, group)[-1])
            held = table.slice(last)
            if last:
                yield from _pairs_within(table.slice(0, last), group, percent)
        if held is not None and held.num_rows:
            yield from _pairs_within(held, group, percent)

    return dealt.mapInArrow(run, "a long, b long")


def _group_starts(table: pa.Table, group: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in group:
        x = table.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _pairs_within(table: pa.Table, group: list[str], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups (sorted by group, then chunk) that agree enough, each from the first prefix list that it shares.

    A group is one chunk, whose rows are all compared with each other, or two, which are compared across.
    """
    n_rows = table.num_rows
    starts = _group_starts(table, group)
    size = np.diff(np.r_[starts, n_rows])
    key, inner, i, j, c, doc, comp = (table.column(x).to_numpy() for x in (*group, "c", "doc", "component"))
    mask = table.column("mask").to_numpy().astype(np.uint64)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, K)
    marks = Marks(table.column("n"), table.column("sketch"), table.column("halves"), percent)
    of = np.repeat(np.arange(len(starts)), size)
    place, end = np.arange(n_rows) - starts[of], (starts + size)[of]
    across = ~inner | (i != j)
    left = np.where(inner, c == i, c == 0)  # rows of the first of two chunks
    second = (starts + np.add.reduceat(left.astype(np.int64), starts))[of]
    first = np.where(across, np.where(left, second, end), starts[of] + place + 1)
    count = end - first
    bits = np.uint64(1) << np.arange(K, dtype=np.uint64)
    low = (np.uint64(1) << (key >> 32).astype(np.uint64)) - np.uint64(1)
    upto = np.cumsum(count)
    cuts = np.searchsorted(upto, np.arange(PAIRS, int(upto[-1]) + PAIRS, PAIRS))
    for a, b in zip([0, *(cuts[:-1] + 1).tolist()], [*(cuts[:-1] + 1).tolist(), n_rows], strict=True):
        if a >= b:
            continue
        n = count[a:b]
        x = np.repeat(np.arange(a, b), n)
        y = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        apart = comp[x] != comp[y]
        x, y = x[apart], y[apart]
        same = sig[x] == sig[y]
        near = np.flatnonzero(same.sum(1) >= LEAST)
        x, y, same = x[near], y[near], same[near]
        before = (same * bits[None]).sum(1, dtype=np.uint64) & mask[x] & mask[y] & low[x]
        own = np.flatnonzero(before == 0)
        x, y = x[own], y[own]
        good = marks.similar(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(doc[x[good]]), pa.array(doc[y[good]])], ["a", "b"])


def _classes(signed: DataFrame) -> DataFrame:
    """(rep, s1, s2, d, t): a number for each set that isn't empty, in the order of its least row (d, t)."""
    some = signed.where("n > 0 and doc_id is not null")
    least = some.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t")).alias("x")).orderBy("x.doc_id", "x.t")
    return cut(least.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", F.col("x.doc_id").alias("d"), F.col("x.t").alias("t")), "classes")


def _linked(docs: DataFrame, signed: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of each class: component is the least class that its links reach."""
    if percent < 80:
        raise ValueError("the match threshold of 36 of 64 coordinates is set for similarities of 0.8 and more")
    row = classes.select("rep", F.col("d").alias("d_"), F.col("t").alias("t_"))
    reps = cut(signed.where("n > 0").join(row, (F.col("doc_id") == F.col("d_")) & (F.col("t") == F.col("t_"))).dropDuplicates(["rep"]).select("rep", "sig"), "sigs")
    postings = _postings(reps)
    leaders = F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.pmod(F.shiftright("key", 32), F.lit(FAMILIES)), "doc").alias("h"), "doc")).alias("first")
    lists = lambda rows: cut(rows.groupBy("key").agg(*leaders).where("n > 1").select(F.col("key").alias("k"), F.col("first.doc").alias("leader")), "lists")
    first = lists(postings)
    posted = cut(postings.join(first, F.col("key") == F.col("k")).select("key", "doc", "leader"), "shared")
    shared, able = _skip(posted)
    again = lists(shared)
    release(first, posted, able)
    posted = shared
    shared, able = _skip(posted.select("key", "doc").join(again, F.col("key") == F.col("k")).select("key", "doc", "leader"))
    release(again, posted)
    wanted = row.join(able, F.col("rep") == F.col("d")).select("rep", "d_", "t_")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    texts = texts.join(wanted, (F.col("doc_id") == F.col("d_")) & (F.col("t") == F.col("t_")))
    sets = cut(_sets(texts, width).dropDuplicates(["rep"]), "sets")
    marks = cut(reps.join(sets.select("rep", "n", "sketch", "halves"), "rep"), "marks")
    release(reps)

    mark = lambda c: marks.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("sig", "n", "sketch", "halves")])
    pairs = shared.where("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = cut(_agreeing(pairs.join(mark("a"), "a").join(mark("b"), "b"), percent), "pairs")
    label = able.select(F.col("d").alias("node"), F.col("d").alias("component"))
    for one_each in (True, True, False):
        # First each class tries its best leader that is still in another component, which leaves little for the last round.
        pairs = cut(_apart(pairs, label), "pairs")
        tried = pairs
        if one_each:
            best = pairs.groupBy("a").agg(F.max(F.struct("hits", (-F.col("b")).alias("nb"))).alias("x"))
            tried = cut(best.select("a", (-F.col("x.nb")).alias("b")), "best")
        label = _joined(label, _confirmed(tried, sets, percent))
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    left = cut(_rest(shared.select("key", "doc"), label, marks, percent), "candidates")
    label = _joined(label, _confirmed(left, sets, percent))
    release(shared, sets, marks, left, able)
    return label


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the least doc_id that its links reach).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. The agreement threshold is set for
    percent >= 80.
    """
    signed = cut(_signed(docs, width), "signed")
    classes = _classes(signed)
    label = _linked(docs, signed, classes, width, percent)
    of = classes.select("rep", F.col("s1").alias("c1"), F.col("s2").alias("c2"))
    member = cut(signed.where("n > 0 and doc_id is not null").join(of, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))).select("doc_id", "n", "rep"), "members")
    # Rows of one doc_id with other sets: their classes are one document's.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("d"), "lo")
    same = cut(member.join(several, F.col("doc_id") == F.col("d")).where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")).distinct(), "same")
    if same.limit(1).count():
        every = classes.select(F.col("rep").alias("node"))
        known = label.withColumnRenamed("node", "x").withColumnRenamed("component", "c")
        label = _joined(every.join(known, F.col("node") == F.col("x"), "left").select("node", F.coalesce("c", "node").alias("component")), same)
    moved = label.where("node <> component").select(F.col("node").alias("x"), "component")
    root = classes.select(F.col("rep").alias("r"), F.col("d").alias("component_id"))
    found = member.join(moved, F.col("rep") == F.col("x"), "left").withColumn("own", F.coalesce("component", "rep"))
    found = found.join(root, F.col("own") == F.col("r")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.union(alone)


def _skip(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shared, able): the postings of documents with LEAST shared values at least, and these documents (d)."""
    able = cut(shared.groupBy("doc").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST).select(F.col("doc").alias("d")), "able")
    return cut(shared.join(able, F.col("doc") == F.col("d"), "left_semi"), "shared"), able


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b, hits) whose ends are in different components."""
    a = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a").join(b, "b").where("ca <> cb").select("a", "b", "hits")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) after links (a, b): only what lies between components goes on to their search."""
    a = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = cut(links.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
    found = components(between).withColumnRenamed("node", "x").withColumnRenamed("component", "c")
    out = cut(label.join(found, F.col("component") == F.col("x"), "left").select("node", F.coalesce("c", "component").alias("component")), "labels")
    release(between)
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: the row of the least (doc_id, text hash) of each component stays, once, with the columns of docs."""
    signed = cut(_signed(docs, width), "signed")
    classes = _classes(signed)
    label = _linked(docs, signed, classes, width, percent)
    d, t, own = (free_name(docs, x) for x in ("__id", "__kept", "__hash"))
    moved = label.where("node <> component").select("node")
    kept = cut(classes.join(moved, F.col("rep") == F.col("node"), "left_anti").select(F.col("d").alias(d), F.col("t").alias(t)), "kept")
    worded = F.btrim(docs["text"], F.lit(SPACE_CHARS)) != ""
    some = F.coalesce(worded & docs["doc_id"].isNotNull(), F.lit(False))
    hashed = docs.where(some).withColumn(own, F.xxhash64(docs["text"]))
    left = hashed.join(kept, (F.col("doc_id").cast("long") == F.col(d)) & (F.col(own) == F.col(t)), "left_semi").dropDuplicates(["doc_id", own])
    return left.drop(own).unionByName(docs.where(~some))
