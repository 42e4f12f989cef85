"""Alignment search: hits of protein queries in a database by seeds, two hits on a diagonal, and gapped local alignment in bands.

Words of the database, with their neighbourhood (all words that score `least` or more against them), meet the queries' words in a
join that is salted against frequent words; queries' words that a filter of the database's tells to be in none are left out before. Seeds of a query and a subject on one diagonal count where another seed stands within
`reach` before them; only such bands of diagonals are aligned, so no pair without two seeds is touched. Windows of low entropy give
no words. Bands are aligned by anti-diagonals over batches of candidates, with affine gaps, and traced back. Bit scores and e-values
follow from the parameters of Karlin and Altschul, solved for the scores' frequencies in the database, and from effective lengths.

Masks and the two-hit rule miss subjects that stand in a query whole but have too few words left. A search for whole subjects takes
two long words instead, the first and the last letters of a subject, which overlap: both on one diagonal tell that all of it is there.

Null and empty sequences have no hits; letters that are no residue count as unknown, which score UNKNOWN and give no words. Of one
query and subject the best alignment stands, of ties the one that starts first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.functions.scratch import cut

#: Fixed value: the residues, in the order of the score table.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
#: BLOSUM62, lower triangle, in the order of RESIDUES.
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
UNKNOWN, OUTSIDE = -1, -10_000
#: Codes of letters that are no residue, and of places beyond a sequence's end.
X, PAST = 20, 21


def score_table() -> np.ndarray:
    """Scores by code: the residues, an unknown letter, and the outside of a sequence, which no alignment enters."""
    out = np.full((22, 22), OUTSIDE, np.int32)
    out[:21, :21] = UNKNOWN
    for a, row in enumerate(BLOSUM62.strip().split("\n")):
        for b, v in enumerate(row.split()):
            out[a, b] = out[b, a] = int(v)
    return out


SCORES = score_table()
_CODES = np.full(256, X, np.uint8)
for _k, _c in enumerate(RESIDUES):
    _CODES[[ord(_c), ord(_c.lower())]] = _k


def codes(seq: str) -> np.ndarray:
    return _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


@dataclass(frozen=True)
class Search:
    """Settings: word length, least score of a neighbour, reach of the two-hit rule, half width of a band, gap costs (a gap of g
    residues costs opening + g * extension), entropy in bits under which a window is masked, and its length."""

    word: int = 5
    least: int = 20
    reach: int = 40
    band: int = 24
    opening: int = 11
    extension: int = 1
    window: int = 12
    low_entropy: float = 2.2
    salts: int = 16


# ---- statistics


@dataclass(frozen=True)
class Statistics:
    lam: float
    k: float
    h: float

    def bits(self, score: float) -> float:
        return (self.lam * score - math.log(self.k)) / math.log(2)

    def length_taken(self, m: float, n: float, count: float) -> float:
        """What edges take of a query of m residues against `count` subjects of n: the mean length of an alignment of chance."""
        taken = 0.0
        for _ in range(20):
            left, db = max(m - taken, 1.0), max(n - count * taken, count)
            taken = min(max(math.log(self.k * left * db) / self.h, 0.0), m - 1.0 if m > 1 else 0.0)
        return taken

    def evalue(self, score: float, m: float, n: float, count: float) -> float:
        taken = self.length_taken(m, n, count)
        return max(m - taken, 1.0) * max(n - count * taken, count) * 2.0 ** -self.bits(score)


def score_frequencies(p: np.ndarray, q: np.ndarray, scores: np.ndarray = SCORES) -> dict[int, float]:
    """How often residues of two compositions score each value when paired by chance."""
    out: dict[int, float] = {}
    for s, w in zip(scores[:20, :20].ravel().tolist(), np.outer(p, q).ravel().tolist(), strict=True):
        out[s] = out.get(s, 0.0) + w
    return {s: w for s, w in sorted(out.items()) if w > 0}


def karlin_altschul(freq: dict[int, float]) -> Statistics:
    """lambda, K and H of ungapped scores; their mean must be negative, and a positive score possible."""
    s, w = np.array(list(freq)), np.array(list(freq.values()))
    w = w / w.sum()
    if (s * w).sum() >= 0 or s.max() <= 0:
        raise ValueError("the mean score must be negative, and a positive one possible")
    high = 0.5
    while (w * np.exp(high * s)).sum() < 1:
        high *= 2
    lam = high
    for _ in range(200):  # Newton's steps from above: the function is convex
        e = w * np.exp(lam * s)
        step = (e.sum() - 1) / (s * e).sum()
        lam -= step
        if abs(step) < 1e-16 * lam:
            break
    tilted = w * np.exp(lam * s)
    h = lam * (s * tilted).sum()
    unit = math.gcd(*[abs(int(x)) for x in s if x])
    low, span = int(s.min()), int(s.max() - s.min())
    one = np.zeros(span + 1)
    one[(s - low).astype(int)] = w
    total, sums = 0.0, np.ones(1)
    for j in range(1, 200):
        sums = np.convolve(sums, one)
        at = np.arange(len(sums)) + j * low
        part = (sums[at < 0] * np.exp(lam * at[at < 0])).sum() + sums[at >= 0].sum()
        total += part / j
        if part / j < 1e-13:
            break
    return Statistics(float(lam), float(unit * lam * math.exp(-2 * total) / (h * (1 - math.exp(-lam * unit)))), float(h))


# ---- words


def masked(seq: np.ndarray, window: int, low: float) -> np.ndarray:
    """Which residues lie in a window whose entropy is under `low` bits; sequences shorter than a window have none."""
    out = np.zeros(len(seq), bool)
    if len(seq) < window:
        return out
    seen = np.zeros((len(seq) + 1, 21), np.int32)
    np.cumsum(seq[:, None] == np.arange(21), axis=0, out=seen[1:])
    share = (seen[window:] - seen[:-window]) / window
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    poor = np.flatnonzero(entropy < low - 1e-12)
    edges = np.zeros(len(seq) + 1, np.int32)
    np.add.at(edges, poor, 1)
    np.add.at(edges, poor + window, -1)
    return np.cumsum(edges[:-1]) > 0


def words(seq: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray]:
    """(places, words) of the words of known residues outside masked windows; a word is a number of base 20."""
    k = how.word
    if len(seq) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum((seq >= 20) | masked(seq, how.window, how.low_entropy))])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    out = np.zeros(len(at), np.int64)
    for j in range(k):
        out = out * 20 + seq[at + j]
    return at, out


def neighbours(found: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray]:
    """(owner, word) of all words that score how.least or more against found[owner]; each word counts as its own neighbour."""
    k = how.word
    letters = np.stack([found // 20 ** (k - 1 - j) % 20 for j in range(k)], 1) if len(found) else np.zeros((0, k), np.int64)
    table = SCORES[:20, :20]
    best = table.max(1)[letters]
    rest = np.concatenate([np.cumsum(best[:, ::-1], 1)[:, ::-1], np.zeros((len(found), 1), np.int64)], 1)
    owner, word, score = np.arange(len(found)), np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    for j in range(k):
        more = score[:, None] + table[letters[owner, j]]
        at, letter = np.nonzero(more + rest[owner, j + 1][:, None] >= how.least)
        owner, word, score = owner[at], word[at] * 20 + letter, more[at, letter]
    own = np.flatnonzero(table.diagonal()[letters].sum(1) < how.least)  # words that score too little against themselves
    return np.concatenate([owner, own]), np.concatenate([word, found[own]])


#: Fixed value: slots of the filter of words (a prime; 2 MB of bits).
SLOTS = 16_777_213


def _slots(found: DataFrame) -> np.ndarray:
    """Which slots (word mod SLOTS) the words have; words of other slots are surely not among them. 262,144 rows come back at most."""
    slot = F.pmod("word", F.lit(SLOTS))
    got = found.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64 + 1, np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _in_slots(found: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slot = found % SLOTS
    return slots[slot >> 3] >> (slot & 7) & 1 > 0


def _each_word(df: DataFrame, how: Search, near: bool, slots: np.ndarray | None = None) -> DataFrame:
    """(word, id, at) of the sequences (id, seq); near: of the words' neighbours too. slots: only of words that have one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                row = whole.slice(k, 1)
                at, found = words(codes(row.column("seq")[0].as_py()), how)
                if slots is not None:
                    has = _in_slots(found, slots)
                    at, found = at[has], found[has]
                for first in range(0, len(at), 20_000):
                    place, w = at[first : first + 20_000], found[first : first + 20_000]
                    if near:
                        distinct, back = np.unique(w, return_inverse=True)
                        owner, more = neighbours(distinct, how)
                        order = np.argsort(owner, kind="stable")
                        ends = np.searchsorted(owner[order], np.arange(len(distinct) + 1))
                        size = np.diff(ends)[back]
                        pick = np.repeat(ends[back], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        place, w = np.repeat(place, size), more[order][pick]
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), row.column("id").take(pa.array(np.zeros(len(w), np.int64))), pa.array(place, pa.int32())], ["word", "id", "at"])

    kind = dict(df.dtypes)["id"]
    return df.where("seq is not null and seq <> ''").mapInArrow(run, f"word long, id {kind}, at int")


def seeds(queries: DataFrame, db: DataFrame, how: Search) -> DataFrame:
    """(q, s, diagonal, at) of equal words; queries and db are (id, seq). Frequent words are shared by how.salts tasks.

    The words of a database are far more than its size lets the optimizer expect: they are never broadcast.
    """
    made = cut(_each_word(db.repartition(how.salts), how, near=True), "words")
    return _met(_each_word(queries, how, near=False, slots=_slots(made)), made, how).select("q", "s", "diagonal", "at")


def _met(mine: DataFrame, made: DataFrame, how: Search) -> DataFrame:
    """(q, s, diagonal, at) and the other columns of made: words (word, id, at) of queries that equal words of a database."""
    mine = mine.select("word", F.col("id").alias("q"), "at", F.pmod(F.xxhash64("id", "at"), F.lit(how.salts)).cast("int").alias("salt"))
    theirs = made.withColumnsRenamed({"word": "w", "id": "s", "at": "place"})
    theirs = theirs.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(how.salts - 1))))
    met = mine.hint("merge").join(theirs.hint("merge"), (F.col("word") == F.col("w")) & (F.col("salt") == F.col("z")))
    return met.withColumn("diagonal", F.col("at") - F.col("place")).drop("word", "w", "salt", "z", "place")


def candidates(found: DataFrame, how: Search) -> DataFrame:
    """(q, s, low): bands of how.band diagonals, from low on, with two seeds on a diagonal that don't overlap and lie within reach."""
    before = Window.partitionBy("q", "s", "diagonal").orderBy("at").rangeBetween(-how.reach, -how.word)
    twice = found.withColumn("n", F.count("*").over(before)).where("n > 0")
    return twice.select("q", "s", (F.floor(F.col("diagonal") / how.band) * how.band).cast("int").alias("low")).distinct()


# ---- whole subjects


def doubled(seq: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, words) for n = 1, 2, 4, ... letters: the word from each place on, as a 64-bit hash of its two halves' words."""
    turn = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)
    n, out = 1, (seq.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    while len(out):
        yield n, out.view(np.int64)
        out = (out[:-n] ^ turn(out[n:] * np.uint64(0xC2B2AE3D27D4EB4F), 31)) * np.uint64(0x165667B19E3779F9)
        out = out ^ out >> np.uint64(32)
        n *= 2


def _end_words(db: DataFrame) -> DataFrame:
    """(word, id, at, size, ends): the first and the last 2^j letters of each sequence, the most that fit in; one if that is all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[object, ...]] = []
            for key, seq in zip(batch.column("id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                *_, (n, found) = doubled(codes(seq))
                places = sorted({0, len(found) - 1})
                rows += [(int(found[at]), key, at, n, len(places)) for at in places]
            kinds = {"word": pa.int64(), "id": batch.schema.field("id").type, "at": pa.int32(), "size": pa.int64(), "ends": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return db.where("seq is not null and seq <> ''").mapInArrow(run, f"word long, id {dict(db.dtypes)['id']}, at int, size long, ends int")


def _long_words(queries: DataFrame, sizes: int, slots: np.ndarray) -> DataFrame:
    """(word, id, at): the words of sequences (id, seq) that have one of the slots, of all lengths whose bit is set in sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                row = whole.slice(k, 1)
                for n, found in doubled(codes(row.column("seq")[0].as_py())):
                    if n > sizes:
                        break
                    at = np.flatnonzero(_in_slots(found, slots)) if n & sizes else np.zeros(0, np.int64)
                    for first in range(0, len(at), 20_000):
                        place = at[first : first + 20_000]
                        yield pa.RecordBatch.from_arrays([pa.array(found[place], pa.int64()), row.column("id").take(pa.array(np.zeros(len(place), np.int64))), pa.array(place, pa.int32())], ["word", "id", "at"])

    return queries.where("seq is not null and seq <> ''").mapInArrow(run, f"word long, id {dict(queries.dtypes)['id']}, at int")


def whole_candidates(queries: DataFrame, db: DataFrame, how: Search) -> DataFrame:
    """(q, s, low): for each query that holds a subject whole, the band of the first place at which it does."""
    made = cut(_end_words(db), "ends")
    sizes = made.agg(F.coalesce(F.bit_or("size"), F.lit(0))).first()[0]
    met = _met(_long_words(queries, sizes, _slots(made)), made.drop("size"), how)
    there = met.groupBy("q", "s", "diagonal").agg(F.count("*").alias("n"), F.first("ends").alias("ends")).where("n = ends")
    return there.groupBy("q", "s").agg((F.floor(F.min("diagonal") / how.band) * how.band).cast("int").alias("low"))


# ---- gapped alignment


def aligned(query: np.ndarray, subject: np.ndarray, how: Search) -> dict[str, np.ndarray]:
    """The best local alignment of each pair within a band: row k of query, from place i + b, meets place i of row k of subject.

    query is (n, m + w - 1) codes, subject (n, m), with w diagonals (even). Cells of one anti-diagonal are worked out at once, for
    all pairs; of equal ways a pair of residues goes before a gap in the subject, that before a gap in the query, and of equal ends
    the first anti-diagonal, then the first diagonal. Score 0: nothing aligns.
    """
    n, m = subject.shape
    w = query.shape[1] - m + 1
    half = w // 2
    rows = np.arange(n)[:, None]
    steps = 2 * (m - 1) + w
    first, more = how.opening + how.extension, how.extension
    zero, far = np.zeros((n, half), np.int32), np.full((n, half), OUTSIDE, np.int32)
    h, e, f = [zero, zero], [far, far], [far, far]  # of the last anti-diagonal of either parity
    way = np.zeros((steps, n, half), np.uint8)
    best, end_t, end_x = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def moved(a: np.ndarray, by: int, fill: int) -> np.ndarray:
        out = np.full_like(a, fill)
        if by > 0:
            out[:, by:] = a[:, :-by]
        elif by < 0:
            out[:, :by] = a[:, -by:]
        else:
            out = a
        return out

    for t in range(steps):
        p = t % 2
        i = (t - p - 2 * np.arange(half)) // 2
        inside = (i >= 0) & (i < m)
        j = i + p + 2 * np.arange(half)
        q = np.where(inside, query[rows, np.clip(j, 0, query.shape[1] - 1)], PAST)
        s = np.where(inside, subject[rows, np.clip(i, 0, m - 1)], PAST)
        left, up = (-p + 1, -p)  # where the neighbours stand in the other parity's arrays
        h_left, e_left = moved(h[1 - p], left, 0), moved(e[1 - p], left, OUTSIDE)
        h_up, f_up = moved(h[1 - p], up, 0), moved(f[1 - p], up, OUTSIDE)
        opened_e, opened_f = h_left - first, h_up - first
        now_e, now_f = np.maximum(opened_e, e_left - more), np.maximum(opened_f, f_up - more)
        pair = h[p] + SCORES[q, s]
        now = np.maximum(np.maximum(pair, now_e), np.maximum(now_f, 0))
        now = np.where(inside, now, 0)
        choice = np.where(now == 0, 0, np.where(pair == now, 1, np.where(now_e == now, 2, 3)))
        way[t] = choice | (opened_e >= e_left - more) << 2 | (opened_f >= f_up - more) << 3
        h[p], e[p], f[p] = now, np.where(inside, now_e, OUTSIDE), np.where(inside, now_f, OUTSIDE)
        top = now.max(1)
        better = top > best
        best = np.where(better, top, best)
        end_t = np.where(better, t, end_t)
        end_x = np.where(better, now.argmax(1), end_x)
    return {"score": best} | _traced(way, query, subject, best, end_t, end_x)


def _traced(way: np.ndarray, query: np.ndarray, subject: np.ndarray, best: np.ndarray, t: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    n = len(best)
    b = t % 2 + 2 * x
    t, b = t.copy(), b.copy()
    place = lambda: (((t - b) // 2), ((t - b) // 2 + b))
    i, j = place()
    out = {"s_end": i.copy(), "q_end": j.copy(), "s_start": i.copy(), "q_start": j.copy()}
    count = {c: np.zeros(n, np.int64) for c in ("length", "same", "opens")}
    mode, live = np.zeros(n, np.int64), best > 0
    while live.any():
        at = np.flatnonzero(live)
        # A way may lead before the first anti-diagonal: there nothing aligns.
        gone = at[(t[at] < 0) | (b[at] < 0)]
        live[gone] = False
        at = np.flatnonzero(live)
        bits = way[t[at], at, b[at] // 2]
        stop = at[(mode[at] == 0) & (bits & 3 == 0)]
        live[stop] = False
        go = live[at]
        at, bits = at[go], bits[go]
        kind = np.where(mode[at] == 0, bits & 3, mode[at] + 1)
        i, j = (t[at] - b[at]) // 2, (t[at] - b[at]) // 2 + b[at]
        count["length"][at] += 1
        pair = kind == 1
        a = at[pair]
        count["same"][a] += query[a, j[pair]] == subject[a, i[pair]]
        out["s_start"][a], out["q_start"][a] = i[pair], j[pair]
        t[a] -= 2
        for k, (flag, turn) in enumerate(((4, -1), (8, 1))):
            here = kind == 2 + k
            a = at[here]
            opened = bits[here] & flag > 0
            count["opens"][a] += opened
            mode[a] = np.where(opened, 0, k + 1)
            t[a] -= 1
            b[a] += turn
    return out | count


#: Cells of the ways that are kept at a time.
CELLS = 40_000_000


def _align_batch(rows: pa.Table, how: Search, known: Statistics, total: int, count: int) -> pa.Table:
    """The alignments of candidates (q, s, low, q_first, piece, subject, q_len): piece is the query from place q_first on."""
    w = 3 * how.band
    pieces, subjects = ([codes(x) for x in rows.column(c).to_pylist()] for c in ("piece", "subject"))
    ahead = rows.column("q_first").to_numpy() - (rows.column("low").to_numpy() - how.band)
    order = np.argsort([len(s) for s in subjects], kind="stable")
    got: list[tuple[int, ...]] = [()] * len(order)
    names = ("score", "length", "same", "opens", "q_start", "q_end", "s_start", "s_end")
    while len(order):
        m = len(subjects[order[-1]])
        few = max(1, CELLS // ((2 * m + w) * w // 2))
        some, order = order[-few:], order[:-few]
        q, s = np.full((len(some), m + w - 1), PAST, np.uint8), np.full((len(some), m), PAST, np.uint8)
        for k, i in enumerate(some):
            s[k, : len(subjects[i])] = subjects[i]
            q[k, ahead[i] : ahead[i] + len(pieces[i])] = pieces[i]
        found = aligned(q, s, how)
        for i, row in zip(some, zip(*[found[c].tolist() for c in names], strict=True), strict=True):
            got[i] = row
    columns = {c: np.array([g[k] for g in got], np.int64) for k, c in enumerate(names)}
    shift = rows.column("low").to_numpy().astype(np.int64) - how.band
    lengths = rows.column("q_len").to_pylist()
    bits = [known.bits(x) for x in columns["score"]]
    e = [known.evalue(x, m, total, count) for x, m in zip(columns["score"].tolist(), lengths, strict=True)]
    length = np.maximum(columns["length"], 1)
    gaps = columns["q_end"] - columns["q_start"] + columns["s_end"] - columns["s_start"] + 2  # residues of both sides
    mismatch = gaps - columns["length"] - columns["same"]  # columns with two residues, less the equal ones
    return pa.table({
        "qseqid": rows.column("q"), "sseqid": rows.column("s"), "pident": 100.0 * columns["same"] / length, "length": columns["length"], "mismatch": mismatch, "gapopen": columns["opens"],
        "qstart": columns["q_start"] + shift + 1, "qend": columns["q_end"] + shift + 1, "sstart": columns["s_start"] + 1, "send": columns["s_end"] + 1, "evalue": e, "bitscore": bits, "score": columns["score"],
    }).filter(pa.array(columns["score"] > 0))


def composition(db: DataFrame) -> np.ndarray:
    """The share of each residue in the sequences (id, seq); counted in Spark, 20 numbers come back."""
    one = db.agg(*[F.coalesce(F.sum(F.length("seq") - F.length(F.translate("seq", c + c.lower(), ""))), F.lit(0)).alias(c) for c in RESIDUES]).first()
    counts = np.array([one[c] for c in RESIDUES], float)
    return counts / max(counts.sum(), 1)


def search(queries: DataFrame, db: DataFrame, how: Search = Search(), evalue: float = 10.0, known: Statistics | None = None, whole: bool = False) -> DataFrame:
    """(qseqid, sseqid, pident, length, mismatch, gapopen, qstart, qend, sstart, send, evalue, bitscore, score) of queries and db
    (id, seq): the best alignment of each query and subject with an e-value of `evalue` or less. known: other parameters than those
    that follow from the database's composition. whole: of queries that hold a subject whole, with neither masks nor the two-hit rule."""
    total, count = db.where("seq is not null and seq <> ''").agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)), F.count("*")).first()
    if known is None:
        share = composition(db)
        known = karlin_altschul(score_frequencies(share, share)) if share.sum() else Statistics(1.0, 1.0, 1.0)
    bands = cut(whole_candidates(queries, db, how) if whole else candidates(seeds(queries, db, how), how), "bands")
    q = queries.where("seq is not null").select(F.col("id").alias("qid"), F.col("seq").alias("q_seq"))
    s = db.where("seq is not null").select(F.col("id").alias("sid"), F.col("seq").alias("subject"))
    from_ = F.greatest(F.col("low") - how.band, F.lit(0))
    upto = F.col("low") + 2 * how.band + F.length("subject")
    # Each candidate takes the part of the query that its band can reach, and no more.
    both = bands.join(s, F.col("s") == F.col("sid")).join(q, F.col("q") == F.col("qid"))
    rows = both.select("q", "s", "low", from_.alias("q_first"), F.substring("q_seq", from_ + 1, upto - from_ - 1).alias("piece"), "subject", F.length("q_seq").alias("q_len"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _align_batch(pa.Table.from_batches([batch]), how, known, total, count).to_batches()

    kinds = dict(bands.dtypes)
    schema = f"qseqid {kinds['q']}, sseqid {kinds['s']}, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, evalue double, bitscore double, score long"
    hits = rows.mapInArrow(run, schema).where(F.col("evalue") <= evalue)
    fields = [c for c in hits.columns if c not in ("qseqid", "sseqid")]
    best = F.max_by(F.struct(*fields), F.struct("score", (-F.col("qstart")).alias("a"), (-F.col("sstart")).alias("b")))
    return hits.groupBy("qseqid", "sseqid").agg(best.alias("x")).select("qseqid", "sseqid", *[F.col(f"x.{c}").alias(c) for c in fields])


def best_hits(hits: DataFrame, keep: int = 1) -> DataFrame:
    """The `keep` best subjects of each query, by e-value, then score, then the smaller id."""
    order = Window.partitionBy("qseqid").orderBy("evalue", F.col("score").desc(), "sseqid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
