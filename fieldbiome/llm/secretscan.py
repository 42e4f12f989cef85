"""Secret scans: exact patterns, plus tokens that a battery of randomness tests finds, at a controlled rate of false discoveries.

A candidate is a run of letters, digits and the signs of base64, of 16 characters or more, that no exact match overlaps. Its
encoding is the smallest alphabet that holds its characters. The battery tests uniformity over the alphabet and over its classes
of characters (chi-squared), runs above and below the alphabet's middle, and serial correlation of neighbours; each as a z value
for a random string of this length and alphabet. Their sum of squares (of the excess only, for chi-squared) is the candidate's score.

A short token of ordinary text can look random by chance, a long one can't. So for each encoding and class of length, scores of
ordinary names are simulated: words from the letter pairs of all documents, joined as names are (camelCase, snake_case, with
digits, and so on; texts as hexadecimal digits for that encoding). A candidate's z is how far its score's logarithm lies below
theirs. In each class of length, Benjamini and Hochberg's rule over the z values of all candidates of all documents sets the
threshold, for a rate of Q; a candidate must also pass the battery as random strings of its kind do, but for one in a hundred.

Strings of digits alone are no candidates: they show no encoding. Defined results: null and empty texts have no spans; repeated
rows give the same rows, and count as often; empty tables give an empty result. Very long tokens are one candidate each. Base spans
stay as they are. Extra columns aren't carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbiome.llm.common import cut

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{16,}")
#: Rate of false discoveries, and share of random strings that the battery may reject.
Q, ALPHA = 0.01, 0.01
#: Classes of length, by their least length.
LENGTHS = (16, 17, 18, 19, 20, 22, 24, 28, 32, 40, 48, 64, 96, 128)
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, the smallest alphabet first; in each, its classes of characters.
ENCODINGS: dict[str, tuple[str, ...]] = {
    "hex": (DIGITS, "abcdef"),
    "HEX": (DIGITS, "ABCDEF"),
    "base32": ("234567", UPPER),
    "base36": (DIGITS, LOWER),
    "BASE36": (DIGITS, UPPER),
    "base62": (DIGITS, UPPER, LOWER),
    "base64": ("+/", DIGITS, UPPER, LOWER),
    "base64url": ("-", DIGITS, UPPER, "_", LOWER),
}
NAMES = list(ENCODINGS)
#: Tokens whose characters are held as one matrix at a time; longer ones go by themselves.
CELLS = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns: leftmost non-overlapping per kind, failing matches dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24])


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By encoding: each byte's place in the alphabet (-1: none), its class, the alphabet's size, and each class's share."""
    place, group = np.full((len(NAMES), 128), -1, np.int16), np.zeros((len(NAMES), 128), np.int16)
    size, share = np.zeros(len(NAMES), np.int64), np.zeros((len(NAMES), 5))
    for e, classes in enumerate(ENCODINGS.values()):
        letters = "".join(classes)
        size[e] = len(letters)
        place[e, [ord(c) for c in letters]] = np.arange(len(letters))
        for k, some in enumerate(classes):
            group[e, [ord(c) for c in some]] = k
            share[e, k] = len(some) / len(letters)
    return place, group, size, share


PLACE, GROUP, SIZE, SHARE = _tables()


def encoding_of(tokens: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The number of each token's encoding (-1: none, or digits alone); tokens: a matrix of bytes, there: which cells count."""
    held = np.zeros((len(tokens), 128), bool)  # by token, which bytes it has
    held[np.broadcast_to(np.arange(len(tokens))[:, None], tokens.shape)[there], tokens[there]] = True
    fits = ~(held[:, None] & (PLACE < 0)[None]).any(2)
    out = np.where(fits.any(1), fits.argmax(1), -1)
    return np.where(held[:, [c for c in range(128) if not 48 <= c <= 57]].any(1), out, -1)


def battery(tokens: np.ndarray, there: np.ndarray, encoding: np.ndarray) -> np.ndarray:
    """(tokens, 4): z values of uniformity over symbols and over classes, of runs, and of serial correlation."""
    n = there.sum(1).astype(float)
    size = SIZE[encoding].astype(float)
    place, group = PLACE[encoding[:, None], tokens], GROUP[encoding[:, None], tokens]
    row = np.broadcast_to(np.arange(len(tokens))[:, None], tokens.shape)[there]
    seen = np.zeros((len(tokens), 64))
    np.add.at(seen, (row, place[there]), 1)
    chi = size / n * (seen**2).sum(1) - n
    symbols = (chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n)
    kinds = np.zeros((len(tokens), 5))
    np.add.at(kinds, (row, group[there]), 1)
    share = SHARE[encoding]
    expected = n[:, None] * share
    with np.errstate(invalid="ignore", divide="ignore"):
        chi = np.where(share > 0, (kinds - expected) ** 2 / expected, 0).sum(1)
        spread = np.where(share > 0, 1 / share, 0).sum(1)
    free = (share > 0).sum(1) - 1.0
    classes = (chi - free) / np.sqrt(2 * free + (spread - free**2 - 4 * free - 1) / n)
    high = place >= (size / 2)[:, None]
    pairs = there[:, 1:]  # tokens start at the first cell, so a pair ends where a cell is
    up = (high & there).sum(1).astype(float)
    down = n - up
    runs = 1 + ((high[:, 1:] != high[:, :-1]) & pairs).sum(1)
    mean = 1 + 2 * up * down / n
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    flat = (up == 0) | (down == 0)  # one run only: as far out as a token of this length can be
    turns = np.where(flat, -np.sqrt(n), (runs - mean) / np.sqrt(np.where(flat, 1, var)))
    mid = np.where(there, place - (np.where(there, place, 0).sum(1) / n)[:, None], 0)
    power = np.maximum((mid**2).sum(1), 1e-9)
    serial = ((mid[:, 1:] * mid[:, :-1] * pairs).sum(1) / power + 1 / n) * np.sqrt(n)
    return np.column_stack([symbols, classes, turns, serial])


def score(z: np.ndarray) -> np.ndarray:
    return np.log1p((np.maximum(z[:, :2], 0) ** 2).sum(1) + (z[:, 2:] ** 2).sum(1))


def as_matrix(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in tokens])
    there = np.arange(n.max())[None] < n[:, None]
    out = np.zeros(there.shape, np.uint8)
    out[there] = np.frombuffer(b"".join(tokens), np.uint8)
    return out, there


def judged(tokens: list[bytes]) -> list[tuple[int, int, float]]:
    """(encoding, class of length, score) of each token; encoding -1 where it is no candidate."""
    out: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * len(tokens)
    order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
    while order:
        few = max(1, CELLS // (64 + len(tokens[order[-1]])))
        some, order = order[-few:], order[:-few]
        cells, there = as_matrix([tokens[i] for i in some])
        e = encoding_of(cells, there)
        k = np.searchsorted(LENGTHS, there.sum(1), "right") - 1
        good = np.flatnonzero(e >= 0)
        if len(good):
            s = score(battery(cells[good], there[good], e[good]))
            for i, x in zip(good.tolist(), s.tolist(), strict=True):
                out[some[i]] = (int(e[i]), int(k[i]), x)
    return out


def letter_pairs(text: str) -> np.ndarray:
    """Counts of neighbours among a to z and all else (0), in lower case, of the ASCII letters of a text."""
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8) | 32
    code = np.where((raw >= 97) & (raw <= 122), raw - 96, 0).astype(np.int64)
    return np.bincount(code[:-1] * 27 + code[1:], minlength=729) if len(code) > 1 else np.zeros(729, np.int64)


class Reference:
    """Scores of ordinary names and of random strings, by encoding and class of length: median of ordinary ones and their spread below
    it, and the score that ALPHA of the random ones exceed."""

    CHAINS, RANDOM, FEW = 3000, 1000, 40

    def __init__(self, pairs: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        flow = pairs.reshape(27, 27).astype(float) + 1e-3
        flow[0, 0] = 0  # no empty words
        steps = np.cumsum(flow / flow.sum(1, keepdims=True), 1)
        state, walk = np.zeros(self.CHAINS, np.int64), []
        for _ in range(2 * LENGTHS[-1]):
            state = np.minimum((steps[state] < rng.random(self.CHAINS)[:, None]).sum(1), 26)
            walk.append(state)
        names = [self._named(w, i % 9, rng) for i, w in enumerate(np.array(walk).T.tolist())]
        shape = (len(NAMES), len(LENGTHS))
        self.middle, self.spread, self.most = np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape)
        for k, n in enumerate(LENGTHS):
            some = [x[:n] for x in names if len(x) >= n]
            got: list[list[float]] = [[] for _ in NAMES]
            for e, _, s in judged(some):
                if e >= 0:
                    got[e].append(s)
            for e, scores in enumerate(got):
                if len(scores) >= self.FEW:
                    mid = np.median(scores)  # the spread below it: what lies above doesn't matter
                    low = np.array([x for x in scores if x <= mid])
                    self.middle[e, k], self.spread[e, k] = mid, max(np.sqrt(((low - mid) ** 2).mean()), 0.15)
            for e in range(len(NAMES)):
                letters = np.frombuffer("".join(ENCODINGS[NAMES[e]]).encode(), np.uint8)
                cells = letters[rng.integers(len(letters), size=(self.RANDOM, n))].astype(np.int64)
                s = score(battery(cells, np.ones(cells.shape, bool), np.full(self.RANDOM, e)))
                self.most[e, k] = np.quantile(s, 1 - ALPHA)
        for e in range(len(NAMES)):  # kinds of names that ordinary ones give too seldom: as their shorter ones, or as those of base36
            for k in range(len(LENGTHS)):
                if np.isnan(self.middle[e, k]):
                    like = (e, k - 1) if k and not np.isnan(self.middle[e, k - 1]) else (NAMES.index("base36"), k)
                    self.middle[e, k], self.spread[e, k] = self.middle[like], self.spread[like]
        self.middle, self.spread = np.nan_to_num(self.middle, nan=3.0), np.nan_to_num(self.spread, nan=1.0)

    @staticmethod
    def _named(walk: list[int], style: int, rng: np.random.Generator) -> bytes:
        """A name of a chain of letters (0 ends a word): joined, camel, snake, kebab, a path, upper case, with digits, hexadecimal."""
        words = [w for w in "".join(chr(96 + c) if c else " " for c in walk).split()]
        digits = lambda: str(int(rng.integers(10 ** int(rng.integers(1, 5)))))
        if style == 8:
            raw = " ".join(words).encode()
            return (raw.hex() if rng.random() < 0.5 else raw.hex().upper()).encode()
        if style in (6, 7):
            words = [w + digits() if rng.random() < 0.15 else w for w in words]
        if style in (1, 7):
            words = [w.capitalize() for w in words]
        out = {2: "_", 3: "-", 4: "/"}.get(style, "").join(words)
        if style == 5:
            out = "".join(w + (digits() if rng.random() < 0.15 else "") for w in words).upper()
        return out.encode()


def tail(z: float) -> float:
    """The chance that an ordinary name's z is this low or lower."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


#: Steps of z in the counts that thresholds come from, and the farthest that is told apart.
STEP, FAR = 0.05, 30.0


def thresholds(counts: dict[tuple[int, int], int], q: float = Q) -> list[float]:
    """For each class of length the largest z that counts as found; counts: candidates by (class, step of z)."""
    out = []
    for k in range(len(LENGTHS)):
        mine = sorted((b, n) for (c, b), n in counts.items() if c == k)
        total, below, found = sum(n for _, n in mine), 0, -math.inf
        for b, n in mine:
            below += n
            top = (b + 1) * STEP
            if tail(top) * total <= q * below:
                found = top
        out.append(found)
    return out


def _table(values: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in values])


def scan(docs: DataFrame, q: float = Q) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex of the base spans, base_sha256, spans (all), n_added."""
    schema = "doc_id long, base array<struct<start:int,kind:int,end:int>>, cands array<struct<start:int,end:int,enc:int,cls:int,score:double>>, pairs array<long>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("enc", pa.int32()), ("cls", pa.int32()), ("score", pa.float64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("base", span), ("cands", cand), ("pairs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(729, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                bases, places, tokens = [], [], []
                for i, text in enumerate(t or "" for t in batch.column("text").to_pylist()):
                    pairs += letter_pairs(text)
                    base = base_spans(text)
                    bases.append([dict(start=a, kind=k, end=b) for a, k, b in base])
                    for m in CANDIDATE.finditer(text):
                        if not any(a < m.end() and b > m.start() for a, _, b in base):
                            places.append((i, m.start(), m.end()))
                            tokens.append(m[0].encode())
                found: list[list[dict]] = [[] for _ in bases]
                for (i, a, b), (e, k, s) in zip(places, judged(tokens) if tokens else [], strict=True):
                    if e >= 0:
                        found[i].append(dict(start=a, end=b, enc=e, cls=k, score=s))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, span), pa.array(found, cand), pa.nulls(len(bases), pa.list_(pa.int64()))], schema=arrow)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, span), pa.nulls(1, cand), pa.array([pairs.tolist()], pa.list_(pa.int64()))], schema=arrow)

    seen = cut(docs.select("doc_id", "text").mapInArrow(run, schema), "secrets")
    counted = seen.where("pairs is not null").select(F.posexplode("pairs").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # 729 numbers
    pairs = np.zeros(729, np.int64)
    for r in counted:
        pairs[r["i"]] = r["n"]
    known = Reference(pairs)
    rows = seen.where("pairs is null")
    of = lambda values, c: F.get(F.get(_table(values), c["enc"]), c["cls"])
    z = lambda c: F.greatest(F.least((c["score"] - of(known.middle, c)) / of(known.spread, c), F.lit(FAR)), F.lit(-FAR))
    valued = rows.withColumn("cands", F.transform("cands", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["cls"].alias("cls"), z(c).alias("z"), (c["score"] <= of(known.most, c)).alias("passes"))))
    each = valued.select(F.explode("cands").alias("c")).groupBy(F.col("c.cls").alias("cls"), F.floor(F.col("c.z") / STEP).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()  # classes x steps of z at most
    limits = F.array(*[F.lit(x) for x in thresholds({(r["cls"], r["b"]): r["n"] for r in each}, q)])
    good = F.filter("cands", lambda c: c["passes"] & (c["z"] < F.get(limits, c["cls"])))
    added = F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return valued.withColumn("added", added).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
