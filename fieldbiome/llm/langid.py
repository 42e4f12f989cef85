"""Language identification in two levels: the family first, then linear support vector machines between its languages.

Features are relative frequencies of a text's character 1- to 3-grams within words, hashed to DIM places. All decisions are
linear in them, so a word's contribution to every decision is worked out once and remembered; a text's decision is the sum over
its words. Families are decided one against the rest; languages of a family by one machine for each pair, whose votes count.

Defined results: null texts and texts without letters are 'und' with score 0. Without any training row every text is 'und'.
Repeated rows give equal rows. Labels, sources and ids are never inputs of a prediction. Extra columns aren't carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 4096
REMEMBERED = 200_000
# Families of languages by their codes. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_WORD = re.compile(r"[^\W\d_]+")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], f"={lang}")


def grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, owners): the place of each n-gram of each word, with marks at the word's ends, and the word's number."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join([f"<{w}>" for w in found]).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(w) + 2 for w in found])
    places, owners = [], []
    key = np.zeros(len(code), np.uint64)
    for n in (1, 2, 3):
        k = len(code) - n + 1
        key = key[:k] * np.uint64(0x100000001B3) + code[n - 1 :]
        inside = owner[:k] == owner[n - 1 :]
        mixed = (key[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        places.append((mixed >> np.uint64(40)).astype(np.int64) % DIM)
        owners.append(owner[:k][inside])
    return np.concatenate(places), np.concatenate(owners)


def words(text: str | None) -> Counter[str]:
    found = _WORD.findall((text or "").lower())
    return Counter(found) if any(any(c.isalpha() for c in w) for w in found) else Counter()


def vector(text: str | None) -> np.ndarray:
    found = words(text)
    places, owners = grams(list(found))
    out = np.bincount(places, np.fromiter(found.values(), np.float64, len(found))[owners], DIM).astype(np.float32)
    return out / max(out.sum(), 1.0)


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine: full-batch subgradient steps on the hinge loss, averaged.

    Both sides weigh alike, however many rows they have.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b, mean_w, mean_b = np.zeros(x.shape[1], x.dtype), 0.0, np.zeros(x.shape[1]), 0.0
    for k in range(steps):
        short = (y * (x @ w + b) < 1) * weight * y
        rate = 1.0 / (1 + 0.05 * k)
        w = (x.dtype.type(1 - penalty * rate) * w + x.dtype.type(rate) * (short.astype(x.dtype) @ x)).astype(x.dtype)  # no copy of x in another type
        b += rate * short.sum()
        if k >= steps // 2:
            mean_w += w
            mean_b += b
    n = steps - steps // 2
    return mean_w / n, mean_b / n


class Discriminator:
    """All linear decisions as one matrix: a row for each family against the rest, then one for each pair within a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.families = sorted({family_of(v) for v in langs})
        self.langs = {f: sorted({v for v in langs if family_of(v) == f}) for f in self.families}
        of = np.array([family_of(v) for v in langs])
        lang = np.array(langs)
        scale = (1.0 / (x.std(0) + 1e-4) / 8.0).astype(x.dtype)
        z = np.multiply(x, scale, out=x)  # x is the caller's to give: the sample is held once
        rows, offsets = [], []
        self.pairs: dict[str, list[tuple[str, str, int]]] = {}
        for f in self.families:
            w, b = _machine(z, np.where(of == f, 1.0, -1.0)) if len(self.families) > 1 else (np.zeros(DIM), 1.0)
            rows.append(w * scale)
            offsets.append(b)
        for f in self.families:
            self.pairs[f] = []
            for p, q in combinations(self.langs[f], 2):
                at = (lang == p) | (lang == q)
                w, b = _machine(z[at], np.where(lang[at] == p, 1.0, -1.0))
                self.pairs[f].append((p, q, len(rows)))
                rows.append(w * scale)
                offsets.append(b)
        self.weights, self.offsets = np.array(rows, np.float32), np.array(offsets)
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(rows) + 1))

    def _sums(self, found: Counter[str]) -> np.ndarray:
        """Sum of the words' rows (decisions, and the number of n-grams last)."""
        missing = [w for w in found if w not in self.place]
        if len(self.place) + len(missing) > REMEMBERED:
            self.place.clear()
            missing = list(found)
        if missing:
            first = len(self.place)
            while first + len(missing) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            places, owners = grams(missing)
            rows = self.table[first : first + len(missing)]
            for k, weights in enumerate(self.weights):
                rows[:, k] = np.bincount(owners, weights[places], len(missing))
            rows[:, -1] = np.bincount(owners, minlength=len(missing))
            self.place.update(zip(missing, range(first, first + len(missing)), strict=True))
        at = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        return np.fromiter(found.values(), np.float64, len(found)) @ self.table[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.families:
            return "und", 0.0
        sums = self._sums(found)
        margin = sums[:-1] / sums[-1] + self.offsets
        n = len(self.families)
        best = int(np.argmax(margin[:n]))
        p = np.exp(2 * (margin[:n] - margin[:n].max()))
        score = float(p[best] / p.sum())
        family = self.families[best]
        votes = dict.fromkeys(self.langs[family], 0.0)
        sure: dict[str, list[float]] = {v: [] for v in votes}
        for a, b, row in self.pairs[family]:
            s = float(1 / (1 + np.exp(-np.clip(2 * margin[row], -50, 50))))
            votes[a if s >= 0.5 else b] += 1
            sure[a].append(s)
            sure[b].append(1 - s)
        mean = {v: sum(x) / len(x) if x else 1.0 for v, x in sure.items()}
        lang = max(votes, key=lambda v: (votes[v], mean[v]))
        return lang, min(1.0, max(0.0, score * mean[lang]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = 4000) -> Discriminator:
    """Learns from at most sample_rows rows that aren't held out, taken by a hash of doc_id; vectors are made by the workers."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    # The ids come first, so that no text is sorted; at most sample_rows of them are broadcast.
    picked = rows.select(F.col("doc_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    rows = rows.select("doc_id", "text", "lang").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                v = [vector(t).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang"), pa.array(v, pa.binary())], ["doc_id", "lang", "v"])

    got = rows.mapInArrow(run, "doc_id long, lang string, v binary").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "v").limit(sample_rows).collect()
    langs = [r["lang"] for r in got]
    x = np.zeros((len(got), DIM), np.float32)
    for k, r in enumerate(got):
        x[k] = np.frombuffer(r["v"], "<f4")
    del got
    some = np.flatnonzero(x.sum(1) > 0)
    return Discriminator(x if len(some) == len(x) else x[some], [langs[k] for k in some])


def identify(docs: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    d = fit(docs, sample_rows)
    names = ["doc_id", "held_out", "lang_pred", "score"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                got = [d.predict(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)
