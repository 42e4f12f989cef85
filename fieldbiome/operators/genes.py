"""Gene calling: open reading frames of six frames, scored by hexamers, and the best set of them by dynamic programming.

An open reading frame runs from the first start codon after a stop (or after the sequence's beginning) to the next stop of its
frame; frames that meet no stop, or no start, give none. Its score is the sum of log-odds of its hexamers in frame, one codon
apart, between known genes and chance. The called genes of a sequence are the set of the largest sum in which neighbours overlap
by at most `overlap` bases.

Sequences are (id, seq) with unique ids; null and short ones have no frames; codons with other letters than A, C, G, T are neither
start nor stop, and hexamers with such letters score nothing. Positions are 1-based and inclusive, on the forward strand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stop codons, and the start codon.
STOPS, START = ("TAA", "TAG", "TGA"), "ATG"
_LETTER = np.full(256, 4, np.int64)
for _k, _c in enumerate("ACGT"):
    _LETTER[[ord(_c), ord(_c.lower())]] = _k
_number = lambda s: sum(int(_LETTER[ord(c)]) * 4 ** (len(s) - 1 - i) for i, c in enumerate(s))


def _codons(letters: np.ndarray, width: int = 3) -> np.ndarray:
    """The number of the `width` letters from each place on; -1 where one is unknown."""
    n = len(letters) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(width):
        out = out * 4 + letters[j : j + n]
        bad |= letters[j : j + n] > 3
    return np.where(bad, -1, out)


def frames(letters: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(strand, first, last), 0-based on the forward strand, of the frames of `least` bases or more, stop included."""
    which, *found = _frames(letters, np.zeros(1, np.int64), least)
    return list(zip(*[c.tolist() for c in found], strict=True))


def _frames(letters: np.ndarray, starts_at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, strand, first, last) of the frames of many sequences at once: letters are all of theirs, one after another, and
    starts_at says where each begins. Places count from its beginning."""
    ends_at = np.append(starts_at[1:], len(letters))
    out: list[tuple[np.ndarray, ...]] = []
    for strand in (1, -1):
        # On the other strand sequences stand in reverse order, too.
        own = letters if strand == 1 else np.where(letters > 3, 4, 3 - letters)[::-1]
        begin, end = (starts_at, ends_at) if strand == 1 else ((len(letters) - ends_at)[::-1], (len(letters) - starts_at)[::-1])
        codon = _codons(own)
        stop_at, start_at = np.flatnonzero(_IS_STOP[codon]), np.flatnonzero(codon == _number(START))
        of = lambda at: np.searchsorted(begin, at, "right") - 1  # noqa: E731  the last of those that begin there: empty ones hold none
        kept = []
        for at in (stop_at, start_at):
            seq = of(at)
            inside = at + 3 <= end[seq]
            at, seq = at[inside], seq[inside]
            # A number for the sequence and frame that a codon stands in, then its place.
            group = seq * 3 + (at - begin[seq]) % 3
            order = np.lexsort((at, group))
            kept.append((at[order], seq[order], group[order]))
        (stop, seq, group), (start, _, start_group) = kept
        width = len(letters) + 1
        before = np.where(np.diff(group, prepend=-1) == 0, np.append(-1, stop[:-1]), -1)[: len(stop)] if len(stop) else stop
        k = np.searchsorted(start_group * width + start, group * width + before + 1)
        first = np.append(start, 0)[k]
        ok = (k < len(start)) & (np.append(start_group, -1)[k] == group) & (first < stop) & (stop + 3 - first >= least)
        a, b, seq = first[ok] - begin[seq[ok]], stop[ok] + 2 - begin[seq[ok]], seq[ok]
        if strand == -1:
            n = (end - begin)[seq]
            a, b, seq = n - 1 - b, n - 1 - a, len(starts_at) - 1 - seq
        out.append((seq, np.full(len(seq), strand, np.int64), a, b))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: By the number of a codon; the last stands for one with an unknown letter.
_IS_STOP = np.zeros(65, bool)
_IS_STOP[[_number(s) for s in STOPS]] = True

#: Letters that are searched for frames at a time; a longer sequence stands alone.
LETTERS = 2_000_000


def _pieces(seqs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first sequence, letters of all, where each begins) of pieces of a batch."""
    held: list[np.ndarray] = []
    first = size = 0
    for k, seq in enumerate(seqs.to_pylist()):
        held.append(_LETTER[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)])
        size += len(held[-1])
        if size >= LETTERS or k == len(seqs) - 1:
            yield first, np.concatenate(held), np.cumsum([0, *[len(x) for x in held[:-1]]])
            held, first, size = [], k + 1, 0


def open_frames(seqs: DataFrame, least: int = 90) -> DataFrame:
    """(id, strand, first, last) of all open reading frames."""
    kind = dict(seqs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, letters, starts_at in _pieces(batch.column("seq")):
                which, strand, first, last = _frames(letters, starts_at, least)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which + number)), *[pa.array(c, pa.int64()) for c in (strand, first + 1, last + 1)]], ["id", "strand", "first", "last"])

    return seqs.where("seq is not null").select("id", "seq").mapInArrow(run, f"id {kind}, strand long, first long, last long")


def hexamer_scores(genes: DataFrame, background: DataFrame, prior: float = 1.0) -> np.ndarray:
    """4,096 log-odds of hexamers in frame: in genes (seq from start to stop) against every place of background; counted in Spark."""

    def counts(df: DataFrame, step: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(4096, np.int64)
            for batch in batches:
                for _, letters, starts_at in _pieces(batch.column("seq")):
                    six = _codons(letters, 6)
                    at = np.arange(len(six))
                    of = np.searchsorted(starts_at, at, "right") - 1
                    inside = at + 6 <= np.append(starts_at[1:], len(letters))[of]
                    n += np.bincount(six[inside & (six >= 0) & ((at - starts_at[of]) % step == 0)], minlength=4096)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["m", "n"])

        out = np.full(4096, prior)
        for r in df.where("seq is not null").select("seq").mapInArrow(run, "m int, n long").groupBy("m").agg(F.sum("n").alias("n")).collect():  # 4,096 rows at most
            out[r["m"]] += r["n"]
        return out / out.sum()

    return np.log(counts(genes, 3) / counts(background, 1))


def frame_score(letters: np.ndarray, strand: int, first: int, last: int, scores: np.ndarray) -> float:
    own = letters[first : last + 1]
    own = own if strand == 1 else np.where(own > 3, 4, 3 - own)[::-1]
    six = _codons(own, 6)[::3]
    return float(scores[six[six >= 0]].sum())


def chosen(found: list[tuple[int, int, float]], overlap: int) -> list[int]:
    """The numbers of the frames (first, last, score) of the best set, in order of their ends: sums of scores are compared, and of
    equal ones the set that ends earlier stands. Neighbours by their ends overlap by `overlap` bases at most."""
    order = sorted(range(len(found)), key=lambda k: (found[k][1], found[k][0]))
    ends = [found[k][1] for k in order]
    best: list[tuple[float, int]] = []  # (largest sum of sets that end with one of the first frames, that frame)
    sums, before = [], []
    for i, k in enumerate(order):
        first, last, score = found[k]
        upto = int(np.searchsorted(ends[:i], first - 1 + overlap, "right"))
        # A frame within another one's overlap would stand before it: only sets that end earlier go on.
        top = best[upto - 1] if upto else (0.0, -1)
        gain, came = (top[0], top[1]) if top[0] > 0 else (0.0, -1)
        sums.append(score + gain)
        before.append(came)
        best.append((sums[i], i) if not best or sums[i] > best[-1][0] else best[-1])
    at, out = (best[-1][1] if best and best[-1][0] > 0 else -1), []
    while at >= 0:
        out.append(order[at])
        at = before[at]
    return out[::-1]


def called(seqs: DataFrame, scores: np.ndarray, least: int = 90, overlap: int = 30) -> DataFrame:
    """(id, strand, first, last, score) of the called genes of each sequence."""
    kind = dict(seqs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, letters, starts_at in _pieces(batch.column("seq")):
                which, strand, first, last = _frames(letters, starts_at, least)
                order = np.argsort(which, kind="stable")
                edges = np.searchsorted(which[order], np.arange(len(starts_at) + 1))
                rows = []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    own = letters[starts_at[k] : starts_at[k + 1] if k + 1 < len(starts_at) else len(letters)]
                    mine = order[edges[k] : edges[k + 1]]
                    found = [(a, b, frame_score(own, s, a, b, scores), s) for s, a, b in zip(*[c[mine].tolist() for c in (strand, first, last)], strict=True)]
                    rows += [(k + number, *found[i]) for i in chosen([f[:3] for f in found], overlap)]
                ids = batch.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
                cols = [[r[4] for r in rows], [r[1] + 1 for r in rows], [r[2] + 1 for r in rows]]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols], pa.array([r[3] for r in rows], pa.float64())], ["id", "strand", "first", "last", "score"])

    return seqs.where("seq is not null").select("id", "seq").mapInArrow(run, f"id {kind}, strand long, first long, last long, score double")


def strand_of(seqs: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (id, strand, first, last) with seq: the bases from start to stop."""
    whole = seqs.select(F.col("id").alias("of"), F.upper("seq").alias("whole"))
    part = F.substring("whole", F.col("first").cast("int"), (F.col("last") - F.col("first") + 1).cast("int"))
    return spans.join(whole, F.col("id") == F.col("of")).withColumn("seq", F.when(F.col("strand") == 1, part).otherwise(F.reverse(F.translate(part, "ACGT", "TGCA")))).drop("of", "whole")

