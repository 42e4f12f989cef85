"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering and run as Spark expressions.

Statistics are DataFrame functions only. The list is grown and pruned on the driver from a bounded sample of labelled
rows (sample_rows) and is emitted as one ordered CASE expression, so scoring is a single codegen-friendly projection.

Defined results: a null or blank text has no words (all statistics 0, base_failed, not kept). Repeated rows are judged
alike. Documents without labels are judged by the same list; an empty label table gives an empty list (only the base rules
act). Extra columns of the input pass through, whatever their names: keep_good adds none, judged one of a name that is free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbiome.llm.common import SPACE_CHARS, let, words_of

STAT = "__stats"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (*BASE, "n_distinct_words", "n_exclaims", "n_capital_words", "n_lines")


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Number of words inside windows of `width` words that are found twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Equal windows meet by sorting (hash, place); only texts with
    some equal windows pay for it.
    """
    hashes = F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, e: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        twice = let(placed, lambda s: F.filter(s, lambda e, k: ((k > 0) & same(s, F.greatest(k - 1, F.lit(0)), e)) | same(s, k + 1, e)))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        steps = let(starts, lambda p: F.transform(p, lambda v, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - v, F.lit(width)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def text_stats(text: Column) -> Column:
    """Struct of the statistics of a text: the base ones and those that the learned conditions also look at."""
    t = F.coalesce(text, F.lit(""))
    removed = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            removed("#*$%&|<>").cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            removed("!?").cast("long").alias("n_exclaims"),
            F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 1))).cast("long").alias("n_capital_words"),
            let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        ),
    )


#: Learned conditions are on these ratios of statistics.
FEATURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "exclaim_rate", "capital_rate", "mean_word")


def features(stats: Column) -> dict[str, Column]:
    rate = lambda a, b: F.when(stats[b] > 0, stats[a] / stats[b]).otherwise(F.lit(0.0))
    return {
        "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "distinct_rate": rate("n_distinct_words", "n_words"),
        "exclaim_rate": rate("n_exclaims", "n_words"),
        "capital_rate": rate("n_capital_words", "n_words"),
        "mean_word": rate("word_chars", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.threshold if self.above else column < self.threshold

    def column(self, by_name: dict[str, Column]) -> Column:
        return by_name[self.feature] > self.threshold if self.above else by_name[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.mask(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, max_conditions: int) -> Rule:
    """Adds the condition with the largest FOIL gain until no good row is covered or nothing gains."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < max_conditions and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, found = 1e-9, None
        for j, name in enumerate(FEATURES):
            order = np.argsort(x[inside, j], kind="stable")
            v, b = x[inside, j][order], bad[inside][order]
            edges = np.flatnonzero(v[1:] > v[:-1])  # a threshold lies midway between neighbours that differ
            if not len(edges):
                continue
            below = np.cumsum(b)[edges]
            for above in (False, True):
                p = p0 - below if above else below
                n = (len(v) - 1 - edges if above else edges + 1) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = float(gain[k]), Condition(name, above, float((v[edges[k]] + v[edges[k] + 1]) / 2))
        if found is None:
            break
        rule += (found,)
        inside &= found.mask(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops final conditions while (p - n) / (p + n) on the pruning rows doesn't fall."""

    def worth(r: Rule) -> float:
        c = _covers(r, x)
        p, n = (bad & c).sum(), (~bad & c).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k]), -k))
    return rule[:best]


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 3, least_precision: float = 0.97, least_rows: int = 5) -> list[Rule]:
    """Sequential covering: rules for rejection, each grown on two thirds of the rows left and pruned on the rest.

    A rule stays only if at least least_precision of the rows left that it covers are bad, so that good documents go
    through; covering ends at the first rule that fails this or covers under least_rows bad rows.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and bad[left].sum() >= least_rows:
        at = np.flatnonzero(left)
        grow, prune = at[np.arange(len(at)) % 3 < 2], at[np.arange(len(at)) % 3 == 2]
        rule = _grow(x[grow], bad[grow], max_conditions)
        if not rule:
            break
        if len(prune):
            rule = _prune(rule, x[prune], bad[prune])
        covered = _covers(rule, x) & left
        p = int((bad & covered).sum())
        if p < least_rows or p < least_precision * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> list[Rule]:
    """Learns the list from at most sample_rows labelled documents, taken in the order of a hash of doc_id.

    The labels of the sample (two numbers a row, at most sample_rows rows) are the only broadcast.
    """
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "__id")
    held = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    rows = held.select("doc_id", "quality", text_stats(F.col("text")).alias(STAT)).select("doc_id", "quality", *[c.alias(n) for n, c in features(F.col(STAT)).items()]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    x = np.array([[r[n] for n in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r["quality"] == 0 for r in rows], bool))


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The place (from 1) of the first rule that holds, 0 if none does: one ordered CASE expression."""
    by_name = features(stats)
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column(by_name)
        for c in rule[1:]:
            holds = holds & c.column(by_name)
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _verdicts(stats: Column, rules: list[Rule]) -> tuple[Column, Column, Column]:
    """base_failed, rule and kept, from statistics."""
    failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
    rule = verdict(rules, stats)
    return failed, rule, ~failed & (rule == 0)


def judged(docs: DataFrame, rules: list[Rule], name: str = STAT) -> DataFrame:
    """docs with a struct column `name` of the statistics, base_failed, rule and kept. docs must not have such a column."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name}: give another name")

    def facts(s: Column) -> Column:
        failed, rule, kept = _verdicts(s, rules)
        return F.struct(*[s[n].alias(n) for n in STATISTICS], failed.alias("base_failed"), rule.alias("rule"), kept.alias("kept"))

    return docs.withColumn(name, let(text_stats(F.col("text")), facts))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """The documents that the base rules and the learned list keep, with the columns of docs.

    The filter binds the statistics once; a filter on a column of them would have the optimizer put them in for each use.
    """
    rules = fit(docs, labels, sample_rows)
    return docs.where(let(text_stats(F.col("text")), lambda s: _verdicts(s, rules)[2]))
