"""Checked settings: edge lists, k-mer lengths, rates, bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges_of(text: str) -> list[float]:
    out = [float(x) for x in text.split(",") if x.strip()]
    if len(out) < 2 or any(b <= a for a, b in zip(out, out[1:], strict=False)):
        raise ValueError("edges need two values at least, in strictly ascending order")
    return out


def lengths_of(text: str) -> list[int]:
    out = sorted({int(x) for x in text.split(",") if x.strip()})
    if not out or out[0] < 1:
        raise ValueError("k-mer lengths are whole numbers from 1")
    return out


def rates_of(text: str) -> list[float]:
    out = [float(x) for x in text.split(",") if x.strip()]
    if any(not 0 < x < 1 for x in out):
        raise ValueError("rates lie between 0 and 1")
    return out


@dataclass(frozen=True)
class Bins:
    """Half-open bins [lower, upper): a value on the last edge is in none."""

    edges: tuple[float, ...]

    @property
    def rows(self) -> list[tuple[str, float, float, float]]:
        return [(f"{a:g}_to_{b:g}", a, b, (a + b) / 2) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def key(self, x: Column) -> Column:
        """The name of x's bin as one CASE expression; null outside all bins."""
        out = None
        for name, a, b, _ in self.rows:
            hit = (x >= a) & (x < b) & ~F.isnan(x)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out
