"""What the operators share: word patterns, let-bindings, free column names, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbiome.functions.scratch import cut, new_path, release
from fieldbiome.operators.graph import connected

__all__ = ["SPACE_CHARS", "SPACE_RUN", "components", "cut", "free_name", "let", "new_path", "release", "words_of"]

#: The ASCII white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body (or a lambda in it) refers to it.

    A lambda that refers to a long expression would evaluate it anew for each element; binding it as a lambda variable
    keeps such expressions linear without a second Project that the optimizer may collapse.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; empty for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, such that df has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node of an edge; component: its least node.

    Labels and edges are cut to the shared folder every round. An empty edge table gives an empty result. Null ends are
    dropped, self-loops and repeated edges change nothing.
    """
    found = connected(edges.where("a is not null and b is not null"), lambda df: cut(df, "labels"))
    return found.withColumnRenamed("root", "component")
