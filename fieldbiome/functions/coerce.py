"""Column functions that turn text into numbers and numbers into text, each with its own policy for what can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = {"K": 1e3, "M": 1e6, "B": 1e9}


def blank_to_null(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t != "", t)


def first_non_blank(*columns: Column, default: str = "") -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(default))


def key_or_na(x: Column) -> Column:
    """Null and blank keys become 'NA'."""
    return F.coalesce(blank_to_null(x), F.lit("NA"))


def float_or_null(x: Column) -> Column:
    t = F.regexp_replace(F.trim(x), r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(~t.rlike("[dDfF]$") | F.lower(t).isin("inf", "-inf", "+inf"), t.try_cast("double"))


def float_or_zero(x: Column) -> Column:
    return F.coalesce(float_or_null(x), F.lit(0.0))


def count_or_null(x: Column) -> Column:
    """'564K', '3M', '2.5B' or digits as a whole number, half to even; null for anything else."""
    t = F.upper(F.trim(x))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([KMB])$", 1)
    unit = F.regexp_extract(t, r"([KMB])$", 1)
    scale = F.lit(1.0)
    for name, value in _SCALE.items():
        scale = F.when(unit == name, F.lit(value)).otherwise(scale)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint")).when(number != "", F.bround(number.try_cast("double") * scale).cast("bigint"))


def count_or_zero(x: Column) -> Column:
    return F.coalesce(count_or_null(x), F.lit(0).cast("bigint"))


def short_count(x: Column) -> Column:
    """Digits as '3M', '564K' or themselves, half to even; 'NA' for anything else."""
    n = F.when(F.trim(x).rlike("^[0-9]+$"), F.trim(x).try_cast("double"))
    text = lambda scale, unit: F.concat(F.bround(n / scale).cast("bigint").cast("string"), F.lit(unit))
    return F.when(n.isNull(), "NA").when(n >= 1e6, text(1e6, "M")).when(n >= 1e3, text(1e3, "K")).otherwise(n.cast("bigint").cast("string"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def fixed(x: Column, places: int = 6) -> Column:
    """A number with fixed decimals, half to even; 'NA' for null."""
    return F.coalesce(F.regexp_replace(F.format_number(x, places), ",", ""), F.lit("NA"))


def pass_fail(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")


def require_numbers(df: DataFrame, columns: list[str], shown: int = 5) -> DataFrame:
    """df with columns as doubles; raises with the first rows that hold something else."""
    typed = df.select(*[F.col(c).try_cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])
    bad = typed.where(" or ".join(f"`{c}` is null" for c in columns)).limit(shown).collect()
    if bad:
        raise ValueError(f"columns {columns} hold values that are no numbers: {bad}")
    return typed


def not_negative(x: Column, name: str) -> Column:
    """x, or an error at run time where it is negative."""
    return F.when(x < 0, F.raise_error(F.lit(f"{name} is negative")).cast("double")).otherwise(x)


def md5_draw(*values: Column) -> Column:
    """A hash of 60 bits that any engine can state: the first 15 hexadecimal digits of the MD5 of the values' text, joined by |."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[v.cast("string") for v in values])), 1, 15), 16, 10).cast("long")
