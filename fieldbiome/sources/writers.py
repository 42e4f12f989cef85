"""Writers: delimited files, wide matrices, FASTA, reports and keyed metric tables. Numbers become text here and only here."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbiome.functions.coerce import fixed
from fieldbiome.functions.scratch import write_bytes
from fieldbiome.functions.text import wrapped_fasta
from fieldbiome.operators.abundance import wide_matrix
from fieldbiome.operators.selection import upsert


def formatted(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """df with numbers as text of fixed decimals (half to even, NA for null)."""
    return df.select(*[fixed(F.col(c), places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def csv(df: DataFrame, path: str, places: dict[str, int] | None = None, order: list[str] | None = None, single: bool = False) -> None:
    """Writes the rows as part files, each with a header; with an order, parts are ranges of it, and follow each other by name.

    single: one file, by one task, for results that are small by nature.
    """
    out = formatted(df, places or {})
    out = out.orderBy(*order) if order else out
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


def _args(counts: DataFrame, most_columns: int) -> list[str]:
    args = [r[0] for r in counts.select("arg_id").distinct().orderBy("arg_id").limit(most_columns + 1).collect()]
    if len(args) > most_columns:
        raise ValueError(f"over {most_columns} columns: keep the long form")
    return args


def matrix(counts: DataFrame, path: str, most_columns: int = 10_000) -> None:
    """The wide form of (sample_id, arg_id, n): Sample and the sorted args, missing as 0, rows in the order of samples, in parts."""
    csv(wide_matrix(counts, _args(counts, most_columns)).withColumnRenamed("sample_id", "Sample"), path, order=["Sample"])


def normalised_wide(normalised: DataFrame, args: list[str], places: int = 10) -> DataFrame:
    """The wide form of (sample_id, arg_id, normalised) as text of fixed decimals, missing as 0."""
    wide = normalised.groupBy("sample_id").pivot("arg_id", sorted(args)).agg(F.sum("normalised"))
    return wide.select("sample_id", *[fixed(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), places).alias(c) for c in sorted(args)])


def normalised_matrix(normalised: DataFrame, path: str, most_columns: int = 10_000) -> None:
    """The wide normalised matrix: sample_id and the sorted args, ten decimals, rows in the order of samples, in parts."""
    csv(normalised_wide(normalised, _args(normalised, most_columns)), path, order=["sample_id"])


def fasta(df: DataFrame, path: str, seq_id: str = "seq_id", seq: str = "seq", width: int = 80) -> None:
    df.select(wrapped_fasta(F.col(seq_id), F.col(seq), width)).write.mode("overwrite").text(path)


def key_values(df: DataFrame, path: str) -> None:
    """A one-row table as (metric, value) rows."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in df.columns])
    csv(text.unpivot([], text.columns, "metric", "value"), path, single=True)


def report(checks: DataFrame, path: str) -> None:
    """PASS and FAIL lines of (check, value, result)."""
    checks.select(F.concat_ws(" ", "result", "check", F.col("value").cast("string"))).coalesce(1).write.mode("overwrite").text(path)


def notes(df: DataFrame, lines: list[str], path: str) -> None:
    df.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def upserted_metrics(old: DataFrame, rows: DataFrame, path: str, key: str = "method") -> None:
    """Writes old with rows put in by key, in the order of old's rows, new ones after them. path is another one than that of old."""
    order = "__order"
    numbered = lambda df: df.withColumn(order, F.monotonically_increasing_id())  # noqa: E731  order of a small file's lines
    both = upsert(numbered(old), numbered(rows), key, order).coalesce(1).sortWithinPartitions(order).drop(order)
    csv(both, path, single=True)


def empty_notice(df: DataFrame, path: str, message: str = "no rows: nothing to show") -> bool:
    """Whether df is empty; then a text with the message is written in place of what would be shown."""
    if df.limit(1).count():
        return False
    df.sparkSession.createDataFrame([(message,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return True


def grouped_bars(table: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """(group, measure, place, value): the bars of a grouped chart, in the order of measures; what is no number has no bar."""
    named = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(m).alias("measure"), F.col(m).cast("string").try_cast("double").alias("value")) for k, m in enumerate(measures)])
    return table.select(group, F.inline(named)).where("value is not null").select(group, "measure", "place", "value")


def series(table: DataFrame, x: str, lines: list[str]) -> DataFrame:
    """(line, x, value): one series for each of the columns `lines` over x; gaps stay out."""
    named = F.array(*[F.struct(F.lit(c).alias("line"), F.col(c).cast("double").alias("value")) for c in lines])
    return table.select(F.col(x).alias("x"), F.inline(named)).where("value is not null").select("line", "x", "value")


def model_summary(fit: dict[str, object], title: str, extras: dict[str, float] | None = None) -> str:
    """A fit of operators.linear as text; extras: of linear.summary_extras."""
    lines = [title, "=" * 78, f"No. Observations: {fit['n']}  Df Residuals: {fit['df']}  R-squared: {fit['r2']:.3f}  Adj. R-squared: {fit['adj_r2']:.3f}", f"F-statistic: {fit['f']:.4g}  Log-Likelihood: {fit['loglik']:.5g}  AIC: {fit['aic']:.4g}  BIC: {fit['bic']:.4g}", "-" * 78, f"{'term':<28}{'coef':>12}{'std err':>12}{'t':>9}{'P>|t|':>8}"]
    for i, name in enumerate(fit["names"]):
        lines.append(f"{name:<28}{fit['coef'][i]:>12.4g}{fit['se'][i]:>12.4g}{fit['t'][i]:>9.3f}{fit['p'][i]:>8.3f}")
    if extras:
        lines += ["-" * 78, f"Omnibus: {extras['omnibus']:.3f}  Prob(Omnibus): {extras['omnibus_p']:.3f}  Skew: {extras['skew']:.3f}  Kurtosis: {extras['kurtosis']:.3f}", f"Durbin-Watson: {extras['durbin_watson']:.3f}  Jarque-Bera: {extras['jarque_bera']:.3f}  Prob(JB): {extras['jb_p']:.3f}  Cond. No.: {extras['condition']:.3g}"]
    return "\n".join(lines)


def npy(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """(row_index, embedding) as one .npy matrix of 32-bit floats, rows in the order of row_index. The file is one array by its
    format, so it is made on the driver, for most_rows rows at most; larger ones stay in Parquet (npy_table)."""
    rows = df.select("row_index", F.col("embedding").cast("array<float>").alias("embedding")).orderBy("row_index").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"over {most_rows} rows: write a table (npy_table)")
    out = io.BytesIO()
    np.save(out, np.array([r["embedding"] for r in rows], np.float32))
    write_bytes(df.sparkSession, path, out.getvalue())


def npy_table(df: DataFrame, path: str) -> None:
    """Vectors of any number as Parquet (row_index, embedding)."""
    df.select("row_index", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)
