"""Readers of the file formats that the analyses take: delimited text, hit tables, FASTA, archives, matrices, sheets, lists."""

from __future__ import annotations

import csv
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", required: list[str] | None = None) -> DataFrame:
    """A delimited file with a header, all columns as strings; quotes as RFC 4180 has them; a byte-order mark is dropped."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    df = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path) if columns else reader.option("inferSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing in {path}")
    return df


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A file with a header and inferred types; NA, nan and blanks are null."""
    df = spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").option("nanValue", "nan").csv(path)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def first_column(spark: SparkSession, path: str) -> DataFrame:
    df = csv_strings(spark, path)
    return df.select(df.columns[0])


def listed(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; carriage returns and blank lines go."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r", "")).alias("id")).where("id <> ''")


def sample_hits(spark: SparkSession, paths: str) -> DataFrame:
    """(sample_id, arg_id) of hit files <sample>/<file>.tsv without headers.

    Lines are trimmed before they are split, so a leading tab shifts columns; lines of one field are skipped. Of files in
    folders of one name, the last by path stands.
    """
    parent = F.element_at(F.split("path", "/"), -2)
    lines = spark.read.text(paths).select(_plain_path(F.col("_metadata.file_path")).alias("path"), F.split(F.trim(F.regexp_replace("value", r"^[\s]+|[\s]+$", "")), "\t").alias("f"))
    last = sample_files(spark, paths).select(F.col("path").alias("p"))
    return lines.join(last, F.col("path") == F.col("p"), "left_semi").where(F.size("f") >= 2).select(parent.alias("sample_id"), F.col("f")[1].alias("arg_id"))


def _plain_path(path: F.Column) -> F.Column:
    """Local paths are written file:/x or file:///x: one form for joins."""
    return F.regexp_replace(path, "^file:/+", "/")


def sample_files(spark: SparkSession, paths: str) -> DataFrame:
    """(sample_id, path): the file that counts for each sample, empty files too, so that they give samples of zeros.

    Spark's readers skip empty files, so the paths come from the file system's own listing.
    """
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths)
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    files = spark.createDataFrame([(f.getPath().toUri().toString(),) for f in found], "path string")
    files = files.select(_plain_path(F.col("path")).alias("path"))
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("sample_id")).agg(F.max("path").alias("path"))


def blast_hits(spark: SparkSession, path: str, columns: tuple[str, ...] = ("qseqid", "sseqid", "pident"), strict: bool = False) -> DataFrame:
    """Positional hit columns, as numbers where a name is one of the numeric ones. Further fields are ignored; strict: a line with
    another number of fields raises when it is read. Without strict, lines with fewer fields are skipped."""
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    numeric = {"pident", "bitscore", "evalue", "length", "qcov"}
    rows = spark.read.text(path).where(F.trim("value") != "").select(fields.alias("f"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit(f"a hit line has not {len(columns)} fields: "), F.array_join("f", " ")))
        rows = rows.select(F.when(F.size("f") == len(columns), F.col("f")).otherwise(F.split(wrong.cast("string"), "\t")).alias("f"))
    else:
        rows = rows.where(F.size("f") >= len(columns))
    return rows.select(*[F.col("f")[k].try_cast("double").alias(c) if c in numeric else F.col("f")[k].alias(c) for k, c in enumerate(columns)])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, seq, file, ord) of FASTA records; duplicates stay, ord orders the records of a file.

    Files are read by byte ranges, cut at record marks, so tasks share a large file; ord is the range's first byte and the
    record's number within the task that reads it. A file begins with a record; blank text before it is dropped.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("ord"), F.regexp_replace("value", "\r", "").alias("r"))
    return _records(raw.where(F.trim(F.regexp_replace("r", "\n", "")) != "").withColumn("r", F.regexp_replace("r", r"^\n*>", "")), ["file", "ord"])


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, seq) of FASTA records, split at record marks: large files are shared by tasks, order isn't kept."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("r"))
    return _records(raw, [])


def _records(parts: DataFrame, keep: list[str]) -> DataFrame:
    header = F.trim(F.substring_index("r", "\n", 1))
    at = F.locate("\n", F.col("r"))
    body = F.when(at > 0, F.regexp_replace(F.substr(F.col("r"), at), "[\\s]+", "")).otherwise("")
    named = parts.select(*keep, header.alias("header"), body.alias("seq"))
    bad = F.when(F.col("header") == "", F.raise_error(F.lit("a FASTA record has no id")).cast("string"))
    return named.select(F.coalesce(bad, F.regexp_extract("header", r"^(\S+)", 1)).alias("seq_id"), "header", "seq", *keep)


def last_of_id(records: DataFrame) -> DataFrame:
    """(seq_id, seq): the last record of each id."""
    return records.groupBy("seq_id").agg(F.max_by("seq", F.struct("file", "ord")).alias("seq"))


def _per_file(spark: SparkSession, path: str, schema: str, read: object) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield from read(name, bytes(content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def tar_members(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(archive, member, text) of named members of tar archives (bz2, gz, xz or plain)."""

    def read(archive: str, content: bytes) -> Iterator[pd.DataFrame]:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
            for m in tar:
                if m.isfile() and posixpath.basename(m.name) in names:
                    yield pd.DataFrame([(archive, m.name, tar.extractfile(m).read().decode("utf-8", "ignore"))], columns=["archive", "member", "text"])

    return _per_file(spark, path, "archive string, member string, text string", read)


def npy_rows(spark: SparkSession, path: str, rows_at_once: int = 10_000) -> DataFrame:
    """(row_index, embedding) of a two-dimensional .npy matrix: the place of a row is its identity."""

    def read(_: str, content: bytes) -> Iterator[pd.DataFrame]:
        x = np.load(io.BytesIO(content), allow_pickle=False)
        for at in range(0, len(x), rows_at_once):
            part = x[at : at + rows_at_once].astype(np.float32)
            yield pd.DataFrame({"row_index": np.arange(at, at + len(part)), "embedding": list(part)})

    return _per_file(spark, path, "row_index long, embedding array<float>", read)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes, sheet: str) -> Iterator[list[str]]:
    """The rows of a sheet of an .xlsx workbook, cells in the order in which they are stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        ids = {s.get("name"): s.get(_REL) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet not in ids:
            raise ValueError(f"the workbook has no sheet {sheet}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[ids[sheet]].lstrip("/")
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
            cells = []
            for c in row.iter(f"{_MAIN}c"):
                v = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
                elif v is None or v.text is None:
                    cells.append("")
                else:
                    cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
            yield cells


def xlsx_table(spark: SparkSession, path: str, sheet: str, header: list[str]) -> DataFrame:
    """The rows under the row that starts with `header`, where no cell of these columns is blank; columns as strings."""

    def read(_: str, content: bytes) -> Iterator[pd.DataFrame]:
        seen, out = False, []
        for cells in sheet_rows(content, sheet):
            if not seen:
                seen = [c.strip() for c in cells[: len(header)]] == header
            elif len(cells) >= len(header) and all(c.strip() for c in cells[: len(header)]):
                out.append([c.strip() for c in cells[: len(header)]])
        yield pd.DataFrame(out, columns=range(len(header)), dtype=object)

    names = [f"c{k}" for k in range(len(header))]
    return _per_file(spark, path, ", ".join(f"{n} string" for n in names), lambda p, c: (d.set_axis(names, axis=1) for d in read(p, c))).toDF(*header)


def sample_attributes(df: DataFrame, xml: str) -> DataFrame:
    """df with attributes: a map of lower-cased attribute names to their first value that isn't blank."""
    names = F.call_function("xpath", F.col(xml), F.lit("//Attribute[normalize-space(.)!='']/@attribute_name"))
    values = F.call_function("xpath", F.col(xml), F.lit("//Attribute[normalize-space(.)!='']/text()"))
    pairs = F.arrays_zip(F.transform(names, F.lower).alias("k"), F.transform(values, lambda v: F.trim(v)).alias("v"))
    first = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    return df.withColumn("attributes", first)


def runinfo(df: DataFrame, text: str) -> DataFrame:
    """Rows of run tables held as CSV text in a column: (run, fields as a map). Quoted fields may hold commas, quotes and line ends;
    blank lines go; fields that a line lacks are empty, further ones are dropped."""
    schema = "run string, fields map<string,string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["text"].dropna():
                lines = (r for r in csv.reader(io.StringIO(content.replace("\r\n", "\n"))) if any(x.strip() for x in r))
                head = next(lines, [])
                rows += [dict(zip(head, r + [""] * len(head), strict=False)) for r in lines]
            rows = [r for r in rows if r.get("Run", "").strip()]
            yield pd.DataFrame({"run": [r["Run"].strip() for r in rows], "fields": rows}, columns=["run", "fields"], dtype=object)

    return df.select(F.col(text).alias("text")).mapInPandas(run, schema)


def later_wins(rows: DataFrame, key: str, batch: str) -> DataFrame:
    """One row for each key of batched results: the one of the last batch that has it."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(batch)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in others])
