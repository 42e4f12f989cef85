"""Queries that write test tables in the file formats of the analyses and read them back, with the SQL of what comes back."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbiome.functions import coerce, text
from fieldbiome.functions.scratch import new_path, write_bytes
from fieldbiome.operators import abundance, learn, linear, metrics, panel, selection, similarity
from fieldbiome.operators.ranking import placed
from fieldbiome.plans import tables as t
from fieldbiome.plans.registry import _BINROWS, _PANEL, _PER, query, r6
from fieldbiome.plans.tables import BINS, table
from fieldbiome.sources import readers, web, writers
from fieldbiome.streaming import events as streaming


def _lines(df: DataFrame, *columns: F.Column) -> DataFrame:
    """One tab-separated text line for each row."""
    return df.select(F.concat_ws("\t", *[c.cast("string") for c in columns]).alias("value"))


def _write_lines(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.select("value").write.text(path)
    return path


# ---- delimited text


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS label FROM customer")
def csv_strings(spark, sf_dir):
    path = new_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return readers.csv_strings(spark, path, required=["c_custkey", "label"])


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS v FROM supplier")
def csv_inferred(spark, sf_dir):
    path = new_path(spark, "csv")
    s = table(spark, sf_dir, "supplier")
    s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "NA").otherwise(F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string")).alias("v")).write.option("header", True).csv(path)
    return readers.csv_inferred(spark, path).select(F.col("id").cast("long").alias("id"), F.col("v").cast("double").alias("v"))


@query("SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def tsv_header(spark, sf_dir):
    path = new_path(spark, "tsv")
    table(spark, sf_dir, "nation").select("n_name", "n_regionkey").write.option("header", True).option("sep", "\t").csv(path)
    return readers.csv_strings(spark, path, sep="\t")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")
def csv_first_column(spark, sf_dir):
    path = new_path(spark, "csv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").write.option("header", True).csv(path)
    return readers.first_column(spark, path)


@query("SELECT DISTINCT c_name AS id FROM customer")
def plain_list(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.explode(F.array(F.concat("c_name", F.lit("\r")), F.lit(" "))).alias("value")).distinct()
    return readers.listed(spark, _write_lines(names, "list"))


# ---- hits


@query("""WITH l AS (SELECT l_returnflag AS s, 'g' || (l_partkey % 50) AS g, l_linenumber AS k FROM lineitem)
SELECT 's=' || s AS sample_id, g AS arg_id, count(*) AS n FROM l WHERE k % 5 <> 0 GROUP BY ALL""")
def hit_files(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    # Lines of one field don't count.
    value = F.when(F.col("l_linenumber") % 5 == 0, F.lit("q")).otherwise(F.concat(F.lit("q"), F.col("l_orderkey").cast("string"), F.lit("\tg"), (F.col("l_partkey") % 50).cast("string"), F.lit("\t99.5")))
    path = new_path(spark, "hits")
    lines = l.select(F.col("l_returnflag").alias("s"), value.alias("value"))
    # Each sample has a file of its own in two folders, the first with other hits; the last by path counts. Files are written sample by
    # sample, as one task that takes whole samples would sort them by sample first.
    first = lines.where("value <> 'q'").select("s", F.lit("q\tnone\t1.0").alias("value"))
    for (s,) in l.select("l_returnflag").distinct().collect():  # one row a file
        for folder, df in (("first", first), ("last", lines)):
            df.where(F.col("s").eqNullSafe(F.lit(s))).select("value").repartition(1).write.text(f"{path}/{folder}/s={s if s is not None else '__HIVE_DEFAULT_PARTITION__'}")
    return abundance.hit_counts(readers.sample_hits(spark, f"{path}/*/*/*.txt"))


@query("""SELECT 'o' || l_orderkey AS qseqid, arg_max('p' || l_partkey, (l_quantity, -l_linenumber)) AS sseqid, max(l_quantity) AS pident FROM lineitem GROUP BY 1""")
def hit_table(spark, sf_dir):
    # Of lines that quantity and line number don't tell apart the first of the table counts, so each carries its place.
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    path = _write_lines(_lines(l, F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("l_quantity"), F.col("l_linenumber"), F.col("file"), F.col("row")), "hits")
    hits = readers.blast_hits(spark, path, ("qseqid", "sseqid", "pident", "n", "file", "row"), strict=True)
    return selection.top_hits(hits, "qseqid", [F.desc("pident"), F.col("n").cast("int"), F.col("file"), F.col("row").cast("long")]).select("qseqid", "sseqid", "pident")


@query("""WITH q AS (SELECT c_name AS query_id, c_mktsegment AS label FROM customer WHERE c_custkey % 4 <> 0), d AS (SELECT 'p' || p_partkey AS db_id, p_type AS label FROM part WHERE p_size < 40)
SELECT c.c_name AS qseqid, 'p' || l.l_partkey AS sseqid, l.l_linenumber AS n, q.label AS true_label, d.label AS pred_label FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN q ON q.query_id = c.c_name JOIN d ON d.db_id = 'p' || l.l_partkey""")
def hit_label_lookup(spark, sf_dir):
    l, o, c = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    hits = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("qseqid"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("sseqid"), F.col("l_linenumber").alias("n"))
    q = c.where("c_custkey % 4 <> 0").select(F.col("c_name").alias("query_id"), F.col("c_mktsegment").alias("label"))
    d = table(spark, sf_dir, "part").where("p_size < 40").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("db_id"), F.col("p_type").alias("label"))
    return similarity.hit_labels(hits, q, d)


@query("""WITH h AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'x|' || p_name ELSE 'gb|A|ARO:' || (3000000 + p_size) || '|' || p_name || '|ARO:1' END AS header FROM part),
m AS (SELECT 'ARO:' || (3000000 + p_size) AS aro, arg_max(p_type, p_partkey) AS label FROM part WHERE p_size % 5 <> 0 GROUP BY 1)
SELECT p_partkey, aro, label FROM (SELECT p_partkey, nullif(regexp_extract(header, 'ARO:[0-9]+', 0), '') AS aro FROM h) JOIN m USING (aro)""")
def aro_label_map(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    aro = F.concat(F.lit("ARO:"), (F.lit(3000000) + F.col("p_size")).cast("string"))
    header = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x|"), "p_name")).otherwise(F.concat(F.lit("gb|A|"), aro, F.lit("|"), "p_name", F.lit("|ARO:1")))
    index = p.select(F.when(F.col("p_size") % 5 != 0, aro).alias("aro"), F.col("p_type").alias("label"), F.col("p_partkey").alias("ord"))
    return selection.mapped_labels(p.select("p_partkey", header.alias("header")), index, F.col("header")).select("p_partkey", "aro", "label")


# ---- sequences, archives, matrices, sheets


_CLEAN = "regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]', '', 'g')"


@query(f"SELECT 'b' || item_id AS seq_id, {_CLEAN} AS seq FROM benchmark")
def fasta_file(spark, sf_dir):
    path = new_path(spark, "fasta")
    b = table(spark, sf_dir, "benchmark")
    writers.fasta(b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("seq_id"), text.clean_sequence(F.col("text")).alias("seq")), path)
    return readers.last_of_id(readers.fasta(spark, path)).select("seq_id", "seq")


@query(f"WITH b AS (SELECT item_id, {_CLEAN} AS s FROM benchmark) SELECT 'b' || (item_id % 10) AS seq_id, arg_max(s, (length(s), CAST(item_id < 20 AS INT), -item_id)) AS seq FROM b GROUP BY 1")
def fasta_merged(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), (F.col("item_id") % 10).cast("string")).alias("seq_id"), text.clean_sequence(F.col("text")).alias("seq"), F.col("item_id").alias("ord"))
    return selection.merged_longest(b.where("ord < 20"), b.where("ord >= 20"), ["seq_id"], "seq").select("seq_id", "seq")


@query("SELECT r_name || '.tsv' AS member, CAST(r_regionkey AS VARCHAR) AS text FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def tar_members(spark, sf_dir):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:bz2") as archive:
        for r in table(spark, sf_dir, "region").collect():  # five rows
            content = str(r["r_regionkey"]).encode() + b"\xff"
            info = tarfile.TarInfo(f"./d/{r['r_name']}.tsv")
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    path = new_path(spark, "tar") + ".tar.bz2"
    write_bytes(spark, path, out.getvalue())
    got = readers.tar_members(spark, path, ["ASIA.tsv", "EUROPE.tsv"])
    return got.select(F.element_at(F.split("member", "/"), -1).alias("member"), "text")


@query("SELECT vec_id AS row_index, embedding FROM embeddings WHERE embedding IS NOT NULL")
def npy_matrix(spark, sf_dir):
    path = new_path(spark, "npy") + ".npy"
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    writers.npy(e.select(F.col("vec_id").alias("row_index"), "embedding"), path)
    # A row's place is its identity: places go back to ids by their order.
    ids = e.select(F.col("vec_id").alias("id"))
    from fieldbiome.operators.ranking import placed

    rows = readers.npy_rows(spark, path)
    return rows.join(placed(ids, [F.col("id")]), F.col("row_index") + 1 == F.col("place")).select(F.col("id").alias("row_index"), "embedding")


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@query("SELECT n_name AS \"Sample\", CAST(n_regionkey AS VARCHAR) AS \"Campaign\", CAST(n_nationkey AS VARCHAR) AS \"Gene\" FROM nation")
def xlsx_sheet(spark, sf_dir):
    rows = [("", "", ""), ("Sample", "Campaign", "Gene"), *[(r["n_name"], r["n_regionkey"], r["n_nationkey"]) for r in table(spark, sf_dir, "nation").collect()], ("tail", "", "")]  # 25 rows
    strings = sorted({x for r in rows for x in r if isinstance(x, str)})
    cell = lambda v: f'<c t="s"><v>{strings.index(v)}</v></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_RELS}"><sheets><sheet name="S10" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>" + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    path = new_path(spark, "sheet") + ".xlsx"
    write_bytes(spark, path, out.getvalue())
    return readers.xlsx_table(spark, path, "S10", ["Sample", "Campaign", "Gene"])


# ---- web answers


def answer(url: str) -> str:
    """Stands for a server: JSON rows of ids, a run table or a sample record, by the url; ids of 7 have an error."""
    import urllib.error

    kind, _, keys = url.partition("?")
    ids = [k for k in keys.replace("%2C", ",").split(",") if k]
    if kind == "search" and ids == ["7"]:
        raise urllib.error.URLError("no such term")
    if kind == "search":
        return json.dumps([{"run": f"R{k}", "n": int(k) * 2} for k in ids])
    if kind == "report":
        return json.dumps([{"run": f"R{int(k) % 10}", "n": k} for k in ids])
    if kind == "runs":
        return "Run,Title,Size\r\n" + "\r\n\r\n".join(f'R{k},"a, ""{k}""",{int(k) + 1}' for k in ids) + "\r\n"
    return f'<B><Attribute attribute_name="Geo_Loc">  </Attribute><Attribute attribute_name="geo_loc"> place {ids[0]} </Attribute><Attribute attribute_name="Depth">{ids[0]}</Attribute></B>'


_ANSWER = "fieldbiome.plans.files:answer"


def _keys(spark, sf_dir, name="n_nationkey"):
    return [str(r[0]) for r in table(spark, sf_dir, "nation").select(name).orderBy(name).collect()]  # 25 rows


@query("SELECT 'R' || n_nationkey AS run, CAST(2 * n_nationkey AS VARCHAR) AS n FROM nation WHERE n_nationkey <> 7")
def web_search(spark, sf_dir):
    spark.dataSource.register(web.JsonRows)
    got = spark.read.format("json_rows").options(url="search?{key}", keys=json.dumps(_keys(spark, sf_dir)), fields="run,n", fetch=_ANSWER, errors="warn").load()
    return got.select("run", "n")


@query("SELECT 'R' || (n_nationkey % 10) AS run, CAST(max(n_nationkey) AS VARCHAR) AS n FROM nation GROUP BY 1")
def web_file_report(spark, sf_dir):
    spark.dataSource.register(web.JsonRows)
    got = spark.read.format("json_rows").options(url="report?{key}", keys=json.dumps(_keys(spark, sf_dir)), size="4", fields="run,n", fetch=_ANSWER, errors="raise").load()
    return readers.later_wins(got.select("run", "batch", "n"), "run", "batch").select("run", "n")


@query("SELECT 'R' || n_nationkey AS run, 'a, \"' || n_nationkey || '\"' AS title, CAST(n_nationkey + 1 AS VARCHAR) AS size FROM nation")
def web_run_tables(spark, sf_dir):
    got = web.run_tables(spark, "runs?{key}", _keys(spark, sf_dir), size="6", fetch=_ANSWER)
    return got.select("run", F.col("fields")["Title"].alias("title"), F.col("fields")["Size"].alias("size"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, 'place ' || n_nationkey AS place, CAST(n_nationkey AS VARCHAR) AS depth FROM nation")
def web_sample_attributes(spark, sf_dir):
    got = web.sample_attributes(spark, "sample?{key}", _keys(spark, sf_dir), fetch=_ANSWER)
    return got.select("key", F.col("attributes")["geo_loc"].alias("place"), F.col("attributes")["depth"].alias("depth"))


# ---- writers


@query("SELECT c_name AS name, row_number() OVER (ORDER BY c_name DESC) AS place FROM customer")
def sorted_parts(spark, sf_dir):
    """A file written in an order, in parts: the parts by name, and the lines in each, stand in it."""
    path = new_path(spark, "sorted")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.translate("c_name", "0123456789", "9876543210").alias("turned"))
    writers.csv(c, path, order=["turned"])
    lines = readers.csv_strings(spark, path).withColumns({"file": F.input_file_name(), "row": F.monotonically_increasing_id()})
    return placed(lines.select("name", "file", "row"), [F.col("file"), F.col("row")]).select("name", "place")


@query("SELECT 's' || s_suppkey AS id, printf('%.2f', round_even(s_acctbal, 2)) AS balance FROM supplier")
def csv_fixed(spark, sf_dir):
    path = new_path(spark, "csv")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.bround("s_acctbal", 2).alias("balance"))
    writers.csv(s, path, {"balance": 2}, ["id"])
    return readers.csv_strings(spark, path)


@query("SELECT 'd' || doc_id AS id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label FROM labels")
def label_file(spark, sf_dir):
    path = new_path(spark, "labels")
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    writers.csv(labels, path, order=["id", "label"])
    return readers.csv_strings(spark, path)


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("""WITH c AS (SELECT o_custkey AS s, p_type, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT CAST(s AS VARCHAR) AS "Sample", """ + ", ".join(f"CAST(CAST(coalesce(sum(n) FILTER (p_type = '{x}'), 0) AS BIGINT) AS VARCHAR) AS \"{x}\"" for x in _TYPES) + " FROM c GROUP BY s")
def matrix_file(spark, sf_dir):
    path = new_path(spark, "matrix")
    writers.matrix(t.counts(spark, sf_dir, "p_type"), path)
    return readers.csv_strings(spark, path)


@query("""WITH c AS (SELECT o_custkey AS s, p_type, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT CAST(s AS VARCHAR) AS sample_id, """ + ", ".join(f"printf('%.10f', coalesce(sum(n) FILTER (p_type = '{x}'), 0) / 64.0) AS \"{x}\"" for x in _TYPES) + " FROM c GROUP BY s")
def normalised_matrix_file(spark, sf_dir):
    counts = t.counts(spark, sf_dir, "p_type")
    depth = counts.select("sample_id").distinct().withColumn("read_count", F.lit(64))
    path = new_path(spark, "matrix")
    writers.normalised_matrix(abundance.normalised(counts, depth), path)
    return readers.csv_strings(spark, path)


@query("SELECT 'n' AS metric, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'first', CAST(min(o_orderkey) AS VARCHAR) FROM orders UNION ALL SELECT 'none', 'NA'")
def key_value_file(spark, sf_dir):
    path = new_path(spark, "values")
    writers.key_values(table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.lit(None).cast("string").alias("none")), path)
    return readers.csv_strings(spark, path)


@query("SELECT CASE WHEN n BETWEEN 60 AND 90 THEN 'PASS' ELSE 'FAIL' END || ' customers ' || n AS line FROM (SELECT count(*) AS n FROM customer) UNION ALL SELECT 'assumed: one row a customer' UNION ALL SELECT 'no rows: nothing to show'")
def report_files(spark, sf_dir):
    report, notes, empty = (new_path(spark, x) for x in ("report", "notes", "empty"))
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("value"))
    checks = n.select(F.lit("customers").alias("check"), "value", coerce.pass_fail(F.col("value").between(60, 90)).alias("result"))
    writers.report(checks, report)
    writers.notes(checks, ["assumed: one row a customer"], notes)
    writers.empty_notice(checks.where("value < 0"), empty)
    return spark.read.text([report, notes, empty]).select(F.col("value").alias("line"))


@query("""SELECT method, printf('%.2f', f1) AS f1, CAST(place AS INT) AS place FROM (SELECT r_name AS method, CASE WHEN r_regionkey = 2 THEN 0.75 ELSE 0.5 END AS f1, r_regionkey + 1 AS place FROM region UNION ALL SELECT 'ARCTIC', 0.25, 6)""")
def upserted_file(spark, sf_dir):
    old, path = new_path(spark, "old"), new_path(spark, "new")
    r = table(spark, sf_dir, "region")
    writers.csv(r.select(F.col("r_name").alias("method"), F.lit("0.50").alias("f1"), "r_regionkey").orderBy("r_regionkey").select("method", "f1"), old, single=True)
    put = r.where("r_regionkey = 2").select(F.col("r_name").alias("method"), F.lit("0.75").alias("f1")).union(spark.createDataFrame([("ARCTIC", "0.25"), (" ", "0.9")], "method string, f1 string"))
    writers.upserted_metrics(readers.csv_strings(spark, old), put.coalesce(1), path)
    lines = readers.csv_strings(spark, path).withColumn("at", F.monotonically_increasing_id())
    return lines.select("method", "f1", (F.col("at") + 1).cast("int").alias("place"))


# ---- texts and numbers


@query(r"""WITH x AS (SELECT doc_id, source || ' ' || coalesce(lang, '') || ' ' || doc_id AS m, coalesce(source, '') AS s, 'day ' || (doc_id % 40) || ' of 19' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS d,
CASE doc_id % 4 WHEN 0 THEN 'WB' || doc_id WHEN 1 THEN 'wa' || doc_id WHEN 2 THEN 'x-1' ELSE '1x' END AS alias, CASE doc_id % 3 WHEN 0 THEN 'At Wascana Creek' WHEN 1 THEN 'QU''APPELLE RIVER' ELSE 'lake' END AS place FROM documents)
SELECT doc_id, coalesce(m, '') AS merged, '19' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS year, 'day' || (doc_id % 40) AS timepoint, CASE doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '' END AS time_code,
CASE doc_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '' END AS treatment_code, CASE doc_id % 4 WHEN 0 THEN 'unknown_site_WB' WHEN 1 THEN 'unknown_site_wa' WHEN 2 THEN 'unknown_site_x' ELSE 'unknown_site' END AS site,
'part ' || (doc_id % 7) AS first_part, 'Study ' || upper('k' || (doc_id % 5)) AS title FROM x""")
def text_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    number = F.col("doc_id").cast("string")
    day = F.concat(F.lit("day "), (F.col("doc_id") % 40).cast("string"), F.lit(" of 19"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"))
    choose = lambda n, *xs: F.array(*xs)[(F.col("doc_id") % n).cast("int")]
    alias = choose(4, F.concat(F.lit("WB"), number), F.concat(F.lit("wa"), number), F.lit("x-1"), F.lit("1x"))
    place = choose(3, F.lit("At Wascana Creek"), F.lit("QU'APPELLE RIVER"), F.lit("lake"))
    return d.select(
        "doc_id", F.when(F.col("source").isNull(), "").otherwise(text.merged_text(F.col("source"), F.col("lang"), number)).alias("merged"), text.year_of(day).alias("year"), text.timepoint_of(day).alias("timepoint"),
        text.time_code(alias).alias("time_code"), text.treatment_code(place).alias("treatment_code"), text.prefixed_slug(F.lit(None).cast("string"), alias).alias("site"),
        text.first_of_list(F.concat(F.lit(" part "), (F.col("doc_id") % 7).cast("string"), F.lit(" ; x"))).alias("first_part"), text.panel_title(F.concat(F.lit("studyk"), (F.col("doc_id") % 5).cast("string"))).alias("title"),
    )


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN round(s_acctbal, 2) WHEN 1 THEN 1000.0 ELSE 0.0 END AS lenient, CASE s_suppkey % 4 WHEN 0 THEN printf('%.2f', round(s_acctbal, 2)) WHEN 1 THEN '1000.00' ELSE 'NA' END AS fixed FROM supplier""")
def number_fields(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    raw = F.array(F.concat(F.lit(" "), F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string")), F.lit("1_000"), F.lit("1d"), F.lit(""))[(F.col("s_suppkey") % 4).cast("int")]
    return s.select("s_suppkey", coerce.float_or_zero(raw).alias("lenient"), coerce.fixed(coerce.float_or_null(raw), 2).alias("fixed"))


@query("SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS y FROM orders")
def checked_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("y"))
    typed = coerce.require_numbers(o, ["y"])
    return typed.select("o_orderkey", F.round(F.log1p(coerce.not_negative(F.col("y"), "y")), 9).alias("y"))


@query("""WITH g(environment, target) AS (VALUES ('wastewater', 40), ('soil', 25), ('river', 20), ('irrigation', 15)), d AS (SELECT CASE doc_id % 6 WHEN 0 THEN 'soil' WHEN 1 THEN 'river' WHEN 2 THEN 'sludge' ELSE NULL END AS e FROM documents)
SELECT environment, target, count(e) AS n, greatest(target - count(e), 0) AS shortfall FROM g LEFT JOIN (SELECT CASE e WHEN 'sludge' THEN 'wastewater' ELSE e END AS e FROM d) ON e = environment GROUP BY environment, target""")
def config_targets(spark, sf_dir):
    word = F.array(F.lit("Top SOIL"), F.lit("a river"), F.lit("sewage"), F.lit("none"), F.lit("none"), F.lit("none"))[(F.col("doc_id") % 6).cast("int")]
    found = table(spark, sf_dir, "documents").select(text.environment_of(word).alias("environment")).where("environment is not null")
    targets = spark.createDataFrame(list(text.ENVIRONMENT_TARGETS.items()), "environment string, target int")
    return abundance.category_counts(found, "environment", targets)


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 100")
def global_head(spark, sf_dir):
    return selection.head_by(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), [F.col("c_mktsegment"), F.col("c_custkey")], 100)


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, CAST(row_number() OVER (ORDER BY o_orderpriority DESC, o_orderstatus) AS INT) AS place, n FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def two_key_order(spark, sf_dir):
    from fieldbiome.operators.ranking import placed

    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return placed(n, [F.desc("priority"), F.col("status")]).withColumn("place", F.col("place").cast("int"))


@query("""SELECT c_mktsegment AS seg, measure, CAST(place AS INT) AS place, value FROM (SELECT c_mktsegment, count(*)::DOUBLE AS n, max(c_custkey)::DOUBLE AS top FROM customer GROUP BY 1) x, LATERAL (VALUES ('n', 0, n), ('top', 1, top)) v(measure, place, value)""")
def chart_bars(spark, sf_dir):
    by = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").cast("string").alias("n"), F.max("c_custkey").cast("string").alias("top"), F.lit("pending").alias("auc"))
    return writers.grouped_bars(by, "seg", ["n", "top", "auc"])


@query(f"SELECT line, lower AS x, value FROM (WITH {_PER}, b(identity_bin, lower, upper) AS (VALUES {_BINROWS})" + """
SELECT lower, round(avg(nearest_ok), 9) AS a, round(avg(topk_ok), 9) AS b FROM b JOIN p ON pident >= lower AND pident < upper GROUP BY 1) z, LATERAL (VALUES ('nearest_recall', a), ('topk_recall', b)) v(line, value)""")
def chart_series(spark, sf_dir):
    r = metrics.binned_recall(t.per_query(spark, sf_dir), BINS, "pident", {"nearest": "nearest_ok", "topk": "topk_ok"})
    return writers.series(r, "lower", ["nearest_recall", "topk_recall"]).withColumn("value", F.round("value", 9))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS v FROM supplier WHERE s_suppkey % 5 NOT IN (1, 3)")
def numeric_metrics(spark, sf_dir):
    v = F.when(F.col("s_suppkey") % 5 == 1, "pending").when(F.col("s_suppkey") % 5 == 3, "").when(F.col("s_suppkey") % 2 == 0, "0.5").otherwise("1")
    rows = metrics.numeric_rows(table(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v")), ["v"])
    return rows.select("s_suppkey", F.col("v").cast("double").alias("v"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: x + 1)), 9) END AS sim FROM embeddings WHERE embedding IS NOT NULL")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    v = F.col("embedding").cast("array<double>")
    zero = F.transform(v, lambda x: F.lit(0.0))
    other = F.when(F.col("vec_id") % 3 == 0, zero).otherwise(F.transform(v, lambda x: x + 1))
    return e.select("vec_id", F.round(similarity.cosine(v, other, -1.0), 9).alias("sim"))


# ---- models


_TRIPLE = f"""WITH {_PANEL}, f AS (SELECT study, a1 - avg(a1) OVER s AS y, m - avg(m) OVER s AS x, e - avg(e) OVER s AS z, a1 FROM lg WHERE a1 IS NOT NULL WINDOW s AS (PARTITION BY study)),
r AS (SELECT m1 - avg(m1) OVER s AS y, a - avg(a) OVER s AS x, m1, study FROM lg WHERE m1 IS NOT NULL WINDOW s AS (PARTITION BY study)),
k AS (SELECT sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy, count(*) AS n, count(DISTINCT study) AS g, var_pop(a1) * count(*) AS tss FROM f),
q AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, count(*) AS n, count(DISTINCT study) AS g, var_pop(m1) * count(*) AS tss FROM r),
d AS (SELECT regr_r2(da, dm) AS r2, count(*) AS n FROM lg WHERE da IS NOT NULL AND dm IS NOT NULL),
u AS (SELECT 'forward' AS model, 1 - (yy - xy * xy / xx) / tss AS r2, n, n - g - 1 AS df FROM k UNION ALL SELECT 'enriched', 1 - (yy - (zz * xy * xy - 2 * xz * xy * zy + xx * zy * zy) / (xx * zz - xz * xz)) / tss, n, n - g - 2 FROM k
UNION ALL SELECT 'reverse', 1 - (yy - xy * xy / xx) / tss, n, n - g - 1 FROM q UNION ALL SELECT 'difference', r2, n, n - 2 FROM d)
SELECT model, round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / df, 6) AS adjusted_r_squared, n, n < 30 AS proof_of_concept FROM u"""


@query(_TRIPLE)
def lag_model_table(spark, sf_dir):
    fits = linear.lag_models(t.panel(spark, sf_dir))
    rows = [(k, round(float(f["r2"]), 6), round(float(f["adj_r2"]), 6), int(f["n"]), f["n"] < 30) for k, f in fits.items() if "r2" in f]
    return spark.createDataFrame(rows, "model string, r_squared double, adjusted_r_squared double, n long, proof_of_concept boolean")


@query("""WITH o AS (SELECT CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS g, CAST(o_orderdate >= TIMESTAMP '1998-07-01' AS INT) AS t, ln(1 + o_totalprice) AS y FROM orders),
c AS (SELECT g, t, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM o GROUP BY ALL), s AS (SELECT sum(ss) AS rss, sum(n) AS n, (SELECT var_pop(y) * count(*) FROM o) AS tss FROM c),
w AS (SELECT max(m) FILTER (g = 0 AND t = 0) AS m00, max(m) FILTER (g = 0 AND t = 1) AS m01, max(m) FILTER (g = 1 AND t = 0) AS m10, max(m) FILTER (g = 1 AND t = 1) AS m11, max(1.0 / n) FILTER (g = 0 AND t = 0) AS v00, max(1.0 / n) FILTER (g = 0 AND t = 1) AS v01, max(1.0 / n) FILTER (g = 1 AND t = 0) AS v10, max(1.0 / n) FILTER (g = 1 AND t = 1) AS v11 FROM c),
r AS (SELECT 'Intercept' AS term, m00 AS b, v00 AS v FROM w UNION ALL SELECT 'treatment', m10 - m00, v10 + v00 FROM w UNION ALL SELECT 'time', m01 - m00, v01 + v00 FROM w UNION ALL SELECT 'treatment:time', m11 - m10 - m01 + m00, v00 + v01 + v10 + v11 FROM w)
SELECT term, round(b, 6) AS coef, round(sqrt(v * rss / (n - 4)), 6) AS std_err, round(b / sqrt(v * rss / (n - 4)), 4) AS t, CAST(n AS BIGINT) AS nobs, round(1 - rss / tss, 6) AS r2, round(1 - (rss / tss) * (n - 1) / (n - 4), 6) AS adj_r2 FROM r, s""")
def did_log_table(spark, sf_dir):
    table_ = linear.did_table(t.did_rows(spark, sf_dir), log_outcome=True)
    return table_.select("term", r6("coef"), r6("std_err"), F.round("t", 4).alias("t"), "nobs", r6("r2"), r6("adj_r2"))


@query("""WITH o AS (SELECT o_totalprice / 1000 AS y, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), r AS (SELECT y - (SELECT avg(y) FROM o) AS u, k FROM o), z AS (SELECT u, lead(u) OVER (ORDER BY k) AS w FROM r),
s AS (SELECT count(*) AS n, avg(u * u) AS m2, avg(u * u * u) AS m3, avg(u * u * u * u) AS m4, sum((w - u) * (w - u)) / sum(u * u) AS dw FROM z)
SELECT n, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2), 6) AS kurtosis, round(dw, 6) AS durbin_watson, round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 3) AS jarque_bera FROM s""")
def residual_shapes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("y"), "o_orderkey")
    mean = o.agg(F.avg("y").alias("m"))  # one row
    s = linear.residual_shape(o.join(F.broadcast(mean)).withColumn("u", F.col("y") - F.col("m")), "u", "o_orderkey")
    return s.select("n", r6("skew"), r6("kurtosis"), r6("durbin_watson"), F.round("jarque_bera", 3).alias("jarque_bera"))


@query(f"""WITH {_PANEL}, b AS (SELECT study, count(*) AS n, arg_min(m, "order") AS m0, arg_max(m, "order") AS ml, arg_min(a, "order") AS a0, arg_max(a, "order") AS al FROM pn GROUP BY 1)
SELECT study, study || ': cohort' AS title, 'Start values: MGE=' || printf('%.2f', m0) || ', ARG=' || printf('%.1f', a0) || ' | Direction over time: MGE=' || CASE WHEN ml > m0 THEN 'up' WHEN ml < m0 THEN 'down' ELSE 'flat' END || ', ARG=' || CASE WHEN al > a0 THEN 'up' WHEN al < a0 THEN 'down' ELSE 'flat' END || ' | n=' || n AS note FROM b""")
def panel_texts(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    mge, arg = panel.trends(p, "mge_abundance"), panel.trends(p, "arg_total")
    both = mge.alias("m").join(arg.alias("a"), "study")
    note = text.panel_note(F.col("m.n"), F.col("m.first"), F.col("a.first"), F.col("m.word"), F.col("a.word"))
    return both.select("study", text.panel_title(F.col("study"), F.lit("cohort")).alias("title"), note.alias("note"))


# ---- rows and models that other queries only use on the way


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def last_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return abundance.last_wins(e, "user_id", F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


@query("SELECT label, count(*) AS n, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS n_test FROM embeddings GROUP BY 1")
def stratified_sizes(spark, sf_dir):
    split = selection.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.2)
    return split.groupBy("label").agg(F.count("*").alias("n"), F.count_if("in_test").alias("n_test"))


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5('7|' || vec_id), 1, 15) AS BIGINT), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, k <= round_even(n * 0.2, 0) AS in_test FROM r""")
def stratified_rows(spark, sf_dir):
    return selection.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.2, 7, coerce.md5_draw).select("vec_id", "label", "in_test")


@query("SELECT e.vec_id AS row_index, 'q' || l.quality AS label FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE e.vec_id % 3 <> 0")
def labelled_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_index"), "embedding")
    named = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit("q"), F.col("quality").cast("string")))
    return learn.labelled(rows, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_index"), named.alias("label"))).select("row_index", "label")


@query("""WITH o AS (SELECT o_totalprice / 1000 AS y, o_custkey::DOUBLE AS x FROM orders), s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM o),
e AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS s2 FROM s)
SELECT 'Intercept' AS term, round(a, 6) AS coef, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) AS std_err, round(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4) AS t, n AS nobs, round(r2, 9) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 9) AS adj_r2 FROM e
UNION ALL SELECT 'x', round(b, 6), round(sqrt(s2 / sxx), 6), round(b / sqrt(s2 / sxx), 4), n, round(r2, 9), round(1 - (1 - r2) * (n - 1) / (n - 2), 9) FROM e""")
def ols_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fit = linear.ols(*linear.design(o, {"x": F.col("o_custkey").cast("double")}, [], F.col("o_totalprice") / 1000))
    return linear.coefficients(o, fit).select("term", r6("coef"), r6("std_err"), F.round("t", 4).alias("t"), "nobs", F.round("r2", 9).alias("r2"), F.round("adj_r2", 9).alias("adj_r2"))


@query("""WITH c AS (SELECT o_custkey AS s, p_type AS g, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT s AS sample_id, g AS arg_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT s FROM c) CROSS JOIN (SELECT DISTINCT p_type AS g FROM part) LEFT JOIN c USING (s, g)""")
def matrix_to_long(spark, sf_dir):
    wide = abundance.wide_matrix(t.counts(spark, sf_dir, "p_type"), _TYPES)
    return abundance.long_of_wide(wide, abundance.sample_column(wide.columns))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    return streaming.sessions(table(spark, sf_dir, "events"), "12 hours").select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, CAST(min(epoch_us(ts)) AS BIGINT) AS start_us, CAST(max(epoch_us(ts)) + 43200000000 AS BIGINT) AS end_us, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY user_id, s""")
def user_session_bounds(spark, sf_dir):
    """Starts and ends of sessions, to the microsecond; a session ends 12 hours after its last event."""
    found = streaming.sessions(table(spark, sf_dir, "events").where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


# ---- hashed features, with crc32 worked out in SQL


_CRC = """tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(word) + 1), lambda p: ascii(substr(word, p, 1))::BIGINT)), lambda c, b: xor(c >> 8, tab.tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM words, tab)"""


@query(f"""WITH c AS (SELECT item_id, {_CLEAN} AS s FROM benchmark), k AS (SELECT item_id, '3:' || substr(s, unnest(range(1, length(s) - 1)), 3) AS token FROM c WHERE length(s) >= 3 UNION ALL SELECT item_id, '4:' || substr(s, unnest(range(1, length(s) - 2)), 4) FROM c WHERE length(s) >= 4),
n AS MATERIALIZED (SELECT item_id, token, count(*) AS n FROM k GROUP BY ALL), words AS MATERIALIZED (SELECT DISTINCT token AS word FROM n UNION SELECT DISTINCT 's' || token FROM n), {_CRC},
x AS (SELECT item_id, CAST(p.h % 4096 AS INT) AS idx, sum(CASE WHEN g.h % 2 = 0 THEN n ELSE -n END) AS x FROM n JOIN crc p ON p.word = n.token JOIN crc g ON g.word = 's' || n.token GROUP BY ALL)
SELECT item_id, idx, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 9) AS v FROM x WHERE x <> 0""")
def kmer_crc_embedding(spark, sf_dir):
    from fieldbiome.operators import sequence

    return sequence.crc_features(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("v", F.round("v", 9))


def registered(spark: SparkSession) -> None:
    """Registers the data sources of this package with a session."""
    spark.dataSource.register(web.JsonRows)
    spark.dataSource.register(web.TextRows)

