"""The operators' queries, by name, and the SQL that states the same results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbiome.llm import idfiles, intervals, langid, linededup, mixing, neardup, neighbours, pages, pieces, pii, quality, secretscan, turntrie

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False, with_spans=False)


def op2_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.clean(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("__lines.n_lines").alias("n_lines"), F.col("__lines.n_exact").alias("n_exact"), F.col("__lines.n_near").alias("n_near"), F.sha2("text", 256).alias("text_sha256"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judged(docs.select("doc_id", "text"), rules)
    s = F.col(quality.STAT)
    return judged.select("doc_id", *[s[n].alias(n) for n in quality.BASE], s["base_failed"].alias("base_failed"), s["kept"].alias("kept"), s["rule"].alias("rule"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link(table(spark, sf_dir, "documents"), width=4, percent=80)
    return linked.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op11_turntrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.trie(table(spark, sf_dir, "conversations"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op13_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.relations(*[table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks")])


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_idfiles": op2_idfiles,
    "op3_pii": op3_pii,
    "op4_linededup": op4_linededup,
    "op5_mix": op5_mix,
    "op6_neighbours": op6_neighbours,
    "op7_langid": op7_langid,
    "op8_quality": op8_quality,
    "op9_neardup": op9_neardup,
    "op10_html": op10_html,
    "op11_turntrie": op11_turntrie,
    "op12_secrets": op12_secrets,
    "op13_overlaps": op13_overlaps,
}

#: crc32 of an ASCII text, as a CTE crcs(t, crc) of the texts of a CTE crc(t); DuckDB has none of its own.
_CRC32 = """tab AS (
  SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END) AS c FROM range(256) q(i)),
tabs AS (SELECT list(c ORDER BY i) AS c FROM tab),
crcs AS (
  SELECT t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(t, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda a, x: xor(a >> 8, c[1 + (xor(a, x) & 255)])), CAST(4294967295 AS BIGINT)) AS crc FROM crc, tabs)"""

SQL: dict[str, str] = {
    "op4_linededup": r"""
WITH parts AS (
  SELECT doc_id, unnest(range(0, len(l))) AS place, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (
  SELECT doc_id, place, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM parts),
named AS (SELECT *, array_to_string(w, ' ') AS k FROM lines),
firsts AS (SELECT k, any_value(w) AS w, min((doc_id, place)) AS spot FROM named WHERE len(w) > 0 GROUP BY k),
longs AS (SELECT * FROM firsts WHERE len(w) >= 10),
cutout AS (SELECT k, spot, p, array_to_string(w[1:p - 1] || w[p + 1:len(w)], ' ') AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM longs)),
same AS (SELECT rest, p, min(spot) AS spot FROM cutout GROUP BY ALL),
shorter AS (SELECT rest, min(spot) AS spot FROM cutout GROUP BY rest),
near AS (
  SELECT c.k FROM cutout c JOIN same s ON c.rest = s.rest AND c.p = s.p WHERE s.spot < c.spot
  UNION SELECT c.k FROM cutout c JOIN longs x ON c.rest = x.k WHERE x.spot < c.spot
  UNION SELECT x.k FROM shorter c JOIN longs x ON c.rest = x.k WHERE c.spot < x.spot),
verdict AS (
  SELECT n.doc_id, n.place, n.line, len(n.w) > 0 AS word,
         len(n.w) > 0 AND (n.doc_id, n.place) > f.spot AS exact, len(n.w) > 0 AND (n.doc_id, n.place) = f.spot AND e.k IS NOT NULL AS near
  FROM named n LEFT JOIN firsts f ON n.k = f.k LEFT JOIN near e ON n.k = e.k),
byd AS (
  SELECT doc_id, CAST(count(*) FILTER (word) AS BIGINT) AS n_lines, CAST(count(*) FILTER (exact) AS BIGINT) AS n_exact, CAST(count(*) FILTER (near) AS BIGINT) AS n_near,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT coalesce(exact, false) AND NOT coalesce(near, false)), '')) AS text_sha256
  FROM verdict GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, text_sha256
FROM documents d LEFT JOIN byd USING (doc_id)
""",
    "op9_neardup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ends AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN ends b ON r.y = b.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id
""",
    "op5_mix": r"""
WITH base AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM base GROUP BY source),
lev AS (
  SELECT *, 2.0 * source_size / w AS ratio,
         (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER before, 0))
           / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lv
  FROM src WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size,
         least(2.0 * source_size, w * coalesce((SELECT lv FROM lev WHERE ratio > lv ORDER BY ratio LIMIT 1), 1e300)) AS target
  FROM lev),
rest AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM goal),
groups AS (
  SELECT b.source, b.h, sum(b.size) AS s FROM base b GROUP BY ALL),
cum AS (
  SELECT g.source, g.h, g.s, sum(g.s) OVER (PARTITION BY g.source ORDER BY g.h) AS upto FROM groups g WHERE g.s > 0),
mixed AS (
  SELECT c.source, c.h, (c.upto - c.s / 2.0 <= r.target - r.passes * r.source_size) AS more
  FROM cum c JOIN rest r ON c.source IS NOT DISTINCT FROM r.source)
SELECT b.doc_id, b.size, r.source_size, CAST(r.target AS DOUBLE) AS target,
       CAST(b.size * CASE WHEN b.size > 0 THEN least(2, r.passes + CASE WHEN m.more THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM base b JOIN rest r ON b.source IS NOT DISTINCT FROM r.source
LEFT JOIN mixed m ON b.source IS NOT DISTINCT FROM m.source AND b.h = m.h
""",
    "op11_turntrie": """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT CAST(c AS VARCHAR) AS t FROM ids),
""" + _CRC32 + """,
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p,
         sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS label, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, crc % 6 AS h FROM ids JOIN crcs ON t = CAST(c AS VARCHAR)),
again AS (
  SELECT h.c, t.p, label, chars FROM h JOIN turns t ON t.c = h.c - h.c % 100 AND t.p <= h.h
  UNION ALL SELECT h.c, t.p + 100, label, chars FROM h JOIN turns t ON t.c = h.c AND t.p > h.h),
seqs AS (SELECT ids.c, list(label ORDER BY p) FILTER (label IS NOT NULL) AS l, list(chars ORDER BY p) FILTER (label IS NOT NULL) AS n FROM ids LEFT JOIN again USING (c) GROUP BY ids.c),
prefixes AS (
  SELECT c, d, md5(array_to_string(coalesce(l, [])[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(l[1:d - 1], ',')) END AS up,
         CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars, d = coalesce(len(l), 0) AS ends FROM (SELECT *, unnest(range(0, coalesce(len(l), 0) + 1)) AS d FROM seqs)),
node AS (
  SELECT d, k, any_value(up) AS up, min(c) AS low, count(*) AS n, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
worth AS (SELECT node.*, coalesce(kids.n, 0) AS kids, CASE WHEN node.d > 0 THEN (node.n - 1) * chars ELSE 0 END AS own FROM node LEFT JOIN kids USING (d, k)),
sums AS (
  SELECT a.d, a.k, count(*) FILTER (w.kids = 0) AS leaves, sum(w.own) AS saved
  FROM worth w JOIN prefixes a ON a.c = w.low AND a.d <= w.d GROUP BY a.d, a.k)
SELECT w.low AS conv_id, w.d AS depth, p.low AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM worth w JOIN sums USING (d, k) LEFT JOIN node p ON p.d = w.d - 1 AND p.k = w.up
""",
    "op13_overlaps": """
WITH click AS (SELECT client_id, epoch_us(ts) AS u, kind FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY client_id ORDER BY u) <= 600000000 THEN 0 ELSE 1 END AS new FROM click),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked),
run AS (
  SELECT client_id, min(u) AS f, max(u) AS l, max(CASE WHEN u = top AND kind = 'purchase' THEN 1 ELSE 0 END) AS open
  FROM (SELECT *, max(u) OVER (PARTITION BY client_id, run) AS top FROM numbered) GROUP BY client_id, run),
r AS (SELECT client_id, f, f // 3600000000 AS s, CASE WHEN open = 1 THEN NULL ELSE l // 3600000000 END AS e FROM run),
line AS (SELECT sale_id, max(epoch_us(shipped_at)) AS top, max(CASE WHEN shipped_at IS NULL THEN 1 ELSE 0 END) AS open FROM sale_lines GROUP BY sale_id),
l AS (
  SELECT a.sale_id, client_id, epoch_us(sold_at) // 3600000000 AS s,
         CASE WHEN open = 1 THEN NULL ELSE greatest(epoch_us(sold_at), coalesce(top, epoch_us(sold_at))) // 3600000000 END AS e
  FROM sales a LEFT JOIN line b ON a.sale_id = b.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
pair AS (
  SELECT l.sale_id, r.f, l.s AS ls, r.s AS rs, coalesce(l.e, 1000000000000) AS le, coalesce(r.e, 1000000000000) AS re
  FROM l JOIN r ON l.client_id = r.client_id AND l.s <= coalesce(r.e, 1000000000000) AND r.s <= coalesce(l.e, 1000000000000)),
named AS (
  SELECT sale_id, f, CASE WHEN le = 1000000000000 AND re = le THEN NULL ELSE least(le, re) - greatest(ls, rs) + 1 END AS slots,
         CASE WHEN ls < rs THEN CASE WHEN le < re THEN 'overlaps' WHEN le = re THEN 'finished_by' ELSE 'contains' END
              WHEN ls = rs THEN CASE WHEN le < re THEN 'starts' WHEN le = re THEN 'equals' ELSE 'started_by' END
              ELSE CASE WHEN le < re THEN 'during' WHEN le = re THEN 'finishes' ELSE 'overlapped_by' END END AS relation
  FROM pair),
crc AS (SELECT DISTINCT CAST(f AS VARCHAR) AS t FROM run),
""" + _CRC32 + """
SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(slots) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc
FROM named JOIN crcs ON t = CAST(f AS VARCHAR) GROUP BY sale_id, relation
""",
}
