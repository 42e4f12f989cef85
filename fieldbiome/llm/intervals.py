"""Interval overlap join: sales and click sessions of the same client, by Allen's relations on time slots.

Both sides are brought down to distinct intervals of slots of a client before they meet, so a client with any share of the rows
has no more intervals in a time shard than the shard has pairs of slots. They are dealt to groups by a hash of the client and by
time shard. In a group, DuckDB joins them twice, each time by two inequalities, which it does by IEJoin: sales that start in the
shard with the sessions that hold their start, and sessions that start later, in the shard, with the sales that hold theirs. So
each pair is found once, in the shard of its later start. Clients are laid one after another on one line of numbers, so that no
equality is needed. Pairs are classified and summed there; the partial sums of shards merge in Spark and go back to the sales.

An open end is a sentinel, OPEN, larger than any slot; it reaches to the last shard in which anything starts.

Defined results: rows without client, sold_at or ts have no intervals; lines without a sale's id, or of no sale, count for none;
a sale without lines ends where it starts; a null kind is no purchase. Sales of one sale_id (null too) are summed in one row, each
of its rows being an interval. Repeated clicks change nothing but which kinds stand at a ts. Sales without a pair have no row.
Empty tables give an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.llm.common import cut

MICRO = 1_000_000
#: A session ends where the next click comes over GAP_S seconds later.
GAP_S, SLOT_S = 600, 3600
#: The end of an open interval, as a slot.
OPEN = 1 << 40
#: Slots of a time shard, and distinct intervals of sales that a hash bucket of clients should have.
SHARD, BUCKET_ROWS = 720, 100_000
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970 of a timestamp column, with a zone or without one, whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c)
    since = c - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since)
    seconds = (part("DAY").cast("long") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    return seconds * MICRO + (part("SECOND") * MICRO).cast("long")


def slot_of(us: Column, width_us: int) -> Column:
    """floor(us / width), for times before 1970 too."""
    return F.call_function("div", us - F.pmod(us, F.lit(width_us)), F.lit(width_us))


def sessions(clicks: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """(client_id, first, last, open): runs of a client's clicks with no gap over gap_s; open: a click at the last ts is a purchase.

    Clicks of one stretch of gap_s belong together, so they are summed to one row first, on the map side. Runs within a day are
    found by client and day; only the first and the last run of each day can go on in another day, and these meet by client.
    """
    gap, day = gap_s * MICRO, 86_400 * MICRO
    read = clicks.select("client_id", micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("bought")).where("client_id is not null and us is not null")
    stretch = read.groupBy("client_id", slot_of(F.col("us"), gap).alias("stretch")).agg(F.min("us").alias("first"), F.max(F.struct("us", "bought")).alias("end"))
    by_day = stretch.withColumn("day", slot_of(F.col("first"), day))

    def runs(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("first")
        new = (F.col("first") - F.lag("end.us").over(w) > gap).cast("int")
        return df.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))

    daily = runs(by_day, ["client_id", "day"])
    daily = daily.withColumn("last_run", F.max("run").over(Window.partitionBy("client_id", "day"))).withColumn("inner", (F.col("run") > 0) & (F.col("run") < F.col("last_run")))
    whole = daily.where("inner").select("client_id", "first", "end")
    ends = runs(daily.where("not inner").select("client_id", "first", "end"), ["client_id"]).select("client_id", "first", "end")
    return whole.unionByName(ends).select("client_id", "first", F.col("end.us").alias("last"), F.col("end.bought").alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """(sale_id, client_id, s, e): the slots of each sale; e is OPEN where a line has no shipped_at."""
    width = slot_s * MICRO
    shipped = lines.select(F.col("sale_id").alias("of_sale"), micros(lines, "shipped_at").alias("us")).where("of_sale is not null")
    shipped = shipped.groupBy("of_sale").agg(F.max("us").alias("shipped"), F.max(F.col("us").isNull()).alias("open"))
    sold = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("sold")).where("client_id is not null and sold is not null")
    both = sold.join(shipped, F.col("sale_id") == F.col("of_sale"), "left")
    end = F.when(F.col("open"), F.lit(OPEN)).otherwise(slot_of(F.greatest("sold", F.coalesce("shipped", "sold")), width))
    return both.select("sale_id", "client_id", slot_of(F.col("sold"), width).alias("s"), end.alias("e"))


def session_intervals(runs: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """(client_id, s, e, n, crc): the distinct slots of sessions, how many have them, and the sum of crc32 of their exact first ts."""
    width = slot_s * MICRO
    end = F.when(F.col("open"), F.lit(OPEN)).otherwise(slot_of(F.col("last"), width))
    rows = runs.select("client_id", slot_of(F.col("first"), width).alias("s"), end.alias("e"), F.crc32(F.col("first").cast("string").cast("binary")).alias("c"))
    return rows.groupBy("client_id", "s", "e").agg(F.count("*").alias("n"), F.sum("c").alias("crc"))


#: Relation by the order of starts (earlier, equal, later) and of ends; k = 3 * starts + ends. Overlap is null where both are open.
_SUMS = f"""
  l.client_id AS client_id, l.s AS s, l.e AS e, 3 * CASE WHEN l.s < r.s THEN 0 WHEN l.s = r.s THEN 1 ELSE 2 END + CASE WHEN l.e < r.e THEN 0 WHEN l.e = r.e THEN 1 ELSE 2 END AS k,
  r.n AS n, CASE WHEN l.e < {OPEN} OR r.e < {OPEN} THEN r.n * (least(l.e, r.e) - greatest(l.s, r.s) + 1) END AS slots, r.crc AS crc"""
#: Both joins of a group. x and y are ends on the common line; lhs and rhs are the rows that start in the shard.
JOIN = f"""
SELECT client_id, s, e, k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(slots) AS BIGINT) AS slots, CAST(sum(crc) AS BIGINT) AS crc FROM (
  SELECT {_SUMS} FROM lhs l JOIN right_rows r ON r.x <= l.x AND r.y >= l.x
  UNION ALL SELECT {_SUMS} FROM rhs r JOIN left_rows l ON l.x < r.x AND l.y >= r.x)
GROUP BY client_id, s, e, k"""
#: One thread a task; what a group takes is bounded, so nothing spills; joins by inequalities are IEJoins at any size.
CONFIG = {"threads": 1, "memory_limit": "700MB", "temp_directory": "", "merge_join_threshold": 0, "nested_loop_join_threshold": 0}
_OUT = pa.schema([("client_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32()), ("n", pa.int64()), ("slots", pa.int64()), ("crc", pa.int64())])


def on_one_line(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> None:
    """Adds x and y, the start and end of each interval, such that those of different clients never meet. Ends past the last start
    are cut there, which changes no comparison with a start."""
    keys, code = np.unique(np.concatenate([left["client_id"], right["client_id"]]), return_inverse=True)
    starts = np.concatenate([left["s"], right["s"]])
    low, high = starts.min(), starts.max()
    for rows, own in ((left, code[: len(left["s"])]), (right, code[len(left["s"]) :])):
        base = own * (high - low + 2)
        rows["x"] = base + rows["s"] - low
        rows["y"] = base + np.minimum(rows["e"], high) - low


def joined(left: pa.Table, right: pa.Table, first_slot: int) -> pa.Table:
    """The partial sums of a group whose shard starts at first_slot, by distinct interval of a sale and relation."""
    if not left.num_rows or not right.num_rows:
        return _OUT.empty_table()
    a = {c: left.column(c).to_numpy() for c in ("client_id", "s", "e")}
    b = {c: right.column(c).to_numpy() for c in ("client_id", "s", "e", "n", "crc")}
    on_one_line(a, b)
    with duckdb.connect(config=CONFIG) as db:
        for name, rows in (("left_rows", a), ("right_rows", b)):
            db.register(name, pa.table(rows))
        db.execute(f"CREATE VIEW lhs AS SELECT * FROM left_rows WHERE s >= {first_slot}")
        db.execute(f"CREATE VIEW rhs AS SELECT * FROM right_rows WHERE s >= {first_slot}")
        return db.sql(JOIN).to_arrow_table().cast(_OUT)


def related(sales: DataFrame, held: DataFrame, shard: int = SHARD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(client_id, s, e, k, n, slots, crc) for each distinct interval of sales (client_id, s, e) and relation k to intervals held
    (client_id, s, e, n, crc): how many are held, shared slots and crc, summed."""
    left = cut(sales.select("client_id", "s", "e").distinct(), "sale-intervals")
    right = cut(held, "session-intervals")
    n, low_left, top_left = left.agg(F.count("*"), F.min("s"), F.max("s")).first()
    _, low_right, top_right = right.agg(F.count("*"), F.min("s"), F.max("s")).first()
    starts = [x for x in (low_left, top_left, low_right, top_right) if x is not None] or [0]
    base, top = min(starts), max(starts)
    buckets = max(1, -(-n // bucket_rows))
    number = lambda c: F.floor((c - base) / shard).cast("int")

    def dealt(df: DataFrame) -> DataFrame:
        shards = F.sequence(number(F.col("s")), number(F.least(F.col("e"), F.lit(top))))
        return df.withColumn("bucket", F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int")).withColumn("shard", F.explode(shards))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return joined(a, b, base + key[1].as_py() * shard)

    parts = dealt(left).groupBy("bucket", "shard").cogroup(dealt(right).groupBy("bucket", "shard")).applyInArrow(run, "client_id long, s long, e long, k int, n long, slots long, crc long")
    return parts.groupBy("client_id", "s", "e", "k").agg(*[F.sum(c).alias(c) for c in ("n", "slots", "crc")])


def relations(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) of each sale and relation that it has to sessions of its client."""
    spans = cut(sale_intervals(sales, lines), "sales")
    found = related(spans, session_intervals(sessions(clicks)))
    names = F.array(*[F.lit(r) for r in RELATIONS])
    back = found.select(F.col("client_id").alias("c"), F.col("s").alias("fs"), F.col("e").alias("fe"), F.get(names, F.col("k")).alias("relation"), "n", "slots", "crc")
    rows = spans.join(back, (F.col("client_id") == F.col("c")) & (F.col("s") == F.col("fs")) & (F.col("e") == F.col("fe")))
    return rows.groupBy("sale_id", "relation").agg(F.sum("n").alias("n_pairs"), F.sum("slots").alias("overlap_slots"), F.sum("crc").alias("sessions_crc"))
