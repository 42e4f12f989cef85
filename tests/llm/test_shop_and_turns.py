"""Conversation tries, secret scans and interval overlaps against brute-force versions, with nulls, ties, repeats and empty tables."""

import datetime as dt
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldbiome.llm import intervals, secretscan, turntrie

# ---- 11


def trie_by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            text = text or ""
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    nodes.setdefault((), [])
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, members in nodes.items():
        below = [x for x in nodes if x[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == p)
        out.append((
            min(members, default=None), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(not kids[x] for x in below),
            sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, conv string, n_convs int"


def conversations(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 900), n) + [-7, -100, -203]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 9])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "user", None, ""]), rng.choice(["hi", "hi", "go on", "", None, "🙂 é"]), "x", 1))
    rows += rows[:20] + [(None, 1, "user", "lost", "x", 1), (1000, None, None, None, "x", 1)]
    return rows


@pytest.mark.parametrize("block", [1, 3, 20_000])
def test_trie_equals_all_prefixes(spark, block):
    rows = conversations(block)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got = turntrie.trie(df, block=block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert list(map(tuple, turntrie.trie(spark.createDataFrame([], TURNS)).collect())) == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())]
    lone = turntrie.trie(spark.createDataFrame([(None, 1, "user", "x", "", 1)], TURNS)).collect()
    assert len(lone) == 1 and lone[0]["conv_id"] is None


def test_trie_of_a_very_long_conversation(spark):
    rows = [(5, t, "user", str(t), "x", 1) for t in range(3000)] + [(6, t, "user", str(t), "x", 1) for t in range(2500)]
    got = {(r["conv_id"], r["depth"]): r for r in turntrie.trie(spark.createDataFrame(rows, TURNS), block=1).collect()}
    h5, h6 = (zlib.crc32(str(c).encode()) % 6 for c in (5, 6))
    assert got[(5, 3000 - h5)]["n_convs"] == 1 and len(got) == 1 + (3000 - h5) + (0 if h5 == h6 else 2500 - h6)


def test_louds_of_random_tries():
    rng = random.Random(5)
    for _ in range(30):
        seqs = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 25))})
        flat = np.array([x for s in seqs for x in s], np.int64)
        t = turntrie.Louds(flat, flat * 0, np.array([len(s) for s in seqs]))
        prefixes = sorted({s[:d] for s in seqs for d in range(len(s) + 1)}, key=lambda p: (len(p), p))
        assert [int(x) for x in t.a[1:]] == [p[-1] for p in prefixes[1:]]
        assert t.parents().tolist() == [-1] + [prefixes.index(p[:-1]) for p in prefixes[1:]]
        assert t.degrees().tolist() == [sum(q[:-1] == p for q in prefixes if q) for p in prefixes]
        ends = t.node_of(np.array([len(s) for s in seqs]), np.arange(len(seqs)))
        assert [prefixes[i] for i in ends] == seqs


# ---- 12

DOCS = "doc_id long, text string, base string, added int"
PLAIN = "the river carries silt past reeds and a pump draws water from soil where moss grows over clay while salt dries on sand at noon".split()
ORDINARY = ["getHttpServerResponseBody", "src/main/java/org/example/Application", "2024-01-01T00-00-00", "READING_FRAME_TABLE_NAME", "internationalization", "river-and-sludge-samples-2021", "xxxxxxxxxxxxxxxxxxxxxxxx", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "1234567890123456", "0000000000000000000000000001", "=" * 40, "-" * 30, "550e8400-e29b-41d4-a716-446655440000", "aaaaaaaaaaaaaaaab1"]


def spans_by_pattern(text):
    out = []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def random_text(rng):
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "Kelvin", "ſecret", " ", "  ", "=", ":", '"', "'", "abc", "abcdef", "x+/_.=-", "AKIA", "AKIA", "SJDZWJNP6ZRYWK44", "0123456789abcdef", "deadbeef", "é", "🙂", "\n"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(60)))


def test_secret_base_spans_and_digests(spark):
    rng = random.Random(8)
    texts = [None, "", "a" * 100_000, "password" * 3000, "token" + " " * 50_000 + "=abcdefg", "AKIA" * 20_000] + [random_text(rng) for _ in range(400)]
    got = {r["doc_id"]: r for r in secretscan.scan(spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS)).collect()}
    for k, t in enumerate(texts):
        want = spans_by_pattern(t or "")
        text = ",".join(f"{secretscan.KINDS[x]}:{a}:{b}" for a, x, b in want)
        assert got[k]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[k][f"n_{x}"] for x in ("assign", "access", "hex")] == [sum(w[1] == i for w in want) for i in range(3)]
        assert set(text.split(",")) - {""} <= set(got[k]["spans"].split(","))
    assert secretscan.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_secrets_are_found_and_names_are_left(spark):
    rng = random.Random(21)
    texts, planted = [], {}
    for k in range(600):
        words = [rng.choice(PLAIN) for _ in range(40)] + rng.sample(ORDINARY, 3) + ["".join(rng.sample(PLAIN, 4))]
        rng.shuffle(words)
        if k % 6 == 0:
            alphabet = "".join(secretscan.ENCODINGS[rng.choice(["HEX", "base62", "base64", "base64url"])])
            planted[k] = "".join(rng.choice(alphabet) for _ in range(rng.choice([40, 48, 64, 88])))
            words.insert(20, planted[k])
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["spans"] for r in secretscan.scan(spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS)).collect()}
    found = {k: [texts[k][int(a) : int(b)] for n, a, b in (s.split(":") for s in v.split(",")) if n == "random"] for k, v in got.items() if v}
    hits = sum(found.get(k) == [t] for k, t in planted.items())
    false = sum(len([x for x in v if x != planted.get(k)]) for k, v in found.items())
    assert hits >= 0.9 * len(planted) and false <= 2, (hits, len(planted), false)


def test_battery_holds_for_random_strings():
    rng = np.random.default_rng(2)
    for e, name in enumerate(secretscan.NAMES):
        letters = np.frombuffer("".join(secretscan.ENCODINGS[name]).encode(), np.uint8)
        cells = letters[rng.integers(len(letters), size=(4000, 40))].astype(np.int64)
        z = secretscan.battery(cells, np.ones(cells.shape, bool), np.full(4000, e))
        assert np.abs(z.mean(0)).max() < 0.1 and np.abs(z.std(0) - 1).max() < 0.15, name
    # In a matrix of tokens of other lengths, each has the values that it has alone.
    tokens = [bytes(rng.choice(letters, n)) for n in (16, 33, 70)]
    assert np.allclose([x[2] for x in secretscan.judged(tokens)], [secretscan.judged([t])[0][2] for t in tokens])


def test_thresholds_are_those_of_the_rule():
    rng = random.Random(3)
    z = [rng.gauss(0, 1) for _ in range(500)] + [rng.gauss(-9, 1) for _ in range(20)]
    steps = defaultdict(int)
    for x in z:
        steps[(2, int(np.floor(x / secretscan.STEP)))] += 1
    got = secretscan.thresholds(steps, 0.05)
    p = sorted(secretscan.tail((np.floor(x / secretscan.STEP) + 1) * secretscan.STEP) for x in z)
    k = max(i + 1 for i, x in enumerate(p) if x <= 0.05 * (i + 1) / len(p))
    assert sum(x < got[2] for x in z) == k and got[0] == -np.inf


# ---- 13

T0 = dt.datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, x int, day int"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, e int"
LINES = "sale_id long, shipped_at timestamp_ntz, s int"


def relations_by_hand(sales, lines, clicks):
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    by_client = defaultdict(list)
    for _, ts, c, kind, *_ in clicks:
        if ts is not None and c is not None:
            by_client[c].append((us(ts), kind))
    held = defaultdict(list)
    for c, ts in by_client.items():
        ts.sort(key=lambda x: x[0])
        runs = [[ts[0]]]
        for t in ts[1:]:
            if t[0] - runs[-1][-1][0] > 600_000_000:
                runs.append([])
            runs[-1].append(t)
        for r in runs:
            held[c].append((r[0][0], r[-1][0], any(k == "purchase" for t, k in r if t == r[-1][0])))
    of_sale = defaultdict(list)
    for i, t, *_ in lines:
        of_sale[i].append(t)
    out = {}
    hour, inf = 3_600_000_000, 10**9
    for i, c, sold, *_ in sales:
        if c is None or sold is None:
            continue
        mine = of_sale[i] if i is not None else []
        s, e = us(sold) // hour, inf if None in mine else max([us(sold), *(us(t) for t in mine)]) // hour
        for f, last, open_ in held[c]:
            a, b = f // hour, inf if open_ else last // hour
            if max(s, a) > min(e, b):
                continue
            name = intervals.RELATIONS[3 * ((s > a) - (s < a) + 1) + (e > b) - (e < b) + 1]
            n, o, x = out.get((i, name), (0, None, 0))
            out[i, name] = (n + 1, o if e == b == inf else (o or 0) + min(e, b) - max(s, a) + 1, x + zlib.crc32(str(f).encode()))
    return sorted(((i, r, *v) for (i, r), v in out.items()), key=str)


def shop(seed):
    rng = random.Random(seed)
    at = lambda days: T0 + dt.timedelta(microseconds=rng.randrange(int(days * 86_400e6)))
    client = lambda: rng.choice([1, 1, 1, 2, 3, None, -4])
    clicks = []
    for k in range(250):
        t, c = at(70), client()
        for _ in range(rng.randrange(1, 5)):
            clicks.append((k, t if rng.random() < 0.97 else None, c, rng.choice(["view", "click", "purchase", None]), 0, 0))
            t += rng.choice([dt.timedelta(0), dt.timedelta(minutes=10), dt.timedelta(minutes=10, microseconds=1), dt.timedelta(minutes=3), dt.timedelta(hours=30)])
    night = T0 + dt.timedelta(days=3, hours=20)
    clicks += [(9000 + k, night + dt.timedelta(minutes=9 * k), 2, "view", 0, 0) for k in range(400)] + clicks[:30]
    clicks += [(9999, dt.datetime(1969, 12, 31, 23, 59, 59, 999999), 3, "view", 0, 0)]
    sales = [(rng.randrange(150) if rng.random() < 0.97 else None, client(), at(70) if rng.random() < 0.97 else None, 0) for _ in range(200)] + [(500, 3, dt.datetime(1969, 12, 31, 23), 0)]
    lines = [(rng.randrange(170) if rng.random() < 0.97 else None, at(90) if rng.random() < 0.9 else None, 0) for _ in range(250)]
    return sales, lines, clicks


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_relations_against_all_pairs(spark, zone):
    sales, lines, clicks = shop(4)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = intervals.relations(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), spark.createDataFrame(clicks, CLICKS).repartition(5))
        assert sorted(map(tuple, got.collect()), key=str) == relations_by_hand(sales, lines, clicks)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_relations_do_not_depend_on_shards_and_buckets(spark):
    sales, lines, clicks = shop(6)
    spans = intervals.sale_intervals(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES))
    held = intervals.session_intervals(intervals.sessions(spark.createDataFrame(clicks, CLICKS)))
    got = [sorted(map(tuple, intervals.related(spans, held, shard=a, bucket_rows=b).collect()), key=str) for a, b in ((24, 7), (720, 100_000))]
    assert got[0] == got[1] and got[0]


def test_relations_of_empty_tables(spark):
    sales, lines, clicks = shop(1)
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    for a, b, c in (([], [], []), (sales, lines, []), ([], lines, clicks), (sales, [], clicks)):
        got = intervals.relations(make(a, SALES), make(b, LINES), make(c, CLICKS))
        assert sorted(map(tuple, got.collect()), key=str) == relations_by_hand(a, b, c)


def test_groups_are_joined_by_inequalities_alone():
    rng = np.random.default_rng(1)
    sides = []
    for n in (5000, 3000):
        side = {"client_id": rng.integers(0, 50, n), "s": rng.integers(0, 720, n)}
        side["e"] = np.where(rng.random(n) < 0.1, intervals.OPEN, side["s"] + rng.integers(0, 300, n))
        sides.append(side | {"n": np.ones(n, np.int64), "crc": np.ones(n, np.int64)})
    intervals.on_one_line(*sides)
    with duckdb.connect(config=intervals.CONFIG) as db:
        for name, side in zip(("left_rows", "right_rows"), sides, strict=True):
            db.register(name, pa.table(side))
        db.execute("CREATE VIEW lhs AS FROM left_rows WHERE s >= 100")
        db.execute("CREATE VIEW rhs AS FROM right_rows WHERE s >= 100")
        plan = db.execute("EXPLAIN " + intervals.JOIN).fetchall()[0][1]
        assert len(re.findall("IE.?JOIN", plan, re.I)) == 2


def test_hot_clients_do_not_stay_in_one_task(spark):
    """Clicks of one client come down to stretches before they meet; the runs of a day then meet by client and day."""
    rows = [(k, T0 + dt.timedelta(minutes=k), 1, "view", 0, 0) for k in range(20_000)]
    got = intervals.sessions(spark.createDataFrame(rows, CLICKS)).select("client_id", (F.col("last") - F.col("first")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(1, 19_999 * 60_000_000)]
