"""Assembly of short reads: a de Bruijn graph of canonical k-mers, cleaned of rare k-mers and short tips, contracted to unitigs.

A node is a k-mer and its reverse complement together, named by the lesser (canonical) one; each has two sides, the end of its
canonical form (out) and its start (in). Two nodes are linked where one's k - 1 last letters continue in the other. A side that
links to one node only, by a side that links back alone, is inner to a unitig; unitigs are the chains of such links. Chains are
ranked by pointer jumping: in each round every side knows who stands twice as far on, so n nodes in a chain take log2(n) rounds,
whatever the chain's length. All steps are joins and groupings of k-mers; k-mers are numbers of two bits a letter, k is 31 at most and odd.

Reads are (id, seq); letters other than A, C, G, T break a read; null and short reads give no k-mers; repeated reads count as often.
A chain that closes on itself has no ends, and is opened before its least k-mer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbiome.functions.scratch import cut, release


def _reverse(code: Column, k: int) -> Column:
    """The code of a k-mer's reverse complement: letters are 0 to 3 (A, C, G, T), so a complement is 3 less the letter."""
    out = F.lit(0).cast("long")
    for i in range(k):
        out = out.bitwiseOR(F.shiftleft(F.lit(3) - F.shiftright(code, 2 * i).bitwiseAND(3), 2 * (k - 1 - i)))
    return out


def _code(letters: Column, k: int) -> Column:
    """The number of a string of k letters."""
    places = F.sequence(F.lit(1), F.lit(k))
    return F.aggregate(places, F.lit(0).cast("long"), lambda n, i: F.shiftleft(n, 2).bitwiseOR((F.call_function("instr", F.lit("ACGT"), F.substring(letters, i, F.lit(1))) - 1).cast("long")))


def letters_of(code: Column, k: int) -> Column:
    """The letters of a k-mer's number."""
    return F.concat(*[F.substring(F.lit("ACGT"), F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(3).cast("int") + 1, F.lit(1)) for i in range(k)])


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(node, n): canonical k-mers of the reads and how often each is found, on either strand.

    Tasks count MERS k-mers at a time, deal them out by ranges of a scattered order, and send each range packed (some bytes a k-mer
    instead of a row); what a range gets is added up at once. Both hold a bounded number of k-mers of k to 15, whatever the input;
    beyond, a range holds its distinct k-mers.
    """
    if k % 2 == 0 or not 3 <= k <= 31:
        raise ValueError("k is odd, from 3 to 31")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for letters in _joined(batch.column("seq"), k):
                held.append(_scattered(_canonical(letters, k), k))
                size += len(held[-1])
                if size >= MERS:
                    yield _packed(held, k)
                    size = 0
        if size:
            yield _packed(held, k)

    def added(rows: pa.Table) -> pa.Table:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0  # of what came since k-mers were added up
        for mers, part, packed in zip(*(rows.column(c) for c in ("mers", "part", "packed")), strict=True):
            held.append(_unpacked(mers.as_py(), part.as_py(), packed.as_buffer(), k))
            size += len(held[-1][0])
            if size >= MERS // 4:
                held, size = [_summed(held)], 0
        codes, n = _summed(held)
        return pa.table({"node": _gathered(codes, k), "n": n})

    some = reads.where("seq is not null").select("seq").mapInArrow(run, "part int, mers int, packed binary")
    return some.groupBy("part").applyInArrow(added, "node long, n long")


#: Letters of a piece of a batch, k-mers that a task counts at a time, and bits of the number of ranges.
LETTERS, MERS, PARTS = 1_000_000, 8_000_000, 12
_LETTER = np.full(256, 4, np.uint8)
for _n, _c in enumerate("ACGT"):
    _LETTER[[ord(_c), ord(_c.lower())]] = _n
#: Fixed value: an odd factor; products by it, modulo the number of k-mers, are an order of them in which any set lies about evenly.
_ODD = 0x9E3779B97F4A7C15
_CODEC = "zstd"


def _joined(seqs: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The letters of sequences, one after another with a break (4) after each, in pieces; long sequences are cut, k - 1 letters twice."""
    held: list[np.ndarray] = []
    size = 0
    for seq in seqs:
        raw = np.frombuffer(seq.as_buffer(), np.uint8)
        for first in range(0, len(raw), LETTERS):
            held += [_LETTER[raw[first : first + LETTERS + k - 1]], np.full(1, 4, np.uint8)]
            size += len(held[-2]) + 1
            if size >= LETTERS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _canonical(letters: np.ndarray, k: int) -> np.ndarray:
    """The lesser codes of the k letters from each place on and of their reverse complement, where all are known; 32 bits for k to 15."""
    if len(letters) < k:
        return np.zeros(0, _kind(k))
    bad = np.cumsum(np.concatenate([[0], letters > 3]), dtype=np.int64)
    own = (letters & 3).astype(_kind(k))
    back = 3 - own
    done, n = 0, 1  # words of n = 1, 2, 4, ... letters, put together to words of `done` letters
    while True:
        if k & n:
            if done:
                whole, turned = whole[:-n] << 2 * n | own[done:], back[done:] << 2 * done | turned[:-n]
            else:
                whole, turned = own, back
            done += n
        if done == k:
            return np.minimum(whole, turned)[bad[k:] == bad[:-k]]
        own, back, n = own[:-n] << 2 * n | own[n:], back[n:] << 2 * n | back[:-n], 2 * n


def _kind(k: int) -> type:
    return np.uint32 if k < 16 else np.uint64


def _scattered(codes: np.ndarray, k: int) -> np.ndarray:
    return codes * codes.dtype.type(_ODD % 4**k) & codes.dtype.type(4**k - 1)


def _gathered(places: np.ndarray, k: int) -> np.ndarray:
    """The codes of places in the scattered order."""
    return (places * places.dtype.type(pow(_ODD, -1, 4**k)) & places.dtype.type(4**k - 1)).astype(np.int64)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    places, n = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(places, kind="stable")  # of sorted runs
    places = places[order]
    at = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
    return places[at], np.add.reduceat(n[order], at)


def _planes(numbers: np.ndarray) -> bytes:
    """All first bytes of numbers, all second ones, and so on: most are alike."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _numbers(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(held: list[np.ndarray], k: int) -> pa.RecordBatch:
    """(part, mers, packed) of the k-mers at places in the scattered order; held is emptied. A range's k-mers are distances and counts."""
    places = np.concatenate(held)
    held.clear()
    places.sort()
    at = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
    counts = np.diff(at, append=len(places)).astype(np.uint32)
    places = places[at]
    parts, first = np.unique(places >> places.dtype.type(_shift(k)), return_index=True)
    ahead = np.diff(places, prepend=places[:1])
    ahead[first] = places[first] - (parts << places.dtype.type(_shift(k)))
    ends = [*first.tolist(), len(places)]
    codec = pa.Codec(_CODEC, compression_level=1)
    packed = [codec.compress(_planes(ahead[a:b]) + _planes(counts[a:b]), asbytes=True) for a, b in zip(ends, ends[1:])]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.diff(ends), pa.int32()), pa.array(packed, pa.binary())], ["part", "mers", "packed"])


def _unpacked(mers: int, part: int, packed: pa.Buffer, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of one range."""
    kind = _kind(k)
    wide = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.Codec(_CODEC).decompress(packed, mers * (wide + 4)), np.uint8)
    ahead, counts = _numbers(raw[: mers * wide], kind), _numbers(raw[mers * wide :], np.uint32)
    return np.cumsum(ahead, dtype=kind) + kind(part << _shift(k)), counts.astype(np.int64)


def _shift(k: int) -> int:
    return max(2 * k - PARTS, 0)


def links(nodes: DataFrame, k: int) -> DataFrame:
    """(a, a_side, b, b_side): links between sides of nodes, each in both directions; side 0 is the start of the canonical form."""
    mask = (1 << 2 * k) - 1
    strand = F.explode(F.array(F.struct(F.lit(1).alias("a_side"), F.col("node").alias("c")), F.struct(F.lit(0).alias("a_side"), _reverse(F.col("node"), k).alias("c"))))
    out = nodes.select("node", strand.alias("x")).select("node", F.col("x.a_side").alias("a_side"), F.col("x.c").alias("c"))
    onward = out.withColumn("letter", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select(F.col("node").alias("a"), "a_side", F.shiftleft("c", 2).bitwiseAND(mask).bitwiseOR(F.col("letter").cast("long")).alias("to"))
    back = _reverse(F.col("to"), k)
    named = onward.select("a", "a_side", F.least("to", back).alias("b"), (F.col("to") > back).cast("int").alias("b_side"))
    return named.join(nodes.select(F.col("node").alias("there")), F.col("b") == F.col("there"), "left_semi")


def _inner(found: DataFrame) -> DataFrame:
    """(a, a_side, b, b_side) of the links whose sides have no other link on either end, self-links left out."""
    ways = found.groupBy("a", "a_side").agg(F.count("*").alias("n"), F.min(F.struct("b", "b_side")).alias("x"))
    one = ways.where("n = 1").select("a", "a_side", F.col("x.b").alias("b"), F.col("x.b_side").alias("b_side"))
    other = one.select(F.col("a").alias("p"), F.col("a_side").alias("p_side"), F.col("b").alias("q"), F.col("b_side").alias("q_side"))
    both = one.join(other, (F.col("b") == F.col("p")) & (F.col("b_side") == F.col("p_side")) & (F.col("q") == F.col("a")) & (F.col("q_side") == F.col("a_side")))
    return both.where("a <> b").select("a", "a_side", "b", "b_side")


def chains(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """(node, chain, place, turned): the chain of each node (the least node of it, or of its start), its place, and whether it is
    read in its reverse complement.

    A walk enters a node by one side and leaves by the other. The state (node, side by which it is left) points to the state that
    follows; each round doubles how far it points, until it points to a chain's end. The two walks of a chain end at either end;
    the one that starts at the lesser end gives the places.
    """
    states = nodes.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    step = inner.select(F.col("a").alias("n0"), F.col("a_side").alias("s0"), F.col("b").alias("to"), (1 - F.col("b_side")).alias("to_side"))
    # far: states walked on; at: where the walk is; low: the least node met on the way; open: it can go on
    walk = states.join(step, (F.col("node") == F.col("n0")) & (F.col("side") == F.col("s0")), "left").select(
        "node", "side", F.coalesce("to", "node").alias("at"), F.coalesce("to_side", "side").alias("at_side"), F.col("to").isNotNull().cast("long").alias("far"), F.least("node", F.coalesce("to", "node")).alias("low"), F.col("to").isNotNull().alias("open")
    )
    walk = cut(walk, "walk")
    size, rounds = nodes.count(), 0
    while walk.where("open").limit(1).count() and (1 << rounds) <= 2 * size:
        nxt = walk.select(F.col("node").alias("m"), F.col("side").alias("ms"), F.col("at").alias("at2"), F.col("at_side").alias("at_side2"), F.col("far").alias("far2"), F.col("low").alias("low2"), F.col("open").alias("open2"))
        both = walk.join(nxt, (F.col("at") == F.col("m")) & (F.col("at_side") == F.col("ms")))
        on = F.col("open")
        after = cut(both.select(
            "node", "side", F.when(on, F.col("at2")).otherwise(F.col("at")).alias("at"), F.when(on, F.col("at_side2")).otherwise(F.col("at_side")).alias("at_side"),
            (F.col("far") + F.when(on, F.col("far2")).otherwise(0)).alias("far"), F.least("low", F.when(on, F.col("low2")).otherwise(F.col("low"))).alias("low"), (on & F.col("open2")).alias("open"),
        ), "walk")
        release(walk)
        walk, rounds = after, rounds + 1
    ends = walk.where("not open")
    # A closed chain never ends: cut the link before its least node, and walk again.
    rings = walk.where("open").select(F.col("node").alias("rn"), "low").distinct()
    if rings.limit(1).count():
        cuts = rings.groupBy("low").agg(F.count("*").alias("n")).select(F.col("low").alias("first"))
        # The least node keeps the link at its end and loses the one at its start.
        kept = inner.join(cuts, (F.col("a") == F.col("first")) & (F.col("a_side") == 0), "left_anti").join(cuts, (F.col("b") == F.col("first")) & (F.col("b_side") == 0), "left_anti")
        return chains(nodes, cut(kept, "links"))
    # far of (node, side) counts the nodes that follow it on that side.
    e = ends.select("node", "side", "at", "far")
    right = e.where("side = 1").select("node", F.col("at").alias("r_end"), F.col("far").alias("r_far"))
    left = e.where("side = 0").select(F.col("node").alias("l"), F.col("at").alias("l_end"), F.col("far").alias("l_far"))
    both = right.join(left, F.col("node") == F.col("l"))
    first_left = F.col("l_end") <= F.col("r_end")
    start = F.least("l_end", "r_end")
    return both.select("node", start.alias("chain"), F.when(first_left, F.col("l_far")).otherwise(F.col("r_far")).alias("place"), (~first_left).alias("turned"))


def without_tips(nodes: DataFrame, k: int, longest: int) -> DataFrame:
    """The nodes but those of tips: unitigs of at most `longest` k-mers with a dead end on one side and a link on the other, where
    that side's neighbour goes on elsewhere with more. One pass."""
    all_links = cut(links(nodes, k), "links")
    placed = cut(chains(nodes.select("node"), cut(_inner(all_links), "inner")), "chains")
    outer = all_links.join(_inner(all_links).withColumnsRenamed({"a": "ia", "a_side": "ias", "b": "ib", "b_side": "ibs"}), (F.col("a") == F.col("ia")) & (F.col("a_side") == F.col("ias")) & (F.col("b") == F.col("ib")), "left_anti")
    own = placed.select(F.col("node").alias("n1"), F.col("chain").alias("from_chain"))
    to = placed.select(F.col("node").alias("n2"), F.col("chain").alias("to_chain"))
    between = outer.join(own, F.col("a") == F.col("n1")).join(to, F.col("b") == F.col("n2"))
    depth = placed.join(nodes.select(F.col("node").alias("m"), "n"), F.col("node") == F.col("m")).groupBy("chain").agg(F.count("*").alias("size"), F.avg("n").alias("depth"))
    # Ends that a chain has links on: its first and last nodes' outer sides.
    sides = between.groupBy(F.col("from_chain").alias("c")).agg(F.count_distinct("a", "a_side").alias("ends"), F.min(F.struct("b", "b_side")).alias("root"))
    tips = depth.join(sides, F.col("chain") == F.col("c")).where((F.col("ends") == 1) & (F.col("size") <= longest)).select("chain", "depth", F.col("root.b").alias("rb"), F.col("root.b_side").alias("rs"))
    rivals = between.select(F.col("b").alias("b1"), F.col("b_side").alias("s1"), F.col("from_chain").alias("rival")).distinct().join(depth.select(F.col("chain").alias("dc"), F.col("depth").alias("rival_depth"), F.col("size").alias("rival_size")), F.col("rival") == F.col("dc"))
    # Of what meets at one side, the deepest stays (of ties the longest, then the least); a tip goes if another outranks it.
    rank = lambda d, s, c: F.struct(d, s, (-c).alias("c"))
    best = rivals.groupBy("b1", "s1").agg(F.max(rank(F.col("rival_depth"), F.col("rival_size"), F.col("rival"))).alias("best"))
    gone = tips.join(best, (F.col("rb") == F.col("b1")) & (F.col("rs") == F.col("s1"))).where(-F.col("best.c") != F.col("chain")).select(F.col("chain").alias("gone"))
    keep = placed.join(gone, F.col("chain") == F.col("gone"), "left_anti").select(F.col("node").alias("stays"))
    return nodes.join(keep, F.col("node") == F.col("stays"), "left_semi")


def unitigs(nodes: DataFrame, k: int) -> DataFrame:
    """(seq, kmers, depth): the sequence of each unitig (the lesser of its two strands), its k-mers and their mean count."""
    placed = chains(nodes.select("node"), cut(_inner(links(nodes, k)), "inner"))
    counted = placed.join(nodes.select(F.col("node").alias("m"), "n"), F.col("node") == F.col("m"))
    read = F.when(F.col("turned"), _reverse(F.col("node"), k)).otherwise(F.col("node"))
    last = F.substring(F.lit("ACGT"), read.bitwiseAND(3).cast("int") + 1, F.lit(1))
    rows = counted.select("chain", "place", "n", read.alias("read"), last.alias("letter"))
    out = rows.groupBy("chain").agg(F.min_by("read", "place").alias("first"), F.sort_array(F.collect_list(F.struct("place", "letter"))).alias("letters"), F.count("*").alias("kmers"), F.avg("n").alias("depth"))
    tail = F.array_join(F.transform(F.slice("letters", 2, F.size("letters")), lambda x: x["letter"]), "")
    seq = F.concat(letters_of(F.col("first"), k), tail)
    return out.select(F.least(seq, reverse_complement(seq)).alias("seq"), "kmers", "depth")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def assembled(reads: DataFrame, k: int = 21, least: int = 2, tip: int | None = None, passes: int = 2) -> DataFrame:
    """(seq, kmers, depth): the unitigs of reads (id, seq) whose k-mers are found `least` times or more, after clipping tips of at
    most `tip` (2 k) k-mers, passes times."""
    nodes = cut(kmer_counts(reads, k).where(F.col("n") >= least), "kmers")
    for _ in range(passes):
        nodes = cut(without_tips(nodes, k, 2 * k if tip is None else tip), "kmers")
    return unitigs(nodes, k)
