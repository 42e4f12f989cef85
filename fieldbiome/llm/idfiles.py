"""Token-id files, compressed by Re-Pair grammars.

Documents are put in ascending doc_id order by a range partitioning; each partition's ids (with an end id after each document) are
cut into shards of whole documents. A shard's ids are compressed by Re-Pair: the most frequent pairs of neighbours are replaced
by new nonterminals, round after round, until no pair is found LEAST_COUNT times. A shard is one row of a Parquet table: so files live wherever Spark
writes, a commit is atomic, and a lost task is just written again. The row also says how many ids its part holds before it. Its
payload:

    magic "RP01", then little-endian uint32: first nonterminal, rules, symbols, documents, id bound
    rules x (left, right) uint32 | rules expansion lengths uint32 | document lengths uint32 | symbols, uint16 or uint32
    one expansion offset (uint64) for each STRIDE symbols

Random access to ids [a, b) finds the symbol by the stored offsets and expands only the symbols that overlap.

Defined results: null and empty texts are one end id. Repeated doc_ids keep their own rows, in an order fixed by a hash of the
text. An empty table writes no shards and reads back no rows. Extra columns aren't written.
"""

from __future__ import annotations

import array
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbiome.llm.common import new_path

#: Ids of a shard, about: bounds the memory of compressing and of reading one.
SHARD_IDS = 1 << 20
RULES_A_ROUND, LEAST_COUNT = 4096, 8
STRIDE = 1024
#: Parts of a file set whose starts are broadcast (16 bytes each); those of more are joined without.
BROADCAST_PARTS = 1 << 18
#: Words that a worker's memory holds, and characters that are encoded at once.
REMEMBERED, CHARS = 1_000_000, 12_000_000


# ---- Re-Pair


def compress(ids: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rules[k] is the pair that symbol bound + k stands for.

    A round takes the pairs of the most counts (at most RULES_A_ROUND, each found LEAST_COUNT times or more) and replaces
    them left to right; where pairs overlap, the first stands. Pairs are counted exactly over the whole shard, and rounds
    go on until none is found LEAST_COUNT times. After a round that took every such pair, only pairs with one of its new
    symbols, or of two equal ones, can be found so often: all others were rarer before and lose places only. So just these are
    counted next.
    """
    seq, rules = ids.astype(np.uint32), []
    first, half, low = bound, np.uint64(32), np.uint64((1 << 32) - 1)
    spots = None  # the places of the pairs to count; None: all
    while len(seq) > 1 and (spots is None or len(spots) >= LEAST_COUNT):
        left, right = (seq[:-1], seq[1:]) if spots is None else (seq[spots], seq[spots + 1])
        twins = np.flatnonzero(left == right)  # of a run of one symbol, every second pair counts
        if len(twins):
            apart = np.ones(len(left), bool)
            apart[twins[~_every_second(twins if spots is None else spots[twins])]] = False
            spots = np.flatnonzero(apart) if spots is None else spots[apart]
            left, right = left[apart], right[apart]
        ordered = left.astype(np.uint64) << half | right
        ordered.sort()
        edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
        counts = np.diff(edges)
        often = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(often):
            break
        if all_taken := len(often) <= RULES_A_ROUND:
            pairs = ordered[edges[often]]
        else:
            pairs = ordered[edges[np.sort(often[np.argsort(-counts[often], kind="stable")[:RULES_A_ROUND]])]]
        # Pairs find their rule in a table of the symbols that start and that end a chosen pair, 0 for all others.
        a, b = (pairs >> half).astype(np.int64), (pairs & low).astype(np.int64)
        heads, a = np.unique(a, return_inverse=True)
        tails, b = np.unique(b, return_inverse=True)
        width = len(tails) + 1
        head, tail = np.zeros(first, np.int32), np.zeros(first, np.int32)
        head[heads], tail[tails] = np.arange(1, len(heads) + 1) * width, np.arange(1, len(tails) + 1)
        rule_of = np.full((len(heads) + 1) * width, -1, np.int16)
        rule_of[(a + 1) * width + b + 1] = np.arange(len(pairs))
        rule = rule_of[head[left] + tail[right]]
        own = np.flatnonzero(rule >= 0)
        places, rule = own if spots is None else spots[own], rule[own]
        take = _every_second(places)
        places, rule = places[take], rule[take]
        used = np.bincount(rule, minlength=len(pairs)) > 0  # a pair that gave way everywhere needs no rule
        pairs = pairs[used]
        seq[places] = (first + np.cumsum(used) - 1).astype(np.uint32)[rule]
        gone = np.zeros(len(seq), bool)
        gone[places + 1] = True
        seq = seq[~gone]
        rules.append(np.stack([pairs >> half, pairs & low], 1).astype(np.uint32))
        first += len(pairs)
        if all_taken:
            new = places - np.arange(len(places))
            beside = np.zeros(len(seq) + 1, bool)
            beside[new], beside[new - 1] = True, True  # the pair before place 0 falls on the end, which is cut off
            # Of a run of one symbol, pairs that were set aside count where the symbol before them is gone.
            spots = np.flatnonzero(beside[: len(seq) - 1] | (seq[1:] == seq[:-1]))
        else:
            spots = None
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq


def _every_second(places: np.ndarray) -> np.ndarray:
    """Which of ascending places stand if each rules out the next place: the first of a run of neighbours, the third and so on."""
    out = np.ones(len(places), bool)
    after = np.flatnonzero(places[1:] == places[:-1] + 1) + 1  # those that follow a neighbour
    if len(after):
        # Of neighbours that follow each other, the 1st, 3rd, ... after a run's first place go.
        new = np.r_[True, after[1:] != after[:-1] + 1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(after), dtype=np.int32), 0))
        out[after[(np.arange(len(after), dtype=np.int32) - first) % 2 == 0]] = False
    return out


def _generations(rules: np.ndarray, bound: int) -> Iterator[tuple[int, int]]:
    """[first, end) of runs of rules that only name symbols made before the run: each can be worked out at once."""
    newest = rules.max(1).astype(np.int64) - bound if len(rules) else np.zeros(0, np.int64)
    first = 0
    while first < len(rules):
        later = np.flatnonzero(newest[first:] >= first)
        end = first + int(later[0]) if len(later) else len(rules)
        yield first, end
        first = end


def expansion_lengths(rules: np.ndarray, bound: int) -> np.ndarray:
    out = np.ones(bound + len(rules), np.int64)
    for a, b in _generations(rules, bound):
        out[bound + a : bound + b] = out[rules[a:b, 0]] + out[rules[a:b, 1]]
    return out[bound:]


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, bound: int) -> np.ndarray:
    """The ids that symbols stand for."""
    size = np.concatenate([np.ones(bound, np.int64), lengths])
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint32)
    flat[:bound] = np.arange(bound)
    for a, b in _generations(rules, bound):
        pair = rules[a:b].ravel()  # left and right parts of the run's rules, in order
        flat[start[bound + a] : start[bound + b - 1] + lengths[b - 1]] = _gathered(flat, start[pair], size[pair])
    return _gathered(flat, start[symbols], size[symbols])


def pack(ids: np.ndarray, doc_lengths: np.ndarray, bound: int) -> bytes:
    rules, symbols = compress(ids, bound)
    lengths = expansion_lengths(rules, bound)
    wide = "<u2" if bound + len(rules) <= 1 << 16 else "<u4"
    size = np.concatenate([np.ones(bound, np.int64), lengths])[symbols]
    offsets = (np.cumsum(size) - size)[::STRIDE]
    head = b"RP01" + struct.pack("<5I", bound, len(rules), len(symbols), len(doc_lengths), bound)
    return b"".join([head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), doc_lengths.astype("<u4").tobytes(), symbols.astype(wide).tobytes(), offsets.astype("<u8").tobytes()])


class Shard:
    """A shard's payload, read without expanding it."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RP01":
            raise ValueError("no shard of this format")
        self.bound, n_rules, n_symbols, n_docs, _ = struct.unpack("<5I", payload[4:24])
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.doc_lengths = take("<u4", n_docs).astype(np.int64)
        self.symbols = take("<u2" if self.bound + n_rules <= 1 << 16 else "<u4", n_symbols)
        self.offsets = take("<u8", -(-n_symbols // STRIDE)).astype(np.int64)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.lengths, self.bound)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids [a, b) of the shard, from the symbols that overlap them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.offsets, a, "right") - 1)
        last = int(np.searchsorted(self.offsets, b, "left"))
        part = expand(self.symbols[first * STRIDE : last * STRIDE], self.rules, self.lengths, self.bound)
        return part[a - self.offsets[first] : b - self.offsets[first]]


# ---- tokenizing


#: A word of Latin letters, with a space before or signs after it, is one or two pre-tokens of the byte-level pattern.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SIGNS = ".,;:!?|*#$%&"


class _Words:
    """Encodes texts as the tokenizers library does, remembering words: lone white space splits them from each other."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        #: By word: its ids as bytes. A word after a line end holds that line end, any other one has a space before it.
        self.known: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.bound = self.lib.get_vocab_size()
        self.line_end = np.array(self.lib.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()
        # What sends a text to the library: special tokens, white space side by side, and any other white space there is.
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        beside = [a + b for a in " \n" for b in " \n"]
        white = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
        self.odd = [*special, *beside, *white]
        self.odd_ascii = [x for x in self.odd if x.isascii()]
        self.piece = self._merger(path)

    def _merger(self, path: str) -> Callable[[bytes], list[int]] | None:
        """The merges of a byte-level vocabulary by rank, without the library's set-up for each call; None where they might differ.

        They are the library's if ids follow the order of merges and the library itself gives each token for its own text: then
        the last two parts of a token are always those that its merge names.
        """
        model = json.loads(Path(path).read_bytes())["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = dict(zip(plain, plain, strict=True)) | {256 + k: b for k, b in enumerate(others)}
        if len(self.line_end) != 4 or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        if any(ord(c) not in byte_of for t in vocab for c in t) or any([x.id for x in self.lib.model.tokenize(t)] != [i] for t, i in vocab.items()):
            return None
        ranks = {bytes(byte_of[ord(c)] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _plain(self, text: str) -> bool:
        """Whether a text's white space is lone spaces and lone line ends between words, and it holds no special token.

        It then splits before each space and around each line end: the byte-level pattern never joins across these places.
        """
        return not text or not (text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, self.odd_ascii if text.isascii() else self.odd)))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text], 0)[0][:-1]

    def encode_many(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """The ids of each text and the end id. Words of all texts are told apart at once, so that each is looked up once."""
        plain = [self._plain(t) and len(self.line_end) == 4 for t in texts]
        some = pa.array(["\n" + t.replace("\n", " \n") for t, ok in zip(texts, plain, strict=True) if ok], pa.large_string())
        words = pc.split_pattern(some, " ")
        coded = words.flatten().dictionary_encode()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        known = self.known
        found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        of_word = list(map(known.get, found))
        piece, packed, latin = self.piece, array.array, _LATIN.fullmatch
        for k in [k for k, got in enumerate(of_word) if got is None]:
            word = found[k]
            letters = word.rstrip(_SIGNS)
            if piece and letters.isalpha() and (letters.isascii() or latin(letters)):  # one or two pre-tokens; no call for each word
                got = packed("I", piece(b" " + letters.encode())).tobytes()
                if len(letters) < len(word):
                    got += self._signs(word[len(letters) :])
                known[word] = of_word[k] = got
            else:
                of_word[k] = self._learn(word)
        lengths = np.fromiter(map(len, of_word), np.int64, len(of_word)) // 4
        table, starts = np.frombuffer(b"".join(of_word), "<u4"), np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        n = lengths[at]
        ends = np.cumsum(n)
        ids = table[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        # Each text begins with the line end put before it: one place on, these are the places of the end ids.
        last = np.r_[0, ends][words.offsets.to_numpy()[1:]] - 1 if len(some) else np.zeros(0, np.int64)
        ids = np.r_[ids[1:], 0].astype(np.uint32)
        ids[last] = end_id
        parts = iter(np.split(ids, last[:-1] + 1) if len(last) else [])
        whole = lambda t: np.array([*self.lib.encode(t, add_special_tokens=False).ids, end_id], np.uint32)
        return [next(parts) if ok else whole(t) for t, ok in zip(texts, plain, strict=True)]

    def _signs(self, signs: str) -> bytes:
        if signs not in self.signs:
            self.signs[signs] = array.array("I", self.piece(signs.encode())).tobytes()
        return self.signs[signs]

    def _learn(self, word: str) -> bytes:
        head, body = (self.line_end, word[1:]) if word[0] == "\n" else (b"", " " + word)
        letters = body.rstrip(_SIGNS)
        if not body:
            got = head
        elif head and self.piece and letters.isalpha() and (letters.isascii() or _LATIN.fullmatch(letters)):
            got = head + array.array("I", self.piece(letters.encode())).tobytes() + (self._signs(body[len(letters) :]) if len(letters) < len(body) else b"")
        else:
            got = head + np.array(self.lib.encode(body, add_special_tokens=False).ids, "<u4").tobytes()
        self.known[word] = got
        return got


_words: dict[str, _Words] = {}


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Writes the ids of docs as shards under path (a folder of any file system that Spark writes)."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    names = ["part", "shard", "before", "doc_ids", "n_ids", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _words:
            _words[tokenizer_path] = _Words(tokenizer_path)
        t = _words[tokenizer_path]
        held: list[np.ndarray] = []
        ids_of: list[int | None] = []
        count = shard = part = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal count, shard, before
            lengths = np.array([len(b) for b in held])
            ids = np.concatenate(held)
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([ids_of], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, lengths, max(t.bound, end_id + 1))], pa.binary())]
            before += len(ids)
            held.clear()
            ids_of.clear()
            count = 0
            shard += 1
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            texts = [x or "" for x in batch.column("text").to_numpy(zero_copy_only=False).tolist()]
            doc_ids = batch.column("doc_id").to_pylist()
            sizes = np.cumsum([len(x) for x in texts])
            cuts = np.flatnonzero(np.diff(sizes // CHARS)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
                for doc_id, ids in zip(doc_ids[a:b], t.encode_many(texts[a:b], end_id), strict=True):
                    held.append(ids)
                    ids_of.append(doc_id)
                    count += len(ids)
                    if count >= SHARD_IDS:
                        yield flush()
        if held:
            yield flush()

    ordered.mapInArrow(run, "part int, shard int, before long, doc_ids array<long>, n_ids long, payload binary").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards under path: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    # A shard knows what its part holds before it; what stands before a part is a sum with one row a part, never a row a shard.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if parts.count() <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    held = shards.join(starts, F.col("part") == F.col("p")).select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "payload")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, doc_ids, payload in zip(batch["first"], batch["doc_ids"], batch["payload"], strict=True):
                shard = Shard(payload)
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.doc_lengths)
                starts = ends - shard.doc_lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame(dict(zip(names, (pd.array(doc_ids, "Int64"), first + starts, shard.doc_lengths, crc), strict=True)))

    return held.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes docs' ids to the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "ids")
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path)
