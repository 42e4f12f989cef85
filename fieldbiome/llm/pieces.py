"""SentencePiece encoding and decoding with byte offsets.

Normalisation walks the model's compiled character map by longest prefix and records, for each byte of the normalised text,
the byte of the original text it came from; each piece then projects to a byte span of the original. Encoding splits the
normalised text before each run of word marks: no piece of a BPE model that has a mark after another character exists
(checked when the model loads), so no merge crosses such a split. Models without a character map merge in the library;
for the others, segments merge here and are remembered.

Defined results: null and empty texts have no pieces and decode to an empty text. Repeated rows encode alike; rows are
independent, so extra columns pass through and any partitioning gives the same result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Segments that a worker remembers before it starts anew: bounds its memory to about 200 MB.
REMEMBERED = 500_000


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, blob[at : at + n]
            at += n


class CharMap:
    """The compiled character map: a double-array trie over source byte strings and a blob of their replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.out = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry that text has at `at`; None without one."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        node ^= self._offset(units[node])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.out[start : self.out.index(b"\0", start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Model:
    """A SentencePiece BPE model: its pieces, its normaliser with alignment, and remembered segments."""

    def __init__(self, path: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        norm = dict(_fields(b"".join(v for k, v in top if k == 3)))
        self.chars = CharMap(norm.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.pieces, self.scores, self.kinds = [], [], []
        for k, v in top:
            if k == 1:
                f = dict(_fields(v))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, 1))
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (1, 4)}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == 6}
        self.unknown = self.kinds.index(2)
        self.width = np.array([1 if k == 6 else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece has a word mark after another character: segments don't encode alone")
        self.plain = not self.chars.units and self.dummy and self.escape and not self.squeeze
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.known: dict[str, list[int]] = {}

    # ---- normalisation

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and for its end, the place in the original's bytes."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return b"", np.zeros(1, np.int64)
        space = MARK.encode() if self.escape else b" "
        if not self.chars.units and not self.squeeze:
            body = raw.replace(b" ", space)
            codes = np.frombuffer(raw, np.uint8)
            at = np.repeat(np.arange(len(raw)), np.where(codes == 32, len(space), 1))
            head = space if self.dummy else b""
            return head + body, np.concatenate([np.zeros(len(head), np.int64), at, [len(raw)]])
        out, at = bytearray(), []

        def put(b: bytes, place: int) -> None:
            out.extend(b)
            at.extend([place] * len(b))

        steps, k = [], 0
        while k < len(raw):
            if hit := self.chars.longest(raw, k):
                steps.append((k, hit[1], k + hit[0]))
                k += hit[0]
            else:
                n = 1
                while k + n < len(raw) and raw[k + n] & 0xC0 == 0x80:
                    n += 1
                steps.append((k, raw[k : k + n], k + n))
                k += n
        first = 0
        while self.squeeze and first < len(steps) and steps[first][1] == b" ":
            first += 1
        steps = steps[first:]
        if not steps:
            return b"", np.array([len(raw)], np.int64)
        if self.dummy:
            put(space, steps[0][0])
        spaced = self.squeeze
        for place, b, _ in steps:
            while self.squeeze and spaced and b[:1] == b" ":
                b = b[1:]
            if b:
                put(b.replace(b" ", space), place)
                spaced = b[-1:] == b" "
            if not self.squeeze:
                spaced = False
        end = steps[-1][2]
        while self.squeeze and out.endswith(space):
            n = len(out) - len(space)
            end = at[n]
            del out[n:], at[n:]
        return bytes(out), np.array([*at, end], np.int64)

    # ---- encoding

    def merge(self, segment: str) -> list[int]:
        """BPE of one segment: the adjacent pair whose piece scores most, leftmost first, until none is a piece."""
        parts = list(segment)
        while len(parts) > 1:
            scored = [(self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.id_of.get(parts[k] + parts[k + 1])) is not None]
            if not scored:
                break
            k = -max(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        ids: list[int] = []
        for p in parts:
            if (i := self.id_of.get(p)) is not None:
                ids.append(i)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in p.encode())
            else:
                ids.append(self.unknown)
        return ids

    def segments(self, text: str) -> list[str]:
        """The normalised text, split before each run of word marks."""
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", self.normalize(text)[0].decode("utf-8", "replace"))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; with an identity character map the library merges, else the segments' own merges do."""
        if self.plain:
            return self.lib.encode(texts, num_threads=1)
        out = []
        for text in texts:
            ids: list[int] = []
            for s in self.segments(text):
                if s not in self.known:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[s] = self.merge(s)
                ids += self.known[s]
            out.append(ids)
        return out

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """[begin, end) of each piece in the bytes of the original text, as an array of two columns."""
        _, at = self.normalize(text)
        width = self.width[np.array(ids, np.int64)]
        ends = np.cumsum(width)
        return np.stack([at[ends - width], at[ends]], 1)

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a path, once a process."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, with_ids: bool = True, with_spans: bool = True) -> DataFrame:
    """docs' doc_id, n_tokens, ids_sha256, decoded_sha256 and span_crc32; with_ids adds ids, with_spans begins and ends.

    ids are array<int>; begins and ends are byte offsets (array<int>) into the original UTF-8 text. span_crc32 is the
    unsigned crc32 of the (begin, end) pairs as little-endian 64-bit integers. Texts go through Arrow in small batches, so
    a worker holds one batch and the bounded memory of segments.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("span_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if with_spans:
        fields += [T.StructField("begins", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                columns: list[list] = [[] for _ in fields[1:]]
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for text, ids in zip(texts, m.encode_batch(texts), strict=True):
                    spans = m.spans(text, ids)
                    row = [len(ids), hashlib.sha256(m.decimal(ids).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest(), zlib.crc32(spans.astype("<i8").tobytes())]
                    row += [np.array(ids, np.int32)] if with_ids else []
                    row += [spans[:, 0].astype(np.int32), spans[:, 1].astype(np.int32)] if with_spans else []
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.list_(pa.int32())] * (len(columns) - 4)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
