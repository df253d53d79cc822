"""Offset-preserving SentencePiece BPE encoding and decoding.

The text is normalised by the model's compiled character map: at each place the
longest prefix the map holds is replaced, anything else is copied one code
point at a time, and every normalised byte records the source byte it came
from.  White space is then escaped (U+2581) and a leading one added, as the
model says.  Byte-pair merging runs over the normalised text: of all adjacent
symbols whose join is a piece, the one with the highest score (the leftmost of
equals) is merged first.  Symbols that are no piece fall back to byte pieces.
The alignment projects the end of every piece back to source bytes, so each id
carries the span of the original text it stands for.

No piece has white space after another character, and no piece holds a line
feed (both are checked when the model is loaded; otherwise the text is not
split).  Merges therefore never cross from one word into the next, and a word's
pieces are worked out once and kept.

Defined results: a null text is an empty one (no ids, empty decoding); repeated
rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Words a Python worker remembers at least (twice as many at most), and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 250_000, 48
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            if key & 7 == 2:
                n, i = varint(i)
            else:
                n = 8 if key & 7 == 1 else 4
            value, i = data[i:i + n], i + n
        yield key >> 3, value


def read_character_map(blob: bytes) -> dict[bytes, bytes]:
    """The rules of a compiled character map: a 32-bit size, a double-array trie
    of that many bytes, then the replacements, each ended by a zero byte.  A
    unit of the trie holds its label (low byte), whether a value hangs below it
    (bit 8) and the offset to its children (from bit 10, scaled if bit 9 is set)."""
    if len(blob) < 4:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
    texts = blob[4 + size:]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    out: dict[bytes, bytes] = {}
    stack = [(0, b"")]
    while stack:
        at, prefix = stack.pop()
        unit = units[at]
        base = at ^ offset(unit)
        if prefix and (unit >> 8) & 1:
            start = units[base] & 0x7FFFFFFF
            out[prefix] = texts[start:texts.index(b"\0", start)]
        for label in range(1, 256):
            child = base ^ label
            if child < len(units) and units[child] & 0x800000FF == label:
                stack.append((child, prefix + bytes([label])))
    return out


class Normalizer:
    """Longest-prefix rewriting with source alignment."""

    def __init__(self, rules: dict[bytes, bytes], dummy_prefix: bool = True, remove_extra: bool = False, escape: bool = True):
        self.rules, self.dummy_prefix, self.remove_extra = rules, dummy_prefix, remove_extra
        self.space = SPACE.encode() if escape else b" "
        self.longest: dict[int, int] = {}  # by first byte
        for key in rules:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and for the end) the offset of
        the source byte it came from."""
        if not self.rules and not self.remove_extra:
            if not source:
                return b"", np.zeros(1, np.int64)
            raw = np.frombuffer(source, np.uint8)
            lead = len(self.space) if self.dummy_prefix else 0
            width = np.where(raw == 32, len(self.space), 1)
            align = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]])
            return (self.space if lead else b"") + source.replace(b" ", self.space), align
        parts: list[tuple[bytes, int, int]] = []  # replacement, source start and end
        i = 0
        while i < len(source):
            n = next((n for n in range(min(self.longest.get(source[i], 0), len(source) - i), 0, -1) if source[i:i + n] in self.rules), 0)
            if n:
                parts.append((self.rules[source[i:i + n]], i, i + n))
            else:
                b = source[i]
                n = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                parts.append((source[i:i + n], i, i + n))
            i += n
        if self.remove_extra:
            kept: list[tuple[bytes, int, int]] = []
            for part in parts:
                text = part[0]
                if not kept or kept[-1][0].endswith(b" "):
                    text = text.lstrip(b" ")
                if text:
                    kept.append((text, part[1], part[2]))
            while kept and kept[-1][0].endswith(b" "):
                text = kept[-1][0].rstrip(b" ")
                kept[-1:] = [(text, *kept[-1][1:])] if text else []
            parts = kept
        out, align = bytearray(), []
        if self.dummy_prefix and parts:
            out += self.space
            align += [parts[0][1]] * len(self.space)
        for text, start, _ in parts:
            text = text.replace(b" ", self.space)
            out += text
            align += [start] * len(text)
        return bytes(out), np.array([*align, parts[-1][2] if parts else 0], np.int64)


class Word(NamedTuple):
    ids_text: bytes   # decimal ids joined by commas
    widths: bytes     # normalised bytes of each piece, packed
    surface: bytes    # what the ids decode to


class Codec:
    """Encoder and decoder read from a model file's bytes."""

    def __init__(self, model: bytes, cache_words: int = CACHE_WORDS):
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        norm: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 3:
                norm = dict(_fields(value))
        if any(t in (USER_DEFINED, UNUSED) for t in self.types):
            raise ValueError("user-defined and unused pieces are not supported")
        self.normalize = Normalizer(read_character_map(norm.get(2, b"")), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        # a piece's part of a word: id in decimal, packed width, what it decodes to
        self.known = {p: (str(i).encode(), struct.pack("<I", len(p.encode())), p.replace(SPACE, " ").encode()) for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.words = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if apart else r"(?s:.+)").findall
        self.cache: dict[str, Word] = {}  # words met lately, and before that
        self.older: dict[str, Word] = {}
        self.cache_words = cache_words

    def merge(self, text: str) -> list[str]:
        """Symbols of ``text`` after all merges."""
        rank = self.rank
        parts = list(text)
        if len(parts) <= 32:
            get, none = rank.get, math.inf
            ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]  # of each pair of neighbours
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                parts[i:i + 2] = [joined := parts[i] + parts[i + 1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get(joined + parts[i + 1], none)
                if i:
                    ranks[i - 1] = get(parts[i - 1] + joined, none)
            return parts
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap = [(rank[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := joined + parts[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := parts[h] + joined) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [p for p in parts if p]

    def encode_word(self, text: str) -> Word:
        parts = self.merge(text)
        try:
            return Word(*map(bytes.join, (b",", b"", b""), zip(*[self.known[p] for p in parts])))
        except KeyError:
            return self._with_unknown(parts)

    def _with_unknown(self, parts: list[str]) -> Word:
        ids: list[int] = []
        widths: list[int] = []
        for p in parts:
            raw = p.encode()
            if p in self.ids:
                ids.append(self.ids[p])
                widths.append(len(raw))
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in raw]
                widths += [1] * len(raw)
            else:
                ids.append(self.unknown)
                widths.append(len(raw))
        return Word(",".join(map(str, ids)).encode(), np.array(widths, "<u4").tobytes(), self.surface(ids))

    def surface(self, ids: list[int]) -> bytes:
        out = bytearray()
        for i in ids:
            if self.types[i] == BYTE:
                out.append(int(self.pieces[i][3:5], 16))
            elif self.types[i] == NORMAL:
                out += self.pieces[i].replace(SPACE, " ").encode()
            elif self.types[i] == UNKNOWN:
                out += " ⁇ ".encode()
        return bytes(out)

    def decode(self, ids: list[int]) -> str:
        return self._unprefixed(self.surface(ids)).decode("utf-8", "replace")

    def _unprefixed(self, raw: bytes) -> bytes:
        return raw[1:] if self.normalize.dummy_prefix and raw[:1] == b" " else raw

    def encode(self, text: str) -> tuple[bytes, np.ndarray, bytes]:
        """(decimal ids joined by commas, spans as rows of source byte start and
        end, decoded text in UTF-8) of a whole text."""
        normal, align = self.normalize(text.encode())
        if len(self.cache) > self.cache_words:
            self.cache, self.older = {}, self.cache
        cache, older, words = self.cache, self.older, []
        for w in self.words(normal.decode()):
            word = cache.get(w)
            if word is None:
                word = older.get(w) or self.encode_word(w)
                if len(w) <= CACHE_LENGTH:
                    cache[w] = word
            words.append(word)
        ends = np.cumsum(np.frombuffer(b"".join([w.widths for w in words]), "<u4"), dtype=np.int64)
        spans = np.empty((len(ends), 2), np.int64)
        if len(ends):
            spans[:, 1] = align[ends]
            spans[0, 0] = align[0]
            spans[1:, 0] = spans[:-1, 1]
        decoded = self._unprefixed(b"".join([w.surface for w in words]))
        return b",".join([w.ids_text for w in words]), spans, decoded


def _codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


_CODECS: dict[str, Codec] = {}


def shared_codec(path: str) -> Codec:
    """The Python worker's codec, with the words it has met in earlier tasks."""
    if path not in _CODECS:
        _CODECS[path] = _codec(path)
    return _CODECS[path]


def _mapped(docs: DataFrame, model_path: str, row, added: list[T.StructField], types: list[pa.DataType]) -> DataFrame:
    names = [f.name for f in added]
    kept = docs.select(*[c for c in docs.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(model_path)
        for batch in batches:
            texts, start, held, out = batch.column(batch.schema.get_field_index("text")), 0, 0, []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                out.append(row(codec, text))
                held += len(text)
                if held > 1 << 22 or i + 1 == len(texts):
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                    part = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])
                    start, held, out = i + 1, 0, []

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ``ids`` and ``spans`` (source byte start and end of each id,
    flat) and ``decoded``.  ``model_path`` must be readable on every executor."""
    def row(codec: Codec, text: str):
        ids, spans, decoded = codec.encode(text)
        return np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32), spans.ravel(), decoded.decode("utf-8", "replace")

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]
    return _mapped(docs, model_path, row, fields, [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()])


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with n_tokens, and the sha256 of the ids, of the decoded text, and
    the crc32 of the spans, made where the text is encoded."""
    def row(codec: Codec, text: str):
        ids, spans, decoded = codec.encode(text)
        return len(spans), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), zlib.crc32(spans.astype("<u4").tobytes())

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_crc32", T.LongType())]
    return _mapped(docs, model_path, row, fields, [pa.int64(), pa.string(), pa.string(), pa.int64()])
