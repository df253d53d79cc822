"""Best-fit packing by bin completion.

Documents become token pieces of at most ``capacity`` tokens.  The plan needs
only how many pieces there are of each length (at most ``capacity`` numbers,
whatever the input), so it is made once from that histogram:

* best-fit decreasing gives the first incumbent;
* bin completion takes the longest piece left and enumerates the undominated
  fillings of the room beside it, least waste first, and goes depth first.  A
  branch is cut when its waste so far leaves no plan better than the incumbent
  (``waste > (incumbent - 1) * capacity - total``).  The first descent takes
  the best filling everywhere and is an incumbent of its own;
* the search ends at the bound ``ceil(total / capacity)`` (or the bound for
  pieces over half a sequence), or after ``SEARCH_NODES`` nodes.

Equal pieces are interchangeable, so a filling is applied to as many sequences
at once as its lengths allow; each application uses up some length.  Pieces are
numbered within their length in Spark (salted, so a hot length is split) and
read their sequence and offset from the plan.

Defined results: a null text is an empty one and still has the end id; an empty
table gives an empty table; repeated rows are packed one by one.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varlens.llm.common import stored

CAPACITY = 4096
#: Nodes of the branch-and-bound over whole plans after its first descent.
SEARCH_NODES = 400
#: Nodes of one enumeration of fillings, and fillings kept per enumeration.
FILL_NODES, FILLINGS = 300, 4
#: Words, and parts of words, that a Python worker remembers at least; twice as many at most.
CACHE_WORDS = 300_000
#: Parts into which the numbering of one length is split.
SALTS = 64


# ---------------------------------------------------------------- tokens

class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never joins across
    it: words between blanks, tabs and line ends are encoded once and kept as
    packed little-endian unsigned 32-bit ids.

    The tokenizer lower-cases and then merges inside letter runs, single digits,
    runs of other signs and the contractions of ``PARTS`` only.  A word of ASCII
    and Latin letters is cut into those here, and each part is encoded once by
    the tokenizer; any other word, and one that may hold a special token, is
    given to it whole."""

    #: What the tokenizer's pre-tokenizer matches, for the characters of ``PLAIN``.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u017f]+")
    #: Words of printable ASCII and composed Latin letters (not U+0130, whose lower case has a mark).
    PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.older = {"": b""}, {}  # words met lately, and before that
        self.parts, self.older_parts = {}, {}
        self.cache_words = cache_words
        #: By id: the token ends a part (None if the model does not mark ends).
        model = json.loads(self.tokenizer.to_str())["model"]
        mark, self.ends = model.get("end_of_word_suffix"), None
        if mark:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True

    @staticmethod
    def _recall(wanted: set[str], older: dict[str, bytes], into: dict[str, bytes]) -> None:
        """Moves what the older words hold of ``wanted`` to the later ones."""
        known = wanted.intersection(older) if older else set()
        for w in known:
            into[w] = older[w]
        wanted.difference_update(known)

    def _learn(self, texts: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(texts), 1024):
            part = texts[at:at + 1024]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                into[w] = np.array(e.ids, "<u4").tobytes()

    def _learn_parts(self, texts: list[str], into: dict[str, bytes]) -> None:
        """As ``_learn`` for parts, which the tokenizer cuts apart at blanks: a run
        of them is encoded as one text and cut behind the tokens that end a
        part; if those are not one a part, each part is encoded by itself."""
        for at in range(0, len(texts), 1024):
            part = texts[at:at + 1024]
            if self.ends is not None:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) == len(part) and cuts[-1] == 4 * len(ids):
                    raw = ids.tobytes()
                    for w, start, stop in zip(part, [0, *cuts], cuts):
                        into[w] = raw[start:stop]
                    continue
            self._learn(part, into)

    def _packed(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words."""
        if len(self.cache) > self.cache_words:
            self.cache, self.older = {"": b""}, self.cache
        if len(self.parts) > self.cache_words:
            self.parts, self.older_parts = {}, self.parts
        cache, parts = self.cache, self.parts
        packed = list(map(cache.get, words))
        missing = [i for i, p in enumerate(packed) if p is None]
        new = {words[i] for i in missing}
        self._recall(new, self.older, cache)
        plain = {w for w in new if w.isascii() and w.isalpha() and w.islower()}  # one part each, and itself
        self._learn_parts(sorted(plain), cache)
        new -= plain
        cut = {w: self.PARTS.findall(w.lower()) for w in new if self.PLAIN.fullmatch(w) and "<|" not in w}
        wanted = set().union(*cut.values()).difference(parts) if cut else set()
        self._recall(wanted, self.older_parts, parts)
        self._learn_parts(sorted(wanted), parts)
        for w, found in cut.items():
            cache[w] = b"".join([parts[p] for p in found])
        self._learn(sorted(new.difference(cut)), cache)
        for i in missing:
            packed[i] = cache[words[i]]
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text: the texts' distinct words are looked up once
        and their ids gathered by place."""
        split = pc.split_pattern(pa.array([t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        packed = self._packed(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = words.indices.to_numpy()
        counts = sizes[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.frombuffer(b"".join(packed), "<u4")[np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def shared_encoder(path: str) -> WordEncoder:
    """The Python worker's encoder, with the words it has met in earlier tasks.
    The worker encodes in one thread; Spark runs the tasks in parallel."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ``ids``,
    an array of int, with ``keep_ids``)."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
              *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        for batch in batches:
            ids, texts, at, held = batch.column(0), batch.column(1), 0, 0
            group: list[str] = []
            for i in range(len(texts)):
                group.append(texts[i].as_py() or "")
                held += len(group[-1])
                if held < 1 << 21 and i + 1 < len(texts):
                    continue
                out: list[list] = [[] for _ in range(6)]
                for j, packed in enumerate(encoder.encode(group)):
                    packed += end
                    n = len(packed) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        part = packed[4 * start:4 * (start + capacity)]
                        for column, v in zip(out, (at + j, k, start, len(part) // 4, zlib.crc32(part))):
                            column.append(v)
                        if keep_ids:
                            out[5].append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
                if keep_ids:
                    columns.append(pa.array(out[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
                at, held, group = i + 1, 0, []

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


# ---------------------------------------------------------------- plan

class Pattern(NamedTuple):
    """``times`` sequences, each holding ``count`` pieces of each ``length``."""
    times: int
    items: tuple[tuple[int, int], ...]


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences needed at least: by tokens, or, for each k, one for each piece
    over capacity - k, plus what the pieces between k and that can't share."""
    total = sum(n * length for length, n in enumerate(counts))
    best = math.ceil(total / capacity)
    above = [0] * (capacity + 2)
    tokens = [0] * (capacity + 2)
    for length in range(capacity, 0, -1):
        above[length] = above[length + 1] + counts[length]
        tokens[length] = tokens[length + 1] + counts[length] * length
    half = capacity // 2
    for k in range(1, half + 1):
        large = above[capacity - k + 1]
        middle_n = above[half + 1] - large
        middle_tokens = tokens[half + 1] - tokens[capacity - k + 1]
        small_tokens = tokens[k] - tokens[half + 1]
        best = max(best, large + middle_n + max(0, math.ceil((small_tokens - (middle_n * capacity - middle_tokens)) / capacity)))
    return best


def best_fit_decreasing(counts: list[int], capacity: int) -> list[Pattern]:
    """Longest first into the open sequence with the least room that fits; like
    sequences are kept as one pattern with a multiplicity."""
    open_: dict[int, list[Pattern]] = {}
    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            room = next((r for r in range(length, capacity) if open_.get(r)), None)
            if room is None:
                per = capacity // length
                whole, rest = divmod(left, per)
                if whole:
                    open_.setdefault(capacity - per * length, []).append(Pattern(whole, ((length, per),)))
                if rest:
                    open_.setdefault(capacity - rest * length, []).append(Pattern(1, ((length, rest),)))
                break
            p = open_[room].pop()
            if left < p.times:
                open_[room].append(Pattern(p.times - left, p.items))
                open_.setdefault(room - length, []).append(Pattern(left, _with(p.items, length, 1)))
                break
            per = min(room // length, left // p.times)
            open_.setdefault(room - per * length, []).append(Pattern(p.times, _with(p.items, length, per)))
            left -= per * p.times
    return [p for ps in open_.values() for p in ps]


def _with(items: tuple[tuple[int, int], ...], length: int, n: int) -> tuple[tuple[int, int], ...]:
    own = dict(items)
    own[length] = own.get(length, 0) + n
    return tuple(own.items())


def fillings(counts: list[int], lengths: list[int], room: int, nodes: int = FILL_NODES, keep: int = FILLINGS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(waste, items) of undominated fillings of ``room``, least waste first.

    ``lengths``: lengths in stock, ascending.  The longest piece that fits is
    always tried first, and the last piece of a filling is the longest that
    fits.  A filling is dominated if one of its pieces could be exchanged for a
    longer one in stock that still fits."""
    from bisect import bisect_right
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    best = room + 1
    left = nodes
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(bisect_right(lengths, room) - 1, room, ())]
    while stack and left > 0:
        at, free, items = stack.pop()
        left -= 1
        at = min(at, bisect_right(lengths, free) - 1)
        if at < 0:  # nothing more fits
            if free < best or len(found) < keep:
                used = dict(items)
                dominated = any((j := bisect_right(lengths, length + free) - 1) >= 0 and lengths[j] > length
                                and counts[lengths[j]] > used.get(lengths[j], 0) for length in used) if free else False
                if not dominated:
                    found.append((free, items))
                    best = min(best, free)
                    if not free:
                        break
            continue
        length = lengths[at]
        most = min(counts[length], free // length)
        if at > 0:
            stack.append((at - 1, free, items))  # without this length
        for n in ([1, most] if most > 1 else [most]):
            stack.append((at - 1, free - n * length, (*items, (length, n))))
    found.sort(key=lambda f: (f[0], len(f[1])))
    return found[:keep] or [(room, ())]


def plan(counts: list[int], capacity: int = CAPACITY, search_nodes: int = SEARCH_NODES) -> list[Pattern]:
    """Patterns that hold every piece of the histogram ``counts[length]``."""
    from bisect import bisect_left
    total = sum(n * length for length, n in enumerate(counts))
    bound = lower_bound(counts, capacity)
    incumbent = best_fit_decreasing(counts, capacity)
    size = sum(p.times for p in incumbent)
    stock = list(counts)
    lengths = [i for i in range(1, capacity + 1) if stock[i]]
    path: list[tuple[Pattern, int, list, int]] = []  # pattern, waste before, other fillings, longest piece
    waste = used = 0
    nodes = 0
    options: list | None = None
    descended = False

    def take(items, sign):
        for length, n in items:
            before = stock[length]
            stock[length] -= sign * n
            if before == 0:
                lengths.insert(bisect_left(lengths, length), length)
            elif stock[length] == 0:
                del lengths[bisect_left(lengths, length)]

    while size > bound:
        if lengths:
            if options is None:
                longest = lengths[-1]
                take(((longest, 1),), 1)
                options = fillings(stock, lengths, capacity - longest)
                take(((longest, 1),), -1)
            dead = True
            while options:
                w, items = options.pop(0)
                whole = _with(items, longest, 1)
                times = min(stock[length] // n for length, n in whole)
                if waste + w <= (size - 1) * capacity - total or not descended:
                    pattern = Pattern(times, whole)
                    path.append((pattern, waste, options, longest))
                    take([(length, n * times) for length, n in whole], 1)
                    waste += w * times
                    used += times
                    options, dead = None, False
                    break
            nodes += descended
        else:
            descended = True
            if used < size:
                incumbent, size = [p for p, *_ in path], used
            dead = True
        if dead:
            descended = True
            if not path or nodes >= search_nodes:
                break
            pattern, waste, options, longest = path.pop()
            used -= pattern.times
            take([(length, n * pattern.times) for length, n in pattern.items], -1)
            nodes += 1
    return incumbent


class Places:
    """The plan as arrays: for each length, ranges of ranks with the first
    sequence, the pieces per sequence and the offset of the first of them."""

    def __init__(self, patterns: list[Pattern], capacity: int = CAPACITY):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for p in patterns:
            offset = 0
            for length, n in p.items:
                rank = used.get(length, 0)
                rows.setdefault(length, []).append((rank, sequence, n, offset))
                used[length] = rank + n * p.times
                offset += n * length
            sequence += p.times
        self.sequences = sequence
        self.rows = {length: np.array(r, np.int64).T for length, r in rows.items()}

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, per, offset = self.rows[length]
        i = np.searchsorted(first, rank, "right") - 1
        j = rank - first[i]
        return base[i] + j // per[i], offset[i] + j % per[i] * length


def ranked(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, 2 ... within each length.  Each length is
    split into ``salts`` parts by a hash of the piece, numbered part by part."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most ``salts`` rows
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    return (salted.withColumn("at", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
            .withColumn("rank", F.col("first") + F.col("at")).drop("salt", "first", "at"))


def pack(rows: DataFrame, capacity: int = CAPACITY, search_nodes: int = SEARCH_NODES) -> DataFrame:
    """``rows`` (pieces) with ``sequence_id`` and ``offset``."""
    rows = stored(rows)  # tokens are made once
    counts = [0] * (capacity + 1)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    shared = rows.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity, search_nodes), capacity))
    names = rows.columns
    out = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    sequence[own], offset[own] = shared.value.find(int(length[own[0]]), rank[own])
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked(rows).mapInArrow(place, out)


