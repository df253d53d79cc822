"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts (order 0 to 3) holds
the counts of the following byte.  Statistics are frozen after learning.  In a
context seen T times with q distinct followers, a follower seen n times costs
-log2(n / (T + q)) bits; any other byte costs the escape -log2(q / (T + q))
plus its cost in the next shorter context, down to 256 equally likely bytes
(escape method C without exclusions).  The language whose tree codes the whole
text in the fewest bits wins.

Every context of the sample has its node and every byte is coded as itself.  The
cost of each (context, byte) that was seen is computed once from the frozen
counts and kept as a sparse row; one that was not seen is the escapes of its
contexts plus the cost in the longest context that has it.

Learning reads about ``SAMPLE_ROWS`` labelled rows per language, chosen by a
hash of their id; their n-gram counts are aggregated in Spark.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with nothing learned every row is ``und``; ties go to the first language in
order; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows learned from, per language.
SAMPLE_ROWS = 800
ORDER = 3
LETTER = re.compile(r"[^\W\d_]")
PAD = b"   "


def ngram_counts(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, gram, n): counts of all byte 4-grams of the sampled labelled rows'
    whole texts, lower-cased, each text preceded by three spaces."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / n))).otherwise(share)
    place = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.lit(0)) / F.lit(float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = np.frombuffer(PAD + text.lower().encode(), np.uint8).astype(np.uint32)
                grams, n = np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_counts=True)
                own = found.setdefault(lang, Counter())
                for g, k in zip(grams.tolist(), n.tolist()):
                    own[g] += k
        for lang, own in found.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "gram": list(own), "n": list(own.values())})

    return (rows.where(place < share).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in ``sorted_keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Model:
    """Frozen trees: per seen 3-gram and 4-gram (codes of bytes that occur, in
    base ``size``; bytes that never occur share the last code, as they cost the
    same) the bits of its last byte in each language."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        if not self.langs:
            return
        index = {lang: i for i, lang in enumerate(self.langs)}
        lang = np.array([index[x] for x, _, _ in counts])
        grams = np.array([g for _, g, _ in counts], np.int64)
        n = np.array([k for _, _, k in counts], np.float64)
        occurs = np.unique(np.concatenate([(grams >> s) & 255 for s in (24, 16, 8, 0)]))
        self.size = size = len(occurs) + 1
        self.codes = np.full(256, size - 1, np.int64)
        self.codes[occurs] = np.arange(len(occurs))
        a, b, c, d = (self.codes[(grams >> s) & 255] for s in (24, 16, 8, 0))

        def summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distinct keys and their counts by language."""
            distinct, at = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(at * len(self.langs) + lang, n, len(distinct) * len(self.langs)).reshape(-1, len(self.langs))

        def coded(n_of: np.ndarray, context: np.ndarray, n_contexts: int, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Probability of each gram's last byte, and each context's escape;
            ``context``: places of the grams' contexts."""
            total, distinct = np.zeros((n_contexts, n_of.shape[1])), np.zeros((n_contexts, n_of.shape[1]))
            np.add.at(total, context, n_of)
            np.add.at(distinct, context, n_of > 0)
            whole = np.maximum(total + distinct, 1)
            escape = np.where(total > 0, distinct / whole, 1.0)
            return np.where(n_of > 0, n_of / whole[context], escape[context] * shorter), escape

        def dense(keys: np.ndarray, length: int) -> np.ndarray:
            distinct, found = summed(keys)
            out = np.zeros((length, len(self.langs)))
            out[distinct] = found
            return out

        p0, _ = coded(dense(d, size), np.zeros(size, int), 1, np.full((size, 1), 1 / 256))
        p1, _ = coded(dense(c * size + d, size ** 2), np.arange(size ** 2) // size, size, np.tile(p0, (size, 1)))
        self.grams3, n3 = summed((b * size + c) * size + d)
        p2, escape2 = coded(n3, self.grams3 // size, size ** 2, p1[self.grams3 % size ** 2])
        self.grams4, n4 = summed(((a * size + b) * size + c) * size + d)
        self.contexts, at = np.unique(self.grams4 // size, return_inverse=True)
        p3, escape3 = coded(n4, at, len(self.contexts), p2[_find(self.grams3, self.grams4 % size ** 3)[0]])
        bits = lambda p: -np.log2(p).astype(np.float32)
        self.bits1, self.bits2, self.bits3, self.escape2, self.escape3 = (bits(p) for p in (p1, p2, p3, escape2, escape3))

    def _costs(self, s: np.ndarray) -> np.ndarray:
        """Bits of ``s[3:]`` in each language, each code after the three before it."""
        size = self.size
        pair = s[2:-1] * size + s[3:]
        gram3 = s[1:-2] * size ** 2 + pair
        at, there = _find(self.grams4, s[:-3] * size ** 3 + gram3)
        rows = self.bits3[at]
        late = np.flatnonzero(~there)
        if len(late):
            at, known = _find(self.contexts, s[late] * size ** 2 + gram3[late] // size)
            missed = np.where(known[:, None], self.escape3[at], 0)
            at, there = _find(self.grams3, gram3[late])
            rows[late] = missed + np.where(there[:, None], self.bits2[at], self.escape2[gram3[late] // size] + self.bits1[pair[late]])
        return rows

    def bits(self, texts: list[bytes], block: int = 1 << 19) -> np.ndarray:
        """Code length in bits of each (lower-cased) text under each language;
        long runs are worked in blocks of bytes to bound memory."""
        data = b"".join(PAD + t for t in texts)
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + len(PAD))
        starts = ends - sizes
        for lo in range(0, len(data), block):
            hi = min(len(data), lo + block)
            first = max(0, lo - ORDER)
            s = self.codes[np.frombuffer(data[first:hi], np.uint8)]
            n = hi - max(lo, ORDER)
            if n <= 0:
                continue
            s = s[-(n + ORDER):]
            rows = self._costs(s)
            sums = np.zeros((n + 1, len(self.langs)))
            np.cumsum(rows, axis=0, dtype=np.float64, out=sums[1:])
            origin = hi - n
            t0, t1 = np.searchsorted(ends, origin, "right"), np.searchsorted(starts, hi, "left")
            a = np.clip(starts[t0:t1] - origin, 0, n)
            b = np.clip(ends[t0:t1] - origin, 0, n)
            out[t0:t1] += sums[b] - sums[a]
        return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows of ``docs``.  What comes to the driver are
    the counts of byte 4-grams of the bounded sample."""
    return Model([(r["lang"], r["gram"], r["n"]) for r in ngram_counts(docs, sample_rows).collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the winner's share of the
    languages' likelihoods 2^-bits)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample of each language
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            names, scores = ["und"] * len(column), np.zeros(len(column))
            group: list[tuple[int, bytes]] = []
            held = 0

            def flush():
                if group and m.langs:
                    bits = m.bits([t for _, t in group])
                    best = bits.argmin(1)
                    share = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                    for (i, _), b, p in zip(group, best.tolist(), share.tolist()):
                        names[i], scores[i] = m.langs[b], p
                group.clear()

            for i in range(len(column)):
                text = column[i].as_py()
                if text and LETTER.search(text):
                    low = text.lower().encode("utf-8", "surrogatepass")
                    group.append((i, low))
                    held += len(low)
                    if held > 1 << 20:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
