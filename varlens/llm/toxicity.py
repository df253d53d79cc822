"""Toxicity by a bag of subword embeddings and a linear softmax.

A word's vector is the mean of the vectors of its byte n-grams (``GRAMS``, with
word boundaries) and of the word itself, hashed into ``BUCKETS`` rows, so an
unseen misspelling shares most of its vector with the word it came from.  A
window of ``WINDOW`` words is the mean of its words' vectors; a linear softmax
over two classes turns it into a probability.  A text is as toxic as its most
toxic window, so a short passage counts in a long text.  Embeddings and softmax
are trained jointly in numpy (Adam, full batches) on the texts' labels: the
first rounds through a soft maximum over a text's windows, the last through the
maximum itself.  Only n-grams whose shares of toxic and of other texts differ
clearly get a vector (``LEAST_Z``); the others' is zero.

Learning reads at most about ``SAMPLE_PER_CLASS`` labelled rows per class,
chosen by a hash of their id.

Windows overlap by half.  As the softmax is linear in the vectors, a word's
share of the logit is one number, computed once per word and kept.

Defined results: a null or empty text gets the score of the bias alone; without
both classes to learn from every score is 0; a conflicting or repeated label
counts as toxic if any of its rows says so; repeated rows give repeated results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows learned from, per class.
SAMPLE_PER_CLASS = 1500
BUCKETS, DIM, GRAMS, WINDOW, STEP = 1 << 18, 8, (3, 4, 5, 6), 128, 64
ROUNDS, RATE, DECAY = 150, 0.05, 1e-5
#: Standard errors by which an n-gram's shares of toxic and other texts differ at least.
LEAST_Z = 4.5
#: Words whose share of the logit a Python worker remembers.
CACHE_WORDS = 500_000
#: Longest word taken in whole into the n-grams; a longer one is cut into such parts.
WORD_BYTES = 64

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII bytes, A-Z lower-cased; very long
    runs are cut into parts of ``WORD_BYTES``."""
    out = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if any(len(w) > WORD_BYTES for w in out):
        out = [w[i:i + WORD_BYTES] for w in out for i in range(0, len(w), WORD_BYTES)]
    return out


def grams(word: bytes) -> list[int]:
    """Bucket numbers of the word itself and of its n-grams."""
    w = b"<" + word + b">"
    found = {w}
    for n in GRAMS:
        found.update([w[i:i + n] for i in range(len(w) - n + 1)])
    return [zlib.crc32(g) % BUCKETS for g in sorted(found)]


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words."""
    return np.arange(0, max(1, n - WINDOW + STEP), STEP)


class Model:
    """A text's score needs only each bucket's share of the logit and the bias."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share.astype(np.float32), bias

    def word(self, word: bytes) -> float:
        return float(self.share[grams(word)].mean())

    def score(self, text: str | None, cache: dict[bytes, float]) -> float:
        own = words(text)
        if not own:
            return float(1 / (1 + np.exp(-self.bias)))
        for w in set(own).difference(cache):
            cache[w] = self.word(w)
        part = np.fromiter(map(cache.__getitem__, own), np.float64, len(own))
        sums = np.concatenate([[0.0], np.cumsum(part)])
        start = windows(len(own))
        end = np.minimum(start + WINDOW, len(own))
        logit = float(((sums[end] - sums[start]) / (end - start)).max()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


class _Sparse:
    """Rows of weighted columns; products with dense matrices both ways."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.by_row = self._side(rows, columns, weights)
        self.by_column = self._side(columns, rows, weights)

    @staticmethod
    def _side(key, other, weights):
        order = np.argsort(key, kind="stable")
        keys, starts = np.unique(key[order], return_index=True)
        return keys, starts, other[order], weights[order, None].astype(np.float32)

    @staticmethod
    def _sum(side, dense, n):
        keys, starts, other, weights = side
        out = np.zeros((n, dense.shape[1]), np.float32)
        if len(keys):
            out[keys] = np.add.reduceat(dense[other] * weights, starts, axis=0)
        return out

    def times(self, dense: np.ndarray) -> np.ndarray:
        return self._sum(self.by_row, dense, self.shape[0])

    def transposed_times(self, dense: np.ndarray) -> np.ndarray:
        return self._sum(self.by_column, dense, self.shape[1])


def telling(texts: list[list[bytes]], y: np.ndarray, least: float = LEAST_Z) -> np.ndarray:
    """Buckets whose share of toxic texts and of other texts differ by at least
    ``least`` standard errors; the others would only memorise single texts."""
    in_toxic, in_other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    known: dict[bytes, list[int]] = {}
    for own, toxic in zip(texts, y):
        found: set[int] = set()
        for w in set(own):
            if w not in known:
                known[w] = grams(w)
            found.update(known[w])
        (in_toxic if toxic else in_other)[list(found)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    p = (in_toxic + in_other) / len(y)
    z = (in_toxic / n1 - in_other / n0) / np.sqrt(np.maximum(p * (1 - p), 0.5 / len(y) ** 2) * (1 / n1 + 1 / n0))
    return np.flatnonzero(np.abs(z) >= least)


def train(texts: list[list[bytes]], labels: list[int], rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Joint training on texts given as lists of words."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), -50.0)
    buckets = telling(texts, y)
    row = {b: i for i, b in enumerate(buckets.tolist())}
    vocabulary: dict[bytes, int] = {}  # words that hold a telling n-gram
    parts: list[tuple[int, int, float]] = []  # word, bucket's row, weight
    other: set[bytes] = set()
    bag: list[tuple[int, int, float]] = []  # window, word, weight
    first = [0]
    for own in texts:
        start = windows(len(own))
        for i, w in enumerate(own):
            if w in other:
                continue
            if w not in vocabulary:
                of = grams(w)
                held = [row[g] for g in of if g in row]
                if not held:
                    other.add(w)
                    continue
                parts += [(len(vocabulary), g, 1 / len(of)) for g in held]
                vocabulary[w] = len(vocabulary)
            for k in range(max(0, i // STEP - WINDOW // STEP + 1), min(len(start), i // STEP + 1)):
                bag.append((first[-1] + k, vocabulary[w], 1 / min(WINDOW, len(own) - start[k])))
        first.append(first[-1] + len(start))
    starts = np.array(first[:-1])
    text_of = np.repeat(np.arange(len(y)), np.diff(first))
    columns = lambda rows: [np.array(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    bags = _Sparse(*columns(bag), (first[-1], max(1, len(vocabulary))))
    mean = _Sparse(*columns(parts), (max(1, len(vocabulary)), max(1, len(buckets))))

    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.1, (max(1, len(buckets)), DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for step in range(1, rounds + 1):
        average = bags.times(mean.times(p[0])) * WINDOW
        logits = average @ p[1] + p[2]
        gap = logits[:, 1] - logits[:, 0]
        sharpness = 1 if step < rounds // 3 else 4 if step < 2 * rounds // 3 else 50
        soft = np.exp((gap - np.maximum.reduceat(gap, starts)[text_of]) * sharpness)
        soft /= np.add.reduceat(soft, starts)[text_of]
        z = np.add.reduceat(soft * gap, starts)
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        d_gap = (error[text_of] * soft).astype(np.float32)
        d_logits = np.stack([-d_gap, d_gap], 1)
        gradients = [mean.transposed_times(bags.transposed_times(d_logits @ p[1].T * WINDOW)) + DECAY * p[0],
                     average.T @ d_logits + DECAY * p[1], d_logits.sum(0)]
        for i, g in enumerate(gradients):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    share = np.zeros(BUCKETS)
    if len(buckets):
        share[buckets] = WINDOW * (p[0] @ (p[1][:, 1] - p[1][:, 0]))
    return Model(share, float(p[2][1] - p[2][0]))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[list[bytes], int]]:
    """Words and label of the sampled rows.  Texts are turned into counted words
    in the executors; only the bounded sample reaches the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, totals.get(1, 0)))).otherwise(min(1.0, per_class / max(1, totals.get(0, 0))))
    chosen = known.where((place < share) & F.col("toxic").isin(0, 1))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about 2 x per_class rows

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(words(t)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), batch.column(batch.schema.get_field_index("toxic")),
                                              batch.column(batch.schema.get_field_index("doc_id"))], names=["words", "toxic", "doc_id"])

    schema = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("toxic", T.IntegerType()), rows.schema["doc_id"]])
    found = rows.mapInArrow(split, schema).collect()
    return [(bytes(r["words"]).split(), r["toxic"]) for r in sorted(found, key=lambda r: (r["doc_id"], bytes(r["words"])))]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, rounds: int = ROUNDS) -> Model:
    rows = sample(docs, labels, per_class)
    return train([w for w, _ in rows], [y for _, y in rows], rounds)


_SHARES: dict[int, dict[bytes, float]] = {}


def word_shares(stamp: int) -> dict[bytes, float]:
    """The Python worker's shares of the words it has met under one model."""
    if stamp not in _SHARES:
        _SHARES.clear()
        _SHARES[stamp] = {}
    return _SHARES[stamp]


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    stamp = zlib.crc32(model.share.tobytes())
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_shares(stamp)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            scores = np.empty(len(texts))
            for i in range(len(texts)):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                scores[i] = shared.value.score(texts[i].as_py(), cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             names=[*batch.schema.names, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))
