"""Language-model scoring with a log-bilinear model trained by noise contrast.

Tokens are words (A-Z lower-cased), then one end token per text.

Counts.  Every training token is counted in Spark.  At most ``FREQUENT`` of the
most frequent tokens go to the tasks with their counts; all others meet their
counts in a join, so no table of the whole vocabulary is ever in one place.

Classes.  The ``VOCABULARY`` most frequent tokens are classes of their own.  Any
other word belongs to one of ``TAILS`` classes by its last two bytes, and within
its class has probability (c + 1) / (N + V + 1), c its training count, N and V
the class's tokens and distinct words; the one in the denominator is for words
not seen.  So the model spreads exactly one over known words and, for each tail
class, one unseen word.

Encoding.  Texts are split twice, to count and to encode: the stored classes of
their tokens serve all rounds and the scores, the words outside the lexicon the join.

Model.  Two context classes a, b (the words before; a start class before the
first) predict the vector h = A*r_a + B*r_b, and class w scores h.q_w + b_w.  It
is trained in numpy with noise-contrastive estimation: each token against
``NOISE`` classes drawn from the unigram distribution, shared by a batch.  Every
partition that was encoded trains on all its training texts from the same start;
the parameters are averaged in Spark, weighted by tokens, and the average is the
start of the next round.  Scores are exact: the normaliser of a context is the sum over all
classes, from one matrix product per block of distinct contexts, each computed
once per Python worker.

Defined results: a null text is an empty one (its end token is scored); with no
training text N = V = 0; repeated rows are counted, and scored, one by one; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlens.llm.common import chunks, stored

FREQUENT, VOCABULARY, TAILS = 65_536, 1024, 128
DIM, NOISE, BATCH = 24, 64, 2048
ROUNDS, PASSES, RATE = 2, 2, 0.1
#: Tokens that a task gathers before it trains on or scores them, and bytes of text split at once.
BLOCK_TOKENS, SPLIT_BYTES = 200_000, 1 << 22
#: Bytes of words a task gathers before it counts them and passes the counts on.
COUNTED_BYTES = 24 << 20
#: The end token among the words; no word is empty.
END = b""


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@cache
def tail_classes() -> np.ndarray:
    """``tail_class`` of all words of two bytes, then of all of one."""
    pairs = [zlib.crc32(bytes([x, y])) % TAILS for x in range(256) for y in range(256)]
    return np.array([*pairs, *(zlib.crc32(bytes([x])) % TAILS for x in range(256))], np.int64)


def tails_of(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each of the (not empty) words."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.empty(0, np.uint8)
    ends, single = ends[1:], np.diff(ends) == 1
    last = data[ends - 1].astype(np.int64)
    return tail_classes()[np.where(single, 1 << 16, data[np.maximum(ends - 2, 0)].astype(np.int64) << 8) + last]


def split_words(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """The words of slices of the texts, about ``SPLIT_BYTES`` each: a slice's first
    text, its words as bytes, one after another, and their number in each text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for start, stop in chunks(sizes, sizes, SPLIT_BYTES):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(start, stop - start), "")))
        words = lists.flatten().cast(pa.binary())
        real = pc.greater(pc.binary_length(words), 0)  # a blank at an end of a text leaves an empty one
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        yield start, words.filter(real), np.diff(before[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c): tokens of the texts, the end token as an empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = ends = 0

        def counted():
            found = pc.value_counts(pa.chunked_array(held, pa.binary()))
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "c"])

        for batch in batches:
            ends += len(batch)
            for _, words, _ in split_words(batch.column(0)):
                held.append(words)
                size += words.nbytes
                if size > COUNTED_BYTES:
                    yield counted()
                    size, held = 0, []
        if size:
            yield counted()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Frequent tokens, their counts and classes; totals of the tail classes."""

    def __init__(self, frequent: list[tuple[bytes, int]], tail_tokens: np.ndarray, tail_words: np.ndarray, tokens: int, words: int):
        """``frequent``: by count, highest first; the first ``VOCABULARY`` are
        classes.  ``tail_tokens``, ``tail_words``: of all words by their tail class."""
        self.tokens, self.words = tokens, words
        self.top = min(VOCABULARY, len(frequent))
        self.classes = self.top + TAILS
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        n, v = tail_tokens.astype(np.float64), tail_words.astype(np.float64)
        for w, c in frequent[:self.top]:
            n[tail_class(w)] -= c
            v[tail_class(w)] -= 1
        size = len(frequent)
        counts = np.array([c for _, c in frequent], np.float64)
        own = np.array([i if i < self.top else self.top + tail_class(w) for i, (w, _) in enumerate(frequent)], np.int64)
        # By lexicon number: frequent words, then one number for all other words of a tail class.
        self.class_of = np.concatenate([own, self.top + np.arange(TAILS)])
        self.log_count = np.concatenate([np.log10(counts + 1), np.zeros(TAILS)])
        self.known = np.concatenate([np.ones(size, np.int64), np.zeros(TAILS, np.int64)])
        within = -np.log10(n + v + 1)
        self.within = np.where(self.class_of >= self.top, self.log_count + within[np.maximum(self.class_of - self.top, 0)], 0.0)
        self.end = self.index.get(END, size + tail_class(END))
        unigram = np.concatenate([counts[:self.top], n]) + 1.0
        self.unigram = unigram / unigram.sum()


def frequent_words(counts: DataFrame, words: int) -> DataFrame:
    """The (word, c) with c above a bound that at most ``FREQUENT`` words exceed:
    an approximate quantile, doubled while too many words are above it.  So no
    more than these rows leave the tasks, however many tasks there are."""
    bound = 0
    if words > FREQUENT:
        bound = counts.agg(F.percentile_approx("c", 1 - FREQUENT / words, 10_000)).first()[0]
        while counts.where(F.col("c") > bound).count() > FREQUENT:
            bound *= 2
    return counts.where(F.col("c") > bound)


def lexicon(counts: DataFrame) -> Lexicon:
    """What tasks need of the (stored) counts: ``FREQUENT`` words and ``TAILS`` sums."""
    last = F.substring("word", -2, 2)
    tails = counts.groupBy((F.crc32(last) % TAILS).cast("int").alias("tail")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in tails:
        n[r["tail"]], v[r["tail"]] = r["n"], r["v"]
    top = sorted(((bytes(r["word"]), r["c"]) for r in frequent_words(counts, int(v.sum())).collect()), key=lambda x: (-x[1], x[0]))
    return Lexicon(top, n, v, int(n.sum()), int(v.sum()))


def encode(docs: DataFrame, training: Column, lex: Lexicon) -> DataFrame:
    """One row per text, in the order read: doc_id, training, part (the partition
    read), n_tokens, the sums of its words in the lexicon (n_known, log_counts) and
    within their tail classes, its tokens' classes as 16-bit numbers, and its words
    that are not in the lexicon, by blanks."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    schema = ("doc_id long, training boolean, part int, n_tokens long, n_known long, log_counts double, within double, "
              "classes binary, missed binary")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, part = shared.value, TaskContext.get().partitionId()
        frequent = pa.array(list(lex.index), pa.binary())
        for batch in batches:
            for at, words, sizes in split_words(batch.column(2)):
                ids = batch.column(0).slice(at, len(sizes)), batch.column(1).slice(at, len(sizes))
                found = pc.index_in(words, frequent)
                lost = found.is_null()
                missed = words.filter(lost)
                numbers = pc.fill_null(found, 0).to_numpy().astype(np.int64)
                lost = lost.to_numpy(zero_copy_only=False)
                numbers[lost] = len(frequent) + tails_of(missed)
                # every text ends with the end token
                ends = np.cumsum(sizes)
                numbers = np.insert(numbers, ends, lex.end)
                stops = ends + np.arange(1, len(sizes) + 1)
                starts = stops - sizes - 1
                sums = [np.add.reduceat(x[numbers], starts) for x in (lex.known, lex.log_count, lex.within)]
                classes = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, 2 * stops).astype(np.int32)),
                                                                          pa.py_buffer(lex.class_of[numbers].astype("<u2"))])
                gaps = np.concatenate([[0], np.cumsum(lost)])[np.append(0, ends)]
                rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(gaps.astype(np.int32)), missed), pa.scalar(b" ", pa.binary()))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(len(sizes), part, np.int32)), pa.array(sizes + 1), *map(pa.array, sums), classes, rest],
                                                 names=names)

    return docs.select(F.col("doc_id").cast("long"), training.alias("training"), "text").mapInArrow(run, schema)


def _logistic(x: np.ndarray, factor: np.ndarray) -> None:
    """x becomes factor / (1 + exp(x)), x held within 30 of zero."""
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    np.divide(factor, x, out=x)


#: Places of the columns of each class's row, two by two, in a flat table.
_PAIRS = np.arange((VOCABULARY + TAILS + 1) * DIM // 2).reshape(-1, DIM // 2)


def add_rows(out: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """out[ids[i]] += rows[i] for every i, of DIM columns, also where ids repeat.
    Two columns go as the parts of a complex number, which halves the index."""
    pairs = _PAIRS if len(out) <= len(_PAIRS) else np.arange(out.size // 2).reshape(-1, DIM // 2)
    np.add.at(out.view(np.complex64).ravel(), pairs.take(ids, axis=0).ravel(), rows.view(np.complex64).ravel())


class Model:
    """Log-bilinear model over ``classes`` output classes; class number
    ``classes`` is the start of a text, in contexts only."""

    def __init__(self, unigram: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = len(unigram)
        self.log_noise = np.log(unigram).astype(np.float32)
        self.noise = np.cumsum(unigram)
        # rows: context vectors, output vectors with bias, then A and B
        self.r = rng.normal(0, 0.3, (self.classes + 1, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.05, (self.classes, DIM)).astype(np.float32)
        self.b = self.log_noise.copy()
        self.m = np.ones((2, DIM), np.float32)

    def rows(self) -> np.ndarray:
        """All parameters as rows of DIM + 1."""
        wide = lambda x, last=0.0: np.column_stack([x, np.full(len(x), last, np.float32) if np.isscalar(last) else last])
        return np.concatenate([wide(self.r), wide(self.q, self.b), wide(self.m)]).astype(np.float64)

    def load(self, rows: np.ndarray) -> None:
        rows = rows.astype(np.float32)
        n = self.classes
        self.r, self.q, self.b, self.m = rows[:n + 1, :DIM].copy(), rows[n + 1:2 * n + 1, :DIM].copy(), rows[n + 1:2 * n + 1, DIM].copy(), rows[2 * n + 1:, :DIM].copy()

    def train(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, state: dict, rng: np.random.Generator, passes: int = 1) -> None:
        """Passes over tokens w with contexts a (the word before) and b, in batches
        of about ``BATCH`` tokens; Adagrad with ``state`` as its sums of squares.
        Equal tokens in equal contexts are worked out once and weighted by their
        number; a batch takes contexts in random order, each with all its tokens."""
        n = self.classes + 1
        triple, count = np.unique((a * n + b) * n + w, return_counts=True)
        context, first = np.unique(triple // n, return_index=True)
        held = np.diff(np.append(first, len(triple)))
        total = np.add.reduceat(count, first)
        triple %= n
        for _ in range(passes):
            order = rng.permutation(len(context))
            size = held[order]
            ends = np.cumsum(size)
            place = np.repeat(first[order] - (ends - size), size) + np.arange(len(triple))
            words, weights = triple[place], count[place].astype(np.float32)
            own_a, own_b, totals = context[order] // n, context[order] % n, total[order]
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(totals) // BATCH)) + 1).tolist(), len(order)]
            for at, cut, draw in zip(cuts, cuts[1:], rng.random((len(cuts) - 1, NOISE))):
                done = int(ends[at - 1]) if at else 0
                upto = int(ends[cut - 1])
                self._step(words[done:upto], weights[done:upto], own_a[at:cut], own_b[at:cut], size[at:cut],
                           totals[at:cut].astype(np.float32), draw, state)

    def _step(self, w, weight, a, b, size, total, draw, state) -> None:
        """One step: contexts (a, b) met ``total`` times, the i-th with ``size[i]`` of
        the words w, met ``weight`` times.  ``draw``: random numbers for the noise."""
        if not state:
            state.update({name: np.full_like(getattr(self, name), 0.1) for name in "rqbm"})
        scale = np.float32(float(total.sum()) ** -0.5)
        drawn = np.minimum(np.searchsorted(self.noise, draw), self.classes - 1)
        ra, rb, qw, qn = self.r.take(a, axis=0), self.r.take(b, axis=0), self.q.take(w, axis=0), self.q.take(drawn, axis=0)
        h = ra * self.m[0]
        h += rb * self.m[1]
        of = np.repeat(np.arange(len(a)), size)
        hw = h.take(of, axis=0)
        bias = self.b - self.log_noise
        bias -= np.float32(math.log(NOISE))
        # Scaled gradients: of data, weight x (1 - P(data)); of noise, - P(data).
        gp = np.einsum("ij,ij->i", hw, qw)
        gp += bias.take(w)
        _logistic(gp, weight * scale)
        gn = h @ -qn.T
        gn -= bias.take(drawn)
        _logistic(gn, (total * -scale)[:, None])
        qw *= gp[:, None]
        hw *= gp[:, None]
        gh = gn @ qn
        add_rows(gh, of, qw)
        gradients = {"r": np.zeros_like(self.r), "q": np.zeros_like(self.q), "m": np.stack([np.einsum("ij,ij->j", gh, ra), np.einsum("ij,ij->j", gh, rb)]),
                     "b": np.bincount(np.append(w, drawn), np.append(gp, np.ones(len(a), np.float32) @ gn), self.classes).astype(np.float32)}
        add_rows(gradients["r"], a, gh * self.m[0])
        add_rows(gradients["r"], b, gh * self.m[1])
        add_rows(gradients["q"], w, hw)
        add_rows(gradients["q"], drawn, gn.T @ h)
        for name, x in gradients.items():
            past, square = state[name], x * x
            past += square
            x /= np.sqrt(past, out=square)
            x *= np.float32(RATE)
            getattr(self, name).__iadd__(x)

    def log10(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each w after a and b.  ``table``
        keeps the normalisers of all contexts met so far (NaN: not yet)."""
        n = self.classes + 1
        context = a * n + b
        z = table[context]
        if np.isnan(z).any():
            new = np.unique(context[np.isnan(z)])
            for part in np.split(new, range(1024, len(new), 1024)):
                s = (self.r[part // n] * self.m[0] + self.r[part % n] * self.m[1]) @ self.q.T
                s += self.b
                top = s.max(1)
                s -= top[:, None]
                table[part] = np.log(np.exp(s, out=s).sum(1)) + top
            z = table[context]
        out = np.empty(len(w))
        ra, rb = self.r * self.m[0], self.r * self.m[1]
        for at in range(0, len(w), 1 << 13):
            s = slice(at, at + (1 << 13))
            h = ra.take(a[s], axis=0)
            h += rb.take(b[s], axis=0)
            out[s] = np.einsum("ij,ij->i", h, self.q.take(w[s], axis=0)) + self.b[w[s]] - z[s]
        return out / math.log(10)


def contexts(w: np.ndarray, starts: np.ndarray, start_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places before each token, within its text."""
    a, b = np.empty_like(w), np.empty_like(w)
    a[1:], b[2:] = w[:-1], w[:-2]
    a[starts] = start_class
    b[starts] = start_class
    second = starts[starts + 1 < len(w)] + 1
    b[second] = start_class
    return a, b


def fit(encoded: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """Train on the encoded texts, each part that was read from the same start."""
    spark = encoded.sparkSession
    unigram = lex.unigram
    model = Model(unigram)
    for step in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learner = None
            for batch in batches:
                for part, classes in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if learner is None or learner.part != part:
                        if learner:
                            yield learner.rows()
                        learner = _Learner(shared.value, unigram, step, part)
                    learner.add(np.frombuffer(classes.as_buffer(), "<u2"))
            if learner:
                yield learner.rows()

        schema = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("weight", T.DoubleType()),
                               *[T.StructField(f"v{k}", T.DoubleType()) for k in range(DIM + 1)]])
        total = F.sum("weight")
        averaged = (encoded.where("training").select("part", "classes").mapInArrow(run, schema).groupBy("row")
                    .agg(*[(F.sum(F.col(f"v{k}") * F.col("weight")) / total).alias(f"v{k}") for k in range(DIM + 1)]).collect())
        if not averaged:
            break
        rows = np.empty((len(averaged), DIM + 1))
        for r in averaged:
            rows[r["row"]] = [r[f"v{k}"] for k in range(DIM + 1)]
        model = Model(unigram)
        model.load(rows)
    return model


class _Learner:
    """Trains a copy of a model on the texts of one part, in blocks of tokens."""

    def __init__(self, model: Model, unigram: np.ndarray, step: int, part: int):
        self.part, self.model, self.state = part, Model(unigram), {}
        self.model.load(model.rows())
        self.rng = np.random.default_rng([step, part])
        self.held: list[np.ndarray] = []
        self.size = self.seen = 0

    def add(self, classes: np.ndarray) -> None:
        self.held.append(classes)
        self.size += len(classes)
        if self.size >= BLOCK_TOKENS:
            self.learn()

    def learn(self) -> None:
        w = np.concatenate(self.held).astype(np.int64)
        starts = np.cumsum([0] + [len(x) for x in self.held[:-1]])
        a, b = contexts(w, starts, self.model.classes)
        self.model.train(w, a, b, self.state, self.rng, PASSES)
        self.seen, self.size, self.held = self.seen + self.size, 0, []

    def rows(self) -> pa.RecordBatch:
        """The parameters, weighted by the tokens seen."""
        if self.held:
            self.learn()
        rows = self.model.rows()
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), float(self.seen))),
                                           *[pa.array(rows[:, k]) for k in range(DIM + 1)]], names=["row", "weight", *[f"v{k}" for k in range(DIM + 1)]])


_TABLES: dict[int, np.ndarray] = {}


def score(docs: DataFrame, training: Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each text,
    learning from the rows where ``training`` is true.  base_score: log10 of the
    add-one unigram probability."""
    spark = docs.sparkSession
    counts = stored(count_tokens(docs.where(training)))
    lex = lexicon(counts)
    encoded = stored(encode(docs, training, lex))
    model = fit(encoded, lex, rounds)
    shared, end_missed = spark.sparkContext.broadcast(model), END not in lex.index
    own = ["doc_id", "n_tokens", "n_known", "log_counts"]
    schema = pa.schema([("rid", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("log_counts", pa.float64()), ("model", pa.float64())])
    stamp = hash((lex.tokens, lex.words, float(model.q.sum()), float(model.r.sum())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = _TABLES.get(stamp)
        if table is None:
            _TABLES.clear()
            table = _TABLES[stamp] = np.full((m.classes + 1) ** 2, np.nan, np.float32)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = batch.column("n_tokens").to_pylist()
            for at, stop in chunks(sizes, sizes, BLOCK_TOKENS):
                texts = batch.slice(at, stop - at)
                starts = np.concatenate([[0], np.cumsum(sizes[at:stop - 1])]).astype(np.int64)
                w = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in texts.column("classes")]).astype(np.int64)
                a, b = contexts(w, starts, m.classes)
                parts = np.add.reduceat(m.log10(w, a, b, table), starts) + texts.column("within").to_numpy()
                # The text's own row: its word can't be a word, as it starts with a blank.
                rids = range(rid, rid + len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array([b" %d" % x for x in rids], pa.binary()), pa.array(np.zeros(len(texts), np.int64)),
                                                  *[texts.column(x) for x in own], pa.array(parts)], schema=schema)
                # A row for each of its words that are not in the lexicon.
                missed = [Counter(x.split()) for x in texts.column("missed").to_pylist()]
                if end_missed:
                    for x in missed:
                        x[END] = 1
                words = [w for x in missed for w in x]
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rids, [len(x) for x in missed])), pa.array(words, pa.binary()),
                                                      pa.array([n for x in missed for n in x.values()], pa.int64()),
                                                      *[pa.nulls(len(words), schema.field(k).type) for k in range(3, 8)]], schema=schema)
                rid += len(texts)

    rows = encoded.select(*own, "within", "classes", "missed").mapInArrow(run, "rid long, word binary, n long, doc_id long, n_tokens long, n_known long, log_counts double, model double")
    seen = F.coalesce("c", F.lit(0))
    found = rows.join(counts, "word", "left")
    rare = F.col("n") * F.log10(seen + 1)
    summed = found.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(seen > 0, F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum("log_counts") + F.sum(rare)).alias("log_counts"), (F.sum("model") + F.sum(rare)).alias("model"))
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(math.log10(lex.tokens + lex.words + 1))
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(lex.tokens).cast("long").alias("train_tokens"),
                         base.alias("base_score"), F.col("model").alias("score"))
