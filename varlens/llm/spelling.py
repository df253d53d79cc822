"""Spelling variant grouping over a variable-length gram index.

Words are enclosed in two marks.  A gram starts at every place and is extended
from ``SHORTEST`` code points while it is frequent, to ``LONGEST`` at most, so
whether a gram goes on depends on nothing but its own code points.  The gram
dictionary is pruned by frequency: it holds the grams that occur more than
1 / ``SHARE`` of all gram occurrences of their length, so its size has a bound
that no vocabulary exceeds; every other gram is rare.

One inserted, deleted or replaced code point affects only the grams over its
place.  A word's affected-gram bound is the largest number of its grams over any
one place, so words one edit apart share all but so many grams, at the same
place from one of the two ends.  In the order of frequency (rare first, then by
text, then by place) the first shared gram of such a pair stands within
bound + 1 of the front in both words, so lists are kept and merged for these
grams alone, by gram, place and length.  Lists of more than ``HOT`` words are
cut further, exactly: by the word with one code point left out, which words one
edit apart share (at most alphabet x length words have it, at any size).  What
meets is verified by its edit distance.

Defined results: null and empty texts have no words; a null id counts as an
empty text in the hash; equal rows count as often as they occur; an empty table
has no words; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.llm.common import stored

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
DAMAGE = 97
MIN_POINTS, MIN_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 2
SHORTEST, LONGEST = 2, 5
SHARE = 8192
HOT = 128
#: Marks of a word's two ends; not letters.
_START, _END = "\x02", "\x03"


def runs(text: Column) -> Column:
    """Maximal runs of letters, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(RUN), F.lit(0))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where the hash of id and run says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and its number of occurrences ``n`` in all texts."""
    tokens = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    words = tokens.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= MIN_POINTS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def dictionary(words: DataFrame) -> dict[str, int]:
    """Frequent grams and their counts: of each length those above 1 / ``SHARE``
    of all occurrences, so less than ``SHARE`` of them (counted in Spark)."""
    marked = words.select(F.concat(F.lit(_START), F.col("word"), F.lit(_END)).alias("w"))
    places = F.sequence(F.lit(1), F.char_length("w") - SHORTEST + 1)
    starts = marked.select("w", F.explode(places).alias("p"))
    sizes = F.array(*[F.lit(i) for i in range(SHORTEST, LONGEST + 1)])
    grams = starts.select("w", "p", F.explode(sizes).alias("l")).where(F.col("p") + F.col("l") - 1 <= F.char_length("w")).select(F.substr("w", "p", "l").alias("gram"), "l")
    counts = stored(grams.groupBy("l", "gram").agg(F.count("*").alias("n")))
    total = counts.groupBy("l").agg(F.sum("n").alias("total"))
    return {r["gram"]: r["n"] for r in counts.join(total, "l").where(F.col("n") * SHARE > F.col("total")).select("gram", "n").collect()}


def decompose(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """(place, gram) of the marked word."""
    marked = _START + word + _END
    grams = []
    for start in range(len(marked) - SHORTEST + 1):
        stop = start + SHORTEST
        while stop < len(marked) and stop - start < LONGEST and marked[start:stop] in frequent:
            stop += 1
        grams.append((start, marked[start:stop]))
    return grams


def affected(grams: list[tuple[int, str]], points: int) -> int:
    """The most grams over any one code point of a word of ``points`` (marks not counted)."""
    over = [0] * (points + 2)
    for start, gram in grams:
        for i in range(start, start + len(gram)):
            over[i] += 1
    return max(over[1:-1])


def front(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """The grams to index: the rarest, one more than one edit can affect."""
    grams = decompose(word, frequent)
    grams.sort(key=lambda g: (frequent.get(g[1], 0), g[1], g[0]))
    return grams[:affected(grams, len(word)) + 1]


def _index(frequent: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, grams, places, sizes = [], [], [], []
            for word in batch["word"].to_pylist():
                for place, gram in front(word, frequent):
                    words.append(word)
                    grams.append(gram)
                    places.append(place)
                    sizes.append(len(word))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(grams, pa.string()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())],
                                             ["word", "gram", "place", "size"])
    return run


def _left_out(word: Column) -> Column:
    """The word and the word without each of its code points."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), cut))


def near(words: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct words of column ``word`` one edit apart,
    each pair once, the shorter (or smaller) first."""
    entries = stored(words.select("word").mapInArrow(_index(dictionary(words)), "word string, gram string, place int, size int"))
    # lists are kept by gram, place and length of the word; a word looks up its own
    # length (same place) and the next (same place from the start or from the end)
    key = lambda shift, longer: F.xxhash64("gram", F.col("place") + shift, F.col("size") + longer)
    lists = entries.select(key(0, 0).alias("key"), F.col("word").alias("b"), F.col("size").alias("size_b"))
    look = entries.select(F.col("word").alias("a"), F.col("size").alias("size_a"), F.explode(F.array(key(0, 0), key(0, 1), key(1, 1))).alias("key"))
    lengths = lists.groupBy("key").agg(F.count("*").alias("length"))
    found = look.join(lengths, "key")
    hot = lengths.where(F.col("length") > HOT).drop("length")
    apart = ((F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    small = found.where(F.col("length") <= HOT).drop("length").join(lists, "key").where(apart)
    cut = lambda df, w: df.withColumn("part", F.explode(_left_out(F.col(w)))).withColumn("part", F.xxhash64("key", "part"))
    large = cut(found.where(F.col("length") > HOT).drop("length"), "a").join(cut(lists.join(hot, "key"), "b").drop("key"), "part").where(apart)
    return small.select("a", "b").unionAll(large.select("a", "b")).distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """Per word: ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    words = stored(vocabulary(docs))
    pairs = stored(near(words))
    edges = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a word has at most alphabet x length near words, so its group has a bound
    other = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    best = edges.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "b")).alias("best"))
    is_form = -F.col("best.m") >= FORM_RATIO * F.col("n")
    judged = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")))
    # each step doubles the way that a word has gone; counts double along the forms, so few steps do
    roots = judged.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.where(F.col("root") != F.col("word")).join(up, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
                       .unionAll(roots.where(F.col("root") == F.col("word")).select("word", "root", F.lit(False))))
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    return judged.join(roots.select("word", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")
