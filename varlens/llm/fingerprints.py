"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's shingles are its runs of five words (fewer words: all of them as one).
Each shingle is hashed once; the hash's high byte names one of 256 bins and each
bin keeps its least hash.  Empty bins are filled by optimal densification: bin i
tries the bins hash(i, 1), hash(i, 2), ... and copies the first that is not
empty; after ``PROBES`` tries it takes the non-empty bin j with the least
hash(i, j), so every bin is filled.  Of each bin the low byte is stored, as two
hexadecimal digits.  Two bins that differ agree in the low byte with
probability c = 1/256, so likeness is (share of equal bytes - c) / (1 - c), 0 at
least.

Hashes are sorted, so the first of each high byte is its bin's least, and the
table of bins is built by one pass over them.

Defined results: a null or empty text, or one of white space, has no shingle and
an empty fingerprint; two such are alike (1), one of them and another text are
not (0); equal texts have equal fingerprints; an empty table gives an empty
table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, SHINGLE, PROBES = 256, 5, 8


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    def over(words: Column) -> Column:
        last = F.size(words) - width
        return (F.when(F.size(words) == 0, F.array().cast("array<bigint>"))
                .when(last <= 0, F.array(F.xxhash64(words)))
                .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                       lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), over)


def _bin(h: Column) -> Column:
    return (F.shiftright(h, 56) + F.lit(128)).cast("int")


def _low(h: Column) -> Column:
    return (h.bitwiseAND(F.lit(255)) - F.lit(128)).cast("tinyint")


def bins(text: Column) -> Column:
    """The 256 filled bins' low bytes (less 128) of ``text``; empty without words."""
    empty = F.lit(None).cast("tinyint")

    def spread(least: Column) -> Column:
        return F.concat(
            F.flatten(F.transform(least, lambda h, t: F.concat(
                F.array_repeat(empty, _bin(h) - F.when(t == 0, F.lit(-1)).otherwise(_bin(F.get(least, t - 1))) - 1), F.array(_low(h))))),
            F.array_repeat(empty, BINS - 1 - _bin(F.element_at(least, -1))))

    def fill(least: Column, table: Column) -> Column:
        nearest = lambda i: F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(i, _bin(h)).alias("at"), _low(h).alias("low"))))["low"]
        return F.transform(table, lambda v, i: F.coalesce(
            v, *[F.get(table, F.pmod(F.hash(i, F.lit(a)), F.lit(BINS))) for a in range(1, PROBES + 1)], nearest(i)))

    def dense(least: Column) -> Column:
        return F.when(F.size(least) == 0, F.array().cast("array<tinyint>")).otherwise(_let(spread(least), lambda table: fill(least, table)))

    def first(hashes: Column) -> Column:
        return F.filter(hashes, lambda h, i: (i == 0) | (F.shiftright(F.get(hashes, i - 1), 56) != F.shiftright(h, 56)))

    return _let(F.sort_array(shingle_hashes(text)), lambda hashes: _let(first(hashes), dense))


def packed(low: Column) -> Column:
    """Bins as hexadecimal text."""
    digits = F.array(*[F.lit(f"{v:02x}") for v in range(256)])
    return F.array_join(F.transform(low, lambda v: F.get(digits, v.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double")
    chance = 1.0 / 256
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
            .otherwise(F.greatest(F.lit(0.0), (equal / BINS - chance) / (1 - chance))))


def with_next(rows: DataFrame, order: str, carried: list[str], buckets: int | None = None) -> DataFrame:
    """``rows`` with ``next_<c>`` for each carried column: its value in the next
    row by ``order`` (then by the hash of the carried columns); after the last
    comes the first.  Rows are dealt into ranges of ``order`` cut at approximate
    quantiles.  A range's first rows are also given, marked, to the range before,
    so each range sees the row that follows it and no range is a whole table."""
    spark = rows.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)] or [[]]
    kind = rows.schema[order].dataType.simpleString()
    literal = lambda values: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    coarse = literal([g[-1] for g in groups[:-1]])
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(order)))
    # A range holds the values above one cut and up to the next; null comes first.
    bucket = _let(below(coarse), lambda g: g * step + below(F.get(F.array(*[literal(x) for x in groups]), g)))
    placed = rows.withColumn("_range", bucket)
    firsts = {r["_range"]: (r["first"], r["nulls"]) for r in  # at most n rows
              placed.groupBy("_range").agg(F.min(order).alias("first"), F.count(F.when(F.col(order).isNull(), 1)).alias("nulls")).collect()}
    there = sorted(firsts)
    if not there:
        return rows.withColumns({f"next_{c}": F.col(c) for c in carried})
    before = {b: there[i - 1] for i, b in enumerate(there)}
    size = there[-1] + 1
    least = literal([None if firsts.get(b, (None, 0))[1] else firsts.get(b, (None, 0))[0] for b in range(size)])
    earlier = F.array(*[F.lit(before.get(b, 0)) for b in range(size)])
    copies = F.when(F.col(order).eqNullSafe(F.get(least, F.col("_range"))),
                    F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("mark")),
                            F.struct(F.get(earlier, F.col("_range")).alias("range"), F.lit(True).alias("mark")))
                    ).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("mark"))))
    dealt = placed.withColumn("_copy", F.explode(copies)).drop("_range")
    window = Window.partitionBy("_copy.range").orderBy("_copy.mark", order, F.xxhash64(*carried))
    return (dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in carried})
            .where(~F.col("_copy.mark")).drop("_copy"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``."""
    kept = docs.select(*[c for c in docs.columns if c != "fingerprint"])
    return kept.withColumn("fingerprint", packed(bins(F.coalesce("text", F.lit("")))))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited and
    near_next, where a text's edited form has its last half replaced by the start
    of the next document's text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", bins(F.col("text")))
    paired = with_next(rows, "doc_id", ["text", "low"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = (paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
              .select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "low", "next_low")
              .withColumn("edited_low", bins(F.col("edited"))))
    return edited.select("doc_id", "n_chars", "edited", packed(F.col("low")).alias("fingerprint"), packed(F.col("edited_low")).alias("edited_fingerprint"),
                         likeness(F.col("low"), F.col("edited_low")).alias("near_edited"), likeness(F.col("low"), F.col("next_low")).alias("near_next"))
