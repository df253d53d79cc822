"""N-gram Jaccard join by parity sketches, and its connected components.

A document's set is its distinct shingles (runs of ``width`` words, A-Z
lower-cased; fewer words: all of them as one), each held as a 64-bit hash.  Two
documents link when 100 * intersection >= ``percent`` * union, which for sizes
a, b is the same as a symmetric difference of at most
D(a + b) = floor((100 - percent) * (a + b) / (100 + percent)).

0. Classes.  Sets of equal size and 128-bit digest are equal, so they link: only
   the one of the least id of each such class goes on, and the others take its
   component in the end.
1. Size bands.  Band edges grow so that a set and its smaller partner are in one
   band or in neighbours.  A set takes part in its own band and in the next; a
   key counts as shared only if one of its sets is in its own band there.
2. Parity sketches, pigeonhole.  In a band a set's hashes are dealt by their high
   bits into B = D + 1 + spare blocks; a block's key is the XOR of its hashes.
   Each differing shingle spoils one block, so linked sets share at least B - D
   blocks.  (Empty blocks carry no key, unless a set has so many that its other
   blocks may all be spoilt.)
3. Prefixes.  Keys are put in one order, rare first, and sets that share that
   many keys share one even if each leaves out its B - D - 1 last.  So each set
   leaves out its most frequent keys (passages that many documents hold), and a
   key seen once is no use.  Of the keys with the same members (by number, least,
   greatest and sums of their hashes) one stands for all.  This is exact.
4. Stars.  In each bucket of a key every set is paired with the bucket's least
   id.  A 512-bit parity sketch of the whole set (XOR of one bit per shingle)
   has a Hamming distance of at most the symmetric difference; pairs above
   D(a + b) go.  The rest are verified on the sets themselves.  Components of
   these links follow.
5. The rest.  Buckets that still hold more than one component are joined with
   themselves, across components, under the same bounds and but for pairs of two
   sets that are both a band below; survivors are verified and added.  Pairs inside a component can't change it.  So no link between
   components is lost, and no bucket is expanded into pairs of one component.

Keys are counted where they are made and then in key order, without a table of all
keys in memory.  Minima and components use partial aggregation; what counts, minima and
components give is stored before it is joined to the rows it came from, so that these
equi-joins read plain shuffles, which adaptive execution splits where one key is hot.

Defined results: without words a set is empty and links with nothing; rows with
one id are one document, and of several texts under it the one with most
shingles (then the greatest digest) counts; a null id has no links and a null component; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varlens.llm.common import stored

WIDTH, PERCENT = 4, 85
#: Spare blocks per block needed: more spare blocks mean more keys and shorter prefixes.
SPARE = 0.2
#: Bits of a key: two blocks that meet in one key by chance cost rows, never links.
KEY_BITS = 48
#: Longs of the sketch of the whole set.
SKETCH = 8
#: Most rows of ids that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Words whose hash a Python worker remembers.
CACHE_WORDS = 200_000

_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> _U(31))) * _ODD[0]
    h = (h ^ (h >> _U(29))) * _ODD[1]
    return h ^ (h >> _U(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.cache: dict[bytes, int] = {}

    def __call__(self, data: bytes | None) -> np.ndarray:
        words = (data or b"").lower().split()  # ASCII letters and white space only
        if not words:
            return np.empty(0, _U)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for w in set(words).difference(self.cache):
            self.cache[w] = xxhash.xxh64_intdigest(w)
        a = np.fromiter(map(self.cache.__getitem__, words), _U, len(words))
        width = min(self.width, len(a))
        h = np.full(len(a) - width + 1, width, _U)
        for k in range(width):
            h += a[k:k + len(h)] * _U(2 * k + 1) * _ODD[k % len(_ODD)]
        h = mix(h)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


class Bands:
    """Band edges, and for each band the blocks of a sketch."""

    def __init__(self, percent: int = PERCENT, spare: float = SPARE, longest: int = 1 << 31):
        self.percent = percent
        edges = [1]
        while edges[-1] < longest:
            edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent))
        self.edges = np.array(edges, np.int64)
        most = self.difference(2 * (self.edges[1:] - 1))
        self.blocks = most + 1 + np.where(most > 0, np.ceil((most + 1) * spare).astype(np.int64) + 1, 0)

    def difference(self, sizes):
        """Largest symmetric difference of linked sets with ``sizes`` in all."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def keys(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(0 or 1 for the own or the next band, keys, how many of the most
        frequent keys may be left out) of a set of sorted hashes."""
        n = len(h)
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        for side in (0, 1):
            band = own + side
            blocks = int(self.blocks[band])
            block = ((h >> _U(32)) * _U(blocks)) >> _U(32)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            keys = mix(np.bitwise_xor.reduceat(h, first) + mix(block[first] * _U(1 << 10) + _U(band + 1)))
            spoilt = self.difference(n + min(int(self.edges[band + 1]) - 1, n * 100 // self.percent))
            if len(keys) <= spoilt:
                empty = np.setdiff1d(np.arange(blocks, dtype=_U), block, assume_unique=False)
                yield side, np.concatenate([keys, mix(mix(empty * _U(1 << 10) + _U(band + 1)))]), 0
            else:
                yield side, keys, len(keys) - spoilt - 1


def digest(h: np.ndarray) -> tuple[int, int]:
    if not len(h):
        return 0, 0
    return int(h.sum(dtype=_U).view(np.int64)), int(np.bitwise_xor.reduce(mix(h ^ _ODD[3])).view(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    bits = np.bincount((h & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for i, doc in enumerate(ids):
            yield doc, texts[i].as_py()


def _batched(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], limit: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def set_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, d0, d1, s0 ...): size, 128-bit digest and sketch of each set."""
    names = ["n", "d0", "d1", *[f"s{i}" for i in range(SKETCH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)

        def rows():
            for doc, data in _texts(batches):
                h = shingle(data)
                yield (doc, len(h), *digest(h), *sketch(h).tolist())

        yield from _batched(rows(), [pa.int64()] * (2 + 2 + SKETCH), ["doc_id", *names], 2000)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ["doc_id", *names]]))


#: Keys that a task gathers before it passes them on.
HELD_KEYS = 100_000


def _held_keys(batches: Iterator[pa.RecordBatch], bands: Bands, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, doc ids, cuts) of the texts, about ``HELD_KEYS`` at a time."""
    shingle = Shingler(width)
    parts: list[list[np.ndarray]] = [[], [], []]
    held = 0
    for doc, data in _texts(batches):
        h = shingle(data)
        if not len(h) or doc is None:
            continue
        for side, keys, over in bands.keys(h):
            for part, v in zip(parts, ((keys >> _U(64 - KEY_BITS)).view(np.int64), doc, 2 * over + side)):
                part.append(v if isinstance(v, np.ndarray) else np.full(len(keys), v))
            held += len(keys)
        if held > HELD_KEYS:
            yield tuple(map(np.concatenate, parts))
            parts, held = [[], [], []], 0
    if held:
        yield tuple(map(np.concatenate, parts))


def block_keys(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, cut): block keys.  ``cut`` is 2 * over + side: of the keys of one
    (doc_id, cut) the ``over`` most frequent may be left out, and side is 0 or 1 for
    keys of the set's own or of the next band."""
    bands = Bands(percent)
    types = [pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _held_keys(batches, bands, width):
            yield pa.RecordBatch.from_arrays([pa.array(p, t, safe=False) for p, t in zip(parts, types)], names=["key", "doc_id", "cut"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, doc_id long, cut int")


def _summed(key: np.ndarray, seen: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each run of equal keys: sum of ``seen``, least ``least``."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(seen, first), np.minimum.reduceat(least, first)


def shared_keys(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, seen): block keys of two sets or more, one of them in its own band.

    Nearly all keys are seen once, so an aggregation's hash table would hold every key
    of a task, before the shuffle and after.  Instead equal keys are summed where they
    are gathered (so a hot key leaves a task in few rows), and the rest in key order,
    by a sort that spills, in one batch at a time."""
    bands = Bands(percent)
    names = ["key", "seen", "least"]

    def found(key, seen, least):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(seen, pa.int64()), pa.array(least, pa.int32())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, cuts in _held_keys(batches, bands, width):
            order = np.argsort(keys)
            yield found(*_summed(keys[order], np.ones(len(keys), np.int64), (cuts[order] & 1).astype(np.int32)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]  # its key may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _summed(*[np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(last)])
            last = [v[-1:] for v in rows]
            kept = (rows[1][:-1] > 1) & (rows[2][:-1] == 0)
            yield found(*[v[:-1][kept] for v in rows])
        kept = (last[1] > 1) & (last[2] == 0)
        yield found(*[v[kept] for v in last])

    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "key long, seen long, least int")
    return counts.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "key long, seen long, least int").select("key", "seen")


def prefixes(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, doc_id, side): the shared keys that each set can't leave out."""
    side = F.col("cut").bitwiseAND(1)
    own = Window.partitionBy("doc_id", "cut")  # one document's keys
    # Stored, so that the join reads two shuffles and can split a hot key.
    placed = (keys.join(stored(shared).hint("merge"), "key").withColumn("place", F.row_number().over(own.orderBy("seen", "key")))
              .withColumn("all", F.count("*").over(own)))
    return placed.where(F.col("place") <= F.col("all") - F.shiftright("cut", 1)).select("key", "doc_id", side.cast("byte").alias("side"))


def buckets(rows: DataFrame) -> DataFrame:
    """(key, doc_id, side, a): ``rows`` of one key for each list of members that holds
    two ids or more and a set in its own band; a is its least id."""
    h = F.xxhash64("doc_id", "side")
    members = ["a", "z", "n", "high", "low"]
    lists = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n"), F.min("side").alias("least"),
                                    F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"))
    kept = lists.where("a < z AND least = 0").groupBy(*members).agg(F.min("key").alias("key")).select("key", "a")
    return rows.join(kept, "key")


def _linkable(a: str, b: str, percent: int) -> Column:
    """Bounds that every linked pair meets: sizes, and Hamming distance of sketches."""
    n = lambda x: F.col(f"{x}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return ((100 * F.least(n(a), n(b)) >= percent * F.greatest(n(a), n(b)))
            & (apart * (100 + percent) <= (100 - percent) * (n(a) + n(b))))


def verified(pairs: DataFrame, docs: DataFrame, one: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b; distinct).  The sets are made again from
    their texts and the two of a pair are brought together."""
    pairs = stored(pairs)
    wanted = pairs.select("a", "b", F.posexplode(F.array("a", "b")).alias("side", "doc_id"))
    ids = stored(wanted.select("doc_id").distinct().join(one.select("doc_id", "d0", "d1"), "doc_id"))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)

        def rows():
            for batch in batches:
                for doc, data, d0, d1 in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                    h = shingle(data)
                    if digest(h) == (d0, d1):  # of several texts under one id, the one that stands for it
                        yield doc, h.view(np.int64)

        yield from _batched(rows(), [pa.int64(), pa.list_(pa.int64())], ["doc_id", "hashes"], 200)

    sets = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).join(ids, "doc_id")
            .select("doc_id", "text", "d0", "d1").mapInArrow(run, "doc_id long, hashes array<long>"))
    of = lambda side: F.first(F.when(F.col("side") == side, F.col("hashes")), ignorenulls=True).alias(f"h{side}")
    together = wanted.join(sets, "doc_id").groupBy("a", "b").agg(of(0), of(1))  # two sets a pair
    common = F.size(F.array_intersect("h0", "h1"))
    return together.where(100 * common >= percent * (F.size("h0") + F.size("h1") - common)).select("a", "b")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(doc_id, component_id) of the ids in ``links`` (a, b): the least id within
    reach.  Large-star and small-star steps, each written out, until nothing
    changes."""
    def signed(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = signed(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that the join reads two shuffles and can split a hot u.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v"))
        edges = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = signed(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The set of the least id of each class of equal sets, as in ``sets``, and (doc_id,
    first) of the other ids.  Of several sets under one id the greatest stands for it."""
    rest = [c for c in sets.columns if c != "doc_id"]
    equal = ["n", "d0", "d1"]
    one = stored(sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("doc_id")
                 .agg(F.max(F.struct(*rest)).alias("set")).select("doc_id", "set.*"))
    least = one.groupBy(*equal).agg(F.min("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in rest if c not in equal])
    several = stored(one.groupBy(*equal).agg(F.min("doc_id").alias("first"), F.count("*").alias("ids")).where("ids > 1"))
    copies = one.join(several, equal).where(F.col("doc_id") > F.col("first")).select("doc_id", "first")
    return stored(least.select(*sets.columns)), stored(copies)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the (stored, distinct) ids, broadcast if there are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti")


def links(docs: DataFrame, one: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between the sets of ``one``, distinct ones with distinct ids,
    whose components are those of all links.  ``docs`` holds their texts."""
    sides = lambda ids, name: one.select(F.col("doc_id").alias(ids), F.struct(*[c for c in one.columns if c != "doc_id"]).alias(name))
    rows = stored(buckets(stored(prefixes(block_keys(docs, width, percent), shared_keys(docs, width, percent)))))
    stars = rows.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    first = stored(verified(stars.join(sides("a", "x"), "a").join(sides("b", "y"), "b").where(_linkable("x", "y", percent)).select("a", "b"),
                            docs, one, width, percent))

    labels = components(first)
    placed = rows.join(labels, "doc_id", "left").select("key", "doc_id", "side", F.coalesce("component_id", "doc_id").alias("component"))
    mixed = stored(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                   .where("low < high").select("key"))
    left = stored(placed.join(mixed, "key").join(one, "doc_id"))
    names = [c for c in left.columns if c != "key"]
    side = lambda name: left.select("key", F.struct(*names).alias(name))
    across = (side("x").join(side("y"), "key")
              .where((F.col("x.component") < F.col("y.component")) & ((F.col("x.side") == 0) | (F.col("y.side") == 0)) & _linkable("x", "y", percent))
              .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct())
    return first.unionByName(verified(across, docs, one, width, percent))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    sets = stored(set_table(docs, width))
    one, copies = classes(sets)
    texts = without(docs.select(F.col("doc_id").cast("long"), "text"), copies.select("doc_id"))
    labels = stored(components(links(texts, one, width, percent)))
    others = copies.join(labels.withColumnRenamed("doc_id", "first"), "first", "left").select("doc_id", F.coalesce("component_id", "first").alias("component_id"))
    return (sets.select("doc_id", F.col("n").alias("n_shingles")).join(labels.unionByName(others), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def first_of_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that link, directly or by others, with one of
    a lesser id."""
    others = groups(docs, width, percent).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return without(docs, stored(others))
