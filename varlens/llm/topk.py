"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors are rows of integer weights over terms (their places); zeros are
absent.  A block of candidates is turned into posting lists, one per term; a
query row scatters, term by term, its weight times each posting into the
block's dense array of scores; partition selection keeps the block's best,
which are merged with the best of the blocks before it, then in Spark with
those of the other tasks.  Every candidate of every block is scored.

Queries go to the tasks in groups of at most ``GROUP_BYTES`` of weights and
``GROUP_ROWS`` rows, one Spark job a group, so what is collected and broadcast
has a fixed bound at every size; candidates are scanned once a group and never
shuffled.

Defined results: vectors that are null or hold a null or non-finite component
take no part; of vectors of different lengths the shorter ends in zeros, so an
empty one scores 0; a row is never its own candidate, but an equal row (also
one of the same id) is; ties go to the smaller id, a null id last; scores
outside the range of a long are clipped to it, other scores are exact at any
magnitude; a query without candidates has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlens.llm.common import stored

#: Candidates of a block: its scores and one posting list stay in the cache.
BLOCK = 8192
#: Bounds of a group of queries.
GROUP_ROWS, GROUP_BYTES = 32_768, 32 << 20
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _weights(values: list[np.ndarray], scale: int) -> np.ndarray:
    """floor(scale * x) as a matrix of whole numbers, padded with zeros; of
    Python integers if any is too large for sums of products in 64 bits."""
    wide = max(map(len, values), default=0)
    real = np.zeros((len(values), wide))
    for i, v in enumerate(values):
        real[i, :len(v)] = v
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * real)
    if np.isfinite(scaled).all() and (not scaled.size or np.abs(scaled).max() < 2.0 ** 52):
        return scaled.astype(np.int64)
    exact = np.zeros(scaled.shape, object)
    for i, j in np.argwhere(real != 0):
        num, den = float(real[i, j]).as_integer_ratio()
        exact[i, j] = scale * num // den
    return exact


def _largest(matrix: np.ndarray) -> int:
    return max((abs(int(x)) for x in (matrix.max(), matrix.min())), default=0) if matrix.size else 0


class Postings:
    """Posting lists of a block: per term the candidates' places and weights; a
    list of more than half of the block is stored for all places, with zeros."""

    def __init__(self, matrix: np.ndarray):
        self.rows, self.terms = matrix.shape
        self.largest = _largest(matrix)
        self.lists: list[tuple[np.ndarray | None, np.ndarray]] = []
        for t in range(self.terms):
            column = np.ascontiguousarray(matrix[:, t])
            at = np.flatnonzero(column)
            self.lists.append((None, column) if 2 * len(at) > self.rows else (at, column[at]))

    def narrowed(self, kind) -> list[tuple[np.ndarray | None, np.ndarray]]:
        return [(at, w.astype(kind)) for at, w in self.lists]


def accumulate(query: np.ndarray, lists, scores: np.ndarray) -> None:
    """Scatters the query's weighted postings into ``scores``, term by term."""
    scores[:] = 0
    kind = scores.dtype.type
    for t in np.flatnonzero(query[:len(lists)]):
        at, weights = lists[t]
        weight = int(query[t]) if scores.dtype == object else kind(query[t])
        if at is None:
            scores += weight * weights
        elif len(at):
            scores[at] += weight * weights


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, best first: by score, then by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(np.int64)))][:k]


def _kind(postings: Postings, largest: int, terms: int):
    """The narrowest type in which no sum can overflow."""
    most = postings.largest * largest * max(1, min(postings.terms, terms))
    return np.int32 if most < 2 ** 31 else np.int64 if most < 2 ** 62 else object


def search_block(rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int):
    """(query's place, id, score) arrays of the block's best for each query."""
    postings = Postings(matrix)
    kind = _kind(postings, _largest(queries), queries.shape[1])
    lists, scores = postings.narrowed(kind), np.zeros(postings.rows, kind)
    order = np.argsort(rows, kind="stable")
    own = order[np.minimum(np.searchsorted(rows, query_rows, sorter=order), len(rows) - 1)] if len(rows) else np.zeros(len(query_rows), int)
    places, found, values = [], [], []
    for q in range(len(queries)):
        accumulate(queries[q], lists, scores)
        best = select(scores, ids, k + 1)
        if rows[own[q]] == query_rows[q]:
            # one more than k was selected; should ties have pushed the row itself out, the first k stand
            best = best[best != own[q]]
        best = best[:k]
        places.append(np.full(len(best), q))
        found.append(ids[best])
        values.append(np.array([max(-_LONG - 1, min(_LONG, int(x))) for x in scores[best]], np.int64))
    return np.concatenate(places), np.concatenate(found), np.concatenate(values)


def _best(places, ids, scores, k):
    """The ``k`` best of each query, of rows in any order."""
    # -score could overflow at the least long: order by its complement
    order = np.lexsort((ids, ~scores, places))
    places, ids, scores = places[order], ids[order], scores[order]
    start = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else np.zeros(0, int)
    nth = np.arange(len(places)) - np.repeat(start, np.diff(np.r_[start, len(places)]))
    keep = nth < k
    return places[keep], ids[keep], scores[keep]


def _blocks(batches: Iterator[pa.RecordBatch], size: int):
    """Row numbers, ids and vectors of ``size`` candidates at a time."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _vectors(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = column.combine_chunks()
    values, cuts = flat.flatten().to_numpy(zero_copy_only=False), flat.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(values, np.cumsum(cuts)[:-1]) if len(cuts) else []


def _search(query_rows: np.ndarray, queries: np.ndarray, k: int, scale: int):
    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for block in _blocks(batches, size):
            # a null id sorts after all others
            ids = block["id"].fill_null(_LONG).to_numpy()
            matrix = _weights(_vectors(block["vector"]), scale)
            found = search_block(block["row"].to_numpy(), ids, matrix, query_rows, queries, k)
            best = _best(*[np.concatenate(x) for x in zip(best, found)], k)
        yield pa.RecordBatch.from_arrays([pa.array(query_rows[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_row", "vec_id", "score"])
    return run


def _groups(queries: DataFrame):
    """Bounded groups of the queries' (rows, vectors), streamed to the driver one
    partition at a time; partitions hold at most what one group may."""
    rows, vectors, size = [], [], 0
    for r in queries.toLocalIterator():
        rows.append(r["row"])
        vectors.append(np.array(r["vector"], float))
        size += 8 * len(vectors[-1])
        if len(rows) >= GROUP_ROWS or size >= GROUP_BYTES:
            yield np.array(rows, np.int64), vectors
            rows, vectors, size = [], [], 0
    if rows:
        yield np.array(rows, np.int64), vectors


def top(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best candidates of every row where ``is_query`` holds: columns
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; the score is the
    inner product of floor(``scale`` * component)."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector_col))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    kept = stored(kept)
    queries = kept.where("is_query")
    schema = "query_row long, vec_id long, score long"
    parts = []
    for rows, values in _groups(queries.select("row", "vector")):
        run = _search(rows, _weights(values, scale), k, scale)
        parts.append(stored(kept.select("row", "id", "vector").mapInArrow(run, schema)))
    found = spark.createDataFrame([], schema)
    for p in parts:
        found = found.unionAll(p)
    by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return ranked.join(named, "query_row").select("query_id", "rank", F.when(F.col("vec_id") != _LONG, F.col("vec_id")).alias("vec_id"), "score")
