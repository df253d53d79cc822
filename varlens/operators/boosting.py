"""Gradient-boosted trees for a binary label, many models in the same passes.

A search over settings and folds fits the same rows again and again.  Here all
its models grow together: the features are binned once, and one pass over the
rows gives, for the next tree level of every model, the histograms of
gradients per (node, feature, bin), whose size does not grow with the rows.  The
tasks' histograms meet on the executors, model by model, and only the chosen
splits come to the driver; where all of a pass are below ``GATHER_BYTES``, they
are gathered and chosen from there, without a shuffle.  A model with fewer
trees is a stage of the one with more, so settings that differ in the number of
trees are one model, evaluated at each stage.

Logistic loss, started at the log-odds of the training labels; splits by the
Friedman improvement n_l * n_r / (n_l + n_r) * (mean_l - mean_r)^2 of the
residuals, leaves by one Newton step, shrunk by ``step``.  Rows are sampled for
each tree by a hash of their id.  Splits lie between bins: ``BINS`` quantiles of
a feature, or all its values if they are fewer.  Missing values count as 0.

The rows travel in chunks, in ranges of their bins: rows with the same bins in a
chunk are one cell, which every model's margin is kept for.  A tree's sample is
drawn row by row and counted per cell and class once for all models that share
it; a model's own work is per cell, of which there are at most ``BINS`` to the
power of the features.  Where no two rows are alike a cell is a row.  Margins
are brought up to date every ``KEEP`` trees in a cached table, which Spark
rebuilds from the stored chunks if an executor is lost.

Few features with few bins have few cells in all, whatever the number of rows.
Up to ``GRID_CELLS`` the tasks count the rows of each (part, class, cell), and
these counts (``Grid``) are all that a fit needs: the models are dealt to the
tasks, each of which grows its own to the end, without a pass over the rows.  A
node is then a box of the grid, and its histograms are sums along the grid's
axes.  A tree's sample is the number of rows drawn of each count, every row with
the same chance and on its own, which is what drawing row by row gives; so two
rows that are alike in all columns are drawn apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.functions.exprs import materialize

BINS = 64
#: Trees between two updates of the cached margins.
KEEP = 5
#: Cells of a chunk, at most, and rows.
CHUNK = 8192
CHUNK_ROWS = 1 << 17
#: Histograms of one pass, over all tasks, that may be gathered at once.
GATHER_BYTES = 32 << 20
#: Counts (parts x classes x cells), at most, that go whole to the tasks.
GRID_CELLS = 1 << 22
_PIECE = 1 << 14  # counts that are worked on at once, so that they stay near the processor
_SUMS = 3  # rows, gradients, second derivatives


@dataclass(frozen=True)
class Model:
    """One model: its settings, and the values of ``part`` that it learns from."""
    step: float
    sample: float
    depth: int
    least: int
    parts: frozenset


class Tree:
    """Nodes in heap order; ``feature`` is -1 where a node is not split.  A row
    goes right if its bin is above ``bin``."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.feature, self.bin, self.value = [-1] * n, [0] * n, [0.0] * n

    def values(self, codes: np.ndarray, node: int = 0):
        """Leaf values of all rows; ``codes``: one array of bins a feature."""
        f = self.feature[node]
        if f < 0:
            return np.float32(self.value[node])
        return np.where(codes[f] > self.bin[node], self.values(codes, 2 * node + 2), self.values(codes, 2 * node + 1))

    def places(self, codes: np.ndarray, level: int, node: int = 0, at: int = 0):
        """Place of each row's node in ``level``, 2^level where its path ends before."""
        if level == at:
            return np.int64(node - (2 ** level - 1))
        f = self.feature[node]
        if f < 0:
            return np.int64(2 ** level)
        return np.where(codes[f] > self.bin[node], self.places(codes, level, 2 * node + 2, at + 1), self.places(codes, level, 2 * node + 1, at + 1))


def fit_bins(rows: DataFrame, cols: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Edges between the bins of each column: midway between neighbours among
    ``bins`` quantiles, or among all values if they are fewer."""
    filled = rows.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols])
    found = [sorted(set(q)) for q in filled.approxQuantile(list(cols), [i / (bins - 1) for i in range(bins)], 0.1 / bins)]
    return [[(a + b) / 2 for a, b in zip(q, q[1:])] for q in found]


def codes(cols: Sequence[str], edges: list[list[float]]) -> Column:
    """A row's bins, one byte a column."""
    limits = [np.array(e) for e in edges]

    @F.pandas_udf("binary")
    def binned(*values: pd.Series) -> pd.Series:
        out = np.empty((len(values[0]), len(values)), np.uint8)
        for i, v in enumerate(values):
            out[:, i] = np.searchsorted(limits[i], np.nan_to_num(v.to_numpy(float, na_value=np.nan), nan=0.0), "left")
        return pd.Series([r.tobytes() for r in out])

    return binned(*[F.col(c).cast("double") for c in cols])


_FIELDS = ["codes", "cell", "label", "part", "id", "margin"]
_CHUNK = ", ".join(f"{n} binary" for n in _FIELDS)


def _packed(*values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in values], _FIELDS)


def _chunks(n_features: int, models: Sequence[Model], starts: np.ndarray):
    """Chunks from rows in the order of their codes."""
    def packed(flat, label, part, ids):
        fresh = np.ones(len(flat), bool)
        fresh[1:] = (flat[1:] != flat[:-1]).any(1)
        cell = np.cumsum(fresh) - 1
        cuts = [0]
        while cuts[-1] < len(flat):
            first = cuts[-1]
            cuts.append(min(first + CHUNK_ROWS, int(np.searchsorted(cell, cell[first] + CHUNK))))
        for a, b in zip(cuts, cuts[1:]):
            new = fresh[a:b].copy()
            new[0] = True
            own = np.ascontiguousarray(flat[a:b][new].T)
            margin = np.repeat(starts.astype(np.float32)[:, None], own.shape[1], 1)
            yield _packed(own, (np.cumsum(new) - 1).astype(np.int32), label[a:b], part[a:b], ids[a:b], margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(-1, n_features), b["label"].to_numpy().astype(np.uint8),
                         b["part"].to_numpy().astype(np.int32), b["id"].to_numpy().astype(np.int64)))
            n += b.num_rows
            if n >= CHUNK_ROWS:
                yield from packed(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            yield from packed(*map(np.concatenate, zip(*held)))
    return run


def _open(batch: pa.RecordBatch, n_features: int, n_models: int):
    for i in range(batch.num_rows):
        read = lambda name, kind: np.frombuffer(batch[name][i].as_buffer(), kind)
        codes_ = read("codes", np.uint8).reshape(n_features, -1)
        yield (codes_, read("cell", np.int32), read("label", np.uint8), read("part", np.int32), read("id", np.int64),
               read("margin", np.float32).reshape(n_models, codes_.shape[1]))


def _sampled(ids: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """A row's own draw for a tree (a mixed hash of id, tree and seed)."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(float) * 2.0 ** -53 < share


def _moved(n_features: int, models: Sequence[Model], recent: list[list[Tree]]):
    """Adds the trees of ``recent`` (by tree, by model) to the margins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes_, cell, label, part, ids, margin in _open(b, n_features, len(models)):
                margin = margin.copy()
                for trees in recent:
                    for m, tree in enumerate(trees):
                        margin[m] += np.float32(models[m].step) * tree.values(codes_)
                yield _packed(codes_, cell, label, part, ids, margin)
    return run


def _histograms(n_features: int, models: Sequence[Model], recent: list[list[Tree]], growing: list[Tree], level: int, number: int, seed: int, buckets: int):
    """Per model that has the level: sums of its sampled training rows by (node, feature, bin)."""
    active = [m for m, x in enumerate(models) if x.depth > level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros((2 ** level + 1, n_features, BINS, _SUMS)) for m in active}
        for b in batches:
            for codes_, cell, label, part, ids, margin in _open(b, n_features, len(models)):
                views, drawn, first = {}, {}, label == 1
                for m in active:
                    x = models[m]
                    if (x.parts, x.sample) not in views:
                        taken = np.isin(part, list(x.parts))
                        if x.sample < 1:
                            if x.sample not in drawn:
                                drawn[x.sample] = _sampled(ids, number, x.sample, seed)
                            taken &= drawn[x.sample]
                        every = np.bincount(cell[taken], minlength=codes_.shape[1]).astype(float)
                        cells = np.flatnonzero(every)
                        own = np.ascontiguousarray(codes_[:, cells])
                        views[x.parts, x.sample] = cells, own, own.astype(np.int64), every[cells], np.bincount(cell[taken & first], minlength=len(every))[cells].astype(float)
                    cells, own, wide, w, ones = views[x.parts, x.sample]
                    if not len(cells):
                        continue
                    f = margin[m][cells]
                    for trees in recent:
                        f = f + np.float32(x.step) * trees[m].values(own)
                    p = (1 / (1 + np.exp(-f))).astype(float)
                    g, h = ones - w * p, w * p * (1 - p)
                    place = growing[m].places(own, level) * BINS
                    size = (2 ** level + 1) * BINS
                    for i in range(n_features):
                        key = wide[i] + place
                        sums[m][:, i, :, 0] += np.bincount(key, w, size).reshape(-1, BINS)
                        sums[m][:, i, :, 1] += np.bincount(key, g, size).reshape(-1, BINS)
                        if i == 0 or level == x.depth - 1:  # leaves need them; a node that stays whole needs one feature's
                            sums[m][:, i, :, 2] += np.bincount(key, h, size).reshape(-1, BINS)
        yield pa.RecordBatch.from_arrays([pa.array([m % buckets for m in active], pa.int32()), pa.array(active, pa.int32()),
                                          pa.array([sums[m][:-1].tobytes() for m in active], pa.binary())], ["bucket", "model", "sums"])
    return run


def _newton(g, h):
    return np.where(h > 1e-150, g / np.maximum(h, 1e-150), 0.0)


def best_splits(sums: np.ndarray, least: np.ndarray):
    """Per model and node of ``sums`` (model, node, feature, bin, 3): feature (-1:
    none), bin, values left, right (of use where all second derivatives are
    there) and of the node unsplit.  Ties: first feature, lowest bin."""
    below = sums.cumsum(3)
    total = below[:, :, :1, -1:, :]
    above = total - below
    nl, nr = below[..., 0], above[..., 0]
    enough = np.maximum(least, 1)[:, None, None, None]
    gain = np.where((nl >= enough) & (nr >= enough),
                    nl * nr / np.maximum(nl + nr, 1) * (below[..., 1] / np.maximum(nl, 1) - above[..., 1] / np.maximum(nr, 1)) ** 2, -1.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    at = flat.argmax(2)
    m, node = np.ogrid[:gain.shape[0], :gain.shape[1]]
    feature, cut = np.divmod(at, gain.shape[3])
    left, right, own = below[m, node, feature, cut], above[m, node, feature, cut], total[:, :, 0, 0]
    feature = np.where(flat[m, node, at] > 1e-12, feature, -1)
    return feature, cut, _newton(left[..., 1], left[..., 2]), _newton(right[..., 1], right[..., 2]), _newton(own[..., 1], own[..., 2])


def _choose(n_features: int, models: Sequence[Model], level: int):
    shape = (2 ** level, n_features, BINS, _SUMS)

    def run(part: pa.Table) -> pa.Table:
        total: dict[int, np.ndarray] = {}
        for m, raw in sorted(zip(part["model"].to_pylist(), part["sums"].to_pylist())):  # no sum depends on the order of tasks
            r = np.frombuffer(raw).reshape(shape)
            total[m] = total[m] + r if m in total else r
        ids = np.array(list(total), np.int32)
        found = best_splits(np.stack(list(total.values())), np.array([models[m].least for m in ids]))
        nodes = np.arange(shape[0], dtype=np.int32)
        out = [np.repeat(ids, len(nodes)), np.tile(nodes, len(ids)), *[v.ravel() for v in found]]
        names = ["model", "node", "feature", "bin", "left", "right", "own"]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 3
        return pa.table({n: pa.array(o, k) for n, k, o in zip(names, kinds, out)})
    return run


_SPLITS = "model int, node int, feature int, bin int, left double, right double, own double"


@dataclass
class Grid:
    """Counts of rows: ``counts`` (part, class, *bins), its last axes being the
    columns in ``order``, those with few bins first."""
    order: list[int]
    parts: list[int]
    counts: np.ndarray

    def of(self, counts: np.ndarray, parts: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each cell in some parts, and those of class 1."""
        own = counts[[i for i, p in enumerate(self.parts) if p in parts]].sum(0).astype(float)
        return own[0] + own[1], own[1]


def grid(rows: DataFrame, cols: Sequence[str], edges: list[list[float]], label: str, part: str, parts: Iterable[int]) -> Grid | None:
    """The rows of ``parts`` counted by (part, class, bins); None where there are
    too many counts.  A null label raises."""
    places, size = sorted(parts), [len(e) + 1 for e in edges]
    order = sorted(range(len(cols)), key=lambda i: size[i])
    shape = (len(places), 2, *[size[i] for i in order])
    total = math.prod(shape)
    if total > GRID_CELLS:
        return None
    limits = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(total, np.int64)
        for b in batches:
            at = np.searchsorted(places, b["part"].to_numpy()) * 2 + b["one"].to_numpy(zero_copy_only=False)
            for i in order:
                at = at * size[i] + np.searchsorted(limits[i], b[f"c{i}"].to_numpy(), "left")
            found += np.bincount(at, minlength=total)
        cells = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(found[cells])], ["cell", "n"])

    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols)]
    one = F.when(F.col(label).isNull(), F.raise_error(F.lit("a label is null")).cast("boolean")).otherwise(F.col(label) == 1)
    taken = rows.where(F.col(part).isin(places)).select(F.col(part).cast("int").alias("part"), one.alias("one"), *filled)
    found = taken.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(total, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return Grid(order, places, counts.reshape(shape))


def _share(ones, n) -> float:
    share = min(max(ones / n, 1e-15), 1 - 1e-15) if n else 0.5
    return np.log(share / (1 - share))


def _drawn_counts(counts: np.ndarray, share: float, seed: Sequence[int]) -> np.ndarray:
    """Of each count of rows how many are drawn, every row with the chance
    ``share`` (to 32 binary places) and on its own: a row is a bit."""
    rng = np.random.default_rng(seed)
    digits, places = round(share * 2 ** 32), 32
    while digits and digits % 2 == 0:
        digits, places = digits // 2, places - 1
    whole, out = counts.ravel(), np.zeros(counts.size, np.int64)
    for first in range(0, counts.size, _PIECE):
        n = whole[first:first + _PIECE]
        at = np.flatnonzero(n)
        n = n[at]
        while len(at):
            bits = np.zeros(len(at), np.uint64)
            for i in range(places):  # from the last place on: each halves the chance, a 1 adds a half
                random = rng.integers(0, 1 << 64, len(at), np.uint64)
                bits = bits | random if digits >> i & 1 else bits & random
            bits &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - np.minimum(n, 64)).astype(np.uint64)
            out[first + at] += np.bitwise_count(bits)
            more = n > 64
            at, n = at[more], n[more] - 64
    return out.reshape(counts.shape)


def _margin_sums(x: np.ndarray) -> list[np.ndarray]:
    """Sums (first axis, bin) of ``x`` along each of its other axes."""
    if x.ndim == 2:
        return [x]
    half = (x.ndim + 1) // 2
    return [*_margin_sums(x.sum(tuple(range(half, x.ndim)))), *_margin_sums(x.sum(tuple(range(1, half))))]


def _leaves(tree: Tree, axis: Sequence[int], box: tuple, node: int = 0):
    """The leaves of a tree as (box of the grid, value); ``axis``: of each column."""
    f = tree.feature[node]
    if f < 0:
        yield box, tree.value[node]
        return
    for child, own in ((2 * node + 1, _part_of(box, axis[f], tree.bin[node], 0)), (2 * node + 2, _part_of(box, axis[f], tree.bin[node], 1))):
        yield from _leaves(tree, axis, own, child)


def _part_of(box: tuple, i: int, cut: int, right: int) -> tuple:
    own = slice(cut + 1, box[i].stop) if right else slice(box[i].start, cut + 1)
    return (*box[:i], own, *box[i + 1:])


def _grown(order: Sequence[int], sums: np.ndarray, model: Model) -> Tree:
    """One tree; ``sums``: (3: rows, gradients, second derivatives; *bins)."""
    tree, axis = Tree(model.depth), list(np.argsort(order))
    boxes = {0: tuple(slice(0, n) for n in sums.shape[1:])}
    for level in range(model.depth):
        first = 2 ** level - 1
        nodes = [n for n in range(first, 2 * first + 1) if n in boxes]
        if not nodes:
            break
        seen = np.zeros((1, len(nodes), len(order), BINS, _SUMS))
        for k, n in enumerate(nodes):
            for i, found in enumerate(_margin_sums(sums[(slice(None), *boxes[n])])):
                seen[0, k, order[i], boxes[n][i]] = found.T
        for n, feature, cut, left, right, own in zip(nodes, *[v[0].tolist() for v in best_splits(seen, np.array([model.least]))]):
            tree.value[n] = own
            if feature >= 0:
                tree.feature[n], tree.bin[n] = feature, cut
                tree.value[2 * n + 1], tree.value[2 * n + 2] = left, right
                for right_, child in ((0, 2 * n + 1), (1, 2 * n + 2)):
                    boxes[child] = _part_of(boxes[n], axis[feature], cut, right_)
    return tree


def _gradients(margin: np.ndarray, ones: np.ndarray, sums: np.ndarray) -> None:
    """Fills gradients and second derivatives of the cells in beside their rows."""
    for first in range(0, len(margin), _PIECE):
        own = slice(first, first + _PIECE)
        p = 1 / (1 + np.exp(-margin[own]))
        hit = sums[0, own] * p
        np.subtract(ones[own], hit, out=sums[1, own])
        np.multiply(hit, 1 - p, out=sums[2, own])


def _train_on_grid(spark, cells: Grid, models: Sequence[Model], trees: int, seed: int) -> tuple[np.ndarray, list[list[Tree]]]:
    starts = np.array([_share(*(x.sum() for x in reversed(cells.of(cells.counts, m.parts)))) for m in models])
    tasks = max(1, min(len(models), spark.sparkContext.defaultParallelism))
    dealt = sorted(range(len(models)), key=lambda m: (models[m].depth, models[m].sample))
    axis = list(np.argsort(cells.order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [m for b in batches for t in b["id"].to_pylist() for m in dealt[t::tasks]]
        bins = cells.counts.shape[2:]
        box = tuple(slice(0, n) for n in bins)
        margin = {m: np.full(bins, starts[m]) for m in mine}
        grown: dict[int, list[Tree]] = {m: [] for m in mine}
        sums = np.empty((_SUMS, *bins))
        whole = {x.parts: cells.of(cells.counts, x.parts) for x in (models[m] for m in mine) if x.sample >= 1}
        for number in range(trees):
            drawn, views = {}, {(k, 1.0): v for k, v in whole.items()}
            for m in mine:
                x = models[m]
                key = x.parts, min(x.sample, 1.0)
                if key not in views:
                    if x.sample not in drawn:
                        drawn[x.sample] = _drawn_counts(cells.counts, x.sample, [seed, number, round(x.sample * 2 ** 32)])
                    views[key] = cells.of(drawn[x.sample], x.parts)
                sums[0], ones = views[key]
                _gradients(margin[m].ravel(), ones.ravel(), sums.reshape(_SUMS, -1))
                tree = _grown(cells.order, sums, x)
                for own, value in _leaves(tree, axis, box):
                    margin[m][own] += x.step * value
                grown[m].append(tree)
        for m in mine:
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), *[pa.array([np.array([getattr(t, k) for t in grown[m]], kind).tobytes()], pa.binary())
                                                                           for k, kind in _PACKED.items()]], ["model", *_PACKED])

    found = spark.range(0, tasks, 1, tasks).mapInArrow(run, "model int, " + ", ".join(f"{k} binary" for k in _PACKED)).toArrow().to_pylist()
    forest: list[list[Tree]] = [[] for _ in models]
    for r in found:
        packed = [np.frombuffer(r[k], kind).reshape(trees, -1).tolist() for k, kind in _PACKED.items()]
        for values in zip(*packed):
            tree = Tree(models[r["model"]].depth)
            tree.feature, tree.bin, tree.value = values
            forest[r["model"]].append(tree)
    return starts, forest


_PACKED = {"feature": np.int32, "bin": np.int32, "value": np.float64}


def train(rows: DataFrame, models: Sequence[Model], trees: int, n_features: int, seed: int = 123, cells: Grid | None = None) -> tuple[np.ndarray, list[list[Tree]]]:
    """``rows``: ``codes`` (see above), ``label`` (0 or 1), ``part`` int, ``id``
    long, best a stored table; not read if there are ``cells`` of all the models'
    parts.  Returns the models' starting margins and, per model, its trees."""
    if cells is not None:
        return _train_on_grid(rows.sparkSession, cells, models, trees, seed)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).collect()
    starts = []
    for m in models:
        n = sum(r["n"] for r in counts if r["part"] in m.parts)
        ones = sum(r["ones"] for r in counts if r["part"] in m.parts)
        starts.append(_share(ones, n))
    starts = np.array(starts)
    needed = set().union(*[m.parts for m in models])
    taken = rows.where(F.col("part").isin([int(p) for p in needed])).select("codes", F.col("label").cast("int").alias("label"), F.col("part").cast("int").alias("part"), F.col("id").cast("long").alias("id"))
    taken = taken.repartitionByRange("codes", "id").sortWithinPartitions("codes")  # a cell with many rows is cut by their ids
    state = materialize(taken.mapInArrow(_chunks(n_features, models, starts), _CHUNK))
    tasks = max(1, min(state.rdd.getNumPartitions(), 2 * sum(r["n"] for r in counts) // CHUNK))
    state = state.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    older, recent, forest = None, [], []
    buckets = max(1, min(len(models), 8))
    for number in range(trees):
        growing = [Tree(m.depth) for m in models]
        for level in range(max(m.depth for m in models)):
            sums = state.mapInArrow(_histograms(n_features, models, recent, growing, level, number, seed, buckets), "bucket int, model int, sums binary")
            choose = _choose(n_features, models, level)
            size = tasks * sum(m.depth > level for m in models) * 2 ** level * n_features * BINS * _SUMS * 8
            found = choose(sums.toArrow()) if size <= GATHER_BYTES else sums.groupBy("bucket").applyInArrow(choose, _SPLITS).toArrow()
            for s in found.to_pylist():
                tree, node = growing[s["model"]], 2 ** level - 1 + s["node"]
                if level and tree.feature[(node - 1) // 2] < 0:
                    continue
                tree.value[node] = s["own"]
                if s["feature"] >= 0:
                    tree.feature[node], tree.bin[node] = s["feature"], s["bin"]
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = s["left"], s["right"]
            if older is not None:
                older.unpersist()
                older = None
        recent = recent + [growing]
        forest.append(growing)
        if len(recent) == KEEP and number + 1 < trees:
            older, state, recent = state, state.mapInArrow(_moved(n_features, models, recent), _CHUNK).persist(StorageLevel.MEMORY_AND_DISK), []
    for df in (older, state):
        if df is not None:
            df.unpersist()
    return starts, [[t[m] for t in forest] for m in range(len(models))]


def margins(models: Sequence[Model], starts: Sequence[float], forest: list[list[Tree]]):
    """A pandas UDF of (``codes``, model): each row's margin of class 1 by the
    model of that place."""
    @F.pandas_udf("double")
    def scored(packed: pd.Series, which: pd.Series) -> pd.Series:
        out = np.empty(len(packed))
        for m in which.unique():
            rows = np.flatnonzero(which == m)
            flat = np.stack([np.frombuffer(packed.iloc[i], np.uint8) for i in rows], 1)
            total = np.full(len(rows), float(starts[m]))
            for t in forest[m]:
                total += models[m].step * t.values(flat)
            out[rows] = total
        return pd.Series(out)

    return scored


def _grid_margins(bins: Sequence[int], axis: Sequence[int], model: Model, start: float, trees: Sequence[Tree], stages: Iterable[int]):
    """Margins of all cells after some numbers of trees, as (number, margins)."""
    margin = np.full(bins, float(start))
    for n, tree in enumerate(trees, 1):
        for own, value in _leaves(tree, axis, tuple(slice(0, k) for k in bins)):
            margin[own] += model.step * value
        if n in stages:
            yield n, margin


def staged_hits(rows: DataFrame, models: Sequence[Model], starts: np.ndarray, forest: list[list[Tree]], held_out: Sequence[frozenset],
                stages: Sequence[int], n_features: int, cells: Grid | None = None) -> DataFrame:
    """Per model and stage (number of trees): ``ones``, rows of class 1 in its
    held-out parts, and ``hits``, those with a margin above 0; one pass over the
    rows, or over the models if there are ``cells``."""
    last = max(stages)
    if cells is not None:
        spark = rows.sparkSession
        tasks = max(1, min(len(models), spark.sparkContext.defaultParallelism))
        axis, bins = list(np.argsort(cells.order)), cells.counts.shape[2:]
        ones = {p: cells.of(cells.counts, p)[1] for p in set(held_out)}

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for m in (m for b in batches for t in b["id"].to_pylist() for m in range(len(models))[t::tasks]):
                own = ones[held_out[m]]
                found += [(m, n, int(own.sum()), int(own[margin > 0].sum())) for n, margin in _grid_margins(bins, axis, models[m], starts[m], forest[m][:last], set(stages))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4, ["model", "stage", "ones", "hits"])

        return spark.range(0, tasks, 1, tasks).mapInArrow(dealt, "model long, stage long, ones long, hits long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            flat = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(-1, n_features).T
            ones, part = b["label"].to_numpy() == 1, b["part"].to_numpy()
            views = {p: np.ascontiguousarray(flat[:, ones & np.isin(part, list(p))]) for p in set(held_out)}
            for m, model in enumerate(models):
                own = views[held_out[m]]
                f = np.full(own.shape[1], float(starts[m]))
                for n, tree in enumerate(forest[m][:last], 1):
                    f += model.step * tree.values(own)
                    if n in stages:
                        total = found.setdefault((m, n), [0, 0])
                        total[0] += own.shape[1]
                        total[1] += int((f > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[(m, n, *v) for (m, n), v in found.items()])] if found else [pa.array([], pa.int64())] * 4,
                                         ["model", "stage", "ones", "hits"])

    packed = rows.select("codes", F.col("label").cast("int").alias("label"), F.col("part").cast("int").alias("part"))
    return packed.mapInArrow(run, "model long, stage long, ones long, hits long").groupBy("model", "stage").agg(F.sum("ones").alias("ones"), F.sum("hits").alias("hits"))


@dataclass
class Boosted:
    """A fitted model with its columns and bins."""
    cols: list[str]
    edges: list[list[float]]
    model: Model
    start: float
    trees: list[Tree]

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """``rows`` with ``out``, the margin of class 1; looked up by cell where they are few."""
        bins = [len(e) + 1 for e in self.edges]
        if self.trees and math.prod(bins) <= GRID_CELLS:
            table = next(m for _, m in _grid_margins(bins, range(len(bins)), self.model, self.start, self.trees, [len(self.trees)])).ravel()
            limits = [np.array(e) for e in self.edges]

            @F.pandas_udf("double")
            def looked_up(*values: pd.Series) -> pd.Series:
                at = np.zeros(len(values[0]), np.int64)
                for limit, v in zip(limits, values):
                    at = at * (len(limit) + 1) + np.searchsorted(limit, np.nan_to_num(v.to_numpy(float, na_value=np.nan), nan=0.0), "left")
                return pd.Series(table[at])

            return rows.withColumn(out, looked_up(*[F.col(c).cast("double") for c in self.cols]))
        return rows.withColumn(out, margins([self.model], [self.start], [self.trees])(codes(self.cols, self.edges), F.lit(0)))
