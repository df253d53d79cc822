"""Boosted trees grown together against a plain implementation, one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.operators import boosting as B
from varlens.operators import ml as ML


def plain_fit(codes, y, model, trees):
    """All rows in every tree; codes: one array of bins a feature."""
    start = np.log(y.mean() / (1 - y.mean()))
    f, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)

        def grow(rows, depth):
            leaf = g[rows].sum() / h[rows].sum()
            best = (1e-12, None)
            if depth < model.depth:
                for i in range(len(codes)):
                    for cut in range(B.BINS):
                        left = codes[i][rows] <= cut
                        a, b = left.sum(), (~left).sum()
                        if a >= model.least and b >= model.least:
                            gain = a * b / (a + b) * (g[rows][left].mean() - g[rows][~left].mean()) ** 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (i, cut))
            if best[1] is None:
                f[rows] += model.step * leaf
                return
            left = codes[best[1][0]][rows] <= best[1][1]
            grow(rows[left], depth + 1)
            grow(rows[~left], depth + 1)

        grow(np.arange(len(y)), 0)
        out.append(f.copy())
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    x[:, 2] = np.round(x[:, 2], 1)
    y = (rng.random(600) < 1 / (1 + np.exp(-4 * (x[:, 0] - 0.5) - 6 * x[:, 1] * x[:, 2] + 1.5))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(c), i % 3) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int, fold int")
    cols = ["a", "b", "c"]
    edges = B.fit_bins(df, cols)
    rows = df.select("id", B.codes(cols, edges).alias("codes"), "label", F.col("fold").alias("part")).cache()
    return df, cols, rows


def test_models_equal_a_plain_fit(spark, table):
    _, cols, rows = table
    models = [B.Model(0.1, 1.0, d, least, frozenset(parts)) for d, least in ((1, 1), (2, 3), (3, 20)) for parts in ((0, 1), (0, 1, 2))]
    starts, forest = B.train(rows, models, 7, len(cols))  # more than KEEP, so margins are moved
    data = rows.orderBy("id").collect()
    codes = np.array([list(r["codes"]) for r in data]).T
    y, part = np.array([r["label"] for r in data]), np.array([r["part"] for r in data])
    for m, model in enumerate(models):
        own = np.isin(part, list(model.parts))
        want = plain_fit(codes[:, own], y[own], model, 7)[-1]
        got = starts[m] + sum(model.step * t.values(codes[:, own]) for t in forest[m])
        assert np.allclose(got, want, atol=1e-4), model
    scored = rows.withColumn("m", F.lit(3)).withColumn("s", B.margins(models, starts, forest)("codes", "m")).orderBy("id").collect()
    assert np.allclose([r["s"] for r in scored], starts[3] + sum(models[3].step * t.values(codes) for t in forest[3]))


def test_shuffled_and_gathered_histograms_agree(spark, table, monkeypatch):
    _, cols, rows = table
    models = [B.Model(0.1, 0.5, 3, 2, frozenset([0, 2])), B.Model(0.05, 1.0, 2, 2, frozenset([1, 2]))]
    one = B.train(rows, models, 4, len(cols))
    monkeypatch.setattr(B, "GATHER_BYTES", 0)
    two = B.train(rows.repartition(3), models, 4, len(cols))
    for a, b in zip(one[1], two[1]):
        assert [t.feature for t in a] == [t.feature for t in b] and [t.bin for t in a] == [t.bin for t in b]
        assert np.allclose([t.value for t in a], [t.value for t in b], atol=1e-6)


def test_a_stage_equals_a_fit_with_fewer_trees(spark, table):
    df, cols, _ = table
    grid = dict(maxIter=(3, 6), stepSize=(0.1, 0.5), subsamplingRate=(0.5, 1.0), maxDepth=(2,), minInstancesPerNode=(1,))
    best, both = ML.grid_search(df, cols, grid=grid)
    _, few = ML.grid_search(df, cols, grid={**grid, "maxIter": (3,)}, refit=False)
    assert len(both) == 8 and len(few) == 4
    assert [t for t in both if t[0]["maxIter"] == 3] == few
    assert max(r for _, r in both) > 0.5
    first = max(both, key=lambda t: t[1])[0]
    assert len(best.trees) == first["maxIter"] and best.model.parts == frozenset(range(3))
    scored = best.score(df).agg(F.avg((F.signum("score") > 0).cast("int")).alias("a"), F.count("score").alias("n")).first()
    assert scored["n"] == 600 and 0 < scored["a"] < 1


def test_nested_cv_scores_every_outer_row_once(spark, table):
    df, cols, _ = table
    outer = spark.createDataFrame([(0,), (1,), (2,)], "for_outer int")
    rows = df.join(outer).withColumn("role", F.when(F.col("fold") == F.col("for_outer"), "outer_test").otherwise("inner"))
    setting = dict(ML.GBT_PARAMS, maxIter=5)
    got = ML.nested_cv(rows, cols, setting=setting).collect()
    assert sorted(r["id"] for r in got) == list(range(600)) and all(r["fold"] == r["id"] % 3 for r in got)
    pos, neg = [r["score"] for r in got if r["label"]], [r["score"] for r in got if not r["label"]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.6
    assert ML.nested_cv(rows.where("false"), cols, setting=setting).count() == 0


def test_rows_with_the_same_bins_are_one_cell(spark, monkeypatch):
    """A model's work is per cell: 4,000 rows with 12 different bins have margins for few cells."""
    monkeypatch.setattr(B, "CHUNK_ROWS", 1500)
    rng = np.random.default_rng(8)
    x, part = rng.integers(0, [4, 3], (4000, 2)), rng.integers(0, 3, 4000)
    y = (rng.random(4000) < 0.2 + 0.15 * x[:, 0] + 0.1 * (x[:, 1] == 1)).astype(int)
    df = spark.createDataFrame([(i, bytes(map(int, r)), int(c), int(p)) for i, (r, c, p) in enumerate(zip(x, y, part))], "id long, codes binary, label int, part int")
    model = B.Model(0.1, 1.0, 2, 1, frozenset([0, 2]))
    starts, forest = B.train(df, [model], 7, 2)
    own = np.isin(part, [0, 2])
    got = starts[0] + sum(model.step * t.values(x[own].T.astype(np.uint8)) for t in forest[0])
    assert np.allclose(got, plain_fit(x[own].T, y[own], model, 7)[-1], atol=1e-4)
    rows = df.coalesce(1).sortWithinPartitions("codes").mapInArrow(B._chunks(2, [model], starts), B._CHUNK).toArrow()
    cells = [len(m) // 4 for m in rows["margin"].to_pylist()]
    assert sum(len(i) // 8 for i in rows["id"].to_pylist()) == 4000 and sum(cells) < 100
