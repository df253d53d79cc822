"""Models grown on a grid of counts against the same models grown on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.operators import boosting as B
from varlens.operators import ml as ML


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 9, 3000), rng.integers(0, 40, 3000) / 7, rng.random(3000).round(2)], 1)
    y = (rng.random(3000) < 1 / (1 + np.exp(-0.6 * (x[:, 0] - 4) - 4 * (x[:, 1] / 6) * x[:, 2] + 1))).astype(int)
    rows = [(i, *map(float, r), int(c), i % 3) for i, (r, c) in enumerate(zip(x, y))]
    rows += [(3000 + i, None, float("nan"), 0.5, 0, i % 3) for i in range(30)]  # missing values count as 0
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int, fold int").repartition(3), ["c", "b", "a"]


def test_grid_and_rows_grow_the_same_trees(spark, table, monkeypatch):
    df, cols = table
    rows, edges, cells = ML._binned(df, cols, "label", "fold", range(3))
    assert cells.counts.sum() == 3030 and cells.counts[:, 0].sum() == df.where("label = 0").count()
    models = [B.Model(0.1, 1.0, d, least, frozenset(parts)) for d, least in ((1, 1), (2, 3), (3, 20)) for parts in ((0, 1), (0, 1, 2))]
    models.append(B.Model(0.1, 1.0, 3, 700, frozenset([0, 1])))  # some nodes above the last level stay whole
    a, b = B.train(rows, models, 8, 3, cells=cells), B.train(rows.cache(), models, 8, 3)
    assert np.allclose(a[0], b[0])
    for x, y in zip(a[1], b[1]):
        assert [t.feature for t in x] == [t.feature for t in y] and [t.bin for t in x] == [t.bin for t in y]
        for s, t in zip(x, y):
            ends = [n for n, f in enumerate(s.feature) if f < 0 and (n == 0 or s.feature[(n - 1) // 2] >= 0)]
            assert np.allclose([s.value[n] for n in ends], [t.value[n] for n in ends], atol=1e-4)
    held = [frozenset(range(3)) - m.parts for m in models]
    hits = [sorted(map(tuple, B.staged_hits(rows, models, *a, held, [3, 8], 3, cells=c).collect())) for c in (cells, None)]
    assert hits[0] == hits[1]
    fitted = B.Boosted(cols, edges, models[4], float(a[0][4]), a[1][4])
    quick = {r["id"]: r["score"] for r in fitted.score(df).collect()}
    monkeypatch.setattr(B, "GRID_CELLS", 0)
    slow = {r["id"]: r["score"] for r in fitted.score(df).collect()}
    assert len(quick) == 3030 and np.allclose([quick[i] for i in sorted(quick)], [slow[i] for i in sorted(slow)], atol=1e-6)
    assert ML._binned(df, cols, "label", "fold", range(3))[2] is None


def test_rows_are_drawn_each_on_its_own():
    counts = np.array([0, 1, 1, 5, 64, 65, 200, 10 ** 4] * 300)
    for share in (0.5, 0.3):
        drawn = B._drawn_counts(counts, share, [1, 2])
        assert (drawn <= counts).all() and (drawn >= 0).all() and (drawn == B._drawn_counts(counts, share, [1, 2])).all()
        for n in (1, 5, 64, 65, 200, 10 ** 4):
            own = drawn[counts == n]
            sd = (n * share * (1 - share)) ** 0.5
            assert abs(own.mean() - n * share) < 5 * sd / len(own) ** 0.5 and 0.7 * sd < own.std() < 1.3 * sd
    assert (B._drawn_counts(counts, 0.5, [1, 3]) != B._drawn_counts(counts, 0.5, [1, 2])).any()


def test_a_search_over_few_cells_makes_no_pass_a_tree(spark, table, monkeypatch):
    """Before: several jobs a tree."""
    df, cols = table
    small = dict(maxIter=(20, 40), stepSize=(0.1,), subsamplingRate=(0.5, 1.0), maxDepth=(2, 3), minInstancesPerNode=(1,))
    spark.sparkContext.setJobGroup("grid", "search")
    best, found = ML.grid_search(df, cols, grid=small)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid"))
    spark.sparkContext.setJobGroup("other", "")
    assert 0 < jobs < 30 and len(found) == 8 and min(r for _, r in found) > 0.5
    monkeypatch.setattr(B, "GRID_CELLS", 0)
    _, by_rows = ML.grid_search(df, cols, grid=small, refit=False)
    for (s, x), (t, y) in zip(found, by_rows):  # other draws where rows are sampled
        assert s == t and abs(x - y) < (1e-6 if s["subsamplingRate"] == 1 else 0.05)


def test_gbt_margin_scores_with_all_columns_kept(spark, table):
    df, cols = table
    train = df.where("fold <> 0 AND id < 3000")
    got = ML.gbt_margin(train, df.where("fold = 0"), cols, maxIter=30)
    assert got.columns == [*df.columns, "prediction", "score"]
    rows = got.collect()
    assert len(rows) == 1010 and all((r["score"] > 0) == (r["prediction"] == 1) for r in rows)
    pos, neg = [r["score"] for r in rows if r["label"]], [r["score"] for r in rows if not r["label"]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.75
    with pytest.raises(Exception, match="a label is null"):
        ML.gbt_margin(train.withColumn("label", F.when(F.col("id") > 7, F.col("label"))), df, cols, maxIter=2)
    with pytest.raises(Exception, match="missing or infinite"):
        ML.gbt_margin(df, df, cols, maxIter=2)
    with pytest.raises(TypeError):
        ML.gbt_margin(train, df, cols, trees=2)
    vectors = [ML.assemble(x, cols, "v").drop(*cols) for x in (train, train)]
    one = {r["id"]: r["score"] for r in ML.gbt_margin(*vectors, ["v"], maxIter=5).collect()}
    assert one == {r["id"]: r["score"] for r in ML.gbt_margin(train, train, cols, maxIter=5).collect()}


def test_tuned_holdout_makes_no_pass_a_tree(spark, table):
    """Before: several jobs a tree."""
    df, cols = table
    small = dict(maxIter=(20, 40), stepSize=(0.1,), subsamplingRate=(0.5,), maxDepth=(2, 3), minInstancesPerNode=(1,))
    spark.sparkContext.setJobGroup("tuned", "holdout")
    scored, found = ML.tuned_holdout(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), cols, "id", grid=small)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("tuned"))
    spark.sparkContext.setJobGroup("other", "")
    rows = scored.collect()
    assert 0 < jobs < 60 and len(found) == 4 and sorted(r["id"] for r in rows) == list(range(0, 3030, 4))
    pos, neg = [r["score"] for r in rows if r["label"]], [r["score"] for r in rows if not r["label"]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.75
