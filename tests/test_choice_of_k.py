"""Fits of k-means that run at once, silhouettes over more rows than a group."""

import threading
import time

import numpy as np
from pyspark.ml.clustering import KMeans

from varlens.operators import ml as ML


def test_fits_run_at_once_and_give_the_same(spark, monkeypatch):
    """Before: one fit after the other."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([tuple(map(float, x)) for x in np.concatenate([rng.normal(m, 0.5, (15, 2)) for m in (0, 3, 7)])], "a double, b double")
    lock, running, most, fit = threading.Lock(), [0], [0], KMeans.fit

    def counted(self, data):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            time.sleep(0.3)
            return fit(self, data)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(KMeans, "fit", counted)
    found = ML.choice_of_k(df, ["a", "b"], 4, restarts=3)
    assert most[0] > 1
    monkeypatch.setattr(ML, "KMEANS_FITS", 1)
    one = ML.choice_of_k(df, ["a", "b"], 4, restarts=3)
    assert [f[0] for f in found] == [1, 2, 3, 4] and found[0][2] is None
    assert np.allclose([f[1] for f in found[:3]], [f[1] for f in one[:3]]) and np.allclose([f[2] for f in found[1:3]], [f[2] for f in one[1:3]])  # k = 4 has no clear best
    assert max(found[1:], key=lambda f: f[2])[0] == 3
    data = ML.assemble(df, ["a", "b"])
    want = min(fit(KMeans(k=3, seed=42 + r, featuresCol="features"), data).summary.trainingCost for r in range(3))
    assert np.isclose(found[2][1], want)


def test_silhouettes_in_groups_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    points, labels = rng.normal(size=(300, 4)), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(p.tolist(), [int(c)]) for p, c in zip(points, labels)], "vector array<double>, labels array<int>").coalesce(1)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    own = [far[i][(labels == labels[i]) & (np.arange(300) != i)].mean() for i in range(300)]
    other = [min(far[i][labels == k].mean() for k in set(labels) if k != labels[i]) for i in range(300)]
    want = np.mean([(b - a) / max(a, b) for a, b in zip(own, other)])
    for rows, batch in ((128, 50), (70, 512), (16384, 7)):
        monkeypatch.setattr(ML, "SILHOUETTE_ROWS", rows)
        monkeypatch.setattr(ML, "SILHOUETTE_BATCH", batch)
        assert np.allclose(ML.silhouettes(df, [3]), [want])
