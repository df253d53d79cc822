"""LOWESS from cell moments against a dense computation."""

import numpy as np
import pytest

from varlens.operators import smoothing as SM

FRAC = 0.15


def dense(x, n, y):
    k, out = max(1, int(FRAC * n.sum() + 1e-10)), []
    for a in x:
        d = np.abs(x - a)
        order = np.argsort(d, kind="stable")
        r = d[order][np.searchsorted(np.cumsum(n[order]), k)]
        if r == 0:
            out.append(y[d == 0][0] / n[d == 0][0])
            continue
        w = np.where(d < r, (1 - (d / r) ** 3) ** 3, 0)
        e, total = x - a, (w * n).sum()
        mx, my = (w * n * e).sum() / total, (w * y).sum() / total
        out.append(my - mx * ((w * y * e).sum() / total - mx * my) / max((w * n * e * e).sum() / total - mx * mx, 1e-12))
    return np.array(out)


def cases():
    rng = np.random.default_rng(1)
    sets = {"even": rng.random(700), "ties": np.round(rng.random(900), 2), "few": np.array([.1, .5, .5, .9]), "one": np.array([.3]),
            "two clusters": np.concatenate([rng.normal(.2, .001, 300), rng.random(60), rng.normal(.9, .03, 300)]),
            "hot value": np.concatenate([np.full(700, .5), rng.random(250)]),
            "gap": np.concatenate([rng.random(200) * 1e-4, 1 - rng.random(200) * 1e-4, [.3, .5]])}
    for name, x in sets.items():
        u, n = np.unique(x, return_counts=True)
        yield name, u, n.astype(float), rng.binomial(n, np.clip(u, 0, 1)).astype(float)


@pytest.mark.parametrize("cells", [5, 64])
def test_equals_dense(spark, monkeypatch, cells):
    monkeypatch.setattr(SM, "CELLS", cells)
    rows = [(name, float(a), int(b), float(c)) for name, x, n, y in cases() for a, b, c in zip(x, n, y)]
    points = spark.createDataFrame(rows + [("one", None, 3, 1.0), ("one", 0.7, 0, 0.0)], "g string, x double, n long, y double")
    got = {(r["g"], r["x"]): r["smooth"] for r in SM.lowess(points, ["g"], "x", "n", "y", FRAC).collect()}
    assert len(got) == len(rows)
    for name, x, n, y in cases():
        assert np.allclose([got[name, a] for a in x], dense(x, n, y), atol=1e-6), name
    assert SM.lowess(points.where("false"), ["g"], "x", "n", "y").count() == 0


def test_error_rate_of_scores(spark):
    rows = [("a", i / 40, 3 if i % 3 else 1, 2) for i in range(41)]
    st = spark.createDataFrame(rows, "run string, score double, pos long, neg long")
    got = sorted(map(tuple, SM.smoothed_error_rate(st, ["run"]).select("score", "n", "n_wrong", "conf", "error_rate").collect()))
    x = np.array([r[1] for r in rows])
    n = np.array([r[2] + r[3] for r in rows], float)
    wrong = np.array([r[3] if r[1] > 0.5 else r[2] for r in rows], float)
    assert [g[0] for g in got] == list(x) and [g[1] for g in got] == list(n) and [g[2] for g in got] == list(wrong)
    assert np.allclose([g[4] for g in got], 100 * dense(x, n, wrong))
    assert np.allclose([g[3] for g in got], np.where(x < 0.5, 1 - x, x))
