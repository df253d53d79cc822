"""Local linear smoothing over a score axis (CRV-15): LOWESS without robust
passes, exact at every distinct x.

At x the ``k`` nearest points (``k`` = the whole part of ``frac`` * n) give the
bandwidth r, the distance of the k-th; a point at distance d < r weighs
(1 - (d / r)^3)^3 and a straight line is fitted.  Points at distance r weigh
nothing, so the fit depends on r alone and not on how ties are cut.

No row meets all others.  The tricube weight is a polynomial in the distance
on either side of x, so sums over a whole cell of neighbouring points follow
from its moments.  A key's points are cut into at most ``CELLS`` cells of
about equal count; a table of cells (moments about the cell's first point) goes
to the tasks, at most ``CELLS`` rows a key.  From it alone every x finds the
few cells in which its window can begin and end; x values with one home cell
and one first cell form a group, and only the points of those cells travel to
it.  All whole cells between are summed from moments shifted to the group, the
cut cells from running moments that start at the window's inner side, so
nothing large is ever subtracted.  Windows that end inside the home cell are
summed point by point.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.functions.exprs import materialize
from varlens.functions.prefix import prefix_sum
from varlens.operators.curves import _conf_table, _n
from varlens.operators.metrics import regroup

#: Cells of a key; also the bound of what is sent to the tasks for it.
CELLS = 128
#: Powers of the distance: nine of the weight and two of the line.
_POWERS = 12
#: Tricube weight by powers of distance / r.
_TRICUBE = ((0, 1.0), (3, -3.0), (6, 3.0), (9, -1.0))
#: Sums are taken about points at most half of this part of r away.
_NEAR = 0.25
#: Distances nearer than this part of x and r count as equal.
_ROUNDING = 4e-16
#: The variance of x in a window is at least this, as in the usual library.
_LEAST_VARIANCE = 1e-12


def _powers(d: np.ndarray) -> np.ndarray:
    """Rows of d^0 .. d^11."""
    out = np.ones((len(d), _POWERS))
    for p in range(1, _POWERS):
        out[:, p] = out[:, p - 1] * d
    return out


def _shift(moments: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Moments of (d + by), from moments of d: (rows, 2, powers), by: (rows)."""
    b, out = _powers(by), np.zeros_like(moments)
    for p in range(_POWERS):
        for q in range(p + 1):
            out[:, :, p] += comb(p, q) * b[:, None, p - q] * moments[:, :, q]
    return out


def _moments(x: np.ndarray, n: np.ndarray, y: np.ndarray, centre: float) -> np.ndarray:
    """(points, 2, powers): n * d^p and y * d^p of each point."""
    return np.stack([n, y], 1)[:, :, None] * _powers(x - centre)[:, None, :]


def _weighted(left: np.ndarray, right: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(rows, 2, 3): weighted sums of d^0, d^1, d^2, from the moments about x of
    the window's two sides."""
    out = np.zeros((len(r), 2, 3))
    for power, factor in _TRICUBE:
        scale = (factor / r ** power)[:, None]
        for p in range(3):
            out[:, :, p] += scale * (right[:, :, p + power] + (-1) ** power * left[:, :, p + power])
    return out


def _line(s: np.ndarray) -> np.ndarray:
    """Value at x of the line with the weighted sums ``s`` (rows, 2, 3)."""
    mean_x, mean_y = s[:, 0, 1] / s[:, 0, 0], s[:, 1, 0] / s[:, 0, 0]
    variance = np.maximum(s[:, 0, 2] / s[:, 0, 0] - mean_x ** 2, _LEAST_VARIANCE)
    return mean_y - mean_x * (s[:, 1, 1] / s[:, 0, 0] - mean_x * mean_y) / variance


class Cells:
    """A key's cells in order: first and last x, count, moments about the first."""

    def __init__(self, cell, first, last, n, moments):
        self.cell, self.first, self.last = np.asarray(cell), np.asarray(first, float), np.asarray(last, float)
        self.moments = np.asarray(moments, float).reshape(len(self.cell), 2, _POWERS)
        self.before = np.concatenate([[0], np.cumsum(np.asarray(n))])

    def whole(self, x, r):
        """Points of the cells that lie whole within r of x."""
        a, b = np.searchsorted(self.first, x - r, "left"), np.searchsorted(self.last, x + r, "right")
        return np.where(b > a, self.before[np.maximum(b, a)] - self.before[a], 0)

    def touched(self, x, r):
        """Points of the cells that reach within r of x."""
        a, b = np.searchsorted(self.last, x - r, "left"), np.searchsorted(self.first, x + r, "right")
        return np.where(b > a, self.before[np.maximum(b, a)] - self.before[a], 0)

    def bracket(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds low < r <= high of the distance of the k-th nearest point (low
        may be negative: no bound), by bisection on the cells' edges."""
        span = np.maximum(x - self.first[0], self.last[-1] - x)
        low, high = np.full(len(x), -1.0), span
        for _ in range(40):
            middle = (np.maximum(low, 0) + high) / 2
            enough, few = self.whole(x, middle) >= k, self.touched(x, middle) < k
            high, low = np.where(enough, middle, high), np.where(few, np.maximum(low, middle), low)
            # neither is known at the middle: close in on both bounds in turn
            unknown = ~enough & ~few
            lower, upper = (np.maximum(low, 0) + middle) / 2, (middle + high) / 2
            low = np.where(unknown & (self.touched(x, lower) < k), np.maximum(low, lower), low)
            high = np.where(unknown & (self.whole(x, upper) >= k), upper, high)
        return low, high

    def reach(self, x, k):
        """Places of the cells in which the windows can begin and end:
        first and last of the left ones, first and last of the right ones."""
        low, high = self.bracket(x, k)
        slack = _ROUNDING * (np.abs(x) + high)
        bound, high = np.maximum(low - slack, 0.0), high + slack
        return (np.searchsorted(self.last, x - high, "left"), np.searchsorted(self.first, x - bound, "right") - 1,
                np.searchsorted(self.last, x + bound, "left"), np.searchsorted(self.first, x + high, "right") - 1)


def _bandwidth(x, z, before, m):
    """Distance of the m-th nearest of the points ``z`` (``before``: running counts, from 0), for each x."""
    at = np.searchsorted(z, x, "left")

    def within(r):
        r = r + _ROUNDING * (np.abs(x) + r)
        return before[np.searchsorted(z, x + r, "right")] - before[np.searchsorted(z, x - r, "left")]

    best = np.full(len(x), np.inf)
    for side in (-1, 1):
        most = at if side < 0 else len(z) - 1 - at
        lo, hi = np.zeros(len(x), int), most.copy()
        while (lo < hi).any():
            middle = (lo + hi) // 2
            ok = within(np.abs(z[at + side * middle] - x)) >= m
            hi, lo = np.where(ok, middle, hi), np.where(ok, lo, np.minimum(middle + 1, hi))
        r = np.abs(z[at + side * lo] - x)
        best = np.where(within(r) >= m, np.minimum(best, r), best)
    return best


def _running(moments: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, 2, _POWERS)), np.cumsum(moments, 0)])


def fit_group(cells: Cells, k: int, x: np.ndarray, home: int, first: int, last: int,
              points: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Fits at the values ``x`` of one home cell (a place in ``cells``) whose
    windows lie in the cells ``first`` to ``last``; ``points``: (x, n, y) of the
    cells that were sent, by place; the others of them lie whole in all windows."""
    own = points[home]
    lefts, rights = [points[c] for c in sorted(points) if c < home], [points[c] for c in sorted(points) if c > home]
    empty = (np.zeros(0), np.zeros(0), np.zeros(0))
    lx, ln, ly = (np.concatenate(v) for v in zip(*lefts)) if lefts else empty
    rx, rn, ry = (np.concatenate(v) for v in zip(*rights)) if rights else empty
    z, n, y = np.concatenate([lx, own[0], rx]), np.concatenate([ln, own[1], rn]), np.concatenate([ly, own[2], ry])
    spread = np.setdiff1d(np.arange(first, max(home, last) + 1), sorted(points))
    inside = (cells.before[spread + 1] - cells.before[spread]).sum()
    r = _bandwidth(x, z, np.concatenate([[0], np.cumsum(n)]), k - inside)
    out = np.full(len(x), np.nan)
    start = 0
    while start < len(x):  # values so near each other that sums about their middle stay exact
        stop = start + 1
        while stop < len(x) and x[stop] - x[start] <= _NEAR * r[start:stop + 1].min():
            stop += 1
        at, start = slice(start, stop), stop
        if r[at].min() > 0:
            out[at] = _fit_near(x[at], r[at], own, (lx, ln, ly), (rx, rn, ry), (z, n, y), cells, spread, home)
    tied = r == 0
    if tied.any():
        at = np.searchsorted(own[0], x[tied])
        out[tied] = own[2][at] / own[1][at]
    return out


def _fit_near(x, r, own, left, right, every, cells: Cells, spread: np.ndarray, home: int) -> np.ndarray:
    """Fits at values within a small part of r of each other."""
    centre = float((x[0] + x[-1]) / 2)
    moved = _shift(cells.moments[spread], cells.first[spread] - centre)
    inner = {-1: moved[spread < home].sum(0), 1: moved[spread > home].sum(0)}
    whole_left, whole_right = x - r <= own[0][0], x + r >= own[0][-1]
    both = whole_left & whole_right
    out = np.full(len(x), np.nan)
    if both.any():
        here = _moments(*own, centre)
        cut = np.searchsorted(own[0], x[both], "right")
        # running sums from home outwards: nothing outside a window is ever in them
        far_left = np.searchsorted(left[0], x[both] - r[both], "left")
        far_right = np.searchsorted(right[0], x[both] + r[both], "right")
        outwards_left = _running(_moments(*[v[far_left.min():] for v in left], centre)[::-1])[::-1]
        outwards_right = _running(_moments(*[v[:far_right.max()] for v in right], centre))
        below = _running(here)[cut] + inner[-1] + outwards_left[far_left - far_left.min()]
        above = _running(here[::-1])[::-1][cut] + inner[1] + outwards_right[far_right]
        about = centre - x[both]
        out[both] = _line(_weighted(_shift(below, about), _shift(above, about), r[both]))
    z, n, y = every
    for i in np.flatnonzero(~both):  # the window ends inside the home cell, on one side at least
        sums = np.zeros((1, 2, 3))
        near = np.abs(z - x[i]) < r[i]
        d = z[near] - x[i]
        weight = (1 - (np.abs(d) / r[i]) ** 3) ** 3
        for p in range(3):
            sums[0, 0, p], sums[0, 1, p] = (weight * n[near] * d ** p).sum(), (weight * y[near] * d ** p).sum()
        for side, whole in ((-1, whole_left[i]), (1, whole_right[i])):
            if whole and inner[side].any():
                part = _shift(inner[side][None], np.array([centre - x[i]]))
                none = np.zeros_like(part)
                sums += _weighted(part if side < 0 else none, part if side > 0 else none, r[i:i + 1])
        out[i] = _line(sums)[0]
    return out


def lowess(points: DataFrame, keys: Sequence[str], x: str, n: str, y: str, frac: float = 0.15) -> DataFrame:
    """``points`` (one row per key and distinct ``x``; ``n`` its number of
    observations, ``y`` their sum) with ``smooth``, the fitted mean of y at x.
    Where k or more observations share x, it is their mean.  Rows with a null x
    or no observation are left out."""
    keys = list(keys)
    clean = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(n).cast("long").alias("n"), F.col(y).cast("double").alias("y"))
    clean = clean.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("n") > 0))
    cum = prefix_sum(clean, keys, "x", ["n"], inclusive=False, suffix="_before", with_totals=True)
    size = F.ceil(F.col("n_total") / CELLS)
    placed = materialize(cum.select(*keys, "x", "n", "y", "n_total", F.floor(F.col("n_before") / size).cast("int").alias("cell")))
    kinds = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in keys)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        m = _moments(rows["x"].to_numpy(), rows["n"].to_numpy(float), rows["y"].to_numpy(), rows["x"].iloc[0]).sum(0)
        return rows.head(1)[[*keys, "cell", "n_total"]].assign(first=rows["x"].iloc[0], last=rows["x"].iloc[-1], n=rows["n"].sum(), moments=[m.ravel()])

    cell_rows = placed.groupBy(*keys, "cell").applyInPandas(
        summed, f"{kinds}, cell int, n_total long, first double, last double, n long, moments array<double>").toPandas()
    tables = {}
    for key, part in cell_rows.groupby(keys, dropna=False) if len(cell_rows) else ():
        part = part.sort_values("cell")
        table = Cells(part["cell"], part["first"], part["last"], part["n"], np.stack(part["moments"]))
        tables[_key(key)] = (table, max(1, int(frac * int(part["n_total"].iloc[0]) + 1e-10)))

    def reach(batches):
        for rows in batches:
            for key, part in rows.groupby(keys, dropna=False):
                cells, k = tables[_key(key)]
                a_first, a_last, b_first, b_last = cells.reach(part["x"].to_numpy(), k)
                yield part[[*keys, "cell"]].assign(a_first=a_first, a_last=a_last, b_first=b_first, b_last=b_last)

    # one group per home cell and first cell: at most twice as many as cells
    spans = (placed.mapInPandas(reach, f"{kinds}, cell int, a_first int, a_last int, b_first int, b_last int")
             .groupBy(*keys, "cell", "a_first").agg(F.max("a_last").alias("a_last"), F.min("b_first").alias("b_first"), F.max("b_last").alias("b_last")))
    number = {k: {int(c): i for i, c in enumerate(t.cell)} for k, (t, _) in tables.items()}

    def needed(batches):
        for rows in batches:
            out = []
            for key, part in rows.groupby(keys, dropna=False):
                cells, places = tables[_key(key)][0].cell, number[_key(key)]
                for r in part.itertuples():
                    home = places[r.cell]
                    for c in {*range(r.a_first, min(r.a_last, home) + 1), home, *range(max(r.b_first, home), r.b_last + 1)}:
                        out.append((*[getattr(r, f"k{i}") for i in range(len(keys))], int(cells[c]), home, r.a_first, r.b_last))
            yield pd.DataFrame(out, columns=[*keys, "cell", "home", "a_first", "b_last"])

    named = spans.select(*keys, *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], "cell", "a_first", "a_last", "b_first", "b_last")
    wanted = named.mapInPandas(needed, f"{kinds}, cell int, home int, a_first int, b_last int")
    same = [placed[c].eqNullSafe(wanted[c]) for c in (*keys, "cell")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    sent = placed.join(wanted, condition).select(*[placed[c] for c in keys], placed["cell"], "x", "n", "y", "home", "a_first", "b_last")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        key = _key(tuple(rows[c].iloc[0] for c in keys))
        cells, k = tables[key]
        places, home, first = number[key], int(rows["home"].iloc[0]), int(rows["a_first"].iloc[0])
        rows = rows.sort_values("x")
        points = {places[c]: (p["x"].to_numpy(), p["n"].to_numpy(float), p["y"].to_numpy()) for c, p in rows.groupby("cell")}
        own = rows[rows["cell"] == cells.cell[home]]
        own = own[cells.reach(own["x"].to_numpy(), k)[0] == first]
        return own[[*keys, "x", "n", "y"]].assign(smooth=fit_group(cells, k, own["x"].to_numpy(), home, first, int(rows["b_last"].iloc[0]), points))

    return sent.groupBy(*keys, "home", "a_first").applyInPandas(fit, f"{kinds}, x double, n long, y double, smooth double")


def _key(key) -> tuple:
    return tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))


def smoothed_error_rate(st: DataFrame, keys: Sequence[str], frac: float = 0.15, cut: float = 0.5) -> DataFrame:
    """Smoothed error rate in percent at every distinct score (CRV-15): wrong
    predictions (score > ``cut`` is class 1) by the class-1 score.  ``conf`` is
    the confidence on the score's half: 1 - score below 0.5."""
    ct = _conf_table(regroup(st, keys), cut).select(*keys, "score", _n().alias("n"), F.col("n_wrong_at").alias("wrong"))
    fitted = lowess(ct, keys, "score", "n", "wrong", frac)
    score = F.col("x")
    return fitted.select(*keys, score.alias("score"), F.col("n"), F.col("y").cast("long").alias("n_wrong"),
                         F.when(score < 0.5, 1 - score).otherwise(score).alias("conf"), (100.0 * F.col("smooth")).alias("error_rate"))
