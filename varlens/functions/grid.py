"""Fixed grids and bin indices with numpy's edge arithmetic.

Curves are evaluated on small fixed grids (100 thresholds, 10 or 100 bins).
Rows are mapped to their grid cell with O(1) arithmetic followed by exact
comparisons against the edges, so an edge is computed the same way as
``np.linspace`` does (``k * step + start``; the last one is ``stop``) and a
value sitting on an edge falls on the same side as in numpy.  No row x grid
cross join is needed anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lin_step(start: float, stop: float, num: int) -> float:
    return (float(stop) - float(start)) / (num - 1)


def lin_value(k: Column, start: float, stop: float, num: int) -> Column:
    """k-th value of ``np.linspace(start, stop, num)`` as a column."""
    step = lin_step(start, stop, num)
    return F.when(k == num - 1, F.lit(float(stop))).otherwise(k.cast("double") * F.lit(step) + F.lit(float(start)))


def lin_grid(spark: SparkSession, start: float, stop: float, num: int,
             idx: str = "j", val: str = "t") -> DataFrame:
    """Grid table (idx, val); ``num`` rows, built on the executors."""
    return spark.range(num).select(F.col("id").cast("int").alias(idx),
                                   lin_value(F.col("id"), start, stop, num).alias(val))


def hist_bin(x: Column, start: float, stop: float, n_bins: int) -> Column:
    """``np.histogram(x, bins=np.linspace(start, stop, n_bins+1))`` bin index:
    half-open bins, the last one closed; null outside [start, stop]."""
    num = n_bins + 1

    def edge(k: Column) -> Column:
        return lin_value(k, start, stop, num)

    norm = n_bins / (float(stop) - float(start))
    j0 = F.floor((x - F.lit(float(start))) * F.lit(norm)).cast("int")
    j0 = F.least(F.greatest(j0, F.lit(0)), F.lit(n_bins - 1))
    dec = F.when(x < edge(j0), 1).otherwise(0)
    inc = F.when((x >= edge(j0 + 1)) & (j0 != n_bins - 1), 1).otherwise(0)
    inside = (x >= F.lit(float(start))) & (x <= F.lit(float(stop)))
    return F.when(inside, j0 - dec + inc)


def inner_edges_below(x: Column, start: float, stop: float, n_bins: int) -> Column:
    """``np.searchsorted(edges[1:-1], x)`` (side left) for
    ``edges = np.linspace(start, stop, n_bins+1)``: how many inner edges are
    strictly below x.  This is the calibration-curve bin."""
    num = n_bins + 1

    def edge(k: Column) -> Column:
        return lin_value(k, start, stop, num)

    norm = n_bins / (float(stop) - float(start))
    c0 = F.floor((x - F.lit(float(start))) * F.lit(norm)).cast("int")
    c0 = F.least(F.greatest(c0, F.lit(0)), F.lit(n_bins - 1))
    # c0 inner edges are <= x by construction up to rounding; fix both sides.
    dec = F.when((c0 >= 1) & (edge(c0) >= x), 1).otherwise(0)
    inc = F.when((c0 + 1 <= n_bins - 1) & (edge(c0 + 1) < x), 1).otherwise(0)
    return c0 - dec + inc


def first_grid_at_or_above(x: Column, start: float, stop: float, num: int) -> Column:
    """Smallest k with ``linspace[k] >= x`` (null when x > stop)."""
    step = lin_step(start, stop, num)
    k0 = F.ceil((x - F.lit(float(start))) / F.lit(step)).cast("int")
    k0 = F.least(F.greatest(k0, F.lit(0)), F.lit(num - 1))

    def g(k):
        return lin_value(k, start, stop, num)

    # move down while the previous point still qualifies, up while this one fails
    k1 = F.when((k0 >= 1) & (g(k0 - 1) >= x), k0 - 1).otherwise(k0)
    k2 = F.when((k1 < num - 1) & (g(k1) < x), k1 + 1).otherwise(k1)
    return F.when(x <= F.lit(float(stop)), k2)


def last_grid_at_or_below(x: Column, start: float, stop: float, num: int) -> Column:
    """Largest k with ``linspace[k] <= x`` (null when x < start)."""
    step = lin_step(start, stop, num)
    k0 = F.floor((x - F.lit(float(start))) / F.lit(step)).cast("int")
    k0 = F.least(F.greatest(k0, F.lit(0)), F.lit(num - 1))

    def g(k):
        return lin_value(k, start, stop, num)

    k1 = F.when((k0 < num - 1) & (g(k0 + 1) <= x), k0 + 1).otherwise(k0)
    k2 = F.when((k1 >= 1) & (g(k1) > x), k1 - 1).otherwise(k1)
    return F.when(x >= F.lit(float(start)), k2)
