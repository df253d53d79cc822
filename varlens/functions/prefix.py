"""Running sums in a global order without moving a whole group to one task.

A window ``partitionBy(keys).orderBy(x)`` sends every row of a key to one task;
one hot key then holds a third of the data in one task.  ``prefix_sum``
instead cuts the order axis into ranges by approximate quantiles, so rows of
one key spread over many (key, range) window partitions:

1. range bounds: ``approxQuantile`` on the order column (one pruned scan),
   bucket = range index via ``Bucketizer`` (binary search, JVM side);
2. per (key, bucket) totals: a small table, at most keys x buckets rows;
3. exclusive offset of each bucket: a window over that small table;
4. running sum inside (key, bucket) plus the bucket's offset.

The result depends only on the data (bounds come from values, not from
partition ids), so a recomputed task after an executor loss gives the same
rows.  Callers aggregate to distinct (keys, order) first; ties are handled
there, which is also what the curve definitions need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_buckets(df: DataFrame) -> int:
    """Twice the shuffle parallelism: a cluster with thousands of shuffle
    partitions gets thousands of ranges."""
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        n = 200
    return max(8, 2 * n)


def quantile_splits(df: DataFrame, col: str, n_buckets: int) -> list[float]:
    """Sorted distinct inner bounds cutting ``col`` into about ``n_buckets`` ranges.

    One job over ``df`` (column-pruned); the result has at most n_buckets-1
    values, so collecting it is bounded by the parameter, not by the data."""
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    rel = max(1e-5, 0.25 / n_buckets)
    clean = df.select(F.col(col).cast("double").alias(col)).where(~F.isnan(col))
    qs = clean.approxQuantile(col, probs, rel)
    return sorted(set(float(q) for q in qs))


def bucketize(df: DataFrame, col: str, splits: Sequence[float], out: str) -> DataFrame:
    """Range index of ``col`` over inner bounds ``splits`` (int, ascending)."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    full = [float("-inf")] + list(splits) + [float("inf")]
    tmp = out + "__d"
    b = Bucketizer(splits=full, inputCol=col, outputCol=tmp, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(tmp).cast("int")).drop(tmp)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join where null keys match each other (``<=>``)."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def prefix_sum(df: DataFrame, keys: Sequence[str], order, values: Sequence[str],
               *, descending: bool = False, inclusive: bool = True, suffix: str = "_cum",
               n_buckets: int | None = None, splits_from: DataFrame | None = None,
               splits: Sequence[float] | None = None, bucket_on: Column | None = None,
               with_totals: bool = False) -> DataFrame:
    """Add ``<v><suffix>``: the sum of ``v`` over rows of the same key that come
    before (``inclusive=False``) or up to (``inclusive=True``) this row in
    ``order`` (a column or a list of columns, all ascending or, with
    ``descending``, all descending).  The order must be unique within a key.

    Ranges are cut on ``bucket_on`` (default: the first order column), a
    numeric expression that never decreases along the order.
    ``splits_from`` is a frame holding the columns of that expression whose
    quantiles are cheaper to get (for instance the raw scan before
    aggregation).  ``with_totals`` also adds ``<v>_total``, the key's sum,
    taken from the small per-range table (no extra pass over ``df``)."""
    keys = list(keys)
    values = list(values)
    orders = [order] if isinstance(order, (str, Column)) else list(order)
    ocols = [F.col(o) if isinstance(o, str) else o for o in orders]
    lead = (bucket_on if bucket_on is not None else ocols[0]).cast("double")
    lead = -lead if descending else lead
    oname = "__o"
    base = df.withColumn(oname, lead)
    if splits is None:
        nb = n_buckets or default_buckets(df)
        src = splits_from if splits_from is not None else df
        splits = quantile_splits(src.select(lead.alias(oname)), oname, nb)
    b = bucketize(base, oname, splits, "__b")

    totals = b.groupBy(*keys, "__b").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    wk = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*keys)
    offsets = totals.select(*keys, "__b",
                            *[F.coalesce(F.sum(f"__t_{v}").over(wk), F.lit(0)).alias(f"__off_{v}")
                              for v in values],
                            *([F.sum(f"__t_{v}").over(wall).alias(f"{v}_total") for v in values]
                              if with_totals else []))
    joined = _null_safe_join(b, offsets, keys + ["__b"], "inner")
    end = 0 if inclusive else -1
    sort = [c.desc() for c in ocols] if descending else [c.asc() for c in ocols]
    w = Window.partitionBy(*keys, "__b").orderBy(*sort).rowsBetween(Window.unboundedPreceding, end)
    out = joined
    for v in values:
        out = out.withColumn(v + suffix, F.col(f"__off_{v}") + F.coalesce(F.sum(v).over(w), F.lit(0)))
    return out.drop(oname, "__b", *[f"__off_{v}" for v in values])


def hex_lead(col: Column, digits: int = 13) -> Column:
    """Numeric value of the first ``digits`` hex characters of a hex string
    (52 bits: exact in a double).  Orders like the string itself, so it can
    cut an md5 order into ranges."""
    return F.conv(F.substring(col, 1, digits), 16, 10).cast("double")


def text_lead(col: Column) -> Column:
    """Numeric value of a text's first 6 bytes: never decreases along the
    bytewise order of texts, so it can cut it into ranges; null first."""
    return F.coalesce(hex_lead(F.rpad(F.hex(F.encode(col, "UTF-8")), 12, "0"), 12), F.lit(-1.0))


def row_ranks(df: DataFrame, keys: Sequence[str], order, *, bucket_on: Column | None = None,
              splits_from: DataFrame | None = None, rank: str = "__row") -> DataFrame:
    """Number the rows 1..n within each key in ``order`` without a per-key
    window: the rows cross the cluster once, to their range of the order, and add
    their number there to the rows in the ranges below (a small stored table).
    Columns of ``order`` that are expressions are computed after that, so they
    don't travel; other columns break ties."""
    from varlens.functions.exprs import materialize
    keys, cols = list(keys), df.columns
    orders = [order] if isinstance(order, (str, Column)) else list(order)
    lead = bucket_on if bucket_on is not None else F.col(orders[0]) if isinstance(orders[0], str) else orders[0]
    src = splits_from if splits_from is not None else df
    splits = quantile_splits(src.select(lead.cast("double").alias("__o")), "__o", default_buckets(df))
    b = bucketize(df.withColumn("__o", lead.cast("double")), "__o", splits, "__b").drop("__o")
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")))
    names = [o if isinstance(o, str) else f"__o{i}" for i, o in enumerate(orders)]
    rows = b.repartition(*keys, "__b").withColumns({n: o for n, o in zip(names, orders) if not isinstance(o, str)})
    inside = Window.partitionBy(*keys, "__b").orderBy(*names, *[c for c in cols if c not in {*names, *keys}])
    joined = _null_safe_join(rows, offsets, keys + ["__b"], "inner")
    return joined.select(*cols, (F.col("__off") + F.row_number().over(inside)).alias(rank))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n): rows (or summed weight) per distinct value."""
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, value).agg(agg.alias("n"))


def avg_rank(df: DataFrame, keys: Sequence[str], value: str, *, descending: bool = False,
             weight: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """Average ranks with ties, per key: one row per distinct (keys, value) with
    ``n`` (tie size), ``below`` (rows strictly before) and
    ``rank = below + (n + 1) / 2``.  Rows with a null value are not ranked."""
    vc = value_counts(df.where(F.col(value).isNotNull()), keys, value, weight)
    ps = prefix_sum(vc, keys, value, ["n"], descending=descending, inclusive=False,
                    suffix="_below", n_buckets=n_buckets,
                    splits_from=df.select(value).where(F.col(value).isNotNull()))
    return (ps.withColumnRenamed("n_below", "below")
              .withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0))


def prefix_extreme(df: DataFrame, keys: Sequence[str], order, value: str, fn: str = "max", *,
                   descending: bool = False, out: str | None = None, n_buckets: int | None = None,
                   bucket_on: Column | None = None) -> DataFrame:
    """Running max (or min) of ``value`` per key along ``order``, inclusive,
    with the same range-bucketed plan as ``prefix_sum`` (max and min are
    associative, so bucket results combine with the bucket's carry-in)."""
    keys = list(keys)
    orders = [order] if isinstance(order, (str, Column)) else list(order)
    ocols = [F.col(o) if isinstance(o, str) else o for o in orders]
    agg = F.max if fn == "max" else F.min
    comb = F.greatest if fn == "max" else F.least
    lead = (bucket_on if bucket_on is not None else ocols[0]).cast("double")
    lead = -lead if descending else lead
    base = df.withColumn("__o", lead)
    splits = quantile_splits(base.select("__o"), "__o", n_buckets or default_buckets(df))
    b = bucketize(base, "__o", splits, "__b")
    tot = b.groupBy(*keys, "__b").agg(agg(value).alias("__t"))
    wk = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, "__b", agg("__t").over(wk).alias("__carry"))
    j = _null_safe_join(b, carry, keys + ["__b"], "inner")
    sort = [c.desc() for c in ocols] if descending else [c.asc() for c in ocols]
    w = Window.partitionBy(*keys, "__b").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    local = agg(value).over(w)
    res = F.when(F.col("__carry").isNull(), local).otherwise(comb(local, F.col("__carry")))
    return j.withColumn(out or f"{value}_{fn}", res).drop("__o", "__b", "__carry")
