"""Grouped aggregates (AGG-*), top-k and previews (TOP-*, LIM-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per group (AGG-01, AGG-02)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Rows x fixed column values of counts, absent = 0 (AGG-03).  The value
    list is given, so the pivot needs no extra pass to find it."""
    out = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return out.na.fill(0, [str(v) for v in values])


def having_min_size(df: DataFrame, keys: Sequence[str], cut_off: int = 10) -> DataFrame:
    """Drop groups with fewer than ``cut_off`` rows (strict <) (AGG-04).
    Group sizes come from one aggregate joined back (broadcast by AQE when
    small), not from a per-group window holding a whole group in one task."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= cut_off)
    return df.join(sizes.select(*keys), on=list(keys), how="left_semi")


def checked_constant(df: DataFrame, keys: Sequence[str], value: Column, name: str, offset: int = 0) -> DataFrame:
    """The one value of ``value`` per group (plus ``offset``); a group with
    two values raises (AGG-06, AGG-10)."""
    agg = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    chk = F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("__hi")).otherwise(
        F.raise_error(F.lit(f"{name} is not constant within a group")))
    return agg.select(*keys, (chk + F.lit(offset)).alias(name) if offset else chk.alias(name))


def mean_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls with the column mean over the whole frame (AGG-07): one
    global aggregate row, cross-joined (one row, so no shuffle of ``df``)."""
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    j = df.crossJoin(means)
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")))
    return j.drop(*[f"__m_{c}" for c in cols])


def polarity(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Share of class 1 and share of the larger class per group (AGG-08), the
    dominant class (ties to 0) and the group size (AGG-09)."""
    one = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    zero = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    agg = df.groupBy(*keys).agg(one.alias("n1"), zero.alias("n0"), F.count(F.lit(1)).alias("n"))
    tot = F.col("n1") + F.col("n0")
    return agg.select(*keys, "n0", "n1", "n",
                      F.when(tot > 0, F.col("n1") / tot).alias("polarity"),
                      F.when(tot > 0, F.greatest("n0", "n1") / tot).alias("majority_share"),
                      F.when(F.col("n1") > F.col("n0"), 1).otherwise(0).alias("dominant"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights n / (k * n_class) (AGG-11)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()  # over the k-row class table only
    return c.select(label, "n_class",
                    (F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class"))).alias("weight"))


def groups_with_term(df: DataFrame, term: str, group: str) -> DataFrame:
    """Per term: how many distinct groups hold it, and which (AGG-19)."""
    return df.groupBy(term).agg(F.count_distinct(group).alias("n_groups"),
                                F.array_join(F.array_sort(F.collect_set(group)), ",").alias("groups"))


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    salt_buckets: int = 16) -> DataFrame:
    """Top ``k`` rows per group by ``order`` (TOP-01).  Two stages so that no
    task holds a whole group: the top k within (group, salt) first, then the
    top k among the at most k x salt_buckets survivors of each group.  The
    salt is a hash of the row, so the result does not depend on partitioning."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
    s1 = df.withColumn("__s", salt)
    w1 = Window.partitionBy(*keys, "__s").orderBy(*order)
    local = s1.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= k).drop("__r", "__s")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return local.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


def preview(df: DataFrame, order: Sequence[Column], n: int = 5, tail: bool = False) -> DataFrame:
    """Head (or tail) rows in a given order (LIM-01): a distributed top-n,
    each task keeps at most n rows."""
    if tail:
        order = [o.desc() if hasattr(o, "desc") else F.col(o).desc() for o in order]
    return df.orderBy(*order).limit(n)
