"""Joins (JOI-*).

Join strategy is left to Catalyst and AQE: a side whose runtime size is under
``spark.sql.autoBroadcastJoinThreshold`` is broadcast after its size is known,
others are shuffle (sort-merge) joins, and skewed partitions are split by AQE.
No side is broadcast by hint unless its size is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_drop_right_dupes(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join; right-side columns that also exist on the left are dropped
    (the pandas suffix-then-drop pattern) (JOI-01, JOI-02)."""
    on = list(on)
    extra = [c for c in right.columns if c not in left.columns or c in on]
    return left.join(right.select(*extra), on=on, how=how)


def outer_with_provenance(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with ``_merge`` in {both, left_only, right_only};
    overlapping right columns get the suffix ``_right`` (JOI-03)."""
    on = list(on)
    l2 = left.withColumn("__l", F.lit(True))
    r2 = right.select(*on, *[F.col(c).alias(c + "_right" if c in left.columns else c)
                             for c in right.columns if c not in on]).withColumn("__r", F.lit(True))
    j = l2.join(r2, on=on, how="full_outer")
    merge = (F.when(F.col("__l") & F.col("__r"), "both")
              .when(F.col("__l"), "left_only").otherwise("right_only"))
    return j.withColumn("_merge", merge).drop("__l", "__r")


def semi(left: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is in ``keys`` (JOI-04)."""
    return left.join(keys.select(*on), on=list(on), how="left_semi")


def anti(left: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``keys`` (JOI-05, SET-04)."""
    return left.join(keys.select(*on), on=list(on), how="left_anti")


def lookup_terms(left: DataFrame, terms: DataFrame, key: str, term: str, out: str,
                 default: str = "GO:0", sep: str = ";") -> DataFrame:
    """Key -> sorted distinct terms joined by ``sep``; ``default`` when the
    key has none (JOI-06, AGG-05).  The term set is aggregated per key first
    (partial aggregation), then left-joined."""
    agg = terms.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(term)), sep).alias(out))
    return left.join(agg, on=key, how="left").withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def lookup_unique(left: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Dimension lookup that must find exactly one row per key: zero or
    several matches raise at run time (JOI-07).  The multiplicity is counted
    on the dimension side, so the check costs one aggregate of the dimension."""
    n = dim.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    j = left.join(dim.join(n, on=key, how="inner"), on=key, how="left")
    bad = F.col("__n").isNull() | (F.col("__n") != 1)
    msg = F.concat(F.lit("expected one match for "), F.col(key).cast("string"))
    # a filter predicate is always evaluated (a dropped column would be pruned)
    ok = F.coalesce(F.when(bad, F.raise_error(msg)).cast("boolean"), F.lit(True))
    return j.where(ok).drop("__n")


def complete_against(dim: DataFrame, agg: DataFrame, key: str, value_cols: Sequence[str],
                     default=0) -> DataFrame:
    """Every member of the dimension, absent groups filled with ``default`` (JOI-09)."""
    j = dim.join(agg, on=key, how="left")
    for c in value_cols:
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(default)))
    return j


def union_shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union on the columns both sides have, in the left side's order (SET-02)."""
    shared = [c for c in left.columns if c in set(right.columns)]
    return left.select(*shared).unionByName(right.select(*shared))


def replace_group(base: DataFrame, external: DataFrame, group_col: str, group, flag_col: str,
                  flag_value) -> DataFrame:
    """Drop one group from ``base``, stack an external table on the shared
    columns and mark its rows with ``flag_col = flag_value`` (JOI-14)."""
    kept = base.where(~F.col(group_col).eqNullSafe(F.lit(group)))
    ext = external.withColumn(flag_col, F.lit(flag_value))
    return union_shared(kept, ext)
