"""Small column-expression helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_div(num: Column, den: Column, undefined: float | None = None) -> Column:
    """num / den, or ``undefined`` (null when None) if den is 0 or null.
    ANSI mode raises on x / 0, so the test comes first."""
    fallback = F.lit(None).cast("double") if undefined is None else F.lit(float(undefined))
    return F.when(den.isNotNull() & (den != 0), num.cast("double") / den.cast("double")).otherwise(fallback)


def not_equal_keep_null(col: Column, value) -> Column:
    """pandas ``!=``: a missing value is kept (Spark's ``!=`` drops null)."""
    return ~col.eqNullSafe(F.lit(value))


def md5_key(id_col: Column, seed) -> Column:
    """Seeded shuffle key: md5 of ``id|seed`` as hex text.  The same string in
    Spark and DuckDB, and independent of partitioning (SPL-01)."""
    return F.md5(F.concat(id_col.cast("string"), F.lit("|"), F.lit(str(seed))))


def round6(c: Column) -> Column:
    """Round to 6 decimals with plain IEEE arithmetic, floor(x * 1e6 + 0.5) / 1e6,
    so that Spark and the SQL oracle give the same bits for the same input
    (Spark's ``round`` rounds the decimal text, other engines the binary
    value, and the two disagree on ties).  Values beyond 1e12 pass unrounded
    (no overflow of the integer floor); adding 0.0 turns -0.0 into 0.0."""
    x = c.cast("double")
    r = F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)
    return F.when(F.abs(x) < F.lit(1e12), r).otherwise(x) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (the oracle compares at 6 decimals)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round6(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint directory and read
    it back.

    Used where a derived table feeds several branches of one plan (and the
    quantile pass): reading the written table once per branch is cheaper than
    recomputing the scan and shuffles behind it, and it cuts the lineage, so a
    lost executor does not replay them.  The directory is the cluster's shared
    ``spark.checkpoint.dir``."""
    import uuid

    from varlens.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/varlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
