"""Feature encoding and scaling (FEA-*).

Open vocabularies (term lists) stay in long form ``(id, term, value)``; a
vector for Spark ML comes from ``CountVectorizer`` / ``OneHotEncoder``.  Fit
statistics (means, standard deviations, document frequencies) are one small
aggregate, joined back; a wide pivot over thousands of terms is never built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_list(text: Column, seps: str = ",;") -> Column:
    """Quoted delimited term string -> array of terms (``"HP:1,HP:2"``)."""
    cleaned = F.regexp_replace(text, '"', "")
    return F.filter(F.split(cleaned, f"[{seps}]"), lambda t: t != "")


def multi_hot_long(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """0/1 encoding of a term array in long form: one row (id, term, 1) per
    distinct term of a row (duplicates count once) (FEA-01)."""
    return (df.select(id_col, F.explode(F.array_distinct(terms)).alias("term"))
              .select(id_col, "term", F.lit(1).cast("long").alias("value")))


def sum_same_name(frames: Sequence[DataFrame], id_col: str) -> DataFrame:
    """Encoders that produce the same term are added (value 2 possible) (PRJ-10)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return u.groupBy(id_col, "term").agg(F.sum("value").alias("value"))


def one_hot_aligned(train: DataFrame, test: DataFrame, id_col: str, col: str) -> DataFrame:
    """Test rows encoded over the training vocabulary of a categorical column:
    unseen test values get no column, absent ones are 0 (JOI-10, FEA-02).
    Long form, test rows x vocabulary (a categorical vocabulary is small)."""
    vocab = train.select(F.col(col).alias("term")).distinct()
    return (test.select(id_col, col).crossJoin(vocab)
                .select(id_col, "term", F.when(F.col(col) == F.col("term"), 1).otherwise(0).alias("value")))


def index_categories(df: DataFrame, col: str, out: str):
    """StringIndexer (frequency order, ties alphabetical) and a one-hot vector
    without a dropped level (FEA-02).  Returns (frame, fitted pipeline)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=col, outputCol=out + "_idx", handleInvalid="keep",
                      stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCol=out + "_idx", outputCol=out, dropLast=False, handleInvalid="keep")])
    model = pipe.fit(df)
    return model.transform(df), model


def keep_first_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Exact duplicates dropped, then the first row per key in an explicit
    order (FEA-05).  Uses the two-stage top-k, so a hot key is split."""
    from varlens.operators.groups import top_k_per_group
    return top_k_per_group(df.dropDuplicates(), [key], list(order), 1).drop("rank")


def fit_standard(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row table of mean and population std per column, fitted on train."""
    return train.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                     *[F.stddev_pop(c).alias(f"{c}__std") for c in cols])


def apply_standard(df: DataFrame, stats: DataFrame, cols: Sequence[str], impute: bool = True) -> DataFrame:
    """(x - mean) / std with fitted stats; a constant column (std 0) gives 0.
    With ``impute`` missing values first take the fitted mean (FEA-07/08).
    ``stats`` is one row, so the cross join does not shuffle ``df``."""
    j = df.crossJoin(stats)
    for c in cols:
        x = F.col(c).cast("double")
        if impute:
            x = F.coalesce(x, F.col(f"{c}__mean"))
        sd = F.col(f"{c}__std")
        j = j.withColumn(c, F.when(sd > 0, (x - F.col(f"{c}__mean")) / sd).otherwise(F.lit(0.0)))
    return j.drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])


def axis_normalize(long: DataFrame, axis: str, value: str = "x", eps: float = 1e-8) -> DataFrame:
    """Normalise a 3-D tensor in long form ``(sample, residue, feature, x)``
    along one axis (FEA-09): statistics over all cells sharing ``axis``
    (per sample, per residue or per feature), ``(x - mean) / (std_pop + eps)``.
    Statistics are a grouped aggregate joined back, not a per-group window."""
    st = long.groupBy(axis).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    j = long.join(st, axis)
    return j.withColumn(value, (F.col(value) - F.col("__m")) / (F.col("__s") + F.lit(eps))).drop("__m", "__s")


def tfidf_long(long: DataFrame, id_col: str, term: str = "term", value: str = "value") -> DataFrame:
    """TF-IDF of a 0/1 (or count) matrix in long form with the smoothed idf
    ``ln((1+n)/(1+df)) + 1`` and rows scaled to unit L2 norm (FEA-10)."""
    n_docs = long.select(id_col).distinct().agg(F.count(F.lit(1)).alias("__n"))
    df_t = long.where(F.col(value) != 0).groupBy(term).agg(F.count_distinct(id_col).alias("__df"))
    idf = df_t.crossJoin(n_docs).select(term, (F.log((1.0 + F.col("__n")) / (1.0 + F.col("__df"))) + 1.0).alias("__idf"))
    w = long.join(idf, term).withColumn("__w", F.col(value) * F.col("__idf"))
    norms = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    return (w.join(norms, id_col)
             .select(id_col, term, F.when(F.col("__norm") > 0, F.col("__w") / F.col("__norm")).otherwise(0.0).alias("tfidf")))


def pad_lists(df: DataFrame, col: str, out: str, pad=0) -> DataFrame:
    """Integer lists padded with ``pad`` to the longest list (FEA-11); the
    longest size is one aggregate row."""
    m = df.agg(F.max(F.size(col)).alias("__m"))
    j = df.crossJoin(m)
    return j.withColumn(out, F.concat(F.col(col), F.array_repeat(F.lit(pad), F.col("__m") - F.size(col)))).drop("__m")
