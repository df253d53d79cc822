"""P-values of the tests in ``stats`` (STA-02 to 08, 12) from their result rows.

A test's statistics are one row, or one per key or pair, made in Spark; the tail
probability of each row is a small numeric function (``functions/tails.py``)
applied to the result column by column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.functions import tails
from varlens.operators import stats as S

#: Largest number of differences for which the signed-rank p-value is exact.
EXACT_DIFFERENCES = 50


def with_p(df: DataFrame, out: str, tail: Callable[..., float], *cols: str) -> DataFrame:
    """``df`` with ``out`` = tail(cols) per row; null where a column is null or NaN."""
    @F.pandas_udf("double")
    def p(*series: pd.Series) -> pd.Series:
        rows = zip(*[s.astype("float64") for s in series])
        return pd.Series([None if any(math.isnan(v) for v in row) else min(1.0, max(0.0, tail(*row))) for row in rows], dtype="float64")

    return df.withColumn(out, p(*[F.col(c).cast("double") for c in cols]))


def one_or_two_sided(z: float, alternative: str) -> float:
    if alternative == "greater":
        return tails.norm_sf(z)
    if alternative == "less":
        return tails.norm_sf(-z)
    return 2 * tails.norm_sf(abs(z))


def paired_t(d: DataFrame, rho: float | None = None) -> DataFrame:
    """Paired t (STA-02) and corrected resampled t (STA-03) with two-sided p."""
    out = with_p(S.paired_t(d, rho), "p", tails.t_two_sided, "t", "df")
    return out if rho is None else with_p(out, "p_corrected", tails.t_two_sided, "t_corrected", "df")


def wilcoxon_p(n: float, w_plus: float, w_minus: float, tie_term: float, alternative: str = "two-sided") -> float:
    """Signed-rank p: exact for up to ``EXACT_DIFFERENCES`` untied differences,
    else normal with the tie correction and no continuity correction."""
    if n < 1:
        return 1.0
    if alternative == "two-sided" and tie_term == 0 and n <= EXACT_DIFFERENCES:
        return tails.wilcoxon_exact_sf(w_plus, int(n))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return one_or_two_sided((w_plus - n * (n + 1) / 4) / sd, alternative) if sd else 1.0


def wilcoxon(d: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Signed-rank statistics (STA-04) with p."""
    return with_p(S.wilcoxon(d), "p", lambda *row: wilcoxon_p(*row, alternative), "n", "w_plus", "w_minus", "tie_term")


def rank_sum_p(n1: float, n2: float, u1: float, tie_term: float, alternative: str = "two-sided") -> float:
    """Rank-sum p: normal, with tie and continuity corrections."""
    n = n1 + n2
    if n1 < 1 or n2 < 1:
        return 1.0
    sd = math.sqrt(max(0.0, n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1)))))
    if not sd:
        return 1.0
    gap = u1 - n1 * n2 / 2
    if alternative == "greater":
        return tails.norm_sf((gap - 0.5) / sd)
    if alternative == "less":
        return tails.norm_sf(-(gap + 0.5) / sd)
    return 2 * tails.norm_sf((abs(gap) - 0.5) / sd)


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, value: str, alternative: str = "two-sided") -> DataFrame:
    """Rank-sum test per key (STA-05) with p."""
    return with_p(S.mann_whitney(df, keys, group, value, ties=True), "p", lambda *row: rank_sum_p(*row, alternative), "n1", "n2", "u1", "tie_term")


def kolmogorov_p(d: float, n1: float, n2: float) -> float:
    """Two-sided two-sample KS p from the limiting distribution."""
    x = math.sqrt(n1 * n2 / (n1 + n2)) * d
    if x < 0.2:
        return 1.0
    return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))


def ks_2samp(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Two-sample KS per key (STA-05) with the two-sided limiting p."""
    return with_p(S.ks_2samp(df, keys, group, value), "p", kolmogorov_p, "ks_d", "n1", "n0")


def friedman(scores: DataFrame) -> DataFrame:
    """Friedman test (STA-06) with p."""
    return with_p(S.friedman(scores), "p", tails.chi2_sf, "chi2", "df")


def nemenyi(scores: DataFrame) -> DataFrame:
    """Nemenyi post-hoc test (STA-07) with p per pair."""
    return with_p(S.nemenyi(scores), "p", lambda q, k: tails.studentized_range_sf(q, int(k)), "q", "k")


def rm_anova(scores: DataFrame) -> DataFrame:
    """Repeated-measures ANOVA (STA-08) with p."""
    return with_p(S.rm_anova(scores), "p", tails.f_sf, "f", "df1", "df2")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis test (STA-12) with p."""
    return with_p(S.kruskal(df, group, value), "p", tails.chi2_sf, "h", "df")


def pairwise_t(scores: DataFrame, block: str = "fold", run: str = "run", value: str = "value") -> DataFrame:
    """Paired t of every pair of runs over their common blocks, with p adjusted
    over all pairs (Holm and Benjamini-Hochberg).  One row per pair of runs."""
    a = scores.select(block, F.col(run).alias("run_a"), F.col(value).alias("__a"))
    b = scores.select(block, F.col(run).alias("run_b"), F.col(value).alias("__b"))
    d = a.join(b, block).where("run_a < run_b").withColumn("d", F.col("__a") - F.col("__b"))
    agg = d.groupBy("run_a", "run_b").agg(F.count("d").alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd_d"))
    t = agg.withColumn("t", F.when(F.col("sd_d") > 0, F.col("mean_d") / (F.col("sd_d") / F.sqrt("n")))).withColumn("df", F.col("n") - 1)
    pair = F.concat_ws("|", F.col("run_a").cast("string"), F.col("run_b").cast("string"))
    p = with_p(t, "p", tails.t_two_sided, "t", "df").withColumn("__pair", pair)
    return S.adjust_pvalues(p, [], "p", "__pair").drop("__pair")


def feature_audit(audit: DataFrame, term: str = "term") -> DataFrame:
    """``stats.feature_audit`` with the two-sided normal p of its z, Holm and
    Benjamini-Hochberg adjusted over all terms (STA-16)."""
    return S.adjust_pvalues(with_p(audit, "p", lambda z: one_or_two_sided(z, "two-sided"), "z"), [], "p", term)
