"""ROC, precision-recall, calibration, threshold and confidence curves (CRV-*).

Every curve reads a score table ``(keys, score, pos, neg)`` built by
``metrics.score_table`` in one pass over the archive (map-side partial
aggregation, so a hot score value is one row, not a hot task).  Running sums
over the score axis use ``prefix_sum`` (range-bucketed, no single-task window).
Grid-valued curves bucket rows into the fixed grid first and then run over
grid-sized tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlens.functions.exprs import safe_div
from varlens.functions.grid import (first_grid_at_or_above, hist_bin, inner_edges_below,
                                    last_grid_at_or_below, lin_grid, lin_value)
from varlens.functions.prefix import prefix_sum
from varlens.operators.metrics import regroup

#: Sums of scores: exact, so that they do not depend on the order of additions.
_EXACT = "decimal(38,12)"


def _desc_cum(st: DataFrame, keys: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """Distinct scores per group with tp/fp = counts at or above the score,
    plus the group totals P, N.  ``st`` is a score table (keys may be finer
    than ``keys``: it is summed to ``keys`` first)."""
    sc = regroup(st, keys)
    cum = prefix_sum(sc, keys, "score", ["pos", "neg"], descending=True, inclusive=True,
                     suffix="_cum", n_buckets=n_buckets, with_totals=True, splits_from=st)
    return cum.withColumnsRenamed({"pos_cum": "tp", "neg_cum": "fp", "pos_total": "P", "neg_total": "N"})


def roc_curve(st: DataFrame, keys: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """ROC points per group (CRV-01): one per distinct score (threshold =
    score, predicted positive when score >= threshold) plus the origin with
    threshold +inf.  All points are kept; the area is the same as with the
    library's collinear-point dropping."""
    c = _desc_cum(st, keys, n_buckets)
    pts = c.select(*keys, F.col("score").cast("double").alias("threshold"), "tp", "fp", "P", "N")
    # the origin comes from the groups' totals, so the running sums are made once
    origin = (st.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
               .select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"),
                       F.lit(0).cast("long").alias("fp"), "P", "N"))
    allp = pts.unionByName(origin)
    return allp.select(*keys, "threshold", "tp", "fp",
                       safe_div(F.col("tp"), F.col("P")).alias("tpr"),
                       safe_div(F.col("fp"), F.col("N")).alias("fpr"))


def curve_scores(st: DataFrame, keys: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """ROC-AUC, trapezoid area under the PR curve and average precision per
    group (CRV-02, CRV-04, CRV-05) from one pass of running sums.

    ROC-AUC counts ties half: sum_s neg_s * (pos strictly above s + pos_s / 2) /
    (P * N), null when a group has one class only.  Between consecutive distinct
    scores recall grows by pos_s / P; the previous point's counts are this
    point's minus pos_s / neg_s, so no ``lag`` over a global order is needed.
    The first step starts at precision 1."""
    c = _desc_cum(st, keys, n_buckets)
    term = F.col("neg").cast("double") * ((F.col("tp") - F.col("pos")).cast("double") + F.col("pos") / 2.0)
    prec = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    prev_tp = F.col("tp") - F.col("pos")
    prev_all = prev_tp + F.col("fp") - F.col("neg")
    prev_prec = F.when(prev_all > 0, prev_tp.cast("double") / prev_all).otherwise(F.lit(1.0))
    d_rec = F.col("pos").cast("double")
    agg = c.groupBy(*keys).agg(
        F.sum(term).alias("u"), F.sum(d_rec * (prec + prev_prec) / 2.0).alias("trap"), F.sum(d_rec * prec).alias("ap_num"),
        F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))
    den = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return agg.select(*keys, "n_pos", "n_neg", F.when(den > 0, F.col("u") / den).alias("auc"),
                      F.when(F.col("n_pos") > 0, F.col("trap") / F.col("n_pos")).alias("pr_auc"),
                      F.when(F.col("n_pos") > 0, F.col("ap_num") / F.col("n_pos")).alias("average_precision"))


def roc_auc(st: DataFrame, keys: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """ROC-AUC per group (CRV-02)."""
    return curve_scores(st, keys, n_buckets).select(*keys, "n_pos", "n_neg", "auc")


def pr_curve(st: DataFrame, keys: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """Precision-recall points (CRV-04): one per distinct score plus the end
    point (recall 0, precision 1) with threshold null."""
    c = _desc_cum(st, keys, n_buckets)
    pts = c.select(*keys, F.col("score").cast("double").alias("threshold"),
                   safe_div(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"),
                   F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"))
    end = (st.select(*keys).distinct()
            .select(*keys, F.lit(None).cast("double").alias("threshold"),
                    F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))
    return pts.unionByName(end)


def pr_scores(st: DataFrame, keys: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """Trapezoid area under the PR curve and average precision (CRV-04/05)."""
    return curve_scores(st, keys, n_buckets).select(*keys, "n_pos", "n_neg", "pr_auc", "average_precision")


def youden(st: DataFrame, keys: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """Threshold maximising TPR - FPR per group (CRV-06); ties go to the
    highest threshold (the earliest curve point, as argmax does)."""
    roc = roc_curve(st, keys, n_buckets)
    j = F.col("tpr") - F.col("fpr")
    order = F.struct(j.alias("j"), F.col("threshold").alias("t"))
    return roc.groupBy(*keys).agg(F.max_by("threshold", order).alias("threshold"),
                                  F.max(j).alias("youden_j"))


def mean_roc_grid(st: DataFrame, fold_keys: Sequence[str], mean_keys: Sequence[str], num: int = 100,
                  n_buckets: int | None = None) -> DataFrame:
    """TPR interpolated at ``num`` evenly spaced FPR values per fold, averaged
    over folds (CRV-03).  As ``np.interp``: at an FPR present on the curve the
    last (highest) TPR there; between points a straight line from the highest
    TPR at the left FPR to the lowest TPR at the right one.  The first grid
    value is forced to 0 per fold, the last mean to 1.

    Curve points are bucketed into grid cells, so the per-fold work after the
    curve is over ``num`` cells, not points x grid."""
    spark = st.sparkSession
    roc = roc_curve(st, fold_keys, n_buckets).where(F.col("fpr").isNotNull())
    by_x = roc.groupBy(*fold_keys, "fpr").agg(F.min("tpr").alias("y_lo"), F.max("tpr").alias("y_hi"))
    cell = last_grid_at_or_below(F.col("fpr"), 0.0, 1.0, num)
    cells = (by_x.withColumn("j", cell)
                 .groupBy(*fold_keys, "j")
                 .agg(F.min("fpr").alias("x_first"), F.min_by("y_lo", "fpr").alias("y_first_lo"),
                      F.min_by("y_hi", "fpr").alias("y_first_hi"),
                      F.max("fpr").alias("x_last"), F.max_by("y_hi", "fpr").alias("y_last_hi")))
    grid = lin_grid(spark, 0.0, 1.0, num)
    folds = roc.select(*fold_keys).distinct()
    g = folds.crossJoin(grid)  # folds x num rows: grid-sized, not data-sized
    t = g.join(cells, on=[*fold_keys, "j"], how="left")
    w_prev = Window.partitionBy(*fold_keys).orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    w_next = Window.partitionBy(*fold_keys).orderBy("j").rowsBetween(1, Window.unboundedFollowing)
    # Cell j holds the points with g_j <= fpr < g_{j+1}.  A point exactly on
    # g_j is the cell's first point.  Otherwise the left neighbour is the last
    # point of an earlier cell and the right one the first point at or after
    # this cell.
    exact = F.coalesce(F.col("x_first") == F.col("t"), F.lit(False))
    lx = F.last("x_last", ignorenulls=True).over(w_prev)
    ly = F.last("y_last_hi", ignorenulls=True).over(w_prev)
    rx = F.coalesce(F.col("x_first"), F.first("x_first", ignorenulls=True).over(w_next))
    ry = F.coalesce(F.col("y_first_lo"), F.first("y_first_lo", ignorenulls=True).over(w_next))
    t2 = t.select(*fold_keys, "j", "t", lx.alias("lx"), ly.alias("ly"), rx.alias("rx"), ry.alias("ry"),
                  exact.alias("exact"), "y_first_hi")
    interp = (F.when(F.col("j") == 0, F.lit(0.0))
               .when(F.col("exact"), F.col("y_first_hi"))
               .when(F.col("lx").isNull(), F.col("ry"))
               .when(F.col("rx").isNull(), F.col("ly"))
               .otherwise((F.col("ry") - F.col("ly")) / (F.col("rx") - F.col("lx"))
                          * (F.col("t") - F.col("lx")) + F.col("ly")))
    per_fold = t2.select(*fold_keys, "j", "t", interp.alias("tpr"))
    mean = per_fold.groupBy(*mean_keys, "j", "t").agg(F.avg("tpr").alias("tpr"),
                                                     F.count(F.lit(1)).alias("n_folds"))
    return mean.select(*mean_keys, "j", F.col("t").alias("fpr"),
                       F.when(F.col("j") == num - 1, F.lit(1.0)).otherwise(F.col("tpr")).alias("tpr"),
                       "n_folds")


def _n(c: str = "") -> Column:
    return (F.col("pos") + F.col("neg")).cast("long")


def calibration(st: DataFrame, fold_keys: Sequence[str], mean_keys: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Calibration curve per fold with uniform bins (bin = inner edges
    strictly below the score), empty bins dropped, then the mean over folds
    with the standard error std_pop / sqrt(folds) (CRV-07)."""
    b = inner_edges_below(F.col("score"), 0.0, 1.0, n_bins)
    per = (st.withColumn("bin", b)
             .groupBy(*fold_keys, "bin")
             .agg((F.sum((F.col("score").cast(_EXACT) * _n()).cast(_EXACT)).cast("double") / F.sum(_n())).alias("prob_pred"),
                  (F.sum("pos") / F.sum(_n())).alias("prob_true"),
                  F.sum(_n()).alias("n")))
    return per.groupBy(*mean_keys, "bin").agg(
        F.avg("prob_pred").alias("prob_pred"),
        F.avg("prob_true").alias("prob_true"),
        (F.stddev_pop("prob_true") / F.sqrt(F.count(F.lit(1)))).alias("prob_true_se"),
        F.count(F.lit(1)).alias("n_folds"))


def threshold_sweep(st: DataFrame, keys: Sequence[str], num: int = 100) -> DataFrame:
    """Precision, recall, expected precision and expected recall on two
    threshold grids (CRV-08): class 0 selects ``score <= t`` for t in
    linspace(0.001, 0.5), class 1 selects ``score >= t`` for t in
    linspace(0.5, 0.999).  Expected precision is the mean confidence of the
    selected rows, expected recall the mean confidence of the selected true
    positives; an empty selection gives 0 everywhere.  Scores are bucketed to
    their first qualifying grid point, then cumulated over the 100-point grid.
    Confidences are summed as decimals, so no result depends on the order."""
    spark = st.sparkSession
    s = F.col("score")
    parts = []
    for cls, lo, hi in ((0, 0.001, 0.5), (1, 0.5, 0.999)):
        conf = (F.lit(1).cast(_EXACT) - s.cast(_EXACT)).cast(_EXACT) if cls == 0 else s.cast(_EXACT)
        tp1 = F.col("neg") if cls == 0 else F.col("pos")
        cell = first_grid_at_or_above(s, lo, hi, num) if cls == 0 else last_grid_at_or_below(s, lo, hi, num)
        rows = st.select(*keys, cell.alias("j"), conf.alias("conf"), _n().alias("w"), tp1.alias("tp1"))
        per_cell = rows.where(F.col("j").isNotNull()).groupBy(*keys, "j").agg(
            F.sum("w").alias("c_sel"), F.sum("tp1").alias("c_tp"),
            F.sum((F.col("conf") * F.col("w")).cast(_EXACT)).alias("c_conf"),
            F.sum((F.col("conf") * F.col("tp1")).cast(_EXACT)).alias("c_conf_tp"))
        pos_tot = rows.groupBy(*keys).agg(F.sum("tp1").alias("n_true"))
        grid = lin_grid(spark, lo, hi, num)
        g = pos_tot.crossJoin(grid).join(per_cell, on=[*keys, "j"], how="left").na.fill(
            0, ["c_sel", "c_tp", "c_conf", "c_conf_tp"])
        frame = (Window.partitionBy(*keys).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
                 if cls == 0 else
                 Window.partitionBy(*keys).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0))
        cum = g.select(*keys, "j", "t", "n_true",
                       F.sum("c_sel").over(frame).alias("sel"), F.sum("c_tp").over(frame).alias("tp"),
                       F.sum("c_conf").over(frame).alias("conf"), F.sum("c_conf_tp").over(frame).alias("conf_tp"))
        parts.append(cum.select(
            *keys, F.lit(cls).alias("cls"), "j", F.col("t").alias("threshold"), "sel", "tp",
            safe_div(F.col("tp"), F.col("sel"), 0.0).alias("precision"),
            safe_div(F.col("tp"), F.col("n_true"), 0.0).alias("recall"),
            safe_div(F.col("conf"), F.col("sel"), 0.0).alias("expected_precision"),
            safe_div(F.col("conf_tp"), F.col("tp"), 0.0).alias("expected_recall")))
    return parts[0].unionByName(parts[1])


def precision_cutoff(sweep: DataFrame, keys: Sequence[str], target: float = 0.9, num: int = 100) -> DataFrame:
    """Cut-off reaching a target precision (CRV-09): class 0 takes the last
    grid point with precision >= target, class 1 the first; when none
    qualifies, class 0 falls back to the last grid point, class 1 to the first."""
    ok = F.col("precision") >= target
    agg = sweep.groupBy(*keys, "cls").agg(
        F.max(F.when(ok, F.col("j"))).alias("last_ok"), F.min(F.when(ok, F.col("j"))).alias("first_ok"))
    pick = F.when(F.col("cls") == 0, F.coalesce("last_ok", F.lit(num - 1))).otherwise(
        F.coalesce("first_ok", F.lit(0)))
    chosen = agg.select(*keys, "cls", pick.alias("j"), F.when(F.col("cls") == 0, F.col("last_ok")).otherwise(
        F.col("first_ok")).isNotNull().alias("reached"))
    return chosen.join(sweep, on=[*keys, "cls", "j"], how="inner").select(
        *keys, "cls", "j", "threshold", "precision", "recall", "reached")


def ambiguous_count(st: DataFrame, cutoffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows reaching neither class's cut-off (CRV-10): not ``score <= t0`` and
    not ``score >= t1``.  ``cutoffs`` has one row per key and class (tiny)."""
    c = (cutoffs.groupBy(*keys)
                .agg(F.max(F.when(F.col("cls") == 0, F.col("threshold"))).alias("t0"),
                     F.max(F.when(F.col("cls") == 1, F.col("threshold"))).alias("t1")))
    j = st.join(c, on=list(keys), how="inner")
    amb = ~((F.col("score") <= F.col("t0")) | (F.col("score") >= F.col("t1")))
    return j.groupBy(*keys).agg(F.sum(F.when(amb, _n()).otherwise(F.lit(0).cast("long"))).alias("n_ambiguous"),
                                F.sum(_n()).alias("n"))


def confidence_histogram(st: DataFrame, keys: Sequence[str], n_bins: int = 100) -> DataFrame:
    """Histogram of the class-1 probability on [0, 1] by true class, as a
    density: count / (class total * bin width) (CRV-11)."""
    b = hist_bin(F.col("score"), 0.0, 1.0, n_bins)
    long = st.select(*keys, b.alias("bin"),
                     F.explode(F.array(F.struct(F.lit(1).alias("truth"), F.col("pos").alias("c")),
                                       F.struct(F.lit(0).alias("truth"), F.col("neg").alias("c")))).alias("x"))
    counts = (long.where(F.col("bin").isNotNull() & (F.col("x.c") > 0))
                  .groupBy(*keys, F.col("x.truth").alias("truth"), "bin").agg(F.sum("x.c").alias("n")))
    tot = Window.partitionBy(*keys, "truth")
    lo = lin_value(F.col("bin"), 0.0, 1.0, n_bins + 1)
    hi = lin_value(F.col("bin") + 1, 0.0, 1.0, n_bins + 1)
    return counts.select(*keys, "truth", "bin", lo.alias("lo"), "n",
                         (F.col("n") / (F.sum("n").over(tot) * (hi - lo))).alias("density"))


def confidence_rows(pred: DataFrame, score: str = "score", label: str = "label", cut: float = 0.5) -> DataFrame:
    """Confidence of the predicted class and wrong flag per row (CRV-17):
    predicted 1 when score > cut, confidence p1 for class 1 and 1 - p1 for 0."""
    yhat = F.when(F.col(score) > cut, 1).otherwise(0)
    conf = F.when(yhat == 1, F.col(score)).otherwise(1.0 - F.col(score))
    return pred.withColumn("yhat", yhat).withColumn("conf", conf).withColumn(
        "wrong", (F.col("yhat") != F.col(label)).cast("int"))


def _conf_table(st: DataFrame, cut: float = 0.5) -> DataFrame:
    """Score table with predicted class, its confidence, rows and wrong rows."""
    yhat = F.when(F.col("score") > cut, 1).otherwise(0)
    return st.select("*", yhat.alias("yhat"),
                     F.when(yhat == 1, F.col("score")).otherwise(1.0 - F.col("score")).alias("conf"),
                     F.when(yhat == 1, F.col("neg")).otherwise(F.col("pos")).alias("n_wrong_at"))


def error_rate_bins(st: DataFrame, keys: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Error rate by confidence bin on [0.5, 1], per predicted class (CRV-12):
    100 * wrong / max(all, 1)."""
    ct = _conf_table(st)
    b = hist_bin(F.col("conf"), 0.5, 1.0, n_bins)
    per = (ct.select(*keys, "yhat", _n().alias("w"), "n_wrong_at", b.alias("bin")).where(F.col("bin").isNotNull())
             .groupBy(*keys, "yhat", "bin")
             .agg(F.sum("w").alias("n"), F.sum("n_wrong_at").alias("n_wrong")))
    return per.select(*keys, "yhat", "bin", lin_value(F.col("bin"), 0.5, 1.0, n_bins + 1).alias("lo"),
                      "n", "n_wrong",
                      (100.0 * F.col("n_wrong") / F.greatest(F.col("n"), F.lit(1))).alias("error_rate"))


def sliding_window_counts(st: DataFrame, keys: Sequence[str], start: float = 0.5, stop: float = 1.0,
                          step: float = 0.01, window: float = 0.05) -> DataFrame:
    """Counts and error rate in sliding windows ``s <= conf < s + window`` for
    s in arange(start, stop, step), per predicted class (CRV-13).  Each
    distinct confidence is sent only to the few windows that can hold it (a
    bounded explode) and membership is tested exactly.  Starts are
    ``start + i * delta`` with ``delta = (start + step) - start``, which is how
    ``np.arange`` fills a float range."""
    import math
    n_starts = int(math.ceil((stop - start) / step))
    delta = (start + step) - start
    reach = int(math.ceil(window / step)) + 1
    ct = _conf_table(st)
    hi = F.floor((F.col("conf") - F.lit(start)) / F.lit(step)).cast("int") + 1
    cand = F.sequence(F.greatest(hi - reach, F.lit(0)), F.least(hi, F.lit(n_starts - 1)))
    ex = ct.select(*keys, "yhat", _n().alias("w"), "n_wrong_at", "conf", F.explode(
        F.when(hi >= 0, cand).otherwise(F.array().cast("array<int>"))).alias("i"))
    s = F.lit(start) + F.col("i").cast("double") * F.lit(delta)
    inside = (F.col("conf") >= s) & (F.col("conf") < s + F.lit(window))
    per = (ex.where(inside).groupBy(*keys, "yhat", "i")
             .agg(F.sum("w").alias("n"), F.sum("n_wrong_at").alias("n_wrong")))
    return per.select(*keys, "yhat", "i", (F.lit(start) + F.col("i").cast("double") * F.lit(delta)).alias("start"),
                      "n", "n_wrong",
                      (100.0 * F.col("n_wrong") / F.greatest(F.col("n"), F.lit(1))).alias("error_rate"))


def cumulative_mean(st: DataFrame, keys: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """Running mean of the ascending-sorted scores (CRV-14), reported at the
    end of each tie block: n_le = rows with score <= s, cum_mean = their mean.
    Inside a tie block the running mean moves linearly in the count, so the
    per-row curve is fully determined by these points.  Score sums are exact
    decimals, so the result does not depend on the order of additions."""
    vc = regroup(st, keys).select(*keys, "score", _n().alias("n"),
                                  (F.col("score").cast(_EXACT) * _n()).cast(_EXACT).alias("s"))
    cum = prefix_sum(vc, keys, "score", ["n", "s"], inclusive=True, suffix="_le",
                     n_buckets=n_buckets, splits_from=st)
    return cum.select(*keys, "score", "n", F.col("n_le"),
                      (F.col("s_le").cast("double") / F.col("n_le")).alias("cum_mean"))


def fill_interior_zeros(curve: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Replace zeros of a curve by a straight line from the last non-zero
    before, or the curve's first point where there is none, to the next
    non-zero after (CRV-16).  Zeros with no non-zero after them stay.  Windows
    are per curve (one curve is grid-sized)."""
    nz = F.when(F.col(value) != 0, F.col(value))
    nzp = F.when(F.col(value) != 0, F.col(pos))
    w_prev = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    w_next = Window.partitionBy(*keys).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    t = curve.select("*", F.coalesce(F.last(nz, ignorenulls=True).over(w_prev), F.lit(0.0)).alias("__pv"),
                     F.coalesce(F.last(nzp, ignorenulls=True).over(w_prev), F.first(pos).over(w_prev)).alias("__pp"),
                     F.first(nz, ignorenulls=True).over(w_next).alias("__nv"),
                     F.first(nzp, ignorenulls=True).over(w_next).alias("__np"))
    filled = F.when((F.col(value) == 0) & F.col("__nv").isNotNull(),
                    F.col("__pv") + (F.col("__nv") - F.col("__pv")) * (F.col(pos) - F.col("__pp"))
                    / (F.col("__np") - F.col("__pp"))).otherwise(F.col(value))
    return t.withColumn(value, filled.cast("double")).drop("__pv", "__pp", "__nv", "__np")
