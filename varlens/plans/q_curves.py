"""Registered queries: curves and confidence analysis (CRV-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.operators import curves as C
from varlens.operators import metrics as M
from varlens.operators import smoothing as SM
from varlens.plans.catalog import dbl, lin_sql, r6, register
from varlens.plans.q_archive import BEST_ROWS, best_rows, best_st
from varlens.plans.views import pred_view, with_views

FK = ("run", "fold")

# cumulative counts per (keys, distinct score), descending
_CUM = """sc AS (SELECT {keys}, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
    FROM bp GROUP BY {keys}, score),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                  sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                  sum(pos) OVER (PARTITION BY {keys}) AS P, sum(neg) OVER (PARTITION BY {keys}) AS N
    FROM sc)"""

ROC_SQL = _CUM.format(keys="run, fold") + """,
roc AS (SELECT run, fold, CAST(score AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
               CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P END AS tpr, CASE WHEN N > 0 THEN CAST(fp AS DOUBLE) / N END AS fpr
        FROM cum
        UNION ALL
        SELECT DISTINCT run, fold, CAST('inf' AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
               CASE WHEN P > 0 THEN 0.0 END, CASE WHEN N > 0 THEN 0.0 END FROM cum)"""


@register("crv01_roc_curve", with_views(f"""{BEST_ROWS}, {ROC_SQL}
SELECT run, fold, threshold, tp, fp, {r6('tpr', 'tpr')}, {r6('fpr', 'fpr')} FROM roc""", "pred"))
def crv01_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    """ROC points per fold at the best epoch, origin included."""
    return C.roc_curve(best_st(spark, sf), FK)


@register("crv02_roc_auc", with_views(f"""{BEST_ROWS}, {_CUM.format(keys='run, fold')}
SELECT run, fold, CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg,
  {r6('CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(CAST(neg AS DOUBLE) * (CAST(tp - pos AS DOUBLE) + pos / 2.0)) / (CAST(max(P) AS DOUBLE) * max(N)) END', 'auc')}
FROM cum GROUP BY run, fold""", "pred"))
def crv02_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    """ROC-AUC per fold at the best epoch (ties count half)."""
    return C.roc_auc(best_st(spark, sf), FK)


_GRID100 = f"grid AS (SELECT CAST(j AS INTEGER) AS j, {lin_sql('j', 0.0, 1.0, 100)} AS t FROM range(100) r(j))"


@register("crv03_mean_roc", with_views(f"""{BEST_ROWS}, {ROC_SQL}, {_GRID100},
pts AS (SELECT run, fold, fpr, min(tpr) AS ylo, max(tpr) AS yhi FROM roc WHERE fpr IS NOT NULL GROUP BY run, fold, fpr),
g AS (SELECT f.run, f.fold, grid.j, grid.t FROM (SELECT DISTINCT run, fold FROM pts) f, grid),
e AS (SELECT g.*,
   (SELECT max(yhi) FROM pts p WHERE p.run = g.run AND p.fold = g.fold AND p.fpr = g.t) AS ex,
   (SELECT max(fpr) FROM pts p WHERE p.run = g.run AND p.fold = g.fold AND p.fpr < g.t) AS lx,
   (SELECT min(fpr) FROM pts p WHERE p.run = g.run AND p.fold = g.fold AND p.fpr > g.t) AS rx FROM g),
e2 AS (SELECT e.*,
   (SELECT max(yhi) FROM pts p WHERE p.run = e.run AND p.fold = e.fold AND p.fpr = e.lx) AS ly,
   (SELECT min(ylo) FROM pts p WHERE p.run = e.run AND p.fold = e.fold AND p.fpr = e.rx) AS ry FROM e),
per AS (SELECT run, fold, j, t, CASE WHEN j = 0 THEN 0.0 WHEN ex IS NOT NULL THEN ex WHEN lx IS NULL THEN ry
    WHEN rx IS NULL THEN ly ELSE (ry - ly) / (rx - lx) * (t - lx) + ly END AS tpr FROM e2)
SELECT run, j, {r6('t', 'fpr')}, {r6('CASE WHEN j = 99 THEN 1.0 ELSE avg(tpr) END', 'tpr')}, count(*) AS n_folds
FROM per GROUP BY run, j, t""", "pred"))
def crv03_mean_roc(spark: SparkSession, sf: str) -> DataFrame:
    """TPR at 100 FPR grid points, interpolated per fold, mean over folds."""
    return C.mean_roc_grid(best_st(spark, sf), FK, ("run",))


@register("crv04_pr_curve", with_views(f"""{BEST_ROWS}, {_CUM.format(keys='run')}
SELECT run, CAST(score AS DOUBLE) AS threshold, {r6('CAST(tp AS DOUBLE) / (tp + fp)', 'precision')},
  {r6('CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 1.0 END', 'recall')} FROM cum
UNION ALL SELECT DISTINCT run, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM cum""", "pred"))
def crv04_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Precision-recall points pooled over folds per run, end point included."""
    return C.pr_curve(best_st(spark, sf), ("run",))


@register("crv05_pr_scores", with_views(f"""{BEST_ROWS}, {_CUM.format(keys='run')}
SELECT run, CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg,
  {r6('''CASE WHEN max(P) > 0 THEN sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp)
        + CASE WHEN tp - pos + fp - neg > 0 THEN CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) ELSE 1.0 END) / 2.0) / max(P) END''', 'pr_auc')},
  {r6('CASE WHEN max(P) > 0 THEN sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp))) / max(P) END', 'average_precision')}
FROM cum GROUP BY run""", "pred"))
def crv05_pr_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Trapezoid PR area and average precision pooled per run."""
    return C.pr_scores(best_st(spark, sf), ("run",))


@register("crv06_youden", with_views(f"""{BEST_ROWS}, {ROC_SQL}
SELECT run, fold, threshold, {r6('yj', 'youden_j')} FROM (
  SELECT run, fold, threshold, tpr - fpr AS yj,
         row_number() OVER (PARTITION BY run, fold ORDER BY tpr - fpr DESC, threshold DESC) AS rn FROM roc) WHERE rn = 1""",
    "pred"))
def crv06_youden(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold with the largest TPR - FPR per fold (highest on ties)."""
    return C.youden(best_st(spark, sf), FK)


@register("crv07_calibration", with_views(f"""{BEST_ROWS},
b AS (SELECT run, fold, score, label,
   (SELECT count(*) FROM range(1, 10) e(k) WHERE CAST(k AS DOUBLE) * {dbl(0.1)} + {dbl(0.0)} < score) AS bin FROM bp),
per AS (SELECT run, fold, bin, avg(score) AS prob_pred, avg(CAST(label AS DOUBLE)) AS prob_true FROM b GROUP BY run, fold, bin)
SELECT run, CAST(bin AS INTEGER) AS bin, {r6('avg(prob_pred)', 'prob_pred')}, {r6('avg(prob_true)', 'prob_true')},
  {r6('stddev_pop(prob_true) / sqrt(count(*))', 'prob_true_se')}, count(*) AS n_folds
FROM per GROUP BY run, bin""", "pred"))
def crv07_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration curve (10 uniform bins) per fold, mean and s.e. over folds."""
    return C.calibration(best_st(spark, sf), FK, ("run",))


def _sweep_sql() -> str:
    parts = []
    for cls, lo, hi, test, conf, truth in ((0, 0.001, 0.5, "score <= t", "1 - CAST(score AS DECIMAL(28, 12))", "label = 0"),
                                           (1, 0.5, 0.999, "score >= t", "CAST(score AS DECIMAL(28, 12))", "label = 1")):
        parts.append(f"""SELECT b.run, {cls} AS cls, g.j, g.t AS threshold,
    count(*) FILTER (WHERE {test}) AS sel, count(*) FILTER (WHERE {test} AND {truth}) AS tp,
    count(*) FILTER (WHERE {truth}) AS n_true,
    CAST(sum({conf}) FILTER (WHERE {test}) AS DOUBLE) AS conf, CAST(sum({conf}) FILTER (WHERE {test} AND {truth}) AS DOUBLE) AS conf_tp
  FROM bp b, (SELECT CAST(j AS INTEGER) AS j, {lin_sql('j', lo, hi, 100)} AS t FROM range(100) r(j)) g
  GROUP BY b.run, g.j, g.t""")
    return "sw AS (" + " UNION ALL ".join(parts) + """),
sweep AS (SELECT run, cls, j, threshold, sel, tp,
    CASE WHEN sel > 0 THEN CAST(tp AS DOUBLE) / sel ELSE 0.0 END AS precision,
    CASE WHEN n_true > 0 THEN CAST(tp AS DOUBLE) / n_true ELSE 0.0 END AS recall,
    CASE WHEN sel > 0 THEN conf / sel ELSE 0.0 END AS expected_precision,
    CASE WHEN tp > 0 THEN conf_tp / tp ELSE 0.0 END AS expected_recall FROM sw)"""


@register("crv08_threshold_sweep", with_views(f"""{BEST_ROWS}, {_sweep_sql()}
SELECT run, cls, j, {r6('threshold', 'threshold')}, sel, tp, {r6('precision', 'precision')}, {r6('recall', 'recall')},
  {r6('expected_precision', 'expected_precision')}, {r6('expected_recall', 'expected_recall')} FROM sweep""", "pred"))
def crv08_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall, expected precision/recall over two threshold grids."""
    return C.threshold_sweep(best_st(spark, sf), ("run",))


_CUTOFF_SQL = """cut AS (SELECT s.run, s.cls, s.j, s.threshold, s.precision, s.recall,
      (CASE WHEN s.cls = 0 THEN a.last_ok ELSE a.first_ok END) IS NOT NULL AS reached
    FROM sweep s JOIN (SELECT run, cls, max(j) FILTER (WHERE precision >= 0.9) AS last_ok,
                              min(j) FILTER (WHERE precision >= 0.9) AS first_ok FROM sweep GROUP BY run, cls) a
      ON s.run = a.run AND s.cls = a.cls
     AND s.j = CASE WHEN s.cls = 0 THEN coalesce(a.last_ok, 99) ELSE coalesce(a.first_ok, 0) END)"""


@register("crv09_precision_cutoff", with_views(f"""{BEST_ROWS}, {_sweep_sql()}, {_CUTOFF_SQL}
SELECT run, cls, j, {r6('threshold', 'threshold')}, {r6('precision', 'precision')}, {r6('recall', 'recall')}, reached
FROM cut""", "pred"))
def crv09_precision_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Grid cut-off reaching 90 % precision for each class, per run."""
    return C.precision_cutoff(C.threshold_sweep(best_st(spark, sf), ("run",)), ("run",))


@register("crv10_ambiguous", with_views(f"""{BEST_ROWS}, {_sweep_sql()}, {_CUTOFF_SQL},
t AS (SELECT run, max(threshold) FILTER (WHERE cls = 0) AS t0, max(threshold) FILTER (WHERE cls = 1) AS t1 FROM cut GROUP BY run)
SELECT b.run, CAST(sum(CASE WHEN NOT (b.score <= t.t0 OR b.score >= t.t1) THEN 1 ELSE 0 END) AS BIGINT) AS n_ambiguous,
  count(*) AS n FROM bp b JOIN t ON b.run = t.run GROUP BY b.run""", "pred"))
def crv10_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    """Rows reaching neither class's 90 %-precision cut-off, per run."""
    bt = best_st(spark, sf)
    cut = C.precision_cutoff(C.threshold_sweep(bt, ("run",)), ("run",))
    return C.ambiguous_count(bt, cut, ("run",))


def _hist_join(src: str, val: str, lo: float, hi: float, n: int) -> str:
    """SQL joining rows of ``src`` to the numpy histogram bins of ``val``."""
    return f"""(SELECT s.*, CAST(h.k AS INTEGER) AS bin, h.lo, h.hi FROM {src} s JOIN
      (SELECT k, {lin_sql('k', lo, hi, n + 1)} AS lo, {lin_sql('k + 1', lo, hi, n + 1)} AS hi FROM range({n}) r(k)) h
      ON s.{val} >= h.lo AND (s.{val} < h.hi OR (h.k = {n - 1} AND s.{val} <= h.hi)))"""


@register("crv11_confidence_hist", with_views(f"""{BEST_ROWS},
hb AS {_hist_join('bp', 'score', 0.0, 1.0, 100)},
c AS (SELECT run, label AS truth, bin, lo, hi, count(*) AS n FROM hb GROUP BY run, label, bin, lo, hi)
SELECT run, truth, bin, {r6('lo', 'lo')}, n, {r6('n / (sum(n) OVER (PARTITION BY run, truth) * (hi - lo))', 'density')}
FROM c""", "pred"))
def crv11_confidence_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Density histogram (100 bins) of P(class 1) by true class, per run."""
    return C.confidence_histogram(best_st(spark, sf), ("run",))


_CONF = """cf AS (SELECT run, label, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS yhat,
    CASE WHEN score > 0.5 THEN score ELSE 1.0 - score END AS conf,
    CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) <> label THEN 1 ELSE 0 END AS wrong FROM bp)"""


@register("crv12_error_rate_bins", with_views(f"""{BEST_ROWS}, {_CONF},
hb AS {_hist_join('cf', 'conf', 0.5, 1.0, 10)}
SELECT run, yhat, bin, {r6('lo', 'lo')}, count(*) AS n, CAST(sum(wrong) AS BIGINT) AS n_wrong,
  {r6('100.0 * sum(wrong) / greatest(count(*), 1)', 'error_rate')}
FROM hb GROUP BY run, yhat, bin, lo""", "pred"))
def crv12_error_rate_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Error rate per confidence bin on [0.5, 1] by predicted class, per run."""
    return C.error_rate_bins(best_st(spark, sf), ("run",))


_DELTA = (0.5 + 0.01) - 0.5

SLIDE_SQL = f"""{_CONF},
w AS (SELECT CAST(i AS INTEGER) AS i, {dbl(0.5)} + CAST(i AS DOUBLE) * {dbl(_DELTA)} AS s FROM range(50) r(i)),
sl AS (SELECT cf.run, cf.yhat, w.i, w.s AS start, count(*) AS n, CAST(sum(cf.wrong) AS BIGINT) AS n_wrong
  FROM cf JOIN w ON cf.conf >= w.s AND cf.conf < w.s + {dbl(0.05)} GROUP BY cf.run, cf.yhat, w.i, w.s)"""


@register("crv13_sliding_windows", with_views(f"""{BEST_ROWS}, {SLIDE_SQL}
SELECT run, yhat, i, {r6('start', 'start')}, n, n_wrong, {r6('100.0 * n_wrong / greatest(n, 1)', 'error_rate')}
FROM sl""", "pred"))
def crv13_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and error rate in 0.05-wide windows stepped by 0.01, per run."""
    return C.sliding_window_counts(best_st(spark, sf), ("run",))


@register("crv14_cumulative_mean", with_views(f"""{BEST_ROWS},
v AS (SELECT run, score, count(*) AS n, sum(CAST(score AS DECIMAL(38, 12))) AS s FROM bp GROUP BY run, score)
SELECT run, {r6('score', 'score')}, n,
  sum(n) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_le,
  {r6('CAST(sum(s) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / sum(n) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'cum_mean')}
FROM v""".replace("sum(n) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_le",
                  "CAST(sum(n) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_le"),
    "pred"))
def crv14_cumulative_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Running mean of ascending scores, at the end of each tie block, per run."""
    return C.cumulative_mean(best_st(spark, sf), ("run",))


@register("crv16_fill_interior_zeros", with_views(f"""{BEST_ROWS}, {SLIDE_SQL},
fz AS (SELECT k.run, k.yhat, w.i, coalesce(100.0 * sl.n_wrong / greatest(sl.n, 1), 0.0) AS error_rate
  FROM (SELECT DISTINCT run, yhat FROM cf) k CROSS JOIN w
  LEFT JOIN sl ON sl.run = k.run AND sl.yhat = k.yhat AND sl.i = w.i),
nb AS (SELECT f.*,
  coalesce((SELECT max(i) FROM fz g WHERE g.run = f.run AND g.yhat = f.yhat AND g.i <= f.i AND g.error_rate <> 0),
    (SELECT min(i) FROM fz g WHERE g.run = f.run AND g.yhat = f.yhat)) AS pp,
  (SELECT min(i) FROM fz g WHERE g.run = f.run AND g.yhat = f.yhat AND g.i >= f.i AND g.error_rate <> 0) AS np FROM fz f),
v AS (SELECT nb.*, (SELECT error_rate FROM fz g WHERE g.run = nb.run AND g.yhat = nb.yhat AND g.i = nb.pp) AS pv,
   (SELECT error_rate FROM fz g WHERE g.run = nb.run AND g.yhat = nb.yhat AND g.i = nb.np) AS nv FROM nb)
SELECT run, yhat, i, {r6('CASE WHEN error_rate = 0 AND pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (i - pp) / (np - pp) ELSE error_rate END', 'error_rate')}
FROM v""", "pred"))
def crv16_fill_interior_zeros(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding-window error-rate curve on all 50 starts with zeros
    replaced by straight lines from the non-zero value (or the start) before to
    the non-zero value after."""
    bt = best_st(spark, sf)
    sl = C.sliding_window_counts(bt, ("run",))
    keys = bt.select("run", F.when(F.col("score") > 0.5, 1).otherwise(0).alias("yhat")).distinct()
    full = (keys.crossJoin(spark.range(50).select(F.col("id").cast("int").alias("i")))
                .join(sl.select("run", "yhat", "i", "error_rate"), ["run", "yhat", "i"], "left")
                .na.fill(0.0, ["error_rate"]))
    return C.fill_interior_zeros(full, ("run", "yhat"), "i", "error_rate")


@register("crv17_predicted_confidence", with_views(f"""{BEST_ROWS}
SELECT run, fold, id, grp, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS yhat,
  {r6('CASE WHEN score > 0.5 THEN score ELSE 1.0 - score END', 'conf')},
  CAST(CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) <> label THEN 1 ELSE 0 END AS INTEGER) AS wrong
FROM bp""", "pred"))
def crv17_predicted_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Per row: predicted class, its confidence and whether it is wrong."""
    rows = C.confidence_rows(best_rows(pred_view(spark, sf)))
    return rows.select("run", "fold", "id", "grp", "yhat", "conf", "wrong")


@register("crv15_lowess", with_views(f"""{BEST_ROWS},
p AS (SELECT run, score AS x, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN (score > 0.5) <> (label = 1) THEN 1 ELSE 0 END) AS BIGINT) AS y
  FROM bp GROUP BY run, score),
k AS (SELECT run, greatest(1, CAST(floor(0.15 * sum(n) + 1e-10) AS BIGINT)) AS k FROM p GROUP BY run),
d AS (SELECT a.run, a.x AS x0, b.x - a.x AS d, b.n, b.y FROM p a JOIN p b ON a.run = b.run),
c AS (SELECT run, x0, abs(d) AS far, sum(n) OVER (PARTITION BY run, x0 ORDER BY abs(d)) AS within FROM d),
r AS (SELECT c.run, c.x0, min(far) AS r FROM c JOIN k ON c.run = k.run AND c.within >= k.k GROUP BY c.run, c.x0),
w AS (SELECT d.run, d.x0, d.d, d.n, d.y, CASE WHEN r.r > 0 THEN pow(1 - pow(abs(d.d) / r.r, 3), 3) ELSE 1.0 END AS w
  FROM d JOIN r ON d.run = r.run AND d.x0 = r.x0 WHERE abs(d.d) < r.r OR d.d = 0),
m AS (SELECT run, x0, sum(w * n) AS s0, sum(w * n * d) / sum(w * n) AS mx, sum(w * y) / sum(w * n) AS my,
    sum(w * n * d * d) / sum(w * n) AS sxx, sum(w * y * d) / sum(w * n) AS sxy FROM w GROUP BY run, x0),
f AS (SELECT run, x0, my - mx * (sxy - mx * my) / greatest(sxx - mx * mx, 1e-12) AS smooth FROM m)
SELECT p.run, {r6('p.x', 'score')}, p.n, p.y AS n_wrong, {r6('CASE WHEN p.x < 0.5 THEN 1 - p.x ELSE p.x END', 'conf')}, {r6('100.0 * f.smooth', 'error_rate')}
FROM p JOIN f ON p.run = f.run AND p.x = f.x0""", "pred"))
def crv15_lowess(spark: SparkSession, sf: str) -> DataFrame:
    """Error rate smoothed by local lines (15 % nearest rows, no robust pass)
    at every distinct score, per run at the best epoch."""
    return SM.smoothed_error_rate(best_st(spark, sf), ("run",), 0.15)
