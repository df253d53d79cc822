"""Per-row predictions, best-epoch selection and confusion-count metrics (MET-*).

Input is the canonical flat archive ``pred(run, fold, epoch, id, grp, score,
label)`` with ``score`` = P(class 1) (or a margin, see ``predicted_class``).
Every metric is computed from conditional counts in one grouped aggregate,
so the work is a map-side partial aggregation plus a small final merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.functions.exprs import safe_div


# --- row level -------------------------------------------------------------

def softmax(arr: Column) -> Column:
    """Softmax of a numeric array (MET-01, FEA-12).  The maximum is
    subtracted first: same value as exp(x)/sum(exp(x)), no overflow."""
    m = F.array_max(arr)
    ex = F.transform(arr, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def argmax(arr: Column) -> Column:
    """0-based index of the largest element, first one on ties."""
    return F.array_position(arr, F.array_max(arr)) - 1


def predicted_class(score: Column, kind: str = "prob", cut: float | None = None,
                    inclusive: bool = False) -> Column:
    """Class from a score (MET-02): ``prob`` cuts at 0.5, ``margin`` at 0,
    both strict by default (argmax of a pair takes class 0 on a tie)."""
    if cut is None:
        cut = 0.5 if kind == "prob" else 0.0
    test = score >= F.lit(cut) if inclusive else score > F.lit(cut)
    return F.when(test, 1).otherwise(0)


def prob_of_label(score: Column, label: Column) -> Column:
    return F.when(label == 1, score).otherwise(1.0 - score)


# --- per epoch -------------------------------------------------------------

def cross_entropy(pred: DataFrame, keys: Sequence[str] = ("run", "fold", "epoch"),
                  score: str = "score", label: str = "label", eps: float = 1e-12) -> DataFrame:
    """Mean cross-entropy per group (MET-03): probabilities clipped to
    [eps, 1-eps], 1e-9 added inside the log."""
    p = F.least(F.greatest(prob_of_label(F.col(score), F.col(label)), F.lit(eps)), F.lit(1.0 - eps))
    return pred.groupBy(*keys).agg(F.avg(-F.log(p + 1e-9)).alias("loss"), F.count(F.lit(1)).alias("n"))


def best_epoch(per_epoch: DataFrame, keys: Sequence[str] = ("run", "fold"), epoch: str = "epoch",
               metric: str = "loss", minimize: bool = True) -> DataFrame:
    """Epoch with the lowest (or highest) metric per group, earliest on ties
    (MET-04, MET-05).  A grouped ``min_by`` over a struct: no window."""
    m = F.col(metric) if minimize else -F.col(metric)
    order = F.struct(m.alias("m"), F.col(epoch).alias("e"))
    return (per_epoch.where(F.col(metric).isNotNull())
                     .groupBy(*keys)
                     .agg(F.min_by(F.col(epoch), order).alias("best_epoch"),
                          F.min_by(F.col(metric), order).alias(f"best_{metric}")))


def at_best_epoch(pred: DataFrame, best: DataFrame, keys: Sequence[str] = ("run", "fold"),
                  epoch: str = "epoch") -> DataFrame:
    """Rows of the archive at each group's best epoch.  ``best`` has one row
    per group; AQE broadcasts it once its size is known."""
    b = best.select(*keys, F.col("best_epoch").alias(epoch))
    return pred.join(b, on=[*keys, epoch], how="left_semi")


# --- the score table: one pass over the archive -----------------------------

def score_table(pred: DataFrame, keys: Sequence[str] = ("run", "fold", "epoch"), score: str = "score",
                label: str = "label", materialized: bool = True) -> DataFrame:
    """(keys, score, pos, neg): rows per distinct score and class.

    Loss, confusion counts, ROC/PR, calibration and threshold curves depend
    only on (score, label), so every archive metric is computed from this
    table: one pass over the archive with map-side partial aggregation,
    bounded by keys x distinct scores.  Null and NaN scores are dropped.
    Materialized (checkpointed) because several branches read it."""
    clean = pred.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)))
    st = clean.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("neg"))
    if score != "score":
        st = st.withColumnRenamed(score, "score")
    if materialized:
        from varlens.functions.exprs import materialize
        st = materialize(st)
    return st


def regroup(st: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score table summed over coarser keys (for example pooled over folds)."""
    return st.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def loss_from_table(st: DataFrame, keys: Sequence[str] = ("run", "fold", "epoch"),
                    eps: float = 1e-12) -> DataFrame:
    """MET-03 from the score table: the clipped log-loss of every row at a
    score is the same, so it is weighted by the class counts."""
    s = F.col("score")
    p1 = F.least(F.greatest(s, F.lit(eps)), F.lit(1.0 - eps))
    p0 = F.least(F.greatest(1.0 - s, F.lit(eps)), F.lit(1.0 - eps))
    tot = F.col("pos") * -F.log(p1 + 1e-9) + F.col("neg") * -F.log(p0 + 1e-9)
    return st.groupBy(*keys).agg((F.sum(tot) / F.sum(F.col("pos") + F.col("neg"))).alias("loss"),
                                 F.sum(F.col("pos") + F.col("neg")).alias("n"))


def best_table(st: DataFrame, fold_keys: Sequence[str] = ("run", "fold"), epoch: str = "epoch") -> DataFrame:
    """Score table restricted to each fold's lowest-loss epoch (MET-04)."""
    loss = loss_from_table(st, [*fold_keys, epoch])
    best = best_epoch(loss, fold_keys, epoch)
    return at_best_epoch(st, best, fold_keys, epoch)


def confusion_from_table(st: DataFrame, keys: Sequence[str], cut: float = 0.5,
                         inclusive: bool = False) -> DataFrame:
    """tn, fp, fn, tp, n per group from the score table, predicted 1 when
    score > cut (>= with ``inclusive``)."""
    hit = F.col("score") >= cut if inclusive else F.col("score") > cut
    z = F.lit(0).cast("long")
    return st.groupBy(*keys).agg(
        F.sum(F.when(~hit, F.col("neg")).otherwise(z)).alias("tn"),
        F.sum(F.when(hit, F.col("neg")).otherwise(z)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(z)).alias("fn"),
        F.sum(F.when(hit, F.col("pos")).otherwise(z)).alias("tp"),
        F.sum(F.col("pos") + F.col("neg")).alias("n"))


# --- confusion counts and metrics from them ---------------------------------

def confusion(pred: DataFrame, keys: Sequence[str], yhat: str = "yhat", label: str = "label") -> DataFrame:
    """tn, fp, fn, tp, n per group, labels fixed to [0, 1] (AGG-12)."""
    y, p = F.col(label), F.col(yhat)
    return pred.groupBy(*keys).agg(
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).alias("tn"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("fn"),
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
        F.count(F.lit(1)).alias("n"),
    )


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def accuracy(tn="tn", fp="fp", fn="fn", tp="tp") -> Column:
    return safe_div(_d(tp) + _d(tn), _d(tp) + _d(tn) + _d(fp) + _d(fn))


def balanced_accuracy() -> Column:
    """Mean recall over classes present in the truth (MET-07)."""
    pos, neg = _d("tp") + _d("fn"), _d("tn") + _d("fp")
    r1 = F.when(pos > 0, _d("tp") / pos)
    r0 = F.when(neg > 0, _d("tn") / neg)
    present = F.when(pos > 0, 1).otherwise(0) + F.when(neg > 0, 1).otherwise(0)
    return F.when(present > 0, (F.coalesce(r1, F.lit(0.0)) + F.coalesce(r0, F.lit(0.0))) / present)


def mcc(undefined: float | None = 0.0) -> Column:
    """Matthews correlation in double arithmetic (MET-08); ``undefined`` when
    the denominator is 0 (0 as in the library form, None for NaN)."""
    tp, tn, fp, fn = _d("tp"), _d("tn"), _d("fp"), _d("fn")
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    val = (tp * tn - fp * fn) / den
    fallback = F.lit(undefined).cast("double") if undefined is not None else F.lit(None).cast("double")
    return F.when(den > 0, val).otherwise(fallback)


def precision(undefined: float | None = 0.0) -> Column:
    return safe_div(_d("tp"), _d("tp") + _d("fp"), undefined)


def recall(undefined: float | None = 0.0) -> Column:
    return safe_div(_d("tp"), _d("tp") + _d("fn"), undefined)


def specificity(undefined: float | None = 0.0) -> Column:
    return safe_div(_d("tn"), _d("tn") + _d("fp"), undefined)


def fpr(undefined: float | None = 0.0) -> Column:
    return safe_div(_d("fp"), _d("fp") + _d("tn"), undefined)


def fdr(undefined: float | None = 0.0) -> Column:
    return safe_div(_d("fp"), _d("fp") + _d("tp"), undefined)


def npv(undefined: float | None = 0.0) -> Column:
    return safe_div(_d("tn"), _d("tn") + _d("fn"), undefined)


def f1_pos(undefined: float | None = 0.0) -> Column:
    return safe_div(2 * _d("tp"), 2 * _d("tp") + _d("fp") + _d("fn"), undefined)


def f1_neg(undefined: float | None = 0.0) -> Column:
    return safe_div(2 * _d("tn"), 2 * _d("tn") + _d("fp") + _d("fn"), undefined)


def f1_macro(undefined: float | None = 0.0) -> Column:
    return (f1_pos(undefined) + f1_neg(undefined)) / 2.0


def f1_weighted(undefined: float | None = 0.0) -> Column:
    pos, neg = _d("tp") + _d("fn"), _d("tn") + _d("fp")
    return safe_div(f1_pos(undefined) * pos + f1_neg(undefined) * neg, pos + neg, undefined)


def with_metrics(cm: DataFrame, names: Sequence[str] | None = None,
                 undefined: float | None = 0.0) -> DataFrame:
    """Add metric columns computed from tn, fp, fn, tp (MET-06..11)."""
    tpr = safe_div(_d("tp"), _d("tp") + _d("fn"), None)
    fpr_ = safe_div(_d("fp"), _d("fp") + _d("tn"), None)
    fnr = safe_div(_d("fn"), _d("fn") + _d("tp"), None)
    tnr = safe_div(_d("tn"), _d("tn") + _d("fp"), None)
    lr_pos = safe_div(tpr, fpr_, None)
    lr_neg = safe_div(fnr, tnr, None)
    all_metrics = {
        "accuracy": accuracy(),
        "balanced_accuracy": balanced_accuracy(),
        "mcc": mcc(undefined),
        "precision": precision(undefined),
        "recall": recall(undefined),
        "specificity": specificity(undefined),
        "fpr": fpr(undefined),
        "fdr": fdr(undefined),
        "npv": npv(undefined),
        "f1": f1_pos(undefined),
        "f1_neg": f1_neg(undefined),
        "f1_macro": f1_macro(undefined),
        "f1_weighted": f1_weighted(undefined),
        "lr_pos": lr_pos,
        "lr_neg": lr_neg,
        "dor": safe_div(lr_pos, lr_neg, None),
    }
    names = list(names) if names is not None else list(all_metrics)
    return cm.select("*", *[all_metrics[n].alias(n) for n in names])


def hard_label_auc() -> Column:
    """ROC-AUC of 0/1 predictions, (TPR + TNR) / 2; null with one class (MET-13)."""
    pos, neg = _d("tp") + _d("fn"), _d("tn") + _d("fp")
    return F.when((pos > 0) & (neg > 0), (_d("tp") / pos + _d("tn") / neg) / 2.0)
