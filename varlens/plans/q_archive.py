"""Registered queries over the prediction archive: MET-* and the archive AGG-*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.functions.exprs import md5_key
from varlens.operators import curves as C
from varlens.operators import metrics as M
from varlens.plans.catalog import r6, register
from varlens.plans.views import pred3_view, pred_view, variants_view, with_views

# ---------------------------------------------------------------------------
# shared pieces: loss per epoch, best epoch per fold, rows at the best epoch
# ---------------------------------------------------------------------------

LOSS_SQL = """loss AS (SELECT run, fold, epoch,
    avg(-ln(least(greatest(CASE WHEN label = 1 THEN score ELSE 1.0 - score END, 1e-12), 1.0 - 1e-12) + 1e-9)) AS loss,
    count(*) AS n FROM pred GROUP BY run, fold, epoch)"""
BEST_SQL = """best AS (SELECT run, fold, epoch AS best_epoch, loss AS best_loss FROM (
    SELECT *, row_number() OVER (PARTITION BY run, fold ORDER BY loss, epoch) AS rn FROM loss) WHERE rn = 1)"""
BP_SQL = """bp AS (SELECT p.*, CASE WHEN p.score > 0.5 THEN 1 ELSE 0 END AS yhat FROM pred p
    JOIN best b ON p.run = b.run AND p.fold = b.fold AND p.epoch = b.best_epoch)"""
BEST_ROWS = f"WITH {LOSS_SQL}, {BEST_SQL}, {BP_SQL}"


def archive_table(spark: SparkSession, sf: str) -> DataFrame:
    """Score table of the archive per (run, fold, epoch): one pass, checkpointed."""
    return M.score_table(pred_view(spark, sf), ("run", "fold", "epoch"))


def best_rows(pred: DataFrame) -> DataFrame:
    """Archive rows at each (run, fold)'s lowest-loss epoch, with yhat = score > 0.5.
    The loss comes from the compact score table; the rows are then selected
    with a semi-join against the (tiny) best-epoch table."""
    st = M.score_table(pred, ("run", "fold", "epoch"))
    best = M.best_epoch(M.loss_from_table(st), ("run", "fold"))
    return M.at_best_epoch(pred, best).withColumn("yhat", M.predicted_class(F.col("score")))


def best_st(spark: SparkSession, sf: str) -> DataFrame:
    """Score table at each fold's best epoch."""
    return M.best_table(archive_table(spark, sf))


def counts_sql(src: str, keys: str) -> str:
    """SQL for tn, fp, fn, tp, n per ``keys`` over ``src`` (label, yhat)."""
    return f"""SELECT {keys},
        CAST(sum(CASE WHEN label = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
        CAST(sum(CASE WHEN label = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN label = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(sum(CASE WHEN label = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        count(*) AS n FROM {src} GROUP BY {keys}"""


def _div(num: str, den: str, undefined: str = "NULL") -> str:
    return f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE {undefined} END"


METRIC_SQL = {
    "accuracy": _div("tp + tn", "tp + tn + fp + fn"),
    "balanced_accuracy": """CASE WHEN (tp + fn) > 0 OR (tn + fp) > 0 THEN
        (COALESCE(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 0.0)
         + COALESCE(CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END, 0.0))
        / ((CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END)) END""",
    "mcc": """CASE WHEN sqrt(CAST(tp + fp AS DOUBLE) * CAST(tp + fn AS DOUBLE) * CAST(tn + fp AS DOUBLE)
        * CAST(tn + fn AS DOUBLE)) > 0 THEN
        (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * CAST(tp + fn AS DOUBLE)
        * CAST(tn + fp AS DOUBLE) * CAST(tn + fn AS DOUBLE)) ELSE 0.0 END""",
    "precision": _div("tp", "tp + fp", "0.0"),
    "recall": _div("tp", "tp + fn", "0.0"),
    "specificity": _div("tn", "tn + fp", "0.0"),
    "fpr": _div("fp", "fp + tn", "0.0"),
    "fdr": _div("fp", "fp + tp", "0.0"),
    "npv": _div("tn", "tn + fn", "0.0"),
    "f1": _div("2 * tp", "2 * tp + fp + fn", "0.0"),
    "f1_neg": _div("2 * tn", "2 * tn + fp + fn", "0.0"),
}
METRIC_SQL["f1_macro"] = f"(({METRIC_SQL['f1']}) + ({METRIC_SQL['f1_neg']})) / 2.0"
METRIC_SQL["f1_weighted"] = _div(f"({METRIC_SQL['f1']}) * (tp + fn) + ({METRIC_SQL['f1_neg']}) * (tn + fp)",
                                 "tp + fn + tn + fp", "0.0")
_TPR, _FPR = _div("tp", "tp + fn"), _div("fp", "fp + tn")
_FNR, _TNR = _div("fn", "fn + tp"), _div("tn", "tn + fp")
METRIC_SQL["lr_pos"] = _div(_TPR, _FPR)
METRIC_SQL["lr_neg"] = _div(_FNR, _TNR)
METRIC_SQL["dor"] = _div(METRIC_SQL["lr_pos"], METRIC_SQL["lr_neg"])


def metric_cols_sql(names) -> str:
    return ", ".join(r6(METRIC_SQL[n], n) for n in names)


# ---------------------------------------------------------------------------
# MET
# ---------------------------------------------------------------------------

@register("met01_softmax", with_views("""
SELECT run, fold, epoch, id, grp,
  """ + r6("exp(0.0 - greatest(0.0, (score - 0.5) * 8.0)) / (exp(0.0 - greatest(0.0, (score - 0.5) * 8.0)) "
           "+ exp((score - 0.5) * 8.0 - greatest(0.0, (score - 0.5) * 8.0)))", "p0") + """,
  """ + r6("exp((score - 0.5) * 8.0 - greatest(0.0, (score - 0.5) * 8.0)) / (exp(0.0 - greatest(0.0, (score - 0.5) * 8.0)) "
           "+ exp((score - 0.5) * 8.0 - greatest(0.0, (score - 0.5) * 8.0)))", "p1") + """
FROM pred""", "pred"))
def met01_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax over a logit pair (0, 8 * (score - 0.5)) per archive row."""
    p = pred_view(spark, sf)
    logits = F.array(F.lit(0.0), (F.col("score") - 0.5) * 8.0)
    sm = M.softmax(logits)
    return p.select("run", "fold", "epoch", "id", "grp", F.get(sm, 0).alias("p0"), F.get(sm, 1).alias("p1"))


@register("met02_predicted_class", with_views("""
SELECT run, epoch,
  CAST(sum(CASE WHEN (score - 0.5) * 8.0 > 0.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_argmax1,
  CAST(sum(CASE WHEN (score - 0.5) * 8.0 > 0.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_margin1,
  CAST(sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_prob1,
  CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_prob1_incl,
  count(*) AS n
FROM pred GROUP BY run, epoch""", "pred"))
def met02_predicted_class(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted class by argmax of a logit pair, by margin > 0 and by p > 0.5."""
    p = pred_view(spark, sf)
    margin = (F.col("score") - 0.5) * 8.0
    logits = F.array(F.lit(0.0), margin)
    return p.groupBy("run", "epoch").agg(
        F.sum(M.argmax(logits)).cast("long").alias("n_argmax1"),
        F.sum(M.predicted_class(margin, "margin")).cast("long").alias("n_margin1"),
        F.sum(M.predicted_class(F.col("score"))).cast("long").alias("n_prob1"),
        F.sum(M.predicted_class(F.col("score"), inclusive=True)).cast("long").alias("n_prob1_incl"),
        F.count(F.lit(1)).alias("n"))


@register("met03_cross_entropy", with_views(f"WITH {LOSS_SQL} SELECT run, fold, epoch, {r6('loss', 'loss')}, n FROM loss",
                                            "pred"))
def met03_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Mean clipped cross-entropy per (run, fold, epoch)."""
    return M.loss_from_table(archive_table(spark, sf))


@register("met04_best_epoch", with_views(
    f"WITH {LOSS_SQL}, {BEST_SQL} SELECT run, fold, best_epoch, {r6('best_loss', 'best_loss')} FROM best", "pred"))
def met04_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest-loss epoch per (run, fold), earliest on ties."""
    return M.best_epoch(M.loss_from_table(archive_table(spark, sf)), ("run", "fold"))


_EPOCH_COUNTS = """ep AS (SELECT run, fold, epoch,
    CAST(sum(CASE WHEN label = 0 AND score <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN label = 0 AND score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND score <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 1 AND score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp
    FROM pred GROUP BY run, fold, epoch)"""


def _epoch_counts(spark, sf, inclusive=False):
    return M.confusion_from_table(archive_table(spark, sf), ("run", "fold", "epoch"), inclusive=inclusive)


@register("met05_best_epoch_by_metric", with_views(f"""WITH {_EPOCH_COUNTS},
m AS (SELECT run, fold, epoch, {METRIC_SQL['balanced_accuracy']} AS ba, {METRIC_SQL['f1']} AS f1 FROM ep)
SELECT run, fold,
  arg_max(epoch, (ba, -epoch)) AS best_epoch_ba, {r6('max(ba)', 'best_ba')},
  arg_max(epoch, (f1, -epoch)) AS best_epoch_f1, {r6('max(f1)', 'best_f1')}
FROM m GROUP BY run, fold""", "pred"))
def met05_best_epoch_by_metric(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch with the highest balanced accuracy and the highest F1 per fold."""
    cm = M.with_metrics(_epoch_counts(spark, sf), ["balanced_accuracy", "f1"])
    ba = M.best_epoch(cm, ("run", "fold"), metric="balanced_accuracy", minimize=False)
    f1 = M.best_epoch(cm, ("run", "fold"), metric="f1", minimize=False)
    return (ba.select("run", "fold", F.col("best_epoch").alias("best_epoch_ba"),
                      F.col("best_balanced_accuracy").alias("best_ba"))
              .join(f1.select("run", "fold", F.col("best_epoch").alias("best_epoch_f1"),
                              F.col("best_f1")), ["run", "fold"]))


@register("met06_accuracy_by_epoch", with_views(f"""WITH {_EPOCH_COUNTS}
SELECT run, fold, epoch, {metric_cols_sql(['accuracy'])} FROM ep""", "pred"))
def met06_accuracy_by_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy per (run, fold, epoch)."""
    return M.with_metrics(_epoch_counts(spark, sf), ["accuracy"]).select("run", "fold", "epoch", "accuracy")


def _best_counts(spark, sf, keys=("run", "fold")):
    return M.confusion_from_table(best_st(spark, sf), keys)


@register("met07_balanced_accuracy", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')})
SELECT run, fold, {metric_cols_sql(['balanced_accuracy'])} FROM c""", "pred"))
def met07_balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced accuracy per fold at the best epoch."""
    return M.with_metrics(_best_counts(spark, sf), ["balanced_accuracy"]).select("run", "fold", "balanced_accuracy")


@register("met08_mcc", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')})
SELECT run, fold, {metric_cols_sql(['mcc'])} FROM c""", "pred"))
def met08_mcc(spark: SparkSession, sf: str) -> DataFrame:
    """Matthews correlation per fold at the best epoch."""
    return M.with_metrics(_best_counts(spark, sf), ["mcc"]).select("run", "fold", "mcc")


_RATES = ["precision", "recall", "specificity", "fpr", "fdr", "npv"]


@register("met09_rates", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')})
SELECT run, fold, {metric_cols_sql(_RATES)} FROM c""", "pred"))
def met09_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall, specificity, FPR, FDR, NPV per fold at the best epoch."""
    return M.with_metrics(_best_counts(spark, sf), _RATES).select("run", "fold", *_RATES)


_F1S = ["f1", "f1_neg", "f1_macro", "f1_weighted"]


@register("met10_f1", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')})
SELECT run, fold, {metric_cols_sql(_F1S)} FROM c""", "pred"))
def met10_f1(spark: SparkSession, sf: str) -> DataFrame:
    """F1 binary, per class, macro and weighted per fold at the best epoch."""
    return M.with_metrics(_best_counts(spark, sf), _F1S).select("run", "fold", *_F1S)


_LRS = ["lr_pos", "lr_neg", "dor"]


@register("met11_likelihood_ratios", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, grp')})
SELECT run, grp, {metric_cols_sql(_LRS)} FROM c""", "pred"))
def met11_likelihood_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Likelihood ratios and diagnostic odds ratio per (run, group)."""
    cm = M.confusion(best_rows(pred_view(spark, sf)), ("run", "grp"))
    return M.with_metrics(cm, _LRS).select("run", "grp", *_LRS)


@register("met12_learning_curve", with_views(f"""WITH {_EPOCH_COUNTS},
a AS (SELECT run, fold, epoch, {METRIC_SQL['accuracy']} AS acc FROM ep)
SELECT run, epoch, {r6('avg(acc)', 'accuracy')}, count(*) AS n_folds FROM a GROUP BY run, epoch""", "pred"))
def met12_learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy per epoch averaged over folds."""
    acc = M.with_metrics(_epoch_counts(spark, sf), ["accuracy"])
    return acc.groupBy("run", "epoch").agg(F.avg("accuracy").alias("accuracy"),
                                           F.count(F.lit(1)).alias("n_folds"))


@register("met13_epoch_mcc_hard_auc", with_views("""WITH ep AS (SELECT run, fold, epoch,
    CAST(sum(CASE WHEN label = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp
    FROM pred GROUP BY run, fold, epoch)
SELECT run, fold, epoch, """ + metric_cols_sql(["mcc"]) + ", " + r6(
    "CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2.0 END",
    "hard_auc") + " FROM ep", "pred"))
def met13_epoch_mcc_hard_auc(spark: SparkSession, sf: str) -> DataFrame:
    """MCC and hard-label AUC per epoch with scores cut at >= 0.5."""
    cm = M.with_metrics(_epoch_counts(spark, sf, inclusive=True), ["mcc"])
    return cm.select("run", "fold", "epoch", "mcc", M.hard_label_auc().alias("hard_auc"))


@register("met14_null_model", with_views("""
WITH r AS (SELECT run, fold, epoch, id, grp, score, label,
    row_number() OVER (PARTITION BY run, fold, epoch ORDER BY id, grp, score, label) AS rk_row,
    row_number() OVER (PARTITION BY run, fold, epoch ORDER BY md5(CAST(id AS VARCHAR) || '|' || CAST(grp AS VARCHAR) || '|7'), id, grp, score, label) AS rk_p1,
    row_number() OVER (PARTITION BY run, fold, epoch ORDER BY md5(CAST(id AS VARCHAR) || '|' || CAST(grp AS VARCHAR) || '|8'), id, grp, score, label) AS rk_p0
    FROM pred),
s AS (SELECT a.run, a.fold, a.epoch, a.id, a.grp, a.label, b.score AS p1, 1.0 - c.score AS p0
    FROM r a JOIN r b ON a.run = b.run AND a.fold = b.fold AND a.epoch = b.epoch AND a.rk_row = b.rk_p1
             JOIN r c ON a.run = c.run AND a.fold = c.fold AND a.epoch = c.epoch AND a.rk_row = c.rk_p0)
SELECT run, fold, epoch, count(*) AS n,
  CAST(sum(CASE WHEN p1 > p0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pred1,
  CAST(sum(CASE WHEN (CASE WHEN p1 > p0 THEN 1 ELSE 0 END) = label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
  """ + r6("sum(p1)", "sum_p1") + ", " + r6("sum(p0)", "sum_p0") + """
FROM s GROUP BY run, fold, epoch""", "pred"))
def met14_null_model(spark: SparkSession, sf: str) -> DataFrame:
    """Null model: the two class columns permuted independently within each
    (run, fold, epoch) by seeded hash orders; accuracy counts per epoch."""
    from varlens.operators.stats import permute_within
    p = pred_view(spark, sf)
    keys = ("run", "fold", "epoch")
    tie = ["id", "grp", "score", "label"]
    key = F.concat(F.col("id").cast("string"), F.lit("|"), F.col("grp").cast("string"))
    drawn = permute_within(p, keys, tie, [(F.md5(F.concat(key, F.lit(f"|{seed}"))), "score", out) for seed, out in ((7, "p1"), (8, "s0"))])
    s = drawn.withColumn("p0", 1.0 - F.col("s0"))
    yhat = F.when(F.col("p1") > F.col("p0"), 1).otherwise(0)
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(yhat).cast("long").alias("n_pred1"),
        F.sum(F.when(yhat == F.col("label"), 1).otherwise(0)).cast("long").alias("n_correct"),
        F.sum("p1").alias("sum_p1"), F.sum("p0").alias("sum_p0"))


@register("met15_correctness_table", with_views(f"""{BEST_ROWS}
SELECT bp.run, bp.fold, bp.id, v.gene, bp.label, bp.yhat, {r6('bp.score', 'proba')},
  CASE WHEN bp.yhat = bp.label THEN 1 ELSE 0 END AS correct
FROM bp JOIN variants v ON bp.pkey = v.id""", "pred", "variants"))
def met15_correctness_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at the best epoch with prediction, probability and correctness,
    joined to the variant table on the part key."""
    bp = best_rows(pred_view(spark, sf))
    v = variants_view(spark, sf).select(F.col("id").alias("vid"), "gene")
    j = bp.join(v, bp["pkey"] == v["vid"], "inner")
    return j.select("run", "fold", "id", "gene", "label", "yhat", F.col("score").alias("proba"),
                    F.when(F.col("yhat") == F.col("label"), 1).otherwise(0).alias("correct"))


@register("met16_f1_per_group", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, grp')}),
g AS (SELECT run, grp, CASE WHEN tp + fn > 0 THEN {METRIC_SQL['f1']} END AS f1_pos,
                        CASE WHEN tn + fp > 0 THEN {METRIC_SQL['f1_neg']} END AS f1_neg FROM c)
SELECT run, grp, {r6('f1_pos', 'f1_pos')}, {r6('f1_neg', 'f1_neg')},
  {r6('avg(f1_pos) OVER (PARTITION BY run)', 'mean_f1_pos')} FROM g""", "pred"))
def met16_f1_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """F1 per group pooled over folds; a group without the class gives null
    and is skipped in the per-run mean."""
    from pyspark.sql import Window
    cm = M.confusion(best_rows(pred_view(spark, sf)), ("run", "grp"))
    g = cm.select("run", "grp",
                  F.when(F.col("tp") + F.col("fn") > 0, M.f1_pos()).alias("f1_pos"),
                  F.when(F.col("tn") + F.col("fp") > 0, M.f1_neg()).alias("f1_neg"))
    return g.withColumn("mean_f1_pos", F.avg("f1_pos").over(Window.partitionBy("run")))


@register("met17_learning_curve_by_size", with_views(f"""WITH {_EPOCH_COUNTS},
a AS (SELECT run, fold, epoch AS size, {METRIC_SQL['accuracy']} AS acc FROM ep)
SELECT run, size, {r6('avg(acc)', 'accuracy')}, {r6('stddev_samp(acc) / sqrt(count(*))', 'se')}, count(*) AS n_folds
FROM a GROUP BY run, size""", "pred"))
def met17_learning_curve_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy per fold at each training size (here the epoch index), then
    mean and standard error over folds per size."""
    acc = M.with_metrics(_epoch_counts(spark, sf), ["accuracy"]).withColumnRenamed("epoch", "size")
    return acc.groupBy("run", "size").agg(
        F.avg("accuracy").alias("accuracy"),
        (F.stddev_samp("accuracy") / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.count(F.lit(1)).alias("n_folds"))


# ---------------------------------------------------------------------------
# archive aggregates
# ---------------------------------------------------------------------------

@register("agg12_confusion_rollup", with_views(f"""{BEST_ROWS}
SELECT run, grp,
  CAST(sum(CASE WHEN label = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN label = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  count(*) AS n
FROM bp GROUP BY ROLLUP (run, grp)""", "pred"))
def agg12_confusion_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts per (run, group), per run and overall (rollup)."""
    bp = best_rows(pred_view(spark, sf))
    y, p = F.col("label"), F.col("yhat")
    return bp.rollup("run", "grp").agg(
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("long").alias("tp"),
        F.count(F.lit(1)).alias("n"))


@register("agg13_correct_per_group", with_views(f"""{BEST_ROWS}
SELECT run, grp, CAST(sum(CASE WHEN yhat = label THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n,
  {r6('avg(CASE WHEN yhat = label THEN 1.0 ELSE 0.0 END)', 'accuracy')}
FROM bp GROUP BY run, grp""", "pred"))
def agg13_correct_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Hits, total and accuracy per (run, group) at the best epoch."""
    bp = best_rows(pred_view(spark, sf))
    hit = F.when(F.col("yhat") == F.col("label"), 1).otherwise(0)
    return bp.groupBy("run", "grp").agg(F.sum(hit).cast("long").alias("hits"), F.count(F.lit(1)).alias("n"),
                                        F.avg(hit.cast("double")).alias("accuracy"))


@register("agg14_errors_ranked", with_views(f"""{BEST_ROWS}
SELECT run, grp, label, count(*) AS n_wrong,
  row_number() OVER (PARTITION BY run, label ORDER BY count(*) DESC, grp) AS rank
FROM bp WHERE yhat <> label GROUP BY run, grp, label""", "pred"))
def agg14_errors_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Wrong predictions per group split by true class, ranked within
    (run, class) by count (ties by group key)."""
    from pyspark.sql import Window
    bp = best_rows(pred_view(spark, sf))
    e = bp.where(F.col("yhat") != F.col("label")).groupBy("run", "grp", "label").agg(
        F.count(F.lit(1)).alias("n_wrong"))
    w = Window.partitionBy("run", "label").orderBy(F.col("n_wrong").desc(), "grp")
    return e.withColumn("rank", F.row_number().over(w))


@register("agg15_per_class_accuracy", with_views(f"""{BEST_ROWS}
SELECT run, fold,
  {r6('avg(CASE WHEN label = 0 THEN CASE WHEN yhat = 0 THEN 1.0 ELSE 0.0 END END)', 'acc_class0')},
  {r6('avg(CASE WHEN label = 1 THEN CASE WHEN yhat = 1 THEN 1.0 ELSE 0.0 END END)', 'acc_class1')},
  CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_class0,
  CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_class1
FROM bp GROUP BY run, fold""", "pred"))
def agg15_per_class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy within each true class per fold."""
    cm = _best_counts(spark, sf)
    return cm.select("run", "fold", M.specificity(None).alias("acc_class0"), M.recall(None).alias("acc_class1"),
                     (F.col("tn") + F.col("fp")).alias("n_class0"), (F.col("tp") + F.col("fn")).alias("n_class1"))


_FOLD_METRICS = ["accuracy", "balanced_accuracy", "mcc", "precision", "recall", "f1", "f1_macro", "f1_weighted"]

AUC_SQL = """sc AS (SELECT {keys}, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
    FROM {src} GROUP BY {keys}, score),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                  sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
    FROM sc),
auc AS (SELECT {keys}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
      sum(CAST(neg AS DOUBLE) * (CAST(tp - pos AS DOUBLE) + pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc,
    CASE WHEN sum(pos) > 0 THEN sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp)
        + CASE WHEN tp - pos + fp - neg > 0 THEN CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) ELSE 1.0 END) / 2.0) / sum(pos) END AS pr_auc,
    CASE WHEN sum(pos) > 0 THEN sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos) END AS average_precision
    FROM cum GROUP BY {keys})"""


@register("agg18_fold_metrics", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')}),
{AUC_SQL.format(keys='run, fold', src='bp')}
SELECT c.run, c.fold, c.n, {metric_cols_sql(_FOLD_METRICS)}, {r6('auc.auc', 'auc')},
  {r6('auc.average_precision', 'average_precision')}
FROM c JOIN auc ON c.run = auc.run AND c.fold = auc.fold""", "pred"))
def agg18_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metric table per fold at the best epoch: counts-based metrics, ROC-AUC
    and average precision."""
    bt = best_st(spark, sf)
    cm = M.with_metrics(M.confusion_from_table(bt, ("run", "fold")), _FOLD_METRICS)
    areas = C.curve_scores(bt, ("run", "fold")).select("run", "fold", "auc", "average_precision")
    return cm.join(areas, ["run", "fold"]).select(
        "run", "fold", "n", *_FOLD_METRICS, "auc", "average_precision")


@register("agg18_fold_metrics_long", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')})
SELECT run, fold, metric, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM (
  SELECT run, fold, {", ".join(f"{METRIC_SQL[m]} AS {m}" for m in ["accuracy", "balanced_accuracy", "mcc", "f1"])} FROM c)
UNPIVOT (value FOR metric IN (accuracy, balanced_accuracy, mcc, f1))""", "pred"))
def agg18_fold_metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    """The same metrics in long form (run, fold, metric, value)."""
    cm = M.with_metrics(_best_counts(spark, sf), ["accuracy", "balanced_accuracy", "mcc", "f1"])
    return cm.select("run", "fold", "accuracy", "balanced_accuracy", "mcc", "f1").unpivot(
        ["run", "fold"], ["accuracy", "balanced_accuracy", "mcc", "f1"], "metric", "value")


def fold_summary(spark: SparkSession, sf: str, pred: DataFrame | None = None) -> DataFrame:
    """Flagship: balanced accuracy, MCC and ROC-AUC per fold at each fold's
    best epoch, then mean and population std over folds per run."""
    pred = pred if pred is not None else pred_view(spark, sf)
    bt = M.best_table(M.score_table(pred, ("run", "fold", "epoch")))
    cm = M.with_metrics(M.confusion_from_table(bt, ("run", "fold")), ["balanced_accuracy", "mcc"])
    auc = C.roc_auc(bt, ("run", "fold")).select("run", "fold", "auc")
    per = cm.join(auc, ["run", "fold"])
    return per.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("balanced_accuracy").alias("balanced_accuracy_mean"),
        F.stddev_pop("balanced_accuracy").alias("balanced_accuracy_std"),
        F.avg("mcc").alias("mcc_mean"), F.stddev_pop("mcc").alias("mcc_std"),
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
        (F.stddev_samp("auc") / F.sqrt(F.count(F.lit(1)))).alias("auc_se"))


@register("agg16_fold_summary", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')}),
{AUC_SQL.format(keys='run, fold', src='bp')},
per AS (SELECT c.run, c.fold, {METRIC_SQL['balanced_accuracy']} AS ba, {METRIC_SQL['mcc']} AS mcc, auc.auc
        FROM c JOIN auc ON c.run = auc.run AND c.fold = auc.fold)
SELECT run, count(*) AS n_folds,
  {r6('avg(ba)', 'balanced_accuracy_mean')}, {r6('stddev_pop(ba)', 'balanced_accuracy_std')},
  {r6('avg(mcc)', 'mcc_mean')}, {r6('stddev_pop(mcc)', 'mcc_std')},
  {r6('avg(auc)', 'auc_mean')}, {r6('stddev_pop(auc)', 'auc_std')},
  {r6('stddev_samp(auc) / sqrt(count(*))', 'auc_se')}
FROM per GROUP BY run""", "pred"))
def agg16_fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fold_summary(spark, sf)


_POOLED = ["accuracy", "balanced_accuracy", "mcc", "precision", "recall", "f1", "fpr"]


@register("agg23_pooled_metrics", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run')}),
{AUC_SQL.format(keys='run', src='bp')}
SELECT c.run, c.n, {metric_cols_sql(_POOLED)}, {r6('auc.auc', 'auc')}, {r6('auc.pr_auc', 'pr_auc')},
  {r6('auc.average_precision', 'average_precision')}
FROM c JOIN auc ON c.run = auc.run""", "pred"))
def agg23_pooled_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All folds' best-epoch rows pooled into one sample per run."""
    bt = best_st(spark, sf)
    cm = M.with_metrics(M.confusion_from_table(bt, ("run",)), _POOLED)
    areas = C.curve_scores(bt, ("run",)).select("run", "auc", "pr_auc", "average_precision")
    return cm.join(areas, "run").select("run", "n", *_POOLED, "auc", "pr_auc", "average_precision")


@register("agg18_three_runs_fold_metrics", with_views(
    f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')})
SELECT run, fold, {metric_cols_sql(['accuracy', 'balanced_accuracy', 'mcc'])} FROM c""", ("pred", "pred3")))
def agg18_three_runs_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Fold metrics for three runs (the score table behind the k-model tests)."""
    bt = M.best_table(M.score_table(pred3_view(spark, sf)))
    return M.with_metrics(M.confusion_from_table(bt, ("run", "fold")), ["accuracy", "balanced_accuracy", "mcc"]).select(
        "run", "fold", "accuracy", "balanced_accuracy", "mcc")
