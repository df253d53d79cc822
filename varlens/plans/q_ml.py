"""Registered queries: model stage (ML-*).  Approximate by nature (random
restarts, tree sampling): checked on row counts and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.operators import curves as C
from varlens.operators import metrics as M
from varlens.operators import ml as ML
from varlens.plans.catalog import register
from varlens.sources.tables import table

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("ml01_gbt_holdout")
def ml01_gbt_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient-boosted trees (reference settings) predicting the R return
    flag from the numeric line columns; hold-out = orders with key % 5 = 0;
    ROC-AUC of the margin and balanced accuracy at margin > 0."""
    li = table(spark, sf, "lineitem").select("l_orderkey", *_COLS,
                                             (F.col("l_returnflag") == "R").cast("int").alias("label"))
    train, test = li.where(F.col("l_orderkey") % 5 != 0), li.where(F.col("l_orderkey") % 5 == 0)
    scored = ML.gbt_margin(train, test, _COLS).withColumn("run", F.lit("gbt"))
    st = M.score_table(scored, ("run",))
    auc = C.roc_auc(st, ["run"])
    cm = M.with_metrics(M.confusion_from_table(st, ["run"], cut=0.0), ["balanced_accuracy", "mcc"])
    return auc.join(cm.select("run", "balanced_accuracy", "mcc"), "run")


@register("ml05_kmeans")
def ml05_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """k-means (k = 8, seed 404, 10 restarts) on the embedding vectors; cluster sizes."""
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    out = ML.kmeans_best(e, ["v"], 8, 404, 10)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("ml07_pca")
def ml07_pca(spark: SparkSession, sf: str) -> DataFrame:
    """Two principal components of the centred embeddings: explained variance
    ratios and the projection's mean (0 after centring)."""
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    out, ratio, singular = ML.pca_scores(e, ["v"], 2)
    means = out.agg(F.avg(F.get("pcs", 0)).alias("pc1_mean"), F.avg(F.get("pcs", 1)).alias("pc2_mean"))
    return means.select(F.lit(ratio[0]).alias("ratio1"), F.lit(ratio[1]).alias("ratio2"), F.lit(singular[0]).alias("singular1"),
                        F.lit(singular[1]).alias("singular2"), "pc1_mean", "pc2_mean")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), *_COLS,
                                               (F.col("l_returnflag") == "R").cast("int").alias("label"))


@register("ml02_grid_search")
def ml02_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of class 1 of each setting over 3 stratified folds."""
    from varlens.operators import splits as SP
    rows = SP.stratified_kfold(_lines(spark, sf), "id", "label", k=3, out="fold")
    _, found = ML.grid_search(rows, _COLS, refit=False)
    return spark.createDataFrame([(m["maxDepth"], m["maxIter"], m["stepSize"], m["subsamplingRate"], m["minInstancesPerNode"], float(r)) for m, r in found],
                                 "max_depth int, max_iter int, step_size double, subsampling_rate double, min_instances int, recall double")


@register("ml03_tuned_holdout")
def ml03_tuned_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Imputed, scaled and searched on the orders with key % 5 <> 0; AUC,
    balanced accuracy and MCC on the others."""
    li = _lines(spark, sf)
    scored, _ = ML.tuned_holdout(li.where("l_orderkey % 5 <> 0"), li.where("l_orderkey % 5 = 0"), _COLS, "id")
    st = M.score_table(scored.withColumn("run", F.lit("tuned")), ("run",))
    cm = M.with_metrics(M.confusion_from_table(st, ["run"], cut=0.0), ["balanced_accuracy", "mcc"])
    return C.roc_auc(st, ["run"]).join(cm.select("run", "balanced_accuracy", "mcc"), "run")


@register("ml04_nested_cv")
def ml04_nested_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Archive rows of a nested cross-validation: 4 outer folds by gene, the
    standardised cross-fitted densities as features; rows and AUC per fold."""
    from varlens.plans.q_density import _DCOLS, den09_standardised
    rows = den09_standardised(spark, sf).withColumnRenamed("cls", "label")
    scored = ML.nested_cv(rows, _DCOLS).withColumn("run", F.lit("nested"))
    st = M.score_table(scored, ("run", "fold"))
    n = scored.groupBy("run", "fold").agg(F.count(F.lit(1)).alias("n"))
    return C.roc_auc(st, ["run", "fold"]).join(n, ["run", "fold"])


@register("ml06_choice_of_k")
def ml06_choice_of_k(spark: SparkSession, sf: str) -> DataFrame:
    """Cost and Euclidean silhouette of k = 1 .. 9 (below the number of rows) on the
    embeddings, 10 restarts."""
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf, "embeddings").select(array_to_vector("embedding").alias("v"))
    return spark.createDataFrame(ML.choice_of_k(e, ["v"], min(10, e.count()) - 1), "k int, cost double, silhouette double")


@register("ml08_archive_scoring")
def ml08_archive_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Models saved per fold and epoch (logistic regression after 1 and 5
    iterations), loaded and scored into the partitioned archive with their tags;
    rows and AUC of every partition as read from the archive."""
    from pyspark.ml.classification import LogisticRegression
    from varlens.functions.exprs import materialize
    from varlens.sources.io import scratch_dir
    li = materialize(_lines(spark, sf).withColumn("fold", (F.col("l_orderkey") % 3).cast("int")))
    models, archive = scratch_dir(spark, "models"), scratch_dir(spark, "archive")
    for fold in range(3):
        train = ML.assemble(li.where(F.col("fold") != fold), _COLS)
        for epoch, steps in enumerate((1, 5)):
            path = f"{models}/{fold}-{epoch}"
            LogisticRegression(maxIter=steps, featuresCol="features", labelCol="label").fit(train).save(path)
            ML.score_to_archive(path, li.where(F.col("fold") == fold).drop("fold"), _COLS, archive, "lr", fold, epoch, ["id", "label"])
    scored = spark.read.parquet(archive).withColumn("score", F.col("pred"))
    n = scored.groupBy("run", "fold", "epoch").agg(F.count(F.lit(1)).alias("n"))
    return C.roc_auc(M.score_table(scored, ("run", "fold", "epoch")), ["run", "fold", "epoch"]).join(n, ["run", "fold", "epoch"])
