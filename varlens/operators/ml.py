"""Model stage (ML-*): gradient-boosted trees with the reference's settings and
the searches over them by ``boosting``, k-means with restarts and PCA on centred
data by Spark ML.  Scores are margins (log-odds)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.functions.exprs import materialize
from varlens.operators import boosting as B
from varlens.sources.io import write_archive

# Fixed values that must equal the reference's gradient-boosting settings.
GBT_PARAMS = dict(maxIter=200, stepSize=0.1, maxDepth=3, minInstancesPerNode=2, subsamplingRate=0.5, seed=123)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector column; a single vector column is used as it is, numeric
    columns are assembled with missing values kept (NaN) for the trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import VectorUDT
    cols = list(cols)
    if len(cols) == 1 and isinstance(df.schema[cols[0]].dataType, VectorUDT):
        return df.withColumn(out, F.col(cols[0]))
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def gbt_margin(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str = "label", **overrides) -> DataFrame:
    """Fit gradient-boosted trees on ``train`` and score ``test``: adds
    ``prediction`` (0 or 1) and ``score`` (margin of class 1) (ML-01).  ``cols``
    are numeric or one vector column; a missing or infinite value raises in
    ``train`` and is above all others in ``test``."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT
    if unknown := set(overrides) - set(GBT_PARAMS):
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    params = {**GBT_PARAMS, **overrides}
    if len(cols) == 1 and isinstance(train.schema[cols[0]].dataType, VectorUDT):
        one = train.select(F.size(vector_to_array(cols[0])).alias("n")).first()
        found = [F.get(vector_to_array(cols[0]), F.lit(i)) for i in range(one["n"] if one else 0)]
    else:
        found = [F.col(c).cast("double") for c in cols]
    names, infinity = [f"__f{i}" for i in range(len(found))], float("inf")
    bad = [x.isNull() | F.isnan(x) | (F.abs(x) == infinity) for x in found]
    wrong = F.raise_error(F.lit("a feature is missing or infinite")).cast("double")
    rows, edges, cells = _binned(train.withColumns({n: F.when(b, wrong).otherwise(x) for n, b, x in zip(names, bad, found)}), names, label, None, [0])
    setting = _boosted(params, [0])
    starts, forest = B.train(rows, [setting], params["maxIter"], len(names), params["seed"], cells)
    filled = test.withColumns({n: F.when(x.isNull() | F.isnan(x), infinity).otherwise(x) for n, x in zip(names, found)})
    scored = B.Boosted(names, edges, setting, float(starts[0]), forest[0]).score(filled)
    return scored.select(*[c for c in test.columns if c != "score"], (F.col("score") > 0).cast("double").alias("prediction"), "score")


def kmeans_best(df: DataFrame, cols: Sequence[str], k: int = 8, seed: int = 404, restarts: int = 10) -> DataFrame:
    """k-means, best of ``restarts`` seeds by training cost (ML-05)."""
    from pyspark.ml.clustering import KMeans
    data = assemble(df, cols).cache()
    best = None
    for r in range(restarts):
        m = KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol="cluster").fit(data)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    out = best[1].transform(data).drop("features")
    data.unpersist()
    return out


def pca_scores(df: DataFrame, cols: Sequence[str], k: int = 2) -> tuple[DataFrame, list[float], list[float]]:
    """PCA on mean-centred data (Spark's PCA does not centre) (ML-07):
    projection, explained-variance ratios and singular values.  A component's
    sign is such that its largest loading is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    a = assemble(df, cols, "raw")
    centred = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(a).transform(a)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(centred)
    loadings = model.pc.toArray()  # one row per input column
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    flip = F.array(*[F.lit(s) for s in signs])
    out = (model.transform(centred)
           .withColumn("pcs", F.zip_with(vector_to_array("pcs"), flip, lambda x, s: x * s)).drop("raw", "features"))
    ratio = list(model.explainedVariance.toArray())
    row = a.agg(Summarizer.variance(F.col("raw")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    squares = float(sum(row["v"])) * max(0, row["n"] - 1)
    return out, ratio, [(r * squares) ** 0.5 for r in ratio]


# Fixed values that must equal the reference's search grid.
GBT_GRID = dict(maxIter=(100, 200), stepSize=(0.05, 0.1), subsamplingRate=(0.5, 1.0), maxDepth=(1, 2, 3),
                minInstancesPerNode=(1, 2, 3))


def _settings(grid: dict) -> list[dict]:
    """All settings, in the order in which the first of equals is the best."""
    from itertools import product
    names = ["stepSize", "maxDepth", "minInstancesPerNode", "maxIter", "subsamplingRate"]
    return [dict(zip(names, v)) for v in product(*[grid[n] for n in names])]


def _boosted(setting: dict, parts) -> B.Model:
    return B.Model(setting["stepSize"], setting["subsamplingRate"], setting["maxDepth"], setting["minInstancesPerNode"], frozenset(parts))


def _binned(train: DataFrame, cols: Sequence[str], label: str, part: str | None, parts) -> tuple[DataFrame, list[list[float]], B.Grid | None]:
    """Binned rows for ``boosting``, the edges of the bins and, where they are
    few, the counts of all cells; the rows are then not binned one by one.
    ``train`` is evaluated once."""
    place = F.lit(0) if part is None else F.col(part).cast("int")
    own = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    stored = materialize(train.select(*own, F.col(label).cast("int").alias("label"), place.alias("part"), F.xxhash64(*train.columns).alias("id")))
    names = [f"c{i}" for i in range(len(cols))]
    edges = B.fit_bins(stored, names)
    cells = B.grid(stored, names, edges, "label", "part", parts)
    rows = stored.select(B.codes(names, edges).alias("codes"), "label", "part", "id")
    return rows if cells is not None else materialize(rows), edges, cells


def grid_search(train: DataFrame, cols: Sequence[str], label: str = "label", fold: str = "fold", folds: int = 3,
                grid: dict | None = None, refit: bool = True) -> tuple[B.Boosted | None, list[tuple[dict, float]]]:
    """Cross-validated search over boosting settings by the mean recall of class 1
    (ML-02).  ``fold`` holds 0 .. folds - 1 (see ``splits.stratified_kfold``).

    All settings and folds, and with ``refit`` the models on all rows, grow in
    the same passes over one stored table of binned rows; settings that differ
    in ``maxIter`` only are stages of one model.  Returns the refitted model of
    the best setting (the first of equals; None without ``refit``) and the
    table of (setting, recall)."""
    settings = _settings(grid or GBT_GRID)
    every = frozenset(range(folds))
    rows, edges, cells = _binned(train, cols, label, fold, every)
    most = max(s["maxIter"] for s in settings)
    held = [frozenset([f]) for f in range(folds)]
    models = list(dict.fromkeys(_boosted(s, every - h) for s in settings for h in held))
    whole = list(dict.fromkeys(_boosted(s, every) for s in settings)) if refit else []
    starts, forest = B.train(rows, models + whole, most, len(cols), GBT_PARAMS["seed"], cells)
    n = len(models)
    hits = B.staged_hits(rows, models, starts[:n], forest[:n], [every - m.parts for m in models], sorted({s["maxIter"] for s in settings}), len(cols), cells)
    recall = {(models[r["model"]], r["stage"]): r["hits"] / r["ones"] if r["ones"] else 0.0 for r in hits.collect()}
    table = [(s, sum(recall.get((_boosted(s, every - h), s["maxIter"]), 0.0) for h in held) / folds) for s in settings]
    if not refit:
        return None, table
    best = max(table, key=lambda t: t[1])[0]
    at = whole.index(_boosted(best, every))
    return B.Boosted(list(cols), edges, whole[at], float(starts[n + at]), forest[n + at][:best["maxIter"]]), table


def score_margin(model, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``test`` with ``score``, the margin of class 1, by a fitted model (ML-08
    for Spark ML models)."""
    from pyspark.ml.functions import vector_to_array
    return (model.transform(assemble(test, cols)).withColumn("score", F.get(vector_to_array("rawPrediction"), 1))
            .drop("features", "rawPrediction", "probability", "prediction"))


def tuned_holdout(train: DataFrame, test: DataFrame, cols: Sequence[str], id_col: str, label: str = "label",
                  seed: int = 42, **search) -> tuple[DataFrame, list]:
    """Missing values 0, scaled with the training statistics, four fifths of the
    training rows (stratified) searched, the hold-out scored (ML-03).  Returns
    the scored hold-out and the table of settings."""
    from varlens.operators import features as FE
    from varlens.operators import splits as SP
    train, test = train.na.fill(0, list(cols)), test.na.fill(0, list(cols))
    stats = FE.fit_standard(train, cols)
    train, test = FE.apply_standard(train, stats, cols, impute=False), FE.apply_standard(test, stats, cols, impute=False)
    fifth = SP.stratified_kfold(train, id_col, label, k=5, seed=seed, out="__fifth")
    searched = SP.stratified_kfold(materialize(fifth.where("__fifth <> 0")), id_col, label, k=search.get("folds", 3), seed=seed, out="fold")
    model, table = grid_search(searched, cols, label, "fold", **search)
    return model.score(test), table


def nested_cv(rows: DataFrame, cols: Sequence[str], outer: str = "for_outer", role: str = "role", label: str = "label",
              setting: dict | None = None) -> DataFrame:
    """Nested cross-validation (ML-04) over cross-fitted rows (DEN-09): for each
    outer fold the model learns from the rows with role ``inner`` and scores
    those with role ``outer_test``.  ``rows`` is evaluated once and stored with
    its bins (cut on all ``inner`` rows); the models of all outer folds grow in
    the same passes.  The archive rows carry ``fold`` and ``score``."""
    chosen = setting or GBT_PARAMS
    inner = F.col(role) == "inner"
    rows = materialize(rows)
    edges = B.fit_bins(rows.where(inner), cols)
    names = [r[0] for r in sorted(map(tuple, rows.select(outer).distinct().collect()))]  # one model each
    place = F.create_map(*[F.lit(x) for i, f in enumerate(names) for x in (f, i)])[F.col(outer)] if names else F.lit(0)
    kept = [c for c in rows.columns if c not in (outer, role)]
    stored = materialize(rows.select(*kept, B.codes(cols, edges).alias("codes"), F.xxhash64(*rows.columns).alias("__id"),
                                     F.when(inner, place).alias("__part"), F.when(F.col(role) == "outer_test", place).alias("__test")))
    models = [_boosted(chosen, [i]) for i in range(len(names))]
    learn = stored.where("__part IS NOT NULL").select("codes", F.col(label).alias("label"), F.col("__part").alias("part"), F.col("__id").alias("id"))
    starts, forest = B.train(learn, models, chosen["maxIter"], len(cols), GBT_PARAMS["seed"]) if names else ([], [])
    fold = F.array(*[F.lit(f) for f in names])[F.col("__test")] if names else F.lit(None)
    scored = B.margins(models, starts, forest)(F.col("codes"), F.col("__test"))
    return stored.where("__test IS NOT NULL").select(*kept, fold.alias("fold"), scored.alias("score"))


#: Rows that meet all others in one pass over the data.
SILHOUETTE_ROWS = 16384
#: Rows of the data that meet as many of them at once: a tile of distances, of 2 MB, stays
#: near the processor; Arrow's batches grow with the table up to 10,000.
SILHOUETTE_BATCH = 512
#: Fits of k-means that run at once.
KMEANS_FITS = 8


def silhouettes(rows: DataFrame, counts: Sequence[int]) -> list[float | None]:
    """Mean Euclidean silhouette of several clusterings of the same rows:
    ``rows`` holds ``vector`` (array) and ``labels`` (one cluster a clustering,
    from 0), ``counts`` the number of clusters of each.  Null where a clustering
    has one cluster or as many as rows.

    All distances are computed, in blocks: groups of at most ``SILHOUETTE_ROWS``
    rows go to the tasks one after the other, and only sums of distances per
    (row, cluster) come out of a task; no pair does."""
    import numpy as np
    import pyarrow as pa
    spread = rows.select(F.col("vector").cast("array<double>").alias("vector"), "labels").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    rows = materialize(spread.select(F.monotonically_increasing_id().alias("row"), "vector", "labels"))
    total = rows.count()
    starts = np.concatenate([[0], np.cumsum(counts)])

    def passed(own_rows, own):
        left = np.concatenate([own, (own ** 2).sum(1)[:, None], np.ones((len(own), 1))], 1)

        def run(batches):
            sums = np.zeros((len(own), starts[-1]))
            for b in (whole.slice(at, SILHOUETTE_BATCH) for whole in batches for at in range(0, whole.num_rows, SILHOUETTE_BATCH)):
                other = b["vector"].flatten().to_numpy().reshape(b.num_rows, -1)
                labels = b["labels"].flatten().to_numpy().reshape(b.num_rows, -1)
                right = np.concatenate([-2 * other.T, np.ones((1, b.num_rows)), (other ** 2).sum(1)[None]])
                member = np.zeros((b.num_rows, starts[-1]))
                for c in range(len(counts)):
                    member[np.arange(b.num_rows), starts[c] + labels[:, c]] = 1
                place = np.searchsorted(own_rows, b["row"].to_numpy())  # own rows ascend
                itself = np.flatnonzero(own_rows[np.minimum(place, len(own) - 1)] == b["row"].to_numpy())
                for first in range(0, len(own), SILHOUETTE_BATCH):
                    far = left[first:first + SILHOUETTE_BATCH] @ right
                    np.maximum(far, 0, out=far)
                    np.sqrt(far, out=far)
                    here = itself[(place[itself] >= first) & (place[itself] < first + SILHOUETTE_BATCH)]
                    far[place[here] - first, here] = 0
                    sums[first:first + SILHOUETTE_BATCH] += far @ member
            yield pa.RecordBatch.from_arrays([pa.array(own_rows), pa.array(list(sums), pa.list_(pa.float64()))], ["row", "sums"])
        return run

    parts, held = [], []
    for r in rows.select("row", "vector").toLocalIterator():
        held.append(r)
        if len(held) == SILHOUETTE_ROWS:
            parts.append(held)
            held = []
            parts[-1] = materialize(rows.mapInArrow(passed(np.array([x["row"] for x in parts[-1]]), np.array([x["vector"] for x in parts[-1]])), "row long, sums array<double>"))
    if held:
        parts.append(materialize(rows.mapInArrow(passed(np.array([x["row"] for x in held]), np.array([x["vector"] for x in held])), "row long, sums array<double>")))
    if not parts:
        return [None] * len(counts)
    far = parts[0]
    for p in parts[1:]:
        far = far.unionAll(p)
    added = far.groupBy("row").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"x{i}") for i in range(starts[-1])])
    added = added.select("row", F.array(*[F.col(f"x{i}") for i in range(starts[-1])]).alias("sums"))
    sizes = rows.select(F.posexplode("labels").alias("c", "label")).groupBy("c", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # clusters
    size = np.zeros(starts[-1])
    for r in sizes:
        size[starts[r["c"]] + r["label"]] = r["n"]
    sized = F.array(*[F.lit(float(x)) for x in size])
    means = []
    for c, k in enumerate(counts):
        own = F.get("labels", c) + int(starts[c])
        n = F.get(sized, own)
        inside = F.get("sums", own) / (n - 1)
        others = F.filter(F.sequence(F.lit(int(starts[c])), F.lit(int(starts[c + 1]) - 1)), lambda i: (i != own) & (F.get(sized, i) > 0))
        outside = F.array_min(F.transform(others, lambda i: F.get("sums", i) / F.get(sized, i)))
        most = F.greatest(inside, outside)
        means.append(F.avg(F.when((n > 1) & (most > 0), (outside - inside) / most).otherwise(0.0)).alias(f"s{c}"))
    found = added.join(rows, "row").agg(*means).first()
    used = [int((size[starts[c]:starts[c + 1]] > 0).sum()) for c in range(len(counts))]
    return [found[c] if 1 < used[c] < total else None for c in range(len(counts))]


def choice_of_k(df: DataFrame, cols: Sequence[str], k_max: int, seed: int = 42, restarts: int = 10) -> list[tuple[int, float, float | None]]:
    """(k, within-cluster sum of squares, mean Euclidean silhouette) for k = 1 ..
    k_max (ML-06), best of ``restarts`` fits by cost; k = 1 has no silhouette.
    All clusterings share one pass over the distances."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    data = materialize(assemble(df, cols).select("features"))  # not cached: a fit keeps its vectors itself, and doesn't decode them in each step
    row = data.agg(Summarizer.variance(F.col("features")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    costs = [float(sum(row["v"])) * max(0, row["n"] - 1)]
    labelled, ks = data, list(range(2, k_max + 1))

    def fitted(setting):
        k, r = setting
        model = KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol=f"c{k}").fit(data)
        return model.summary.trainingCost, model

    with ThreadPool(KMEANS_FITS) as pool:  # a fit is many short jobs
        fits = pool.map(inheritable_thread_target(df.sparkSession)(fitted), [(k, r) for k in ks for r in range(restarts)], 1)
    for i in range(len(ks)):
        cost, best = min(fits[i * restarts:(i + 1) * restarts], key=lambda f: f[0])
        costs.append(cost)
        labelled = best.transform(labelled)
    found = silhouettes(labelled.select(vector_to_array("features").alias("vector"), F.array(*[F.col(f"c{k}") for k in ks]).alias("labels")), ks) if ks else []
    return list(zip([1, *ks], costs, [None, *found]))


def score_to_archive(model_path: str, rows: DataFrame, cols: Sequence[str], path: str, run: str, fold: int, epoch: int,
                     keep: Sequence[str]) -> None:
    """Loads a saved Spark ML model and writes its margins of ``rows`` into the
    prediction archive under ``path`` (ML-08), tagged with run, fold and epoch.
    Only that partition is replaced, so a repeated run leaves the archive as it
    was.  ``keep`` names the columns that go along."""
    from pyspark.ml.util import DefaultParamsReader
    model = DefaultParamsReader.loadParamsInstance(model_path, rows.sparkSession)
    scored = score_margin(model, rows, cols).select(*keep, F.lit("eval").alias("mode"), F.col("score").alias("pred"),
                                                    F.lit(run).alias("run"), F.lit(fold).alias("fold"), F.lit(epoch).alias("epoch"))
    write_archive(scored, path, ("run", "fold", "epoch"))
