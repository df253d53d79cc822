"""Registered queries: statistics over score tables and groups (STA-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.functions.prefix import avg_rank
from varlens.operators import metrics as M
from varlens.operators import pvalues as P
from varlens.operators import stats as S
from varlens.plans.catalog import r6, register
from varlens.plans.q_archive import BEST_ROWS, METRIC_SQL, best_rows, best_st, counts_sql
from varlens.plans.views import pred3_view, pred_view, variants_view, with_views
from varlens.sources.tables import table

RHO = 1.0 / (10 - 1)


def fold_scores(spark, sf, three=False) -> DataFrame:
    """(run, fold, value): accuracy per fold at the best epoch."""
    pred = pred3_view(spark, sf) if three else pred_view(spark, sf)
    bt = M.best_table(M.score_table(pred))
    cm = M.with_metrics(M.confusion_from_table(bt, ("run", "fold")), ["accuracy"])
    return cm.select("run", "fold", F.col("accuracy").alias("value"))


def _scores_sql(three=False) -> tuple[str, tuple]:
    body = f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')}),
s AS (SELECT run, fold, {METRIC_SQL['accuracy']} AS value FROM c)"""
    return body, (("pred", "pred3"),) if three else ("pred",)


S2, V2 = _scores_sql(False)
S3, V3 = _scores_sql(True)
D_SQL = "dd AS (SELECT a.fold, a.value - b.value AS d FROM s a JOIN s b ON a.fold = b.fold AND a.run = 'F' AND b.run = 'O')"


@register("sta01_avg_ranks", with_views(f"""{BEST_ROWS},
v AS (SELECT run, fold, score, count(*) AS n FROM bp GROUP BY ALL)
SELECT run, fold, score, n, CAST(coalesce(sum(n) OVER (PARTITION BY run, fold ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
  {r6('coalesce(sum(n) OVER (PARTITION BY run, fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0', 'rank')}
FROM v""", "pred"))
def sta01_avg_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Average ranks with ties of the scores within each fold at the best epoch."""
    bt = best_st(spark, sf).withColumn("w", F.col("pos") + F.col("neg"))
    return avg_rank(bt, ["run", "fold"], "score", weight="w").select("run", "fold", "score", "n", "below", "rank")


@register("sta02_paired_t", with_views(f"""{S2}, {D_SQL}
SELECT count(d) AS n, {r6('avg(d)', 'mean_d')}, {r6('stddev_samp(d)', 'sd_d')},
  {r6('avg(d) / (stddev_samp(d) / sqrt(count(d)))', 't')}, count(d) - 1 AS df, {r6('avg(d) / stddev_samp(d)', 'cohen_d')},
  {r6(f"avg(d) / sqrt(var_samp(d) * (1.0 / count(d) + {RHO!r}))", 't_corrected')} FROM dd""", *V2))
def sta02_paired_t(spark: SparkSession, sf: str) -> DataFrame:
    """Paired t, corrected resampled t (STA-03) and effect size (STA-10) of
    the per-fold accuracy difference between the two runs."""
    return S.paired_t(S.paired_diffs(fold_scores(spark, sf), "F", "O"), rho=RHO)


@register("sta04_wilcoxon", with_views(f"""{S2}, {D_SQL},
nz AS (SELECT d, abs(d) AS a FROM dd WHERE d <> 0),
rk AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM nz),
t AS (SELECT sum(c * c * c - c) AS tt FROM (SELECT count(*) AS c FROM nz GROUP BY a))
SELECT count(*) AS n, {r6('coalesce(sum(r) FILTER (WHERE d > 0), 0.0)', 'w_plus')},
  {r6('coalesce(sum(r) FILTER (WHERE d < 0), 0.0)', 'w_minus')},
  {r6('least(coalesce(sum(r) FILTER (WHERE d > 0), 0.0), coalesce(sum(r) FILTER (WHERE d < 0), 0.0))', 'statistic')},
  CAST(coalesce((SELECT tt FROM t), 0) AS BIGINT) AS tie_term FROM rk""", *V2))
def sta04_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    """Wilcoxon signed-rank statistics of the per-fold differences."""
    return S.wilcoxon(S.paired_diffs(fold_scores(spark, sf), "F", "O"))


@register("sta05_rank_sum", with_views(f"""{BEST_ROWS},
v AS (SELECT run, score, count(*) AS n, sum(label) AS n1v FROM bp GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
     + (n + 1) / 2.0 AS rank FROM v)
SELECT run, CAST(sum(n1v) AS BIGINT) AS n1, CAST(sum(n) - sum(n1v) AS BIGINT) AS n2,
  {r6('sum(n1v * rank) - sum(n1v) * (sum(n1v) + 1) / 2.0', 'u1')} FROM r GROUP BY run""", "pred"))
def sta05_rank_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Mann-Whitney U of the scores of class 1 against class 0, per run."""
    bp = best_rows(pred_view(spark, sf))
    return S.mann_whitney(bp, ["run"], "label", "score")


@register("sta05_ks_two_sample", with_views(f"""{BEST_ROWS},
v AS (SELECT run, score, sum(label) AS c1, sum(1 - label) AS c0 FROM bp GROUP BY ALL),
c AS (SELECT run, sum(c1) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k1,
             sum(c0) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k0,
             sum(c1) OVER (PARTITION BY run) AS n1, sum(c0) OVER (PARTITION BY run) AS n0 FROM v)
SELECT run, {r6('max(abs(CAST(k1 AS DOUBLE) / n1 - CAST(k0 AS DOUBLE) / n0))', 'ks_d')},
  CAST(max(n1) AS BIGINT) AS n1, CAST(max(n0) AS BIGINT) AS n0 FROM c GROUP BY run""", "pred"))
def sta05_ks_two_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sample KS statistic between the score distributions of the classes."""
    bp = best_rows(pred_view(spark, sf))
    return S.ks_2samp(bp, ["run"], "label", "score")


_FR = """rk AS (SELECT fold, run, value, rank() OVER (PARTITION BY fold ORDER BY value)
    + (count(*) OVER (PARTITION BY fold, value) - 1) / 2.0 AS r FROM s)"""


@register("sta06_friedman", with_views(f"""{S3}, {_FR},
t AS (SELECT sum(c * c * c - c) AS tt FROM (SELECT count(*) AS c FROM s GROUP BY fold, value)),
kn AS (SELECT count(DISTINCT run) AS k, count(DISTINCT fold) AS n FROM s),
sr AS (SELECT sum(R * R) AS sr2 FROM (SELECT run, sum(r) AS R FROM rk GROUP BY run))
SELECT k, n, {r6('(12.0 / (n * k * (k + 1)) * sr2 - 3.0 * n * (k + 1)) / (1.0 - tt / (n * k * (k * k - 1)))', 'chi2')},
  k - 1 AS df FROM kn, sr, t""", *V3))
def sta06_friedman(spark: SparkSession, sf: str) -> DataFrame:
    """Friedman test over three runs' fold accuracies (tie-corrected)."""
    return S.friedman(fold_scores(spark, sf, True))


@register("sta07_nemenyi", with_views(f"""{S3}, {_FR},
mr AS (SELECT run, avg(r) AS mean_rank, count(*) AS n FROM rk GROUP BY run),
kk AS (SELECT count(*) AS k FROM mr)
SELECT a.run AS run_a, b.run AS run_b, k,
  {r6('abs(a.mean_rank - b.mean_rank) / sqrt(k * (k + 1) / (6.0 * a.n)) * sqrt(2.0)', 'q')}
FROM mr a JOIN mr b ON a.run < b.run, kk""", *V3))
def sta07_nemenyi(spark: SparkSession, sf: str) -> DataFrame:
    """Nemenyi pairwise statistics between runs."""
    return S.nemenyi(fold_scores(spark, sf, True))


@register("sta08_rm_anova", with_views(f"""{S3},
g AS (SELECT avg(value) AS gm, count(DISTINCT run) AS k, count(DISTINCT fold) AS n, sum(value * value) AS ss,
      count(*) AS NN FROM s),
a AS (SELECT sum((m - gm) * (m - gm)) AS a FROM (SELECT avg(value) AS m FROM s GROUP BY run), g),
b AS (SELECT sum((m - gm) * (m - gm)) AS b FROM (SELECT avg(value) AS m FROM s GROUP BY fold), g),
x AS (SELECT n * a AS ssm, ss - NN * gm * gm - n * a - k * b AS sse, k - 1 AS df1, (k - 1) * (n - 1) AS df2 FROM g, a, b)
SELECT {r6('ssm', 'ss_model')}, {r6('sse', 'ss_error')}, df1, df2, {r6('(ssm / df1) / (sse / df2)', 'f')} FROM x""", *V3))
def sta08_rm_anova(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated-measures ANOVA, runs within folds."""
    return S.rm_anova(fold_scores(spark, sf, True))


@register("sta09_adjust_pvalues", f"""WITH p AS (SELECT s_suppkey AS id,
    CAST((s_suppkey * 37) % 1000 + 1 AS DOUBLE) / 1001.0 AS p FROM supplier),
r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM p)
SELECT id, {r6('p', 'p')},
  {r6('max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'p_holm')},
  {r6('min(least(1.0, m * p / i)) OVER (ORDER BY p DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'p_bh')}
FROM r""")
def sta09_adjust_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    """Holm and Benjamini-Hochberg adjustment of one p-value per supplier."""
    s = table(spark, sf, "supplier")
    p = s.select(F.col("s_suppkey").alias("id"),
                 (((F.col("s_suppkey") * 37) % 1000 + 1).cast("double") / 1001.0).alias("p"))
    return S.adjust_pvalues(p, [], "p", "id").select("id", "p", "p_holm", "p_bh")


@register("sta12_kruskal", with_views(f"""WITH v AS (SELECT ptype, position FROM variants),
c AS (SELECT position, count(*) AS n FROM v GROUP BY position),
r AS (SELECT position, coalesce(sum(n) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + (n + 1) / 2.0 AS rank FROM c),
g AS (SELECT ptype, sum(r.rank) AS R, count(*) AS ng FROM v JOIN r ON v.position = r.position GROUP BY ptype),
x AS (SELECT sum(R * R / ng) AS s, count(*) AS gg FROM g),
t AS (SELECT sum(n * n * n - n) AS tt, sum(n) AS NN FROM c)
SELECT NN AS n_total, gg AS g, {r6('(12.0 / (NN * (NN + 1)) * s - 3.0 * (NN + 1)) / (1.0 - tt / (NN * NN * NN - NN))', 'h')},
  gg - 1 AS df FROM x, t""".replace('NN AS n_total', 'CAST(NN AS BIGINT) AS n_total'), "variants"))
def sta12_kruskal(spark: SparkSession, sf: str) -> DataFrame:
    """Kruskal-Wallis H of sizes across part types (many ties)."""
    return S.kruskal(variants_view(spark, sf), "ptype", "position")


_WORDS = "w AS (SELECT DISTINCT gene, unnest(string_split(name, ' ')) || '|' || CAST(position AS VARCHAR) AS term FROM variants)"
_JAC = f"""{_WORDS}, sz AS (SELECT gene, count(*) AS size FROM w GROUP BY gene),
jp AS (SELECT a.gene AS item_a, b.gene AS item_b, count(*) AS inter FROM w a JOIN w b ON a.term = b.term AND a.gene < b.gene
       GROUP BY a.gene, b.gene),
jac AS (SELECT jp.*, CAST(inter AS DOUBLE) / (sa.size + sb.size - inter) AS jaccard FROM jp
        JOIN sz sa ON jp.item_a = sa.gene JOIN sz sb ON jp.item_b = sb.gene)"""


def _words(v: DataFrame) -> DataFrame:
    """A gene's terms: each word of its names with the position it stands at."""
    word = F.explode(F.split("name", " ")).alias("word")
    return v.select("gene", "position", word).select("gene", F.concat_ws("|", "word", F.col("position").cast("string")).alias("term"))


@register("sta13_jaccard_pairs", with_views(f"""WITH {_JAC}
SELECT item_a, item_b, inter, {r6('jaccard', 'jaccard')} FROM jac""", "variants"))
def sta13_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Jaccard similarity of genes' word sets, pairs that share a word."""
    return S.jaccard_pairs(_words(variants_view(spark, sf)), "gene", "term")


_POL = """pol AS (SELECT gene, avg(CASE WHEN label_txt = 'gof' THEN 1.0 ELSE 0.0 END) AS a FROM variants GROUP BY gene)"""


@register("sta14_mantel", with_views(f"""WITH {_JAC}, {_POL},
pairs AS (SELECT x.gene AS ga, y.gene AS gb, 1.0 - coalesce(j.jaccard, 0.0) AS dx, abs(x.a - y.a) AS dy
  FROM pol x JOIN pol y ON x.gene < y.gene LEFT JOIN jac j ON j.item_a = x.gene AND j.item_b = y.gene)
SELECT count(*) AS n_pairs, {r6('corr(dx, dy)', 'r')} FROM pairs""", "variants"))
def sta14_mantel(spark: SparkSession, sf: str) -> DataFrame:
    """Mantel correlation between the genes' word-set distance (1 - Jaccard)
    and their polarity distance, over all gene pairs, computed without
    emitting the pairs (sums over the sparse sharing pairs + rank sums)."""
    v = variants_view(spark, sf)
    words = _words(v)
    pol = v.groupBy("gene").agg(F.avg(F.when(F.col("label_txt") == "gof", 1.0).otherwise(0.0)).alias("a"))
    return S.mantel_sparse(S.jaccard_pairs(words, "gene", "term"), pol, "gene", "a")


@register("sta14_mantel_permutation")
def sta14_mantel_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Mantel r with a p-value from 999 seeded relabellings of the genes."""
    v = variants_view(spark, sf)
    words = _words(v)
    return S.mantel_permutation(S.jaccard_pairs(words, "gene", "term"), _polarity(v), "gene", "a", 999)


_TFIDF = f"""{_WORDS}, nd AS (SELECT count(DISTINCT gene) AS n FROM w),
df AS (SELECT term, count(*) AS d FROM w GROUP BY term),
t0 AS (SELECT w.gene, w.term, ln((1.0 + n) / (1.0 + d)) + 1.0 AS x FROM w JOIN df ON w.term = df.term, nd),
tv AS (SELECT gene, term, x / sqrt(sum(x * x) OVER (PARTITION BY gene)) AS v FROM t0),
cosines AS (SELECT a.gene AS item_a, b.gene AS item_b, sum(a.v * b.v) AS cosine FROM tv a JOIN tv b ON a.term = b.term AND a.gene < b.gene GROUP BY a.gene, b.gene)"""


def _polarity(v: DataFrame) -> DataFrame:
    return v.groupBy("gene").agg(F.avg(F.when(F.col("label_txt") == "gof", 1.0).otherwise(0.0)).alias("a"))


def _tfidf(v: DataFrame) -> DataFrame:
    from varlens.operators.features import tfidf_long
    return tfidf_long(_words(v).distinct().withColumn("value", F.lit(1.0)), "gene")


@register("sta13_weighted_pairs", with_views(f"""WITH {_TFIDF}, {_POL}
SELECT item_a, item_b, {r6('cosine', 'cosine')}, {r6('1 - cosine', 'cosine_distance')}, {r6('abs(x.a - y.a)', 'scalar_distance')}
FROM cosines JOIN pol x ON x.gene = item_a JOIN pol y ON y.gene = item_b""", "variants"))
def sta13_weighted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine distance of the genes' TF-IDF vectors and distance of their
    polarities, for pairs that share a term."""
    v = variants_view(spark, sf)
    return S.weighted_pairs(_tfidf(v), _polarity(v), "gene", "term", "tfidf", "a")


@register("sta14_mantel_tfidf", with_views(f"""WITH {_TFIDF}, {_POL},
pairs AS (SELECT 1.0 - coalesce(c.cosine, 0.0) AS dx, abs(x.a - y.a) AS dy
  FROM pol x JOIN pol y ON x.gene < y.gene LEFT JOIN cosines c ON c.item_a = x.gene AND c.item_b = y.gene)
SELECT count(*) AS n_pairs, {r6('corr(dx, dy)', 'r')} FROM pairs""", "variants"))
def sta14_mantel_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """Mantel correlation of the cosine distances of TF-IDF weighted terms with
    the polarity distances, over all gene pairs, no pair formed."""
    v = variants_view(spark, sf)
    return S.mantel_cosine(_tfidf(v), _polarity(v), "gene", "term", "tfidf", "a")


@register("sta14_mantel_tfidf_permutation")
def sta14_mantel_tfidf_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """The TF-IDF Mantel r with a p-value from 999 seeded relabellings."""
    from varlens.functions.exprs import materialize
    v = variants_view(spark, sf)
    weights, pol = materialize(_tfidf(v)), materialize(_polarity(v))
    pairs = S.weighted_pairs(weights, pol, "gene", "term", "tfidf", "a")
    return S.mantel_permutation(pairs, pol, "gene", "a", 999, similarity="cosine", observed=S.mantel_cosine(weights, pol, "gene", "term", "tfidf", "a"))


_GRP = f"""{BEST_ROWS}, g AS (SELECT grp, count(*) AS n, avg(CASE WHEN yhat = label THEN 1.0 ELSE 0.0 END) AS acc,
    avg(CAST(label AS DOUBLE)) AS ratio FROM bp GROUP BY grp)"""


def _grp(spark, sf):
    bp = best_rows(pred_view(spark, sf))
    return bp.groupBy("grp").agg(F.count(F.lit(1)).alias("n"),
                                 F.avg(F.when(F.col("yhat") == F.col("label"), 1.0).otherwise(0.0)).alias("acc"),
                                 F.avg(F.col("label").cast("double")).alias("ratio"))


@register("sta15_linear_fit", with_views(f"""{_GRP}
SELECT {r6('regr_slope(acc, ratio)', 'slope')}, {r6('regr_intercept(acc, ratio)', 'intercept')}, count(*) AS n FROM g""",
    "pred"))
def sta15_linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Least-squares line of group accuracy against class ratio."""
    g = _grp(spark, sf)
    return g.agg(F.regr_slope("acc", "ratio").alias("slope"), F.regr_intercept("acc", "ratio").alias("intercept"),
                 F.count(F.lit(1)).alias("n"))


@register("sta17_score_vs_size", with_views(f"""{_GRP}
SELECT grp, n, {r6('acc', 'accuracy')}, n < 90 AS small,
  {r6('avg(acc) FILTER (WHERE n < 90) OVER ()', 'mean_small')} FROM g""", "pred"))
def sta17_score_vs_size(spark: SparkSession, sf: str) -> DataFrame:
    """Group size against accuracy, with the mean accuracy of small groups."""
    g = _grp(spark, sf)
    m = g.where(F.col("n") < 90).agg(F.avg("acc").alias("mean_small"))
    return g.crossJoin(m).select("grp", "n", F.col("acc").alias("accuracy"), (F.col("n") < 90).alias("small"),
                                 "mean_small")


@register("sta18_polarity_vs_accuracy", with_views(f"""{_GRP}
SELECT {r6('corr(ratio, acc)', 'corr')}, count(*) AS n FROM g""", "pred"))
def sta18_polarity_vs_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson correlation of group polarity and group accuracy."""
    return _grp(spark, sf).agg(F.corr("ratio", "acc").alias("corr"), F.count(F.lit(1)).alias("n"))


_U = "CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|' || CAST(r AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@register("sta11_observed_vs_random", with_views(f"""{BEST_ROWS},
obs AS (SELECT run, avg(CASE WHEN yhat = label THEN 1.0 ELSE 0.0 END) AS acc FROM bp GROUP BY run),
rnd AS (SELECT run, r, avg(CASE WHEN (CASE WHEN {_U} > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END) AS acc
        FROM bp, range(20) t(r) GROUP BY run, r)
SELECT o.run, {r6('o.acc', 'observed')}, {r6('avg(x.acc)', 'random_mean')}, {r6('stddev_pop(x.acc)', 'random_std')},
  {r6('(o.acc - avg(x.acc)) / stddev_pop(x.acc)', 'z')} FROM obs o JOIN rnd x ON o.run = x.run GROUP BY o.run, o.acc""",
    "pred"))
def sta11_observed_vs_random(spark: SparkSession, sf: str) -> DataFrame:
    """Observed accuracy against 20 seeded uniform-random predictors: mean,
    population std and z-score, per run."""
    bp = best_rows(pred_view(spark, sf))
    draws = spark.range(20).select(F.col("id").alias("r"))
    u = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("|"), F.col("r").cast("string"))), 1, 8),
               16, 10).cast("long") / 4294967296.0
    hit = F.when(F.when(u > 0.5, 1).otherwise(0) == F.col("label"), 1.0).otherwise(0.0)
    rnd = bp.crossJoin(draws).groupBy("run", "r").agg(F.avg(hit).alias("acc"))  # rows x 20 draws
    obs = bp.groupBy("run").agg(F.avg(F.when(F.col("yhat") == F.col("label"), 1.0).otherwise(0.0)).alias("observed"))
    st = rnd.groupBy("run").agg(F.avg("acc").alias("random_mean"), F.stddev_pop("acc").alias("random_std"))
    return obs.join(st, "run").withColumn("z", (F.col("observed") - F.col("random_mean")) / F.col("random_std"))


@register("sta16_feature_audit", with_views(f"""{BEST_ROWS},
rows AS (SELECT bp.id, bp.pkey, CASE WHEN yhat = label THEN 1 ELSE 0 END AS correct FROM bp),
terms AS (SELECT DISTINCT r.id, unnest(string_split(v.name, ' ')) AS term FROM rows r JOIN variants v ON r.pkey = v.id),
tot AS (SELECT count(*) AS n, sum(correct) AS nc FROM rows),
t AS (SELECT term, count(*) AS n_t, sum(r.correct) AS c_t FROM terms JOIN rows r ON terms.id = r.id GROUP BY term),
x AS (SELECT term, c_t + 0.5 AS a, n_t - c_t + 0.5 AS b, nc - c_t + 0.5 AS c, n - nc - (n_t - c_t) + 0.5 AS d FROM t, tot)
SELECT term, {r6('log2((a * d) / (b * c))', 'log2_or')}, {r6('ln((a * d) / (b * c)) / sqrt(1 / a + 1 / b + 1 / c + 1 / d)', 'z')}
FROM x""", "pred", "variants"))
def sta16_feature_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per word of the part name: 2x2 counts against prediction correctness,
    log2 odds ratio (0.5 added to every cell) and the z of the log odds."""
    bp = best_rows(pred_view(spark, sf)).select(
        "id", "pkey", F.when(F.col("yhat") == F.col("label"), 1).otherwise(0).alias("correct"))
    v = variants_view(spark, sf).select(F.col("id").alias("vid"), "name")
    ids = bp.select("id", "pkey").distinct()
    terms = ids.join(v, ids["pkey"] == v["vid"]).select("id", F.explode(F.split("name", " ")).alias("term"))
    return S.feature_audit(bp.drop("pkey"), terms, "id", "term", "correct")


@register("sta16_feature_audit_p")
def sta16_feature_audit_p(spark: SparkSession, sf: str) -> DataFrame:
    """The audit of every word with its p-value, Holm and Benjamini-Hochberg adjusted."""
    return P.feature_audit(sta16_feature_audit(spark, sf))


# --- p-values (tails are not in SQL: checked against table values in tests) ----

@register("sta02_paired_t_p")
def sta02_paired_t_p(spark: SparkSession, sf: str) -> DataFrame:
    """Paired and corrected resampled t-tests with two-sided p-values."""
    return P.paired_t(S.paired_diffs(fold_scores(spark, sf), "F", "O"), rho=RHO)


@register("sta04_wilcoxon_p")
def sta04_wilcoxon_p(spark: SparkSession, sf: str) -> DataFrame:
    """Wilcoxon signed-rank test with its p-value."""
    return P.wilcoxon(S.paired_diffs(fold_scores(spark, sf), "F", "O"))


@register("sta05_rank_sum_p")
def sta05_rank_sum_p(spark: SparkSession, sf: str) -> DataFrame:
    """Rank-sum test per run under the three alternatives."""
    bp = best_rows(pred_view(spark, sf))
    parts = [P.mann_whitney(bp, ["run"], "label", "score", a).withColumn("alternative", F.lit(a)) for a in ("two-sided", "greater", "less")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("sta05_ks_two_sample_p")
def sta05_ks_two_sample_p(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sample KS test between the score distributions of the classes."""
    return P.ks_2samp(best_rows(pred_view(spark, sf)), ["run"], "label", "score")


@register("sta06_friedman_p")
def sta06_friedman_p(spark: SparkSession, sf: str) -> DataFrame:
    """Friedman test over three runs with its p-value."""
    return P.friedman(fold_scores(spark, sf, True))


@register("sta07_nemenyi_p")
def sta07_nemenyi_p(spark: SparkSession, sf: str) -> DataFrame:
    """Nemenyi post-hoc p-values per pair of runs."""
    return P.nemenyi(fold_scores(spark, sf, True))


@register("sta08_rm_anova_p")
def sta08_rm_anova_p(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated-measures ANOVA with its p-value."""
    return P.rm_anova(fold_scores(spark, sf, True))


@register("sta09_pairwise_holm")
def sta09_pairwise_holm(spark: SparkSession, sf: str) -> DataFrame:
    """Paired t of every pair of three runs, Holm- and BH-adjusted."""
    return P.pairwise_t(fold_scores(spark, sf, True))


@register("sta12_kruskal_p")
def sta12_kruskal_p(spark: SparkSession, sf: str) -> DataFrame:
    """Kruskal-Wallis test of sizes across part types with its p-value."""
    return P.kruskal(variants_view(spark, sf), "ptype", "position")
