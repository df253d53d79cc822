"""Registered queries: splits and sampling (SPL-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.operators import keys as K
from varlens.operators import splits as S
from varlens.plans.catalog import register
from varlens.plans.views import variants_view, with_views

SEED = 42


def _sv(spark, sf) -> DataFrame:
    """Labelled variants (neutral dropped): id, gene, position, label (0/1)."""
    v = variants_view(spark, sf).where(K.not_label(F.col("label_txt")))
    return v.select("id", "gene", "position", K.encode_label_strict(F.col("label_txt")).alias("label"))


SV = """sv AS (SELECT id, gene, position, CASE label_txt WHEN 'lof' THEN 0 WHEN 'gof' THEN 1 END AS label
    FROM variants WHERE label_txt <> 'neutral')"""


def h(seed) -> str:
    return f"md5(CAST(id AS VARCHAR) || '|' || '{seed}')"


@register("spl01_shuffle_key", with_views(f"SELECT id, gene, {h(SEED)} AS shuffle_key FROM variants", "variants"))
def spl01_shuffle_key(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded shuffle key per row (the table itself is not sorted)."""
    return S.shuffle_key(variants_view(spark, sf).select("id", "gene"), "id", SEED)


def _lr_sql(src: str, count_expr: str, total_expr: str, name: str) -> str:
    """Largest-remainder allocation of ``total_expr`` over labels, integer SQL."""
    return f"""{name}_t AS (SELECT CAST({total_expr} AS BIGINT) AS T, sum({count_expr}) AS tot FROM {src}),
{name}_a AS (SELECT s.*, ({count_expr} * T) // tot AS b, ({count_expr} * T) % tot AS r, T FROM {src} s, {name}_t),
{name} AS (SELECT *, b + CASE WHEN row_number() OVER (ORDER BY r DESC, label)
     <= T - (SELECT sum(b) FROM {name}_a) THEN 1 ELSE 0 END AS k FROM {name}_a)"""


@register("spl02_stratified_holdout", with_views(f"""WITH {SV}, cnt AS (SELECT label, count(*) AS n FROM sv GROUP BY label),
{_lr_sql('cnt', 'n', "ceil(CAST('0.1' AS DOUBLE) * sum(n))", 'kt')},
kt2 AS (SELECT label, n, k AS kt FROM kt),
{_lr_sql('kt2', '(n - kt)', "ceil(CAST('0.5' AS DOUBLE) * sum(n - kt))", 'kv')},
rk AS (SELECT sv.*, row_number() OVER (PARTITION BY label ORDER BY {h(SEED)}, id) AS rank FROM sv)
SELECT rk.id, rk.gene, rk.position, rk.label,
  CASE WHEN rank <= kv.kt THEN 'test' WHEN rank <= kv.kt + kv.k THEN 'val' ELSE 'train' END AS split
FROM rk JOIN kv ON rk.label = kv.label""", "variants"))
def spl02_stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """10 % stratified test set, the rest halved into validation and training."""
    return S.stratified_holdout(_sv(spark, sf), "id", "label", 0.1, 0.5, SEED)


@register("spl03_stratified_kfold", with_views(f"""WITH {SV}
SELECT id, gene, position, label, CAST((row_number() OVER (ORDER BY label, {h(SEED)}, id) - 1) % 10 AS INTEGER) AS fold
FROM sv""", "variants"))
def spl03_stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified 10-fold assignment by striding the label-sorted hash order."""
    return S.stratified_kfold(_sv(spark, sf), "id", "label", 10, SEED)


@register("spl04_repeated_kfold", with_views(f"""WITH {SV}
""" + " UNION ALL ".join(
    f"""SELECT id, gene, position, label, CAST((row_number() OVER (ORDER BY label, {h(SEED + r)}, id) - 1) % 10 AS INTEGER) AS fold,
  {r} AS repeat, {r * 10} + CAST((row_number() OVER (ORDER BY label, {h(SEED + r)}, id) - 1) % 10 AS INTEGER) AS fold_index FROM sv"""
    for r in range(3)), "variants"))
def spl04_repeated_kfold(spark: SparkSession, sf: str) -> DataFrame:
    """3 x 10 repeated stratified folds; fold index = repeat * 10 + fold."""
    return S.repeated_stratified_kfold(_sv(spark, sf), "id", "label", 10, 3, SEED)


@register("spl05_leave_one_group_out", with_views(f"""WITH {SV},
g AS (SELECT gene, CAST(row_number() OVER (ORDER BY count(*) DESC, gene) - 1 AS INTEGER) AS fold FROM sv GROUP BY gene)
SELECT sv.gene, sv.id, sv.label, g.fold FROM sv JOIN g ON sv.gene = g.gene""", "variants"))
def spl05_leave_one_group_out(spark: SparkSession, sf: str) -> DataFrame:
    """One fold per gene, larger genes first."""
    return S.leave_one_group_out(_sv(spark, sf).select("gene", "id", "label"), "gene")


@register("spl05_group_kfold", with_views("""WITH RECURSIVE g AS (SELECT gene, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, gene) AS i FROM variants GROUP BY gene),
d AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(NULL AS BIGINT) AS fold
  UNION ALL
  SELECT i, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = fold + 1 THEN n ELSE 0 END), fold
  FROM (SELECT g.i, g.n, d.loads, list_position(d.loads, list_min(d.loads)) - 1 AS fold FROM d JOIN g ON g.i = d.i + 1) s)
SELECT v.id, v.gene, CAST(d.fold AS INTEGER) AS fold FROM variants v JOIN g ON v.gene = g.gene JOIN d ON d.i = g.i""", "variants"))
def spl05_group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds of whole genes, largest gene first to the smallest fold."""
    return S.group_kfold(variants_view(spark, sf).select("id", "gene"), "gene", 5)


@register("spl06_expand_folds", with_views(f"""WITH {SV},
f AS (SELECT id, CAST((row_number() OVER (ORDER BY label, {h(SEED)}, id) - 1) % 5 AS INTEGER) AS fold FROM sv)
SELECT id, fold, CAST(s AS INTEGER) AS split_fold, CAST(CASE WHEN s <> fold THEN 1 ELSE 0 END AS INTEGER) AS train
FROM f, range(5) r(s)""", "variants"))
def spl06_expand_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Each row once per fold with train = 1 outside its own fold."""
    f = S.stratified_kfold(_sv(spark, sf), "id", "label", 5, SEED).select("id", "fold")
    return S.expand_folds(f, "fold", 5)


@register("spl07_rule_split", with_views("""SELECT id, symbol,
  CASE WHEN symbol = 'KCNQ4' THEN 'test' WHEN length(name) > 15 THEN 'train' ELSE 'none' END AS split FROM variants""",
    "variants"))
def spl07_rule_split(spark: SparkSession, sf: str) -> DataFrame:
    """Rule split: one gene is the test set, long term strings train."""
    v = variants_view(spark, sf)
    split = (F.when(F.col("symbol") == "KCNQ4", "test").when(F.length("name") > 15, "train").otherwise("none"))
    return v.select("id", "symbol", split.alias("split"))


_FK = "lower(p_brand) || ':' || CAST(p_size AS VARCHAR) || ':' || p_type || ':' || CAST(p_partkey AS VARCHAR)"
_VK = "p_brand || '_' || p_type || '_' || CAST(p_size AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR)"


@register("spl08_external_ids", f"""WITH ext AS (SELECT {_FK} AS fk, CASE WHEN p_size % 3 = 0 THEN 'train' ELSE 'test' END AS split
    FROM part WHERE p_size % 3 <> 2),
ids AS (SELECT upper(split_part(fk, ':', 1)) || '_' || split_part(fk, ':', 3) || '_' || split_part(fk, ':', 2) || '_'
    || split_part(fk, ':', 4) AS varid, split FROM ext),
keys AS (SELECT {_VK} AS varid FROM part)
SELECT keys.varid, ids.split FROM keys JOIN ids ON upper(keys.varid) = ids.varid""")
def spl08_external_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Train/test membership from external id lists in another key format."""
    from varlens.sources.tables import table
    p = table(spark, sf, "part")
    fk = F.concat_ws(":", F.lower("p_brand"), F.col("p_size").cast("string"), "p_type", F.col("p_partkey").cast("string"))
    ext = p.where(F.col("p_size") % 3 != 2).select(
        K.reformat_foreign_key(fk).alias("varid"),
        F.when(F.col("p_size") % 3 == 0, "train").otherwise("test").alias("split"))
    keys = p.select(F.concat_ws("_", "p_brand", "p_type", F.col("p_size").cast("string"),
                                F.col("p_partkey").cast("string")).alias("varid"))
    return keys.join(ext.withColumnRenamed("varid", "ext_id"), F.upper(F.col("varid")) == F.col("ext_id")).select(
        "varid", "split")


@register("spl09_sample_per_class", with_views(f"""WITH {SV},
rk AS (SELECT sv.*, row_number() OVER (PARTITION BY gene, label ORDER BY {h(SEED)}, id) AS rank,
              count(*) OVER (PARTITION BY gene, label) AS n FROM sv)
SELECT 'n3' AS mode, id, gene, label FROM rk WHERE rank <= 3
UNION ALL SELECT 'frac25' AS mode, id, gene, label FROM rk WHERE rank <= round_even(n * CAST('0.25' AS DOUBLE), 0)""", "variants"))
def spl09_sample_per_class(spark: SparkSession, sf: str) -> DataFrame:
    """3 rows per (gene, class), and a 25 % sample per (gene, class)."""
    sv = _sv(spark, sf)
    a = S.sample_per_class(sv, ["gene", "label"], "id", 3, SEED).withColumn("mode", F.lit("n3"))
    b = S.sample_per_class(sv, ["gene", "label"], "id", 0.25, SEED).withColumn("mode", F.lit("frac25"))
    return a.unionByName(b).select("mode", "id", "gene", "label")


@register("spl10_three_way_flags", with_views(f"""WITH {SV},
rk AS (SELECT sv.*, row_number() OVER (PARTITION BY gene, label ORDER BY {h(SEED)}, id) AS rank FROM sv)
SELECT id, gene, label, CASE WHEN rank <= (CASE label WHEN 0 THEN 2 ELSE 1 END) THEN 2
  WHEN rank <= (CASE label WHEN 0 THEN 2 ELSE 1 END) + 3 THEN 1 ELSE 0 END AS train FROM rk""", "variants"))
def spl10_three_way_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed test rows (2 lof, 1 gof per gene) flagged 2, 3 training rows per class 1, rest 0."""
    return S.three_way_flags(_sv(spark, sf).select("id", "gene", "label"), ["gene"], "label", "id",
                             {0: 2, 1: 1}, 3, SEED)


@register("spl11_holdout_by_seed", with_views(f"""WITH {SV}
""" + " UNION ALL ".join(f"""SELECT {s} AS seed, id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {h(s)}, id) <= 5
  THEN 1 ELSE 0 END AS test FROM sv WHERE gene = 'Brand#1'""" for s in (1, 2)), "variants"))
def spl11_holdout_by_seed(spark: SparkSession, sf: str) -> DataFrame:
    """5 test rows per class of one gene, repeated for two seeds."""
    g = _sv(spark, sf).where(F.col("gene") == "Brand#1").select("id", "label")
    parts = []
    for s in (1, 2):
        r = S.rank_within(g, ["label"], "id", s)
        parts.append(r.select(F.lit(s).alias("seed"), "id", "label",
                              F.when(F.col("rank") <= 5, 1).otherwise(0).alias("test")))
    return parts[0].unionByName(parts[1])


@register("spl12_minority_balance", with_views(f"""WITH {SV},
c AS (SELECT gene, label, count(*) AS c FROM sv GROUP BY gene, label),
m AS (SELECT gene, min(c) AS m FROM c GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT label) FROM sv)),
rk AS (SELECT sv.*, row_number() OVER (PARTITION BY sv.gene, label ORDER BY {h(SEED)}, id) AS rank, m.m
       FROM sv JOIN m ON sv.gene = m.gene)
SELECT gene, id, position, label FROM rk WHERE rank <= m""", "variants"))
def spl12_minority_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Per gene, as many rows of each class as the smaller class has."""
    return S.minority_balance(_sv(spark, sf), "gene", "label", "id", SEED).select("gene", "id", "position", "label")
