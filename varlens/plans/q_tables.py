"""Registered queries: projections, filters, joins, aggregates, set operations,
sorts and top-k (PRJ-*, FIL-*, JOI-*, AGG-*, SET-*, SRT-*, TOP-*, LIM-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.operators import groups as G
from varlens.operators import joins as J
from varlens.operators import keys as K
from varlens.operators import metrics as M
from varlens.plans.catalog import r6, register
from varlens.plans.q_archive import BEST_ROWS, METRIC_SQL, best_rows, counts_sql
from varlens.plans.views import pred3_view, pred_view, variants_view, with_views
from varlens.sources.tables import table


def _v(spark, sf):
    return variants_view(spark, sf)


# --- PRJ --------------------------------------------------------------------

@register("prj01_keep_columns", with_views("SELECT id, gene, label_txt FROM variants", "variants"))
def prj01_keep_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Keep a column list, skipping names the table lacks (``train`` here)."""
    return K.select_existing(_v(spark, sf), ["id", "gene", "label_txt", "train"])


@register("prj02_drop_columns", with_views(
    "SELECT id, gene, position, label_txt, ptype, name, symbol FROM variants", "variants"))
def prj02_drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Drop named columns, ignoring one that is missing."""
    return K.drop_existing(_v(spark, sf), ["feature", "no_such_column"])


@register("prj03_drop_by_prefix", with_views(
    "SELECT id, gene, position, label_txt, feature, ptype, name, symbol FROM variants", "variants"))
def prj03_drop_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Drop expression columns by prefix (rel_, abs_) and density columns by substring."""
    v = _v(spark, sf).withColumns({"rel_price": F.col("feature") / 1000.0, "abs_size": F.col("position"),
                                    "densgof": F.col("position") * 2.0, "size_dens3aa": F.col("position") * 3.0})
    return K.drop_by_name(v)


_KEY_SQL = "p_brand || '_' || p_type || '_' || CAST(p_size AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR)"


@register("prj04_parse_key", f"""SELECT varid, split_part(varid, '_', 1) AS gene, split_part(varid, '_', 2) AS ref_aa,
  CAST(split_part(varid, '_', 3) AS INTEGER) AS position, split_part(varid, '_', 4) AS alt_aa
FROM (SELECT {_KEY_SQL} AS varid FROM part)""")
def prj04_parse_key(spark: SparkSession, sf: str) -> DataFrame:
    """Split ``GENE_ref_pos_alt`` keys into their parts."""
    p = table(spark, sf, "part")
    key = F.concat_ws("_", "p_brand", "p_type", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return p.select(key.alias("varid")).select("varid", *K.parse_varid(F.col("varid")))


@register("prj05_reformat_key", """SELECT fk, upper(split_part(fk, ':', 1)) || '_' || split_part(fk, ':', 3) || '_'
  || split_part(fk, ':', 2) || '_' || split_part(fk, ':', 4) AS varid
FROM (SELECT lower(p_brand) || ':' || CAST(p_size AS VARCHAR) || ':' || p_type || ':' || CAST(p_partkey AS VARCHAR) AS fk FROM part)""")
def prj05_reformat_key(spark: SparkSession, sf: str) -> DataFrame:
    """``gene:pos:ref:alt`` ids re-formatted to ``GENE_ref_pos_alt``."""
    p = table(spark, sf, "part")
    fk = F.concat_ws(":", F.lower("p_brand"), F.col("p_size").cast("string"), "p_type", F.col("p_partkey").cast("string"))
    return p.select(fk.alias("fk")).select("fk", K.reformat_foreign_key(F.col("fk")).alias("varid"))


@register("prj06_label_strict", with_views("""SELECT id, CASE label_txt WHEN 'lof' THEN 0 WHEN 'gof' THEN 1 END AS label
FROM variants WHERE label_txt IS DISTINCT FROM 'neutral'""", "variants"))
def prj06_label_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Strict label encoding after the neutral filter (another value raises)."""
    v = _v(spark, sf).where(K.not_label(F.col("label_txt")))
    return v.select("id", K.encode_label_strict(F.col("label_txt")).alias("label"))


@register("prj07_label_lenient", with_views("""SELECT id, CASE label_txt WHEN 'lof' THEN 0 WHEN 'gof' THEN 1 END AS label_map,
  coalesce(CAST(CASE label_txt WHEN 'lof' THEN 0 WHEN 'gof' THEN 1 END AS VARCHAR), label_txt) AS label_replace
FROM variants""", "variants"))
def prj07_label_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Lenient encodings: null for other values (map) or kept (replace)."""
    lt = F.col("label_txt")
    return _v(spark, sf).select("id", K.encode_label_map(lt).alias("label_map"),
                                K.encode_label_replace(lt).alias("label_replace"))


@register("prj08_family_two_way", with_views("""SELECT symbol,
  CASE WHEN upper(symbol) LIKE 'KCN%' OR upper(symbol) LIKE 'HCN%' OR upper(symbol) = 'SH' THEN 'potassium'
       ELSE 'sodium_calcium' END AS family, count(*) AS n
FROM variants GROUP BY ALL""", "variants"))
def prj08_family_two_way(spark: SparkSession, sf: str) -> DataFrame:
    """Potassium / sodium-calcium family of each symbol, with counts."""
    v = _v(spark, sf)
    return v.groupBy("symbol", K.family_two_way(F.col("symbol")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@register("prj09_family_five_way", with_views("""SELECT
  CASE WHEN contains(symbol, 'KCN') THEN 'KCN' WHEN contains(symbol, 'CACNA') THEN 'CACNA'
       WHEN contains(symbol, 'SCN') THEN 'SCN' WHEN contains(symbol, 'Sh') THEN 'Sh' ELSE 'other' END AS family,
  count(*) AS n FROM variants GROUP BY ALL""", "variants"))
def prj09_family_five_way(spark: SparkSession, sf: str) -> DataFrame:
    """Five-way family by first matching substring, with counts."""
    v = _v(spark, sf)
    return v.groupBy(K.family_five_way(F.col("symbol")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


_TERMS_SQL = """enc AS (
  SELECT id, unnest(list_distinct(string_split(name, ' '))) AS term FROM variants
  UNION ALL
  SELECT id, unnest(list_distinct([lower(ptype), split_part(name, ' ', 1)])) AS term FROM variants)"""


@register("prj10_sum_same_name", with_views(f"""WITH {_TERMS_SQL}
SELECT id, term, CAST(count(*) AS BIGINT) AS value FROM enc GROUP BY id, term""", "variants"))
def prj10_sum_same_name(spark: SparkSession, sf: str) -> DataFrame:
    """Two 0/1 term encoders summed on equal term names (value 2 possible), long form."""
    from varlens.operators.features import multi_hot_long, sum_same_name
    v = _v(spark, sf)
    a = multi_hot_long(v, "id", F.split("name", " "))
    b = multi_hot_long(v, "id", F.array(F.lower("ptype"), F.get(F.split("name", " "), 0)))
    return sum_same_name([a, b], "id")


@register("prj11_schema_guard", with_views("""SELECT position % 2 AS part, count(*) AS n FROM variants GROUP BY ALL""",
                                           "variants"))
def prj11_schema_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test halves must have the same columns; then stacked and counted."""
    v = _v(spark, sf).withColumn("part", F.col("position") % 2)
    a, b = v.where(F.col("part") == 0), v.where(F.col("part") == 1)
    K.schema_guard(a, b)
    return a.unionByName(b).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@register("prj12_unpivot", with_views(f"""SELECT id, metric, {r6('value', 'value')} FROM (
  SELECT id, CAST(position AS DOUBLE) AS position, feature FROM variants)
UNPIVOT (value FOR metric IN (position, feature))""", "variants"))
def prj12_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """Wide numeric columns to long (id, metric, value)."""
    v = _v(spark, sf).select("id", F.col("position").cast("double").alias("position"), "feature")
    return v.unpivot(["id"], ["position", "feature"], "metric", "value")


@register("prj13_count_label", with_views("""SELECT gene, '(' || CAST(count(*) AS VARCHAR) || ') ' || gene AS label,
  CAST(count(*) AS INTEGER) AS n_parsed FROM variants GROUP BY gene""", "variants"))
def prj13_count_label(spark: SparkSession, sf: str) -> DataFrame:
    """``(n) gene`` labels and the count parsed back from them."""
    c = _v(spark, sf).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    lab = c.select("gene", K.count_label(F.col("gene"), F.col("n")).alias("label"))
    return lab.select("gene", "label", K.parse_count_label(F.col("label")).alias("n_parsed"))


# --- FIL --------------------------------------------------------------------

_NULLED = "(SELECT id, CASE WHEN position % 11 = 0 THEN NULL ELSE label_txt END AS label_txt FROM variants)"


@register("fil01_label_filter", with_views(f"SELECT id, label_txt FROM {_NULLED} WHERE label_txt IS DISTINCT FROM 'neutral'",
                                           "variants"))
def fil01_label_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Drop the neutral class, keeping rows whose label is missing."""
    v = _v(spark, sf).select("id", F.when(F.col("position") % 11 == 0, F.lit(None)).otherwise(
        F.col("label_txt")).alias("label_txt"))
    return v.where(K.not_label(F.col("label_txt")))


@register("fil02_threshold", with_views("SELECT id, gene, feature FROM variants WHERE feature > 950", "variants"))
def fil02_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric threshold filter (missing values drop out)."""
    return _v(spark, sf).where(F.col("feature") > 950).select("id", "gene", "feature")


@register("fil03_threshold_exempt", with_views("""WITH look AS (SELECT gene, avg(feature) / 1000.0 AS score FROM variants GROUP BY gene)
SELECT v.id, v.gene FROM variants v LEFT JOIN look l ON v.gene = l.gene
WHERE v.gene = 'Brand#1' OR l.score > 0.95""", "variants"))
def fil03_threshold_exempt(spark: SparkSession, sf: str) -> DataFrame:
    """Exempt group passes; other rows need a looked-up per-gene score above a cut."""
    v = _v(spark, sf)
    look = v.groupBy("gene").agg((F.avg("feature") / 1000.0).alias("score"))
    j = J.lookup_unique(v.select("id", "gene"), look, "gene")
    return j.where((F.col("gene") == "Brand#1") | (F.col("score") > 0.95)).select("id", "gene")


_SENT_SQL = """(SELECT id, CASE WHEN position % 10 = 0 THEN '"HP:9999998"' WHEN position % 10 = 1 THEN '"HP:9999999"'
   ELSE '"HP:' || CAST(id AS VARCHAR) || '"' END AS hpo FROM variants)"""


def _hpo(v: DataFrame) -> DataFrame:
    return v.select("id", F.when(F.col("position") % 10 == 0, F.lit('"HP:9999998"'))
                    .when(F.col("position") % 10 == 1, F.lit('"HP:9999999"'))
                    .otherwise(F.concat(F.lit('"HP:'), F.col("id").cast("string"), F.lit('"'))).alias("hpo"))


@register("fil04_sentinel", with_views(f"""SELECT id, hpo FROM {_SENT_SQL} WHERE hpo NOT IN ('"HP:9999998"', '"HP:9999999"')""",
                                       "variants"))
def fil04_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    """Drop rows whose term list is a missing code."""
    h = _hpo(_v(spark, sf))
    return h.where(K.not_sentinel(F.col("hpo")))


@register("fil05_min_length", """SELECT conv_id, turn, length(text) AS n_chars FROM conversations WHERE length(text) >= 10""")
def fil05_min_length(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences shorter than 10 characters are skipped."""
    c = table(spark, sf, "conversations")
    return c.where(K.min_length(F.col("text"))).select("conv_id", "turn", F.length("text").alias("n_chars"))


@register("fil06_group_membership", with_views("""SELECT run, fold, grp, count(*) AS n FROM pred
WHERE grp IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND fold < 5 GROUP BY ALL""", "pred"))
def fil06_group_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of listed groups and of the first folds."""
    p = pred_view(spark, sf)
    return (p.where(F.col("grp").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89) & (F.col("fold") < 5))
             .groupBy("run", "fold", "grp").agg(F.count(F.lit(1)).alias("n")))


@register("fil07_any_term", with_views("""SELECT id, name FROM variants WHERE list_contains(string_split(name, ' '), 'red')""",
                                       "variants"))
def fil07_any_term(spark: SparkSession, sf: str) -> DataFrame:
    """Rows holding a given term."""
    v = _v(spark, sf)
    return v.where(F.array_contains(F.split("name", " "), "red")).select("id", "name")


# --- JOI --------------------------------------------------------------------

@register("joi01_inner_drop_dupes", with_views("""SELECT v.id, v.gene, v.position, v.label_txt, v.feature, v.ptype, v.name,
  v.symbol, p.p_retailprice * 2 AS price2 FROM variants v JOIN part p ON v.id = p.p_partkey""", "variants"))
def joi01_inner_drop_dupes(spark: SparkSession, sf: str) -> DataFrame:
    """Inner join on the key; right columns already on the left are dropped."""
    v = _v(spark, sf)
    ann = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("gene"),
                                         (F.col("p_retailprice") * 2).alias("price2"))
    return J.join_drop_right_dupes(v, ann, ["id"])


@register("joi02_left_feature_map", with_views("""WITH m AS (SELECT gene, position, count(*) AS dens FROM variants
  WHERE label_txt = 'gof' GROUP BY gene, position)
SELECT v.id, v.gene, v.position, m.dens FROM variants v LEFT JOIN m ON v.gene = m.gene AND v.position = m.position""",
    "variants"))
def joi02_left_feature_map(spark: SparkSession, sf: str) -> DataFrame:
    """Left join of a (gene, position) feature map; no match gives null."""
    v = _v(spark, sf)
    m = v.where(F.col("label_txt") == "gof").groupBy("gene", "position").agg(F.count(F.lit(1)).alias("dens"))
    return J.join_drop_right_dupes(v.select("id", "gene", "position"), m, ["gene", "position"], "left")


@register("joi03_outer_provenance", with_views("""SELECT coalesce(l.id, r.id) AS id, l.gene, l.position, r.gene AS gene_right,
  r.position AS position_right,
  CASE WHEN l.id IS NOT NULL AND r.id IS NOT NULL THEN 'both' WHEN l.id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS _merge
FROM (SELECT id, gene, position FROM variants WHERE position <= 30) l
FULL OUTER JOIN (SELECT id, gene, position FROM variants WHERE position >= 20) r ON l.id = r.id""", "variants"))
def joi03_outer_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Full outer join with a ``_merge`` provenance column."""
    v = _v(spark, sf).select("id", "gene", "position")
    return J.outer_with_provenance(v.where(F.col("position") <= 30), v.where(F.col("position") >= 20), ["id"])


@register("joi04_semi", with_views("""SELECT * FROM variants WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
                                   "variants"))
def joi04_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Variants whose key occurs in a key set (semi join)."""
    keys = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("id"))
    return J.semi(_v(spark, sf), keys, ["id"])


@register("joi05_anti", with_views("""SELECT * FROM variants WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.075)""",
                                   "variants"))
def joi05_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Variants whose key does not occur in a key set (anti join)."""
    keys = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.075)).select(F.col("l_partkey").alias("id"))
    return J.anti(_v(spark, sf), keys, ["id"])


_GAF_SQL = """gaf AS (SELECT symbol, 'GO:' || lpad(CAST(position % 13 AS VARCHAR), 7, '0') AS term FROM variants
  WHERE symbol NOT LIKE 'Sh%')"""


def _gaf(v: DataFrame) -> DataFrame:
    # the family Sh* is absent from the association file, so its symbols take the default
    return (v.where(~F.col("symbol").startswith("Sh"))
             .select("symbol", F.concat(F.lit("GO:"), F.lpad((F.col("position") % 13).cast("string"), 7, "0")).alias("term")))


@register("joi06_lookup_default", with_views(f"""WITH {_GAF_SQL},
agg AS (SELECT symbol, array_to_string(list_sort(list_distinct(list(term))), ';') AS go FROM gaf GROUP BY symbol)
SELECT d.symbol, coalesce(agg.go, 'GO:0') AS go FROM (SELECT DISTINCT symbol FROM variants) d
LEFT JOIN agg ON d.symbol = agg.symbol""", "variants"))
def joi06_lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol -> sorted ';'-joined term set, GO:0 when the symbol has none."""
    v = _v(spark, sf)
    return J.lookup_terms(v.select("symbol").distinct(), _gaf(v), "symbol", "term", "go")


@register("joi07_lookup_unique", with_views("""WITH dim AS (SELECT gene, min(name) AS wt FROM variants GROUP BY gene)
SELECT v.id, v.gene, dim.wt FROM variants v JOIN dim ON v.gene = dim.gene""", "variants"))
def joi07_lookup_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Wild-type lookup by gene that must match exactly once."""
    v = _v(spark, sf)
    dim = v.groupBy("gene").agg(F.min("name").alias("wt"))
    return J.lookup_unique(v.select("id", "gene"), dim, "gene")


@register("joi08_array_lookup", with_views(f"""WITH e AS (SELECT 'V_' || CAST(vec_id AS VARCHAR) AS k, embedding FROM embeddings)
SELECT v.id, {r6('e.embedding[1]', 'x0')}, len(e.embedding) AS dim
FROM variants v JOIN e ON 'V_' || CAST(v.id % (SELECT count(*) FROM embeddings) AS VARCHAR) = e.k""", "variants"))
def joi08_array_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding arrays fetched by a composed string key."""
    e = table(spark, sf, "embeddings")
    n = e.count()  # one number; it defines the key rule below
    ek = e.select(F.concat(F.lit("V_"), F.col("vec_id").cast("string")).alias("k"), "embedding")
    v = _v(spark, sf).select("id", F.concat(F.lit("V_"), (F.col("id") % F.lit(n)).cast("string")).alias("k"))
    j = v.join(ek, "k")
    return j.select("id", F.get("embedding", 0).cast("double").alias("x0"), F.size("embedding").alias("dim"))


_GENES = [f"Brand#{i}" for i in range(1, 31)]  # the last five occur in no row


@register("joi09_complete_dimension", with_views("""WITH dim AS (SELECT 'Brand#' || CAST(i AS VARCHAR) AS gene, i AS ord FROM range(1, 31) r(i)),
agg AS (SELECT gene, count(*) AS n FROM variants WHERE label_txt = 'gof' GROUP BY gene)
SELECT dim.gene, CAST(dim.ord AS INTEGER) AS ord, coalesce(agg.n, 0) AS n FROM dim LEFT JOIN agg ON dim.gene = agg.gene""",
    "variants"))
def joi09_complete_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over a fixed gene list in its order; absent genes get 0."""
    dim = spark.createDataFrame([(g, i + 1) for i, g in enumerate(_GENES)], "gene string, ord int")
    agg = (_v(spark, sf).where(F.col("label_txt") == "gof")
           .groupBy("gene").agg(F.count(F.lit(1)).alias("n")))
    return J.complete_against(dim, agg, "gene", ["n"], 0).select("gene", "ord", "n")


@register("joi10_align_dummies", with_views("""WITH tr AS (SELECT DISTINCT ptype FROM variants WHERE position % 2 = 0 AND ptype <> 'PROMO'),
te AS (SELECT id, ptype FROM variants WHERE position % 2 = 1)
SELECT te.id, tr.ptype AS term, CASE WHEN te.ptype = tr.ptype THEN 1 ELSE 0 END AS value FROM te CROSS JOIN tr""", "variants"))
def joi10_align_dummies(spark: SparkSession, sf: str) -> DataFrame:
    """Test-set dummies over the training vocabulary: unseen test values get
    no column, training values absent in a test row are 0 (long form)."""
    from varlens.operators.features import one_hot_aligned
    v = _v(spark, sf)
    train = v.where((F.col("position") % 2 == 0) & (F.col("ptype") != "PROMO"))
    test = v.where(F.col("position") % 2 == 1)
    return one_hot_aligned(train, test, "id", "ptype")


@register("joi11_run_pairs", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')}),
s AS (SELECT run, fold, {METRIC_SQL['accuracy']} AS acc FROM c)
SELECT a.fold, a.run AS run_a, b.run AS run_b, {r6('a.acc', 'acc_a')}, {r6('b.acc', 'acc_b')}
FROM s a JOIN s b ON a.fold = b.fold AND a.run < b.run""", ("pred", "pred3")))
def joi11_run_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All unordered pairs of runs on the same fold."""
    bt = M.best_table(M.score_table(pred3_view(spark, sf)))
    s = M.with_metrics(M.confusion_from_table(bt, ("run", "fold")), ["accuracy"]).select("run", "fold", "accuracy")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.fold") == F.col("b.fold")) & (F.col("a.run") < F.col("b.run"))).select(
        F.col("a.fold").alias("fold"), F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b"),
        F.col("a.accuracy").alias("acc_a"), F.col("b.accuracy").alias("acc_b"))


@register("joi14_replace_group", with_views("""SELECT id, gene, position, 0 AS train FROM variants WHERE gene <> 'Brand#1'
UNION ALL SELECT p_partkey AS id, p_brand AS gene, p_size AS position, 2 AS train FROM part
  WHERE p_brand = 'Brand#1' AND p_size > 25""", "variants"))
def joi14_replace_group(spark: SparkSession, sf: str) -> DataFrame:
    """One gene replaced by an external table stacked on the shared columns."""
    base = _v(spark, sf).select("id", "gene", "position", F.lit(0).alias("train"))
    ext = (table(spark, sf, "part").where((F.col("p_brand") == "Brand#1") & (F.col("p_size") > 25))
           .select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("gene"), F.col("p_size").alias("position"),
                   F.col("p_retailprice").alias("price")))
    return J.replace_group(base, ext, "gene", "Brand#1", "train", 2)


# --- AGG --------------------------------------------------------------------

@register("agg01_group_count", with_views("SELECT gene, count(*) AS n FROM variants GROUP BY gene", "variants"))
def agg01_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return G.value_counts(_v(spark, sf), ["gene"])


@register("agg02_value_counts", with_views("SELECT gene, label_txt, count(*) AS n FROM variants GROUP BY ALL", "variants"))
def agg02_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.value_counts(_v(spark, sf), ["gene", "label_txt"])


@register("agg03_pivot_counts", with_views("""SELECT gene, count(*) FILTER (WHERE label_txt = 'lof') AS lof,
  count(*) FILTER (WHERE label_txt = 'gof') AS gof, count(*) FILTER (WHERE label_txt = 'neutral') AS neutral
FROM variants GROUP BY gene""", "variants"))
def agg03_pivot_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.pivot_counts(_v(spark, sf), "gene", "label_txt", ["lof", "gof", "neutral"])


@register("agg04_having_size", with_views("""SELECT v.id, v.gene, v.position FROM variants v JOIN
  (SELECT gene, position FROM variants GROUP BY gene, position HAVING count(*) >= 2) g
  ON v.gene = g.gene AND v.position = g.position""", "variants"))
def agg04_having_size(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of (gene, position) groups with at least 2 rows."""
    return G.having_min_size(_v(spark, sf).select("id", "gene", "position"), ["gene", "position"], 2)


@register("agg05_set_to_string", with_views("""SELECT ptype, array_to_string(list_sort(list_distinct(list(w))), ';') AS terms
FROM (SELECT ptype, unnest(string_split(name, ' ')) AS w FROM variants) GROUP BY ptype""", "variants"))
def agg05_set_to_string(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words per type, sorted and joined."""
    v = _v(spark, sf).select("ptype", F.explode(F.split("name", " ")).alias("w"))
    return v.groupBy("ptype").agg(F.array_join(F.array_sort(F.collect_set("w")), ";").alias("terms"))


@register("agg06_checked_constant", with_views("""SELECT gene, max(length(gene)) + 2 AS seq_len FROM variants GROUP BY gene""",
                                               "variants"))
def agg06_checked_constant(spark: SparkSession, sf: str) -> DataFrame:
    """One length per gene (checked), plus 2 for the start and end tokens."""
    return G.checked_constant(_v(spark, sf), ["gene"], F.length("gene"), "seq_len", offset=2)


@register("agg07_mean_impute", with_views(f"""WITH x AS (SELECT id, CASE WHEN position % 7 = 0 THEN NULL ELSE feature END AS f FROM variants)
SELECT id, {r6('coalesce(f, (SELECT avg(f) FROM x))', 'f')} FROM x""", "variants"))
def agg07_mean_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values filled with the column mean."""
    x = _v(spark, sf).select("id", F.when(F.col("position") % 7 == 0, F.lit(None)).otherwise(F.col("feature")).alias("f"))
    return G.mean_impute(x, ["f"])


_BIN_LABEL = "CASE label_txt WHEN 'lof' THEN 0 WHEN 'gof' THEN 1 END"


@register("agg08_polarity", with_views(f"""SELECT gene,
  CAST(count(*) FILTER (WHERE lab = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (WHERE lab = 1) AS BIGINT) AS n1, count(*) AS n,
  {r6('CASE WHEN count(lab) > 0 THEN count(*) FILTER (WHERE lab = 1) / count(lab) END', 'polarity')},
  {r6('CASE WHEN count(lab) > 0 THEN greatest(count(*) FILTER (WHERE lab = 0), count(*) FILTER (WHERE lab = 1)) / count(lab) END', 'majority_share')},
  CASE WHEN count(*) FILTER (WHERE lab = 1) > count(*) FILTER (WHERE lab = 0) THEN 1 ELSE 0 END AS dominant
FROM (SELECT gene, {_BIN_LABEL} AS lab FROM variants) GROUP BY gene""", "variants"))
def agg08_polarity(spark: SparkSession, sf: str) -> DataFrame:
    """Share of gof per gene, share of the larger class, dominant class (AGG-08/09)."""
    v = _v(spark, sf).select("gene", K.encode_label_map(F.col("label_txt")).alias("label"))
    return G.polarity(v, ["gene"])


@register("agg09_dominant_class", with_views(f"""SELECT ptype, CASE WHEN n1 > n0 THEN 1 ELSE 0 END AS dominant,
  {r6('CASE WHEN n0 + n1 > 0 THEN greatest(n0, n1) / (n0 + n1) END', 'ratio')}, n
FROM (SELECT ptype, count(*) FILTER (WHERE lab = 0) AS n0, count(*) FILTER (WHERE lab = 1) AS n1, count(*) AS n
      FROM (SELECT ptype, CASE WHEN position % 3 = 0 THEN 1 ELSE 0 END AS lab FROM variants) GROUP BY ptype)""",
    "variants"))
def agg09_dominant_class(spark: SparkSession, sf: str) -> DataFrame:
    """Dominant class (ties to 0), its share and the group size."""
    v = _v(spark, sf).select("ptype", F.when(F.col("position") % 3 == 0, 1).otherwise(0).alias("label"))
    p = G.polarity(v, ["ptype"])
    return p.select("ptype", "dominant", F.col("majority_share").alias("ratio"), "n")


@register("agg10_first_constant", with_views("""SELECT gene, max(substr(gene, 1, 5)) AS prefix FROM variants GROUP BY gene""",
                                             "variants"))
def agg10_first_constant(spark: SparkSession, sf: str) -> DataFrame:
    """A per-group constant read with a constancy check instead of ``first``."""
    return G.checked_constant(_v(spark, sf), ["gene"], F.substring("gene", 1, 5), "prefix")


@register("agg11_class_weights", with_views(f"""SELECT label, count(*) AS n_class,
  {r6('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')} FROM
  (SELECT {_BIN_LABEL} AS label FROM variants WHERE label_txt <> 'neutral') GROUP BY label""", "variants"))
def agg11_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced class weights n / (k * n_class)."""
    v = _v(spark, sf).where(F.col("label_txt") != "neutral").select(K.encode_label_map(F.col("label_txt")).alias("label"))
    return G.class_weights(v)


@register("agg19_groups_with_term", with_views("""SELECT w AS term, count(DISTINCT gene) AS n_groups,
  array_to_string(list_sort(list_distinct(list(gene))), ',') AS groups
FROM (SELECT gene, unnest(string_split(name, ' ')) AS w FROM variants) GROUP BY w""", "variants"))
def agg19_groups_with_term(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct genes holding each word."""
    v = _v(spark, sf).select("gene", F.explode(F.split("name", " ")).alias("term"))
    return G.groups_with_term(v, "term", "gene")


@register("agg20_cluster_profile", with_views(f"""WITH t AS (SELECT id, gene, ptype, w, CAST(position AS DOUBLE) AS weight
  FROM (SELECT id, gene, ptype, position, unnest(string_split(name, ' ')) AS w FROM variants))
SELECT p.ptype, p.term, {r6('p.mean_weight', 'mean_weight')}, m.members FROM
  (SELECT ptype, w AS term, avg(weight) AS mean_weight FROM t GROUP BY ptype, w) p
  JOIN (SELECT ptype, array_to_string(list_sort(list_distinct(list(gene))), ',') AS members FROM t GROUP BY ptype) m
  ON p.ptype = m.ptype""", "variants"))
def agg20_cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Mean term weight per cluster (type) and the cluster's member genes."""
    t = _v(spark, sf).select("gene", "ptype", F.col("position").cast("double").alias("weight"),
                             F.explode(F.split("name", " ")).alias("term"))
    prof = t.groupBy("ptype", "term").agg(F.avg("weight").alias("mean_weight"))
    mem = t.groupBy("ptype").agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("members"))
    return prof.join(mem, "ptype")


@register("agg21_subset_accuracy", with_views(f"""{BEST_ROWS},
subsets AS (SELECT CAST(k AS INTEGER) AS subset, grp FROM range(1, 5) a(k), (SELECT DISTINCT grp FROM bp) b WHERE grp % 4 < k)
SELECT s.subset, count(*) AS n, {r6('avg(CASE WHEN bp.yhat = bp.label THEN 1.0 ELSE 0.0 END)', 'accuracy')}
FROM bp JOIN subsets s ON bp.grp = s.grp GROUP BY s.subset""", "pred"))
def agg21_subset_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled accuracy over growing group subsets: a quarter, half, three
    quarters (by the group number modulo 4) and all of the group dimension."""
    bp = best_rows(pred_view(spark, sf))
    subsets = (spark.range(1, 5).select(F.col("id").cast("int").alias("subset"))
               .crossJoin(bp.select("grp").distinct())  # four rows a group
               .where(F.col("grp") % 4 < F.col("subset")))
    j = bp.join(subsets, "grp")
    hit = F.when(F.col("yhat") == F.col("label"), 1.0).otherwise(0.0)
    return j.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


@register("agg22_scores_wide", with_views(f"""{BEST_ROWS}, c AS ({counts_sql('bp', 'run, fold')}),
s AS (SELECT run, fold, {METRIC_SQL['accuracy']} AS acc FROM c)
SELECT fold, {r6("max(acc) FILTER (WHERE run = 'A')", 'A')}, {r6("max(acc) FILTER (WHERE run = 'N')", 'N')},
  {r6("max(acc) FILTER (WHERE run = 'R')", 'R')} FROM s GROUP BY fold""", ("pred", "pred3")))
def agg22_scores_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Score table with one column per run and one row per fold."""
    bt = M.best_table(M.score_table(pred3_view(spark, sf)))
    s = M.with_metrics(M.confusion_from_table(bt, ("run", "fold")), ["accuracy"])
    return s.groupBy("fold").pivot("run", ["A", "N", "R"]).agg(F.max("accuracy"))


# --- SET, SRT, TOP, LIM -----------------------------------------------------

@register("set01_union_all", with_views("""SELECT id, gene FROM variants WHERE position <= 25
UNION ALL SELECT id, gene FROM variants WHERE position >= 20""", "variants"))
def set01_union_all(spark: SparkSession, sf: str) -> DataFrame:
    v = _v(spark, sf).select("id", "gene", "position")
    return v.where(F.col("position") <= 25).drop("position").unionByName(
        v.where(F.col("position") >= 20).drop("position"))


@register("set02_union_shared", with_views("""SELECT id, gene, position FROM variants WHERE ptype = 'SMALL'
UNION ALL SELECT p_partkey AS id, p_brand AS gene, p_size AS position FROM part WHERE p_type = 'LARGE'""", "variants"))
def set02_union_shared(spark: SparkSession, sf: str) -> DataFrame:
    left = _v(spark, sf).where(F.col("ptype") == "SMALL").select("id", "gene", "position", "label_txt")
    right = (table(spark, sf, "part").where(F.col("p_type") == "LARGE")
             .select(F.col("p_partkey").alias("id"), F.col("p_size").alias("position"), F.col("p_brand").alias("gene"),
                     F.col("p_retailprice").alias("price")))
    return J.union_shared(left, right)


@register("set03_distinct", with_views("SELECT DISTINCT gene, ptype FROM variants", "variants"))
def set03_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return _v(spark, sf).select("gene", "ptype").distinct()


@register("set04_key_difference", with_views("""SELECT id FROM variants EXCEPT SELECT vec_id AS id FROM embeddings""",
                                             "variants"))
def set04_key_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Variant keys without an embedding."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return J.anti(_v(spark, sf).select("id").distinct(), e, ["id"])


@register("srt01_sort_by_value", with_views("SELECT id, feature FROM variants ORDER BY feature DESC, id", "variants"))
def srt01_sort_by_value(spark: SparkSession, sf: str) -> DataFrame:
    """Rows sorted by value with the key as tie-break (a range-partitioned sort)."""
    return _v(spark, sf).select("id", "feature").orderBy(F.col("feature").desc(), "id")


@register("srt02_custom_order", with_views("""WITH dim AS (SELECT 'Brand#' || CAST(i AS VARCHAR) AS gene, CAST(26 - i AS INTEGER) AS ord FROM range(1, 26) r(i))
SELECT v.gene, dim.ord, count(*) AS n FROM variants v JOIN dim ON v.gene = dim.gene GROUP BY v.gene, dim.ord ORDER BY dim.ord""",
    "variants"))
def srt02_custom_order(spark: SparkSession, sf: str) -> DataFrame:
    """Per-gene counts sorted by a fixed custom gene order (an ordinal dimension)."""
    dim = spark.createDataFrame([(g, 26 - (i + 1)) for i, g in enumerate(_GENES)], "gene string, ord int")
    c = G.value_counts(_v(spark, sf), ["gene"])
    return c.join(dim, "gene").select("gene", "ord", "n").orderBy("ord")


@register("top01_top_terms", with_views(f"""WITH t AS (SELECT ptype, w AS term, count(*) AS weight
  FROM (SELECT ptype, unnest(string_split(name, ' ')) AS w FROM variants) GROUP BY ALL)
SELECT ptype, term, weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ptype ORDER BY weight DESC, term) AS rank FROM t) WHERE rank <= 3""",
    "variants"))
def top01_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Top 3 words per type by frequency (ties by word)."""
    t = (_v(spark, sf).select("ptype", F.explode(F.split("name", " ")).alias("term"))
         .groupBy("ptype", "term").agg(F.count(F.lit(1)).alias("weight")))
    return G.top_k_per_group(t, ["ptype"], [F.col("weight").desc(), F.col("term")], 3)


@register("top02_first_last_grid", with_views(f"""{BEST_ROWS}, sw AS (
  SELECT b.run, g.j, count(*) FILTER (WHERE score >= g.t AND label = 1) AS tp, count(*) FILTER (WHERE score >= g.t) AS sel
  FROM bp b, (SELECT CAST(j AS INTEGER) AS j, CAST(j AS DOUBLE) / 100.0 AS t FROM range(100) r(j)) g GROUP BY b.run, g.j)
SELECT run, min(j) FILTER (WHERE sel > 0 AND CAST(tp AS DOUBLE) / sel >= 0.5) AS first_j,
  max(j) FILTER (WHERE sel > 0 AND CAST(tp AS DOUBLE) / sel >= 0.5) AS last_j FROM sw GROUP BY run""", "pred"))
def top02_first_last_grid(spark: SparkSession, sf: str) -> DataFrame:
    """First and last grid cut (score >= j/100) whose precision reaches 0.5."""
    from varlens.plans.q_archive import best_st
    from pyspark.sql import Window
    bt = best_st(spark, sf)
    cell = F.least(F.floor(F.col("score") * 100.0).cast("int"), F.lit(99))
    # exact: the largest j with j/100 <= score
    cell = F.when((cell + 1 <= 99) & ((cell + 1).cast("double") / 100.0 <= F.col("score")), cell + 1).otherwise(
        F.when(cell.cast("double") / 100.0 > F.col("score"), cell - 1).otherwise(cell))
    per = bt.select("run", cell.alias("j"), "pos", "neg").groupBy("run", "j").agg(
        F.sum("pos").alias("c_tp"), F.sum(F.col("pos") + F.col("neg")).alias("c_sel"))
    grid = spark.range(100).select(F.col("id").cast("int").alias("j"))
    g = per.select("run").distinct().crossJoin(grid).join(per, ["run", "j"], "left").na.fill(0, ["c_tp", "c_sel"])
    w = Window.partitionBy("run").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    c = g.select("run", "j", F.sum("c_tp").over(w).alias("tp"), F.sum("c_sel").over(w).alias("sel"))
    ok = (F.col("sel") > 0) & (F.col("tp") / F.col("sel") >= 0.5)
    return c.groupBy("run").agg(F.min(F.when(ok, F.col("j"))).alias("first_j"), F.max(F.when(ok, F.col("j"))).alias("last_j"))


@register("lim01_preview", with_views("SELECT id, gene, feature FROM variants ORDER BY feature DESC, id LIMIT 5", "variants"))
def lim01_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Head preview: the 5 highest-priced rows (the limit is the feature)."""
    return G.preview(_v(spark, sf).select("id", "gene", "feature"), [F.col("feature").desc(), F.col("id")], 5)
