"""Registered queries: feature encoding and scaling (FEA-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.operators import features as X
from varlens.operators import arrays as A
from varlens.operators import preparation as PR
from varlens.plans.catalog import r6, register
from varlens.plans.views import variants_view, with_views
from varlens.sources.tables import table

_TXT = """'"' || lower(ptype) || ',' || split_part(name, ' ', 1) || ';' || lower(ptype) || '"'"""


@register("fea01_multi_hot", with_views(f"""SELECT term, count(DISTINCT id) AS n FROM (
  SELECT id, unnest(string_split_regex(replace({_TXT}, '"', ''), '[,;]')) AS term FROM variants) GROUP BY term""",
    "variants"))
def fea01_multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted ','/';' term strings to 0/1 long form (duplicates once); rows per term."""
    v = variants_view(spark, sf)
    txt = F.concat(F.lit('"'), F.lower("ptype"), F.lit(","), F.get(F.split("name", " "), 0), F.lit(";"),
                   F.lower("ptype"), F.lit('"'))
    long = X.multi_hot_long(v, "id", X.term_list(txt))
    return long.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@register("fea02_categorical_index", with_views("""SELECT ptype, CAST(row_number() OVER (ORDER BY count(*) DESC, ptype) - 1 AS DOUBLE) AS idx,
  count(*) AS n FROM variants GROUP BY ptype""", "variants"))
def fea02_categorical_index(spark: SparkSession, sf: str) -> DataFrame:
    """StringIndexer order (frequency, ties alphabetical) behind the one-hot vectors."""
    out, _ = X.index_categories(variants_view(spark, sf).select("id", "ptype"), "ptype", "ptype_vec")
    return out.groupBy("ptype", F.col("ptype_vec_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n"))


@register("fea02_one_hot", with_views("""WITH c AS (SELECT ptype, row_number() OVER (ORDER BY count(*) DESC, ptype) - 1 AS idx FROM variants GROUP BY ptype),
n AS (SELECT count(*) AS n FROM c)
SELECT id, array_to_string(list_transform(range(0, n), lambda i: CASE WHEN i = idx THEN '1' ELSE '0' END), ',') AS one_hot
FROM variants v JOIN c ON v.ptype = c.ptype, n""", "variants"))
def fea02_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The one-hot vectors, one place a category (the places kept for unseen
    values, all 0 here, are left out)."""
    from pyspark.ml.functions import vector_to_array
    out, model = X.index_categories(variants_view(spark, sf).select("id", "ptype"), "ptype", "v")
    places = F.slice(vector_to_array("v"), 1, len(model.stages[0].labels))
    return out.select("id", F.array_join(F.transform(places, lambda x: x.cast("int").cast("string")), ",").alias("one_hot"))


@register("fea05_first_per_key", with_views("""SELECT gene, id, position FROM (
  SELECT gene, id, position, row_number() OVER (PARTITION BY gene ORDER BY position, id) AS rn FROM variants) WHERE rn = 1""",
    "variants"))
def fea05_first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates dropped, then the first row per gene by (position, id)."""
    v = variants_view(spark, sf).select("gene", "id", "position")
    return X.keep_first_per_key(v, "gene", [F.col("position"), F.col("id")])


@register("fea06_constant_impute", with_views(f"""SELECT id, {r6('coalesce(CASE WHEN position % 7 = 0 THEN NULL ELSE feature END, 0.0)', 'f')}
FROM variants""", "variants"))
def fea06_constant_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values set to 0."""
    v = variants_view(spark, sf).select("id", F.when(F.col("position") % 7 == 0, F.lit(None)).otherwise(
        F.col("feature")).alias("f"))
    return v.na.fill(0.0, ["f"])


@register("fea07_standardize_train_test", with_views(f"""WITH x AS (SELECT id, position % 2 AS part,
    CASE WHEN position % 7 = 0 THEN NULL ELSE feature END AS f FROM variants),
st AS (SELECT avg(f) AS m, stddev_pop(f) AS s FROM x WHERE part = 0)
SELECT id, {r6('CASE WHEN s > 0 THEN (coalesce(f, m) - m) / s ELSE 0.0 END', 'f')} FROM x, st WHERE part = 1""",
    "variants"))
def fea07_standardize_train_test(spark: SparkSession, sf: str) -> DataFrame:
    """Mean imputation and z-score fitted on the training half, applied to the test half."""
    x = variants_view(spark, sf).select("id", (F.col("position") % 2).alias("part"), F.when(
        F.col("position") % 7 == 0, F.lit(None)).otherwise(F.col("feature")).alias("f"))
    stats = X.fit_standard(x.where(F.col("part") == 0), ["f"])
    return X.apply_standard(x.where(F.col("part") == 1).select("id", "f"), stats, ["f"])


@register("fea08_zscore_matrix", with_views(f"""WITH x AS (SELECT id, position % 2 AS part, CASE WHEN position % 7 = 0 THEN 0.0 ELSE feature END AS f,
    CAST(position AS DOUBLE) AS g, 5.0 AS h FROM variants),
st AS (SELECT avg(f) AS mf, stddev_pop(f) AS sf, avg(g) AS mg, stddev_pop(g) AS sg FROM x WHERE part = 0)
SELECT id, {r6('(f - mf) / sf', 'f')}, {r6('(g - mg) / sg', 'g')}, {r6('0.0', 'h')} FROM x, st WHERE part = 1""", "variants"))
def fea08_zscore_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Feature matrix with missing values 0, z-scores fitted on the training half
    and applied to the test half; a constant column gives 0."""
    x = variants_view(spark, sf).select("id", (F.col("position") % 2).alias("part"), F.when(F.col("position") % 7 != 0, F.col("feature")).alias("f"),
                                        F.col("position").cast("double").alias("g"), F.lit(5.0).alias("h")).na.fill(0.0, ["f"])
    cols = ["f", "g", "h"]
    return X.apply_standard(x.where("part = 1").select("id", *cols), X.fit_standard(x.where("part = 0"), cols), cols, impute=False)


@register("fea09_axis_normalize", f"""WITH x AS (SELECT vec_id, d.dim, CAST(d.x AS DOUBLE) AS x FROM embeddings,
  LATERAL (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x) d),
st AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY dim)
SELECT vec_id, CAST(x.dim AS INTEGER) AS dim, {r6('(x - m) / (s + 1e-8)', 'x')} FROM x JOIN st ON x.dim = st.dim""")
def fea09_axis_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Per-feature normalisation of the (vector, feature) tensor in long form."""
    long = A.explode_dims(table(spark, sf, "embeddings"), ["vec_id"], "embedding")
    return X.axis_normalize(long, "dim")


@register("fea10_tfidf", with_views(f"""WITH t AS (SELECT DISTINCT gene, unnest(string_split(name, ' ')) AS term FROM variants),
nd AS (SELECT count(DISTINCT gene) AS n FROM t),
df AS (SELECT term, count(DISTINCT gene) AS d FROM t GROUP BY term),
w AS (SELECT t.gene, t.term, ln((1.0 + n) / (1.0 + d)) + 1.0 AS w FROM t JOIN df ON t.term = df.term, nd),
nr AS (SELECT gene, sqrt(sum(w * w)) AS nrm FROM w GROUP BY gene)
SELECT w.gene, w.term, {r6('w.w / nr.nrm', 'tfidf')} FROM w JOIN nr ON w.gene = nr.gene""", "variants"))
def fea10_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed TF-IDF of the genes' 0/1 word matrix, rows at unit L2 norm."""
    t = variants_view(spark, sf).select("gene", F.explode(F.split("name", " ")).alias("term")).distinct()
    return X.tfidf_long(t.withColumn("value", F.lit(1.0)), "gene").withColumnRenamed("gene", "gene")


@register("fea11_pad_lists", with_views("""WITH l AS (SELECT id, list_transform(string_split(name, ' '), lambda w: length(w)) AS a FROM variants)
SELECT id, (SELECT max(len(a)) FROM l) AS n, list_sum(a) AS total FROM l""", "variants"))
def fea11_pad_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Word-length lists padded with 0 to the longest list."""
    v = variants_view(spark, sf).select("id", F.transform(F.split("name", " "), lambda w: F.length(w)).alias("a"))
    p = X.pad_lists(v, "a", "padded")
    return p.select("id", F.size("padded").alias("n"),
                    F.aggregate("padded", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def _axis_sql(axis: str) -> str:
    return f"""WITH x AS (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS residue, embedding FROM embeddings),
c AS (SELECT label, residue, d.dim, CAST(d.x AS DOUBLE) AS x FROM x, LATERAL (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x) d),
st AS (SELECT {axis}, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY {axis})
SELECT c.label, c.residue, CAST(c.dim AS INTEGER) AS dim, {r6('(x - m) / (s + 1e-8)', 'x')} FROM c JOIN st ON c.{axis} = st.{axis}"""


def _tensor(spark: SparkSession, sf: str) -> DataFrame:
    """(sample, residue, feature) cells: the vectors of one label in order."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").alias("vec"))
    return A.explode_dims(A.residues(e, "label", "vec_id", "vec"), ["label", "residue"], "vec")


@register("fea09_axis_sample", _axis_sql("label"))
def fea09_axis_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Normalisation per sample, over residues and features."""
    return X.axis_normalize(_tensor(spark, sf), "label")


@register("fea09_axis_residue", _axis_sql("residue"))
def fea09_axis_residue(spark: SparkSession, sf: str) -> DataFrame:
    """Normalisation per residue, over samples and features."""
    return X.axis_normalize(_tensor(spark, sf), "residue")


# --- composed preparation -----------------------------------------------------

_ANN_SQL = """ann AS (SELECT id AS VarID, gene, label_txt AS netChange, name AS sequence, CASE WHEN position % 7 = 0 THEN NULL ELSE feature END AS AM,
    CASE WHEN position % 5 = 0 THEN NULL ELSE CAST(position AS DOUBLE) END AS esm_llr,
    CASE WHEN position % 11 = 0 THEN '"HP:9999998"' ELSE '"' || split_part(name, ' ', 1) || ',' || lower(ptype) || '"' END AS hpo,
    '"' || lower(ptype) || ',' || gene || '"' AS parents, split_part(name, ' ', 2) || ';' || gene AS go FROM variants)"""


def _terms_sql(rows: str) -> str:
    """Sparse rows of the merged frame ``rows``."""
    return f"""e AS (SELECT DISTINCT VarID, 0 AS enc, unnest(string_split(trim(hpo, '"'), ',')) AS term FROM {rows}
  UNION ALL SELECT DISTINCT VarID, 1, unnest(string_split(trim(parents, '"'), ',')) FROM {rows}
  UNION ALL SELECT DISTINCT VarID, 2, unnest(string_split(trim(go, '"'), ';')) FROM {rows}),
voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM (SELECT DISTINCT term FROM e WHERE term <> '')),
t AS (SELECT VarID, place, count(*) AS value FROM e JOIN voc ON e.term = voc.term GROUP BY VarID, place),
sp AS (SELECT VarID, count(*) AS n_terms, md5(string_agg(place || ':' || value, ',' ORDER BY place)) AS terms_md5 FROM t GROUP BY VarID)"""


def _annotated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Variants, and annotations with the columns that the preparation handles."""
    v = variants_view(spark, sf).withColumnRenamed("id", "VarID")
    word = lambda i: F.coalesce(F.get(F.split("name", " "), i), F.lit(""))
    ann = v.select(
        "VarID", "gene", F.when(F.col("position") % 7 != 0, F.col("feature")).alias("AM"),
        F.when(F.col("position") % 5 != 0, F.col("position").cast("double")).alias("esm_llr"),
        F.col("feature").alias("rel_brain"), F.col("feature").alias("abs_brain"), "position", F.lit("x").alias("MIM"),
        F.when(F.col("position") % 11 == 0, F.lit('"HP:9999998"')).otherwise(F.concat(F.lit('"'), word(0), F.lit(","), F.lower("ptype"), F.lit('"'))).alias("HPOTerms"),
        F.concat(F.lit('"'), F.lower("ptype"), F.lit(","), F.col("gene"), F.lit('"')).alias("HPOTermParents"),
        F.concat(word(1), F.lit(";"), F.col("gene")).alias("GOTerms"))
    return v.select("VarID", "gene", F.col("label_txt").alias("netChange"), F.col("name").alias("sequence")), ann


def _reloaded(spark: SparkSession, fitted: PR.Preparation) -> PR.Preparation:
    from varlens.sources.io import scratch_dir
    path = scratch_dir(spark, "preparation")
    fitted.save(path)
    return PR.Preparation.load(spark, path)


def _terms_md5() -> list:
    pairs = F.zip_with("terms", "values", lambda p, v: F.concat(p.cast("string"), F.lit(":"), v.cast("string")))
    return [F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join(pairs, ",")).alias("terms_md5")]


@register("fea03_prepare_annotations", with_views(f"""WITH {_ANN_SQL}, {_terms_sql("ann")}
SELECT ann.VarID, gene, {r6('AM', 'AM')}, {r6('esm_llr', 'esm_llr')}, n_terms, terms_md5 FROM ann JOIN sp ON ann.VarID = sp.VarID""", "variants"))
def fea03_prepare_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations through a fitted, saved and loaded preparation: dropped
    columns, three term encoders with equal names added, as sparse rows."""
    _, ann = _annotated(spark, sf)
    prepared = _reloaded(spark, PR.Preparation().fit_annotations(ann)).annotations(ann)
    return prepared.select(*[c for c in prepared.columns if c not in ("terms", "values")], *_terms_md5())


@register("fea04_prepare_dataset", with_views(f"""WITH {_ANN_SQL}, m AS (SELECT * FROM ann WHERE netChange <> 'neutral'),
means AS (SELECT avg(AM) AS am, avg(esm_llr) AS llr FROM m), k AS (SELECT * FROM m WHERE hpo <> '"HP:9999998"'), {_terms_sql("k")}
SELECT k.VarID, gene, CASE netChange WHEN 'lof' THEN 0 WHEN 'gof' THEN 1 END AS netChange, sequence, {r6('coalesce(k.AM, means.am)', 'AM')},
  {r6('coalesce(k.esm_llr, means.llr)', 'esm_llr')}, n_terms, terms_md5 FROM k JOIN sp ON k.VarID = sp.VarID, means""", "variants"))
def fea04_prepare_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The whole preparation: non-neutral variants, annotations joined, means
    filled, labels encoded, variants without terms dropped, terms encoded."""
    variants, ann = _annotated(spark, sf)
    prepared = _reloaded(spark, PR.Preparation(keep_only_hpo=True).fit(variants, ann)).dataset(variants, ann)
    return prepared.select(*[c for c in prepared.columns if c not in ("terms", "values")], *_terms_md5())
