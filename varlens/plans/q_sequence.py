"""Registered queries: sequence edits and embedding arrays (SEQ-*, EMB-*, AGG-17)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.operators import arrays as A
from varlens.operators import sequence as Q
from varlens.operators import stats as S
from varlens.plans.catalog import r6, register
from varlens.sources.tables import table

_CONV = "(SELECT conv_id, turn, text, (conv_id * 7 + turn * 3) % length(text) + 1 AS pos FROM conversations WHERE length(text) > 0)"


def _conv(spark, sf):
    c = table(spark, sf, "conversations").where(F.length("text") > 0)
    return c.withColumn("pos", ((F.col("conv_id") * 7 + F.col("turn") * 3) % F.length("text") + 1).cast("int"))


@register("seq01_apply_mutation", f"""SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos,
  md5(substr(text, 1, pos - 1) || 'X' || substr(text, pos + 1)) AS mutant_md5 FROM {_CONV}""")
def seq01_apply_mutation(spark: SparkSession, sf: str) -> DataFrame:
    """Point mutation to X at a site of every conversation turn (reference checked)."""
    c = _conv(spark, sf)
    ref = F.substring("text", F.col("pos"), 1)
    m = Q.apply_mutation(F.col("text"), F.col("pos"), ref, F.lit("X"))
    return c.select("conv_id", "turn", "pos", F.md5(m).alias("mutant_md5"))


@register("seq02_revert_mutation", f"""SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, true AS restored FROM {_CONV}""")
def seq02_revert_mutation(spark: SparkSession, sf: str) -> DataFrame:
    """Mutate, then revert with the mutant residue checked; the wild type comes back."""
    c = _conv(spark, sf)
    ref = F.substring("text", F.col("pos"), 1)
    m = Q.apply_mutation(F.col("text"), F.col("pos"), ref, F.lit("X"))
    back = Q.revert_mutation(m, F.col("pos"), ref, F.lit("X"))
    return c.select("conv_id", "turn", "pos", (back == F.col("text")).alias("restored"))


_DOC = "(SELECT doc_id, text, length(text) AS n, (doc_id * 13) % length(text) + 1 AS pos FROM documents WHERE length(text) > 0)"


def _docs(spark, sf):
    d = table(spark, sf, "documents").where(F.length("text") > 0)
    return d.select("doc_id", "text", F.length("text").alias("n"),
                    ((F.col("doc_id") * 13) % F.length("text") + 1).cast("int").alias("pos"))


@register("seq03_truncate_site", f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(t) AS n_out, md5(t) AS trunc_md5 FROM (
  SELECT doc_id, pos, CASE WHEN n <= 1022 THEN text WHEN pos < 511 THEN substr(text, 1, 1022)
    WHEN pos >= n - 511 THEN substr(text, n - 1022 + 1, 1022)
    ELSE substr(text, greatest(0, pos - 510) + 1, least(n, pos + 512) - greatest(0, pos - 510)) END AS t FROM {_DOC})""")
def seq03_truncate_site(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents cut to at most 1022 characters around a site."""
    d = _docs(spark, sf)
    t = Q.truncate_around(F.col("text"), F.col("pos"))
    return d.select("doc_id", "pos", F.length(t).alias("n_out"), F.md5(t).alias("trunc_md5"))


@register("seq04_apply_all_variants", """WITH v AS (SELECT doc_id, CAST((doc_id * k) % length(text) + 1 AS INTEGER) AS position,
    chr(CAST(96 + k AS INTEGER)) AS alt, k FROM documents, range(1, 6) r(k) WHERE length(text) > 0),
last AS (SELECT doc_id, position, arg_max(alt, k) AS alt FROM v GROUP BY doc_id, position),
ch AS (SELECT doc_id, CAST(p AS INTEGER) AS position, substr(text, p, 1) AS ch FROM documents, range(1, length(text) + 1) r(p)),
m AS (SELECT ch.doc_id, ch.position, coalesce(last.alt, ch.ch) AS c,
   CASE WHEN last.alt IS NOT NULL AND last.alt <> ch.ch THEN 1 ELSE 0 END AS changed
   FROM ch LEFT JOIN last ON ch.doc_id = last.doc_id AND ch.position = last.position)
SELECT doc_id, md5(string_agg(c, '' ORDER BY position)) AS seq_md5, CAST(sum(changed) AS BIGINT) AS n_changed
FROM m GROUP BY doc_id""")
def seq04_apply_all_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Five variants per document written into the whole text, later ones winning."""
    d = table(spark, sf, "documents").where(F.length("text") > 0)
    ks = spark.range(1, 6).select(F.col("id").alias("k"))
    v = d.crossJoin(ks).select("doc_id", ((F.col("doc_id") * F.col("k")) % F.length("text") + 1).cast("int").alias(
        "position"), F.expr("chr(96 + k)").alias("alt"), "k")
    out = Q.apply_all_variants(d.select("doc_id", "text"), v, "doc_id", "text", "k")
    return out.select("doc_id", F.md5("sequence").alias("seq_md5"), F.col("n_changed").cast("long").alias("n_changed"))


@register("seq05_single_mutants", """SELECT conv_id, turn, count(*) AS n_mutants,
  CAST(sum(CASE WHEN aa <> substr(text, p, 1) THEN 1 ELSE 0 END) AS BIGINT) AS n_changed,
  min(md5(substr(text, 1, p - 1) || aa || substr(text, p + 1))) AS first_md5, max(md5(substr(text, 1, p - 1) || aa || substr(text, p + 1))) AS last_md5
FROM conversations, range(1, length(text) + 1) r(p),
  (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS aa) a
GROUP BY conv_id, turn""")
def seq05_single_mutants(spark: SparkSession, sf: str) -> DataFrame:
    """All single mutants (positions x 20 amino acids) of every turn: counts,
    and the least and greatest md5 of the mutants' texts."""
    c = table(spark, sf, "conversations")
    m = Q.single_mutants(c.select("conv_id", "turn", "text"), ["conv_id", "turn"], "text", digests=True)
    return m.groupBy("conv_id", "turn").agg(F.sum("n_mutants").alias("n_mutants"), F.sum("n_changed").alias("n_changed"),
                                            F.min("first_md5").alias("first_md5"), F.max("last_md5").alias("last_md5"))


_TOK = "[" + ", ".join(f"'{t}'" for t in Q.TAG_TOKENS) + "]"


@register("seq06_gene_tags", f"""SELECT p_brand, {_TOK}[i + 1] || {_TOK}[CASE WHEN jr >= i THEN jr + 1 ELSE jr END + 1] AS tag FROM (
  SELECT p_brand, CAST(g // 24 AS INTEGER) AS i, CAST(g % 24 AS INTEGER) AS jr FROM (
    SELECT p_brand, row_number() OVER (ORDER BY md5(p_brand || '|0'), p_brand) - 1 AS g
    FROM (SELECT DISTINCT p_brand FROM part)))""")
def seq06_gene_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A unique ordered token pair per gene (brand), in seeded hash order."""
    return Q.gene_tags(table(spark, sf, "part"), "p_brand", 0)


@register("seq07_clipped_site", f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN n + 2 <= 1022 THEN pos WHEN pos < 511 THEN pos
  WHEN pos >= n + 2 - 511 THEN 1024 - (n + 2 - pos) - 1 ELSE 512 END AS BIGINT) AS site FROM {_DOC}""")
def seq07_clipped_site(spark: SparkSession, sf: str) -> DataFrame:
    """Site index inside the truncated model input (length counts 2 special tokens)."""
    d = _docs(spark, sf)
    return d.select("doc_id", "pos", Q.clipped_site(F.col("pos"), F.col("n") + 2).cast("long").alias("site"))


# --- embeddings: sample = label, residues = vectors in vec_id order ----------

_RESQ = """res AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS residue,
    embedding AS vec FROM embeddings),
nl AS (SELECT label, count(*) AS n FROM res GROUP BY label)"""


def _res(spark, sf):
    e = table(spark, sf, "embeddings")
    return A.residues(e.select("label", "vec_id", F.col("embedding").alias("vec")), "label", "vec_id", "vec")


def _vsum(c):
    return F.aggregate(F.transform(c, lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)


_VSUM = "list_reduce(list_transform({v}, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b)"


@register("emb01_site_window", f"""WITH {_RESQ},
sites AS (SELECT label, CAST((label * 13) % n AS INTEGER) AS site FROM nl),
w AS (SELECT s.label, s.site, CAST(o AS INTEGER) AS "offset", CAST(s.site + o AS INTEGER) AS residue FROM sites s, range(-3, 4) r(o))
SELECT w.label, w.site, w."offset", w.residue, CASE WHEN res.vec IS NULL THEN 1 ELSE 0 END AS mask,
  {r6('coalesce(CAST(res.vec[1] AS DOUBLE), 0.0)', 'x0')}, {r6('coalesce(' + _VSUM.format(v='res.vec') + ', 0.0)', 'total')}
FROM w LEFT JOIN res ON w.label = res.label AND w.residue = res.residue""")
def emb01_site_window(spark: SparkSession, sf: str) -> DataFrame:
    """2w+1 rows around a site per sample, zero rows and mask 1 outside."""
    res = _res(spark, sf)
    n = res.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sites = n.select("label", ((F.col("label") * 13) % F.col("n")).cast("int").alias("site"))
    w = A.window_rows(res, sites, "label", "site", 3, 64)
    return w.select("label", "site", "offset", "residue", "mask", F.get("vec", 0).cast("double").alias("x0"),
                    _vsum(F.col("vec")).alias("total"))


@register("emb02_window_inside", f"""WITH {_RESQ},
b AS (SELECT label, n, CAST((label * 13) % n AS BIGINT) AS p FROM nl),
se AS (SELECT label, CASE WHEN p + 8 >= n THEN greatest(0, n - 8) ELSE greatest(0, p - 4) END AS s,
              CASE WHEN p - 8 < 0 THEN least(8, n) ELSE least(n, p + 4) END AS e FROM b)
SELECT se.label, CAST(8 - (e - s) + (res.residue - s) AS INTEGER) AS idx, res.residue FROM se
JOIN res ON res.label = se.label AND res.residue >= se.s AND res.residue < se.e""")
def emb02_window_inside(spark: SparkSession, sf: str) -> DataFrame:
    """A window of 8 rows kept inside each sample; short windows are padded
    in front, so idx counts from the padded start."""
    res = _res(spark, sf)
    n = res.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("p", (F.col("label") * 13) % F.col("n"))
    s, e = A.window_inside(F.col("n"), F.col("p"), 8)
    se = n.select("label", s.alias("s"), e.alias("e"))
    j = res.join(se, "label").where((F.col("residue") >= F.col("s")) & (F.col("residue") < F.col("e")))
    return j.select("label", (8 - (F.col("e") - F.col("s")) + (F.col("residue") - F.col("s"))).cast("int").alias("idx"),
                    "residue")


@register("emb03_site_difference", f"""WITH {_RESQ}
SELECT m.label, {r6(_VSUM.format(v='list_transform(list_zip(m.vec, w.vec), lambda z: z[1] - z[2])'), 'diff_total')},
  {r6('CAST(m.vec[1] AS DOUBLE) - CAST(w.vec[1] AS DOUBLE)', 'diff0')}
FROM res m JOIN res w ON w.label = 0 AND m.residue = 5 AND w.residue = 5 WHERE m.label > 0""")
def emb03_site_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Mutant vector minus wild-type vector at the site (sample 0 is the wild type)."""
    res = _res(spark, sf).where(F.col("residue") == 5)
    wt = res.where(F.col("label") == 0).select(F.col("vec").alias("wt"))
    m = res.where(F.col("label") > 0).crossJoin(wt)  # one wild-type row
    d = A.vec_diff(F.col("vec"), F.col("wt"))
    return m.select("label", _vsum(d).alias("diff_total"),
                    (F.get("vec", 0).cast("double") - F.get("wt", 0).cast("double")).alias("diff0"))


_PREFIXES = ["SC", "CA", "KC", "SH", "HC"]


@register("emb04_pad_family", f"""WITH {_RESQ}
SELECT label, ['SC', 'CA', 'KC', 'SH', 'HC'][label % 5 + 1] AS prefix, n AS n_res,
  CASE label % 5 WHEN 0 THEN 2016 WHEN 1 THEN 2506 WHEN 2 THEN 1236 WHEN 3 THEN 655 ELSE 889 END AS target,
  CASE label % 5 WHEN 0 THEN 2016 WHEN 1 THEN 2506 WHEN 2 THEN 1236 WHEN 3 THEN 655 ELSE 889 END - n AS n_pad FROM nl""")
def emb04_pad_family(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to pad (or crop, when negative) to the family's maximum length."""
    n = _res(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n_res"))
    pre = F.get(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("label") % 5).cast("int"))
    t = n.withColumn("prefix", pre).withColumn("target", A.pad_length(F.col("prefix")))
    return t.select("label", "prefix", "n_res", "target", (F.col("target") - F.col("n_res")).alias("n_pad"))


@register("emb05_pad_batch", f"""WITH {_RESQ} SELECT label, n AS n_res, 2018 - n AS n_pad FROM nl""")
def emb05_pad_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Zero rows needed to pad every sample to the fixed batch length."""
    n = _res(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n_res"))
    return n.select("label", "n_res", (F.lit(A.BATCH_LEN) - F.col("n_res")).alias("n_pad"))


@register("emb06_contact_row", f"""WITH {_RESQ}
SELECT res.label, {r6('CAST(res.vec[1] AS DOUBLE)', 'x0')}, {r6(_VSUM.format(v='res.vec'), 'total')}
FROM res JOIN nl ON res.label = nl.label WHERE res.residue = (res.label * 7) % nl.n""")
def emb06_contact_row(spark: SparkSession, sf: str) -> DataFrame:
    """Row (site - 1) of each sample's matrix."""
    res = _res(spark, sf)
    n = res.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    j = res.join(n, "label").where(F.col("residue") == (F.col("label") * 7) % F.col("n"))
    return j.select("label", F.get("vec", 0).cast("double").alias("x0"), _vsum(F.col("vec")).alias("total"))


@register("emb07_dim_rank_test", f"""WITH x AS (SELECT CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS g, d.dim, CAST(d.x AS DOUBLE) AS x
    FROM embeddings, LATERAL (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x) d),
v AS (SELECT dim, x, count(*) AS n, sum(g) AS n1v FROM x GROUP BY dim, x),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY dim ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
     + (n + 1) / 2.0 AS rank FROM v),
u AS (SELECT dim, CAST(sum(n1v) AS BIGINT) AS n1, CAST(sum(n) - sum(n1v) AS BIGINT) AS n2,
    sum(n1v * rank) - sum(n1v) * (sum(n1v) + 1) / 2.0 AS u1 FROM r GROUP BY dim),
m AS (SELECT dim, avg(x) FILTER (WHERE g = 1) - avg(x) FILTER (WHERE g = 0) AS mean_diff FROM x GROUP BY dim)
SELECT u.dim, n1, n2, {r6('u1', 'u1')}, {r6('mean_diff', 'mean_diff')} FROM u JOIN m ON u.dim = m.dim""")
def emb07_dim_rank_test(spark: SparkSession, sf: str) -> DataFrame:
    """Per embedding dimension: Mann-Whitney U between the vectors with a
    positive first element and the others, and the difference of means."""
    e = table(spark, sf, "embeddings").withColumn("g", F.when(F.get("embedding", 0) > 0, 1).otherwise(0))
    x = A.explode_dims(e, ["g"], "embedding")
    u = S.mann_whitney(x, ["dim"], "g", "x")
    m = x.groupBy("dim").agg((F.avg(F.when(F.col("g") == 1, F.col("x"))) - F.avg(F.when(F.col("g") == 0, F.col("x"))))
                             .alias("mean_diff"))
    return u.join(m, "dim").select("dim", F.col("n1").cast("long"), F.col("n2").cast("long"), "u1", "mean_diff")


@register("emb07_dim_rank_fdr")
def emb07_dim_rank_fdr(spark: SparkSession, sf: str) -> DataFrame:
    """Per-dimension rank test with normal-approximation p-values (tie
    and continuity corrected), Benjamini-Hochberg adjusted; the dimensions below
    0.05, most significant first.
    The tail is a vectorised pandas UDF over the per-dimension table."""
    from varlens.functions import tails

    u = emb07_dim_rank_test(spark, sf)

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.abs().map(lambda v: min(1.0, 2.0 * tails.norm_sf(v)))

    e = table(spark, sf, "embeddings").withColumn("g", F.when(F.get("embedding", 0) > 0, 1).otherwise(0))
    x = A.explode_dims(e, ["g"], "embedding")
    ties = x.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("t")).groupBy("dim").agg(
        F.sum(F.col("t") ** 3 - F.col("t")).alias("tt"))
    j = u.join(ties, "dim")
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("tt") / (n * (n - 1))))
    gap = F.col("u1") - F.col("n1") * F.col("n2") / 2.0
    z = F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / sd  # continuity correction
    p = j.withColumn("z", z).withColumn("p", two_sided(F.col("z")))
    adj = S.adjust_pvalues(p.select("dim", "u1", "mean_diff", "z", "p"), [], "p", "dim")
    return adj.where(F.col("p_bh") < 0.05).orderBy("p_bh", "dim")


@register("emb08_scan_moments", f"""WITH {_RESQ},
x AS (SELECT res.residue, d.dim, CAST(d.x AS DOUBLE) AS x FROM res,
  LATERAL (SELECT generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS x) d)
SELECT residue, CAST(dim AS INTEGER) AS dim, count(x) AS count, {r6('avg(x)', 'mean')}, {r6('var_pop(x)', 'var_pop')},
  {r6('CASE WHEN count(x) >= 2 THEN var_samp(x) END', 'var_samp')} FROM x GROUP BY residue, dim""")
def emb08_scan_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and variance over samples per residue and feature."""
    x = A.explode_dims(_res(spark, sf), ["residue"], "vec")
    return A.moments(x, ["residue", "dim"])


@register("agg17_running_moments", f"""WITH x AS (SELECT label, CAST(d.x AS DOUBLE) AS x FROM embeddings,
  LATERAL (SELECT unnest(embedding) AS x) d)
SELECT label, count(x) AS count, {r6('avg(x)', 'mean')}, {r6('var_pop(x)', 'var_pop')},
  {r6('CASE WHEN count(x) >= 2 THEN var_samp(x) END', 'var_samp')} FROM x GROUP BY label""")
def agg17_running_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Mergeable moments (count, mean, population and sample variance) per label."""
    x = A.explode_dims(table(spark, sf, "embeddings"), ["label"], "embedding")
    return A.moments(x, ["label"])


@register("agg17_streaming_moments", f"""WITH x AS (SELECT label, CAST(d.x AS DOUBLE) AS x FROM embeddings,
  LATERAL (SELECT unnest(embedding) AS x) d)
SELECT label, count(x) AS count, {r6('avg(x)', 'mean')}, {r6('var_pop(x)', 'var_pop')},
  {r6('var_samp(x)', 'var_samp')} FROM x GROUP BY label""")
def agg17_streaming_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The moments of AGG-17 computed by a streaming query over the
    embedding rows, which are written as a folder of files and consumed
    incrementally (availableNow trigger)."""
    from varlens.sources.io import scratch_dir
    from varlens.streaming.moments import run_to_folder, streaming_moments
    folder = scratch_dir(spark, "stream-in")
    e = table(spark, sf, "embeddings").select("label", "embedding")
    e.repartition(4, "label").write.parquet(folder)
    out = run_to_folder(streaming_moments(spark, folder, "label int, embedding array<float>", "label", "embedding"),
                        scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-ckpt"))
    return out.select("label", "count", "mean", "var_pop", "var_samp")

# --- padded matrices ----------------------------------------------------------

_ZERO = "list_transform(range(64), lambda i: CAST(0 AS FLOAT))"
_MICRO = "array_to_string(list_transform(vec, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS VARCHAR)), ',')"


def _matrix_sql(cells: str) -> str:
    """``cells``: a query of (label, idx, vec)."""
    return f"""m AS ({cells})
SELECT label, count(*) AS n_rows, md5(string_agg(md5({_MICRO}), '' ORDER BY idx)) AS matrix_md5 FROM m GROUP BY label"""


def _sizes(res: DataFrame) -> DataFrame:
    return res.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("n"))


@register("emb02_window_matrix", f"""WITH {_RESQ},
b AS (SELECT label, n, CAST((label * 13) % n AS BIGINT) AS p FROM nl),
se AS (SELECT label, CASE WHEN p + 8 >= n THEN greatest(0, n - 8) ELSE greatest(0, p - 4) END AS s,
              CASE WHEN p - 8 < 0 THEN least(8, n) ELSE least(n, p + 4) END AS e FROM b),
{_matrix_sql(f"""SELECT se.label, i AS idx, coalesce(res.vec, {_ZERO}) AS vec FROM se, range(greatest(0, e - s - 8), 8) r(i)
  LEFT JOIN res ON res.label = se.label AND res.residue = i - (8 - (e - s)) + s AND res.residue >= s""")}""")
def emb02_window_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The window of 8 rows kept inside each sample as a matrix of 8 rows, zero
    rows in front."""
    res = _res(spark, sf)
    n = _sizes(res).withColumn("p", (F.col("label") * 13) % F.col("n"))
    s, e = A.window_inside(F.col("n"), F.col("p"), 8)
    sizes = n.select("label", s.cast("int").alias("start"), (e - s).cast("int").alias("n"), F.lit(8).alias("length"))
    return A.matrix_md5(A.padded(res, sizes, "label", "length", 64, in_front=True), "label")


@register("emb03_site_stack", f"""WITH {_RESQ},
m AS (SELECT m.label, m.vec AS mv, w.vec AS wv FROM res m JOIN res w ON w.label = 0 AND m.residue = w.residue
  JOIN nl ON nl.label = m.label WHERE m.label > 0 AND m.residue = (m.label * 5) % nl.n)
SELECT label, md5(md5(array_to_string(list_transform(range(1, len(mv) + 1), lambda i: CAST(CAST(floor(CAST(mv[i] - wv[i] AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS VARCHAR)), ','))
  || md5({_MICRO.replace("(vec,", "(wv,")})) AS matrix_md5, CAST(2 AS BIGINT) AS n_rows FROM m""")
def emb03_site_stack(spark: SparkSession, sf: str) -> DataFrame:
    """Difference from the wild type at each sample's site, stacked with the
    wild-type row (sample 0 is the wild type)."""
    res = _res(spark, sf)
    sites = _sizes(res).where(F.col("label") > 0).select("label", ((F.col("label") * 5) % F.col("n")).cast("int").alias("site"))
    return A.matrix_md5(A.site_pair(res, sites, res.where(F.col("label") == 0), "label", "site"), "label")


_FAMILY = "CASE label % 5 WHEN 0 THEN 2016 WHEN 1 THEN 2506 WHEN 2 THEN 1236 WHEN 3 THEN 655 ELSE 889 END"


@register("emb04_family_matrix", f"""WITH {_RESQ},
{_matrix_sql(f"""SELECT nl.label, i AS idx, coalesce(res.vec, {_ZERO}) AS vec FROM (SELECT label, {_FAMILY} AS t FROM nl) nl, range(t) r(i)
  LEFT JOIN res ON res.label = nl.label AND res.residue = i""")}""")
def emb04_family_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every sample's matrix at its family's maximum length: zero rows behind,
    longer ones cut."""
    res = _res(spark, sf)
    pre = F.get(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("label") % 5).cast("int"))
    sizes = _sizes(res).select("label", F.lit(0).alias("start"), "n", A.pad_length(pre).alias("length"))
    return A.matrix_md5(A.padded(res, sizes, "label", "length", 64), "label")


@register("emb05_batch_matrix", f"""WITH {_RESQ},
{_matrix_sql(f"""SELECT nl.label, i AS idx, coalesce(res.vec, {_ZERO}) AS vec FROM nl, range({A.BATCH_LEN}) r(i)
  LEFT JOIN res ON res.label = nl.label AND res.residue = i""")}""")
def emb05_batch_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The ragged batch padded to the fixed length, one matrix per sample."""
    res = _res(spark, sf)
    sizes = _sizes(res).select("label", F.lit(0).alias("start"), "n", F.lit(A.BATCH_LEN).alias("length"))
    return A.matrix_md5(A.padded(res, sizes, "label", "length", 64), "label")
