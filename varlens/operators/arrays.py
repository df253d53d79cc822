"""Embedding arrays (EMB-*), in long form.

An embedding matrix is held as rows ``(sample, residue, vector array<float>)``
rather than one array of arrays per sample, so a sample with many residues
is not one huge row; windows around a site are range joins on the residue
index (2w + 1 rows per site).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: padded length per gene-family
# prefix, and the ragged-batch length.
FAMILY_MAX_LEN = {"SC": 2016, "CA": 2506, "KC": 1236, "SH": 655, "HC": 889}
BATCH_LEN = 2018


def residues(emb: DataFrame, sample: str, order: str, vec: str) -> DataFrame:
    """(sample, residue, vec): vectors of a sample numbered 0.. in ``order``
    (range-bucketed prefix count, no per-sample window)."""
    from varlens.functions.prefix import prefix_sum
    d = emb.select(sample, order, vec).withColumn("__one", F.lit(1).cast("long"))
    r = prefix_sum(d, [sample], order, ["__one"], inclusive=False, suffix="_r")
    return r.select(sample, F.col("__one_r").cast("int").alias("residue"), vec)


def window_rows(res: DataFrame, sites: DataFrame, sample: str, site: str, w: int, dim: int) -> DataFrame:
    """Rows site-w .. site+w of each sample with zero vectors and mask 1
    outside the matrix (EMB-01)."""
    spark = res.sparkSession
    offs = spark.range(-w, w + 1).select(F.col("id").cast("int").alias("offset"))
    want = sites.select(sample, site).crossJoin(offs).withColumn("residue", F.col(site) + F.col("offset"))
    j = want.join(res, [sample, "residue"], "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return j.select(sample, site, "offset", "residue",
                    F.coalesce(F.col("vec"), zeros).alias("vec"),
                    F.when(F.col("vec").isNull(), 1).otherwise(0).alias("mask"))


def window_inside(n: Column, p: Column, w: int) -> tuple[Column, Column]:
    """[start, end) of a window of ``w`` rows kept inside a sequence of n rows
    around position p (EMB-02): start max(0, p - w//2), end min(n, p + w//2);
    near the start the end moves to min(w, n), near the end the start to
    max(0, n - w).  The window may stay short; callers pad in front."""
    start = F.greatest(F.lit(0), p - w // 2)
    end = F.least(n, p + w // 2)
    end = F.when(p - w < 0, F.least(F.lit(w), n)).otherwise(end)
    start = F.when(p + w >= n, F.greatest(F.lit(0), n - w)).otherwise(start)
    return start, end


def pad_length(prefix: Column) -> Column:
    """Padded length for a gene-family prefix (EMB-04); an unknown prefix raises."""
    m = F.create_map(*[x for k, v in FAMILY_MAX_LEN.items() for x in (F.lit(k), F.lit(v))])
    v = F.element_at(m, prefix)
    return F.coalesce(v, F.raise_error(F.concat(F.lit("unknown family "), prefix)).cast("int"))


def padded(res: DataFrame, sizes: DataFrame, sample: str, length: str, dim: int, in_front: bool = False) -> DataFrame:
    """Every sample's matrix with ``length`` rows (EMB-02, EMB-04, EMB-05): (sample,
    ``idx`` from 0, ``vec``).  ``res`` holds the rows (sample, residue, vec);
    ``sizes`` the sample, its first and number of rows (``start``, ``n``) and
    ``length``.  Zero rows follow the sample's, or with ``in_front`` precede them;
    rows beyond ``length`` are cut off, at the end or in front."""
    shift = F.col(length) - F.col("n") if in_front else F.lit(0)
    kept = res.join(sizes, sample).withColumn("idx", F.col("residue") - F.col("start") + shift)
    inside = (F.col("residue") >= F.col("start")) & (F.col("residue") < F.col("start") + F.col("n"))
    kept = kept.where(inside & (F.col("idx") >= 0) & (F.col("idx") < F.col(length))).select(sample, F.col("idx").cast("int").alias("idx"), "vec")
    gaps = F.col(length) - F.col("n")
    first = F.lit(0) if in_front else F.col("n")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    filled = sizes.where(gaps > 0).select(sample, F.explode(F.sequence(first.cast("int"), (first + gaps - 1).cast("int"))).alias("idx")).withColumn("vec", zero)
    return kept.unionByName(filled)


def matrix_md5(rows: DataFrame, sample: str) -> DataFrame:
    """(sample, rows, md5) of matrices in long form: the md5 of the rows' md5s in
    order, a row's being over its values in whole millionths.  A row of the
    matrix counts 32 characters, so a sample's text is short."""
    micro = F.transform("vec", lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("long").cast("string"))
    each = rows.select(sample, "idx", F.md5(F.array_join(micro, ",")).alias("m"))
    return each.groupBy(sample).agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "m"))), lambda s: s["m"]), "")).alias("matrix_md5"))


def site_pair(res: DataFrame, sites: DataFrame, wild: DataFrame, sample: str, site: str) -> DataFrame:
    """The two rows of EMB-03's stack: (sample, ``idx``, vec), 0 the difference of
    the sample's vector at its site from the wild type's there, 1 the wild type's."""
    at = res.join(sites.select(sample, F.col(site).alias("residue")), [sample, "residue"])
    both = at.join(wild.select("residue", F.col("vec").alias("__w")), "residue")
    return both.select(sample, F.posexplode(F.array(vec_diff(F.col("vec"), F.col("__w")), F.col("__w"))).alias("idx", "vec"))


def vec_diff(a: Column, b: Column) -> Column:
    """Element-wise a - b (EMB-03)."""
    return F.zip_with(a, b, lambda x, y: x - y)


def explode_dims(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """(keys, dim, x): one row per vector element."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def moments(df: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """count, mean, population and sample variance per group (AGG-17,
    EMB-08); Spark's partial aggregation is the mergeable running form.
    Fewer than two values give a null sample variance."""
    return df.groupBy(*keys).agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
                                 F.var_pop(x).alias("var_pop"),
                                 F.when(F.count(x) >= 2, F.var_samp(x)).alias("var_samp"))
