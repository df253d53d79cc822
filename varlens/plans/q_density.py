"""Registered queries: alignment-density features (DEN-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.functions.exprs import materialize
from varlens.operators import density as D
from varlens.plans.catalog import r6, register
from varlens.plans.views import positions_view, rows_view, with_views

_RES = """res AS (SELECT family, gene, col, CAST(row_number() OVER (PARTITION BY family, gene ORDER BY col) AS INTEGER) AS residue
    FROM align WHERE ch <> '-'),
nres AS (SELECT family, gene, max(residue) AS n FROM res GROUP BY family, gene)"""
_FREQ = """cnt AS (SELECT family, gene, cls, position, count(*) AS freq FROM positions GROUP BY ALL),
fq AS (SELECT c.family, c.gene, c.cls, r.col, c.freq FROM cnt c JOIN res r
    ON c.family = r.family AND c.gene = r.gene AND c.position = r.residue),
prof AS (SELECT family, cls, col, sum(freq) AS freq FROM fq GROUP BY ALL)"""
_MA = """offs AS (SELECT w.width, CAST(k AS INTEGER) AS k FROM (VALUES (10), (3)) w(width), range(-4, 6) r(k)
    WHERE k BETWEEN -((w.width - 1) // 2) AND w.width // 2),
ong AS (SELECT r.family, r.gene, r.residue, p.cls, p.freq, nres.n FROM res r
    JOIN prof p ON r.family = p.family AND r.col = p.col JOIN nres ON r.family = nres.family AND r.gene = nres.gene
    WHERE p.freq <> 0),
ma AS (SELECT family, gene, cls, width, CAST(((residue - 1 - k) % n + n) % n + 1 AS INTEGER) AS residue,
    sum(CAST(freq AS DOUBLE) / width) AS dens FROM ong, offs GROUP BY ALL)"""
_DMAP = """per AS (SELECT family, gene, residue AS position,
    sum(dens) FILTER (WHERE cls = 1 AND width = 10) AS densgof, sum(dens) FILTER (WHERE cls = 1 AND width = 3) AS densgof3aa,
    sum(dens) FILTER (WHERE cls = 0 AND width = 10) AS denslof, sum(dens) FILTER (WHERE cls = 0 AND width = 3) AS denslof3aa
    FROM ma GROUP BY ALL),
dm AS (SELECT p.family, p.gene, p.k, p.position, p.cls,
    coalesce(per.densgof, 0.0) AS densgof, coalesce(per.densgof3aa, 0.0) AS densgof3aa,
    coalesce(per.denslof, 0.0) AS denslof, coalesce(per.denslof3aa, 0.0) AS denslof3aa
    FROM positions p LEFT JOIN per ON p.family = per.family AND p.gene = per.gene AND p.position = per.position)"""


def _Z(prefix: str = "") -> str:
    return ", ".join(
        f"round_even((CASE WHEN s_{c} > 0 THEN ({prefix}{c} - m_{c}) / s_{c} ELSE {prefix}{c} - m_{c} END) * 100.0, 0) / 100.0 AS {c}"
        for c in _DCOLS)


_DCOLS = ["densgof", "densgof3aa", "denslof", "denslof3aa"]


def _genes(spark, sf):
    """One gapped row per gene, read from the table by each branch: smaller than its columns."""
    return rows_view(spark, sf)


_KEY = ["family", "gene", "k"]


@register("den01_residue_columns", with_views(f"""WITH {_RES}
SELECT family, gene, count(*) AS n_residues, max(col) AS last_col, CAST(sum(CAST(col AS BIGINT) * residue) AS BIGINT) AS checksum
FROM res GROUP BY family, gene""", "align"))
def den01_residue_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment column of each residue (k-th non-gap column), reported per
    gene: residue count, last column and sum(col * residue) over all residues."""
    rc = D.residue_columns(D.gene_columns(rows_view(spark, sf)))
    return rc.groupBy("family", "gene").agg(
        F.count(F.lit(1)).alias("n_residues"), F.max("col").alias("last_col"),
        F.sum(F.col("col").cast("long") * F.col("residue")).alias("checksum"))


@register("den02_position_frequency", with_views(f"WITH {_RES}, {_FREQ} SELECT family, gene, cls, col, freq FROM fq",
                                                 "align", "positions"))
def den02_position_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Variant counts per gene and class on alignment columns."""
    return D.position_frequency(positions_view(spark, sf), _genes(spark, sf))


@register("den03_family_profile", with_views(f"WITH {_RES}, {_FREQ} SELECT family, cls, col, freq FROM prof",
                                             "align", "positions"))
def den03_family_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sum over each family's genes per class and column."""
    rc = _genes(spark, sf)
    return D.family_profile(D.position_frequency(positions_view(spark, sf), rc))


@register("den04_ring_average", with_views(f"""WITH {_RES}, {_FREQ}, {_MA}
SELECT family, gene, cls, width, count(*) AS n_nonzero, {r6('sum(dens)', 'total')}, {r6('max(dens)', 'peak')},
  {r6('sum(dens * residue)', 'moment')} FROM ma GROUP BY family, gene, cls, width""", "align", "positions"))
def den04_ring_average(spark: SparkSession, sf: str) -> DataFrame:
    """Family profile on each gene's residues, circular moving average
    (widths 10 and 3), over the whole ring; reported per gene, class and
    width as the non-zero count, total (the ring average keeps the profile
    mass), peak and first moment."""
    rc = _genes(spark, sf)
    prof = D.family_profile(D.position_frequency(positions_view(spark, sf), rc))
    ring = D.ring_average(prof, rc)
    return ring.groupBy("family", "gene", "cls", "width").agg(
        F.count(F.lit(1)).alias("n_nonzero"), F.sum("dens").alias("total"), F.max("dens").alias("peak"),
        F.sum(F.col("dens") * F.col("residue")).alias("moment"))


@register("den05_gather", with_views(f"""WITH {_RES}, {_FREQ}, {_MA}
SELECT p.family, p.gene, p.k, p.position, ma.cls, ma.width, {r6('ma.dens', 'dens')}
FROM positions p JOIN ma ON p.family = ma.family AND p.gene = ma.gene AND p.position = ma.residue""",
    "align", "positions"))
def den05_gather(spark: SparkSession, sf: str) -> DataFrame:
    """Density values at each variant's position (non-zero ones); only the
    windows of those positions are read."""
    genes = _genes(spark, sf)
    pos = materialize(positions_view(spark, sf))
    found = D.window_density(pos, materialize(D.family_profile(D.position_frequency(pos.where("family IS NOT NULL"), genes))), genes)
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(w).alias("width"), F.col(n).alias("dens")) for n, c, w in D.DENSITY_FEATURES]))
    return found.select("family", "gene", "k", "position", values.alias("v")).select("family", "gene", "k", "position", "v.*").where("dens <> 0")


_FREQ4 = _FREQ.replace("FROM positions GROUP BY ALL", "FROM positions WHERE k <> 5 GROUP BY ALL")


@register("den06_density_map", with_views(f"""WITH {_RES}, {_FREQ4}, {_MA}, {_DMAP}
SELECT family, gene, k, position, cls, {", ".join(r6(c, c) for c in _DCOLS)} FROM dm WHERE k <> 5""", "align", "positions"))
def den06_density_map(spark: SparkSession, sf: str) -> DataFrame:
    """densgof, densgof3aa, denslof, denslof3aa for every feature row.  The rows
    with k = 5 are in the training table only: they count nowhere, though they
    share residues with feature rows."""
    pos = materialize(positions_view(spark, sf))
    return D.density_map(pos, pos.where("k <> 5"), _genes(spark, sf), _KEY)


@register("den07_standardize_round", with_views(f"""WITH {_RES}, {_FREQ}, {_MA}, {_DMAP},
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _DCOLS)} FROM dm)
SELECT family, gene, k, position, cls, {", ".join(
    f"round_even((CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE {c} - m_{c} END) * 100.0, 0) / 100.0 AS {c}"
    for c in _DCOLS)} FROM dm, st""", "align", "positions"))
def den07_standardize_round(spark: SparkSession, sf: str) -> DataFrame:
    """The density map z-scored over all variant rows and rounded to 2 decimals."""
    pos = materialize(positions_view(spark, sf))
    return D.standardize_round(D.density_map(pos, pos, _genes(spark, sf), _KEY), _DCOLS)


@register("den08_apply_to_split", with_views(f"""WITH {_RES},
cnt AS (SELECT family, gene, cls, position, count(*) AS freq FROM positions WHERE gene % 2 = 0 GROUP BY ALL),
fq AS (SELECT c.family, c.gene, c.cls, r.col, c.freq FROM cnt c JOIN res r
    ON c.family = r.family AND c.gene = r.gene AND c.position = r.residue),
prof AS (SELECT family, cls, col, sum(freq) AS freq FROM fq GROUP BY ALL), {_MA}, {_DMAP},
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _DCOLS)} FROM dm)
SELECT t.family, t.gene, t.k, {_Z('dm.')}
FROM (SELECT * FROM positions WHERE gene % 2 = 1) t LEFT JOIN (dm CROSS JOIN st)
  ON t.family = dm.family AND t.gene = dm.gene AND t.k = dm.k""", "align", "positions"))
def den08_apply_to_split(spark: SparkSession, sf: str) -> DataFrame:
    """Map fitted on the even genes, standardised and rounded over all feature
    rows, applied to the odd genes by a left join."""
    pos = materialize(positions_view(spark, sf))
    dm = D.standardize_round(D.density_map(pos.where(F.col("gene") % 2 == 0), pos, _genes(spark, sf), _KEY), _DCOLS)
    test = pos.where(F.col("gene") % 2 == 1).select("family", "gene", "k")
    return test.join(dm.select("family", "gene", "k", *_DCOLS), ["family", "gene", "k"], "left")


_CELLS = """pv AS (SELECT *, CAST(gene % 4 AS INTEGER) AS outer_fold,
    CAST(('0x' || substr(md5(CAST(gene AS VARCHAR) || '|' || CAST(k AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS inner_fold FROM positions),
maps AS (SELECT o.o, j.j FROM (SELECT DISTINCT outer_fold AS o FROM pv) o, (SELECT DISTINCT inner_fold AS j FROM pv UNION ALL SELECT -1) j),
fq AS (SELECT c.family, c.gene, c.cls, r.col, m.o, m.j, count(*) AS freq FROM pv c JOIN res r
    ON c.family = r.family AND c.gene = r.gene AND c.position = r.residue JOIN maps m ON c.outer_fold <> m.o AND c.inner_fold <> m.j GROUP BY ALL),
prof AS (SELECT family, cls, col, o, j, sum(freq) AS freq FROM fq GROUP BY ALL),
offs AS (SELECT w.width, CAST(k AS INTEGER) AS off FROM (VALUES (10), (3)) w(width), range(-4, 6) r(k)
    WHERE k BETWEEN -((w.width - 1) // 2) AND w.width // 2),
tgt AS (SELECT p.*, m.o, m.j FROM pv p JOIN maps m ON m.j = CASE WHEN p.outer_fold = m.o THEN -1 ELSE p.inner_fold END),
hit AS (SELECT t.gene, t.k, t.o, pr.cls AS c, offs.width, CAST(pr.freq AS DOUBLE) / offs.width AS part FROM tgt t
    JOIN nres ON t.family = nres.family AND t.gene = nres.gene CROSS JOIN offs
    JOIN res r ON r.family = t.family AND r.gene = t.gene AND r.residue = ((t.position - 1 + offs.off) % nres.n + nres.n) % nres.n + 1
    JOIN prof pr ON pr.family = t.family AND pr.col = r.col AND pr.o = t.o AND pr.j = t.j),
dm AS (SELECT t.family, t.gene, t.k, t.position, t.cls, t.outer_fold, t.inner_fold, t.o AS for_outer, t.j,
    coalesce(sum(part) FILTER (WHERE c = 1 AND width = 10), 0.0) AS densgof, coalesce(sum(part) FILTER (WHERE c = 1 AND width = 3), 0.0) AS densgof3aa,
    coalesce(sum(part) FILTER (WHERE c = 0 AND width = 10), 0.0) AS denslof, coalesce(sum(part) FILTER (WHERE c = 0 AND width = 3), 0.0) AS denslof3aa
    FROM tgt t LEFT JOIN hit ON hit.gene = t.gene AND hit.k = t.k AND hit.o = t.o GROUP BY ALL)"""


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    seed = F.md5(F.concat(F.col("gene").cast("string"), F.lit("|"), F.col("k").cast("string")))
    return materialize(positions_view(spark, sf)).withColumn("outer_fold", (F.col("gene") % 4).cast("int")).withColumn(
        "inner_fold", (F.conv(F.substring(seed, 1, 8), 16, 10).cast("long") % 5).cast("int"))


@register("den09_cross_fitted", with_views(f"""WITH {_RES}, {_CELLS}
SELECT family, gene, k, position, cls, outer_fold, inner_fold, for_outer,
  CASE WHEN outer_fold = for_outer THEN 'outer_test' ELSE 'inner' END AS role, {", ".join(r6(c, c) for c in _DCOLS)} FROM dm""",
    "align", "positions"))
def den09_cross_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-fitted densities: outer folds by gene, 5 inner folds; every row
    of dev(o) gets the map fitted without its inner fold, outer test rows the
    map fitted on all of dev(o)."""
    return D.cross_fitted(_folded(spark, sf), _genes(spark, sf), "outer_fold", "inner_fold")


@register("den09_standardised")
def den09_standardised(spark: SparkSession, sf: str) -> DataFrame:
    """The cross-fitted densities, each map standardised and rounded."""
    return D.cross_fitted(_folded(spark, sf), _genes(spark, sf), "outer_fold", "inner_fold", digits=2)
