"""Derived views that map the operators' inputs onto the driver tables.

Variant data is not part of the driver tables, so the registered queries run
on views that both Spark and DuckDB compute exactly (integer arithmetic, then
one division).  Every view is given twice: as a DataFrame built from the
scans, and as the SQL text of a CTE for the DuckDB oracle.  Keep them in step.

pred        (run, fold, epoch, id, grp, score, label, pkey)   from lineitem
variants    (id, gene, position, label_txt, feature, ptype, name, symbol)  from part
rows        (family, gene, row): one gapped row per gene        from documents
align       (family, gene, col, ch): the same in long form (SQL only)
positions   (family, gene, k, position, cls)            from documents
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.sources.tables import table

def _score(ok: Column, pk: Column, ln: Column) -> Column:
    return ((ok * 31 + pk * 17 + ln * 7) % 1000).cast("double") / 1000.0


def pred_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction archive in canonical flat form, one row per lineitem."""
    li = table(spark, sf_dir, "lineitem")
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return li.select(
        F.col("l_linestatus").alias("run"),
        (ok % 10).alias("fold"),
        ln.alias("epoch"),
        (ok * 8 + ln).alias("id"),  # line numbers are 1 to 7
        sk.alias("grp"),
        _score(ok, pk, ln).alias("score"),
        F.when((ok * 13 + sk * 5) % 7 < 3, 1).otherwise(0).alias("label"),
        pk.alias("pkey"),
    )


def pred3_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pred`` with three runs (``l_returnflag``) for tests over k > 2 models."""
    li = table(spark, sf_dir, "lineitem")
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return li.select(
        F.col("l_returnflag").alias("run"),
        (ok % 10).alias("fold"),
        ln.alias("epoch"),
        (ok * 8 + ln).alias("id"),  # line numbers are 1 to 7
        sk.alias("grp"),
        _score(ok, pk, ln).alias("score"),
        F.when((ok * 13 + sk * 5) % 7 < 3, 1).otherwise(0).alias("label"),
        pk.alias("pkey"),
    )


def variants_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant-like table: gene = brand, position = size, label from type."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("gene"),
        F.col("p_size").alias("position"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "lof")
         .when(F.col("p_type").isin("LARGE", "PROMO"), "gof")
         .otherwise("neutral").alias("label_txt"),
        F.col("p_retailprice").alias("feature"),
        F.col("p_type").alias("ptype"),
        F.col("p_name").alias("name"),
        F.concat(F.when(F.col("p_size") % 5 == 0, "KCNQ").when(F.col("p_size") % 5 == 1, "HCN")
                  .when(F.col("p_size") % 5 == 2, "SCN").when(F.col("p_size") % 5 == 3, "CACNA")
                  .otherwise("Sh"), (F.col("p_partkey") % 9 + 1).cast("string")).alias("symbol"),
    )


def rows_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment with one gapped row per gene: each whole document, its
    characters being the columns and a space (or '-') a gap."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("family"), F.col("doc_id").alias("gene"),
                    F.translate("text", " ", "-").alias("row"))


def positions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant positions on the aligned genes: for k in 1..5 the residue
    ``(doc_id*k) % residues + 1`` with class ``k % 2``.  Genes without residues
    get none."""
    d = table(spark, sf_dir, "documents")
    residues = F.length(F.regexp_replace(F.col("text"), "[ -]", ""))  # gaps: space and '-'

    base = d.select(F.col("lang").alias("family"), F.col("doc_id").alias("gene"),
                    residues.alias("n_res"))
    return (base.filter(F.col("n_res") > 0)
                .select("family", "gene", "n_res",
                        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
                .select("family", "gene", F.col("k").cast("int").alias("k"),
                        ((F.col("gene") * F.col("k")) % F.col("n_res") + 1).cast("int").alias("position"),
                        (F.col("k") % 2).cast("int").alias("cls")))


# --- the same views as DuckDB CTE bodies -----------------------------------

_SCORE_SQL = "CAST((l_orderkey*31 + l_partkey*17 + l_linenumber*7) % 1000 AS DOUBLE) / 1000.0"
_LABEL_SQL = "CASE WHEN (l_orderkey*13 + l_suppkey*5) % 7 < 3 THEN 1 ELSE 0 END"

SQL_VIEWS = {
    "pred": f"""SELECT l_linestatus AS run, l_orderkey % 10 AS fold, l_linenumber AS epoch,
        l_orderkey*8 + l_linenumber AS id, l_suppkey AS grp,
        {_SCORE_SQL} AS score, {_LABEL_SQL} AS label, l_partkey AS pkey FROM lineitem""",
    "pred3": f"""SELECT l_returnflag AS run, l_orderkey % 10 AS fold, l_linenumber AS epoch,
        l_orderkey*8 + l_linenumber AS id, l_suppkey AS grp,
        {_SCORE_SQL} AS score, {_LABEL_SQL} AS label, l_partkey AS pkey FROM lineitem""",
    "variants": """SELECT p_partkey AS id, p_brand AS gene, p_size AS position,
        CASE WHEN p_type IN ('ECONOMY','SMALL') THEN 'lof'
             WHEN p_type IN ('LARGE','PROMO') THEN 'gof' ELSE 'neutral' END AS label_txt,
        p_retailprice AS feature, p_type AS ptype, p_name AS name,
        CASE p_size % 5 WHEN 0 THEN 'KCNQ' WHEN 1 THEN 'HCN' WHEN 2 THEN 'SCN' WHEN 3 THEN 'CACNA' ELSE 'Sh' END
          || CAST(p_partkey % 9 + 1 AS VARCHAR) AS symbol FROM part""",
    "align": """SELECT lang AS family, doc_id AS gene, g.col AS col,
        CASE WHEN substr(text, g.col, 1) = ' ' THEN '-' ELSE substr(text, g.col, 1) END AS ch
        FROM documents, LATERAL (SELECT unnest(range(1, length(text) + 1)) AS col) g""",
    "positions": """SELECT family, gene, CAST(k AS INTEGER) AS k, CAST((gene*k) % n_res + 1 AS INTEGER) AS position,
        CAST(k % 2 AS INTEGER) AS cls
        FROM (SELECT lang AS family, doc_id AS gene,
                     length(replace(replace(text, ' ', ''), '-', '')) AS n_res
              FROM documents) d, (SELECT unnest(range(1, 6)) AS k) kk
        WHERE n_res > 0""",
}


def with_views(sql: str, *names) -> str:
    """Prefix ``sql`` with the CTEs of the named views.  A name may be a pair
    ``(alias, view)`` to expose a view under another name."""
    ctes = []
    for n in names:
        alias, view = (n, n) if isinstance(n, str) else n
        ctes.append(f"{alias} AS ({SQL_VIEWS[view]})")
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ", ".join(ctes) + ", " + body[len(start):]
    return "WITH " + ", ".join(ctes) + " " + body
