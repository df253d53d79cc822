"""Registered queries: scans and sinks (SRC-*).  Each writes data derived
from the driver tables to a fresh scratch folder under the checkpoint
directory, reads it back with the library readers and reports it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.operators import keys as K
from varlens.plans.catalog import r6, register
from varlens.plans.views import pred_view, variants_view, with_views
from varlens.sources import io as IO

_VSCHEMA = "id bigint, gene string, position int, label_txt string, feature double"


@register("src01_delimited_scan", with_views("SELECT id, gene, position, label_txt, feature FROM variants", "variants"))
def src01_delimited_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated file with a header, read back with a declared schema."""
    path = IO.scratch_dir(spark, "tsv")
    variants_view(spark, sf).select("id", "gene", "position", "label_txt", "feature").write.option(
        "header", True).option("sep", "\t").csv(path)
    return IO.read_delimited(spark, path, _VSCHEMA, "\t")


@register("src02_gaf_scan", with_views("""SELECT symbol, count(*) AS n_terms FROM (
  SELECT symbol, 'GO:' || lpad(CAST(position % 13 AS VARCHAR), 7, '0') AS term FROM variants) GROUP BY symbol""", "variants"))
def src02_gaf_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Association file with '!' comment lines, positional fields 2 and 4."""
    path = IO.scratch_dir(spark, "gaf")
    v = variants_view(spark, sf)
    lines = v.select(F.concat_ws("\t", F.lit("DB"), F.col("id").cast("string"), "symbol", F.lit(""),
                                 F.concat(F.lit("GO:"), F.lpad((F.col("position") % 13).cast("string"), 7, "0")),
                                 F.lit("IEA")).alias("value"))
    comments = spark.createDataFrame([("!gaf-version: 2.2",), ("!generated from the part table",)], "value string")
    comments.unionByName(lines).write.text(path)
    return IO.read_gaf(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_terms"))


@register("src03_archive_fallback", with_views(f"""SELECT run, fold, count(*) AS n, {r6('sum(score)', 'sum_score')}
FROM pred GROUP BY run, fold""", "pred"))
def src03_archive_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """One run stored as Parquet, the other only as tab CSV; the reader picks
    Parquet when present and falls back to the CSV."""
    base = IO.scratch_dir(spark, "runs")
    p = pred_view(spark, sf)
    p.where(F.col("run") == "F").write.parquet(f"{base}/F/output.parquet")
    p.where(F.col("run") == "O").write.option("header", True).option("sep", "\t").csv(f"{base}/O/output.csv")
    schema = "run string, fold bigint, epoch int, id bigint, grp bigint, score double, label int, pkey bigint"
    both = IO.read_archive(spark, f"{base}/F", schema).unionByName(IO.read_archive(spark, f"{base}/O", schema))
    return both.groupBy("run", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("sum_score"))


@register("src04_by_extension", with_views("""SELECT 'parquet' AS fmt, count(*) AS n FROM variants
UNION ALL SELECT 'csv', count(*) FROM variants UNION ALL SELECT 'tsv', count(*) FROM variants""", "variants"))
def src04_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    """The same table written and read by extension: Parquet, comma CSV (the
    default) and tab-separated text."""
    base = IO.scratch_dir(spark, "ext")
    v = variants_view(spark, sf).select("id", "gene", "position", "label_txt", "feature")
    IO.write_by_extension(v, f"{base}/variants.parquet")
    IO.write_by_extension(v, f"{base}/variants.csv")
    IO.write_by_extension(v, f"{base}/variants.tsv", sep="\t")
    a = IO.read_by_extension(spark, f"{base}/variants.parquet").select(F.lit("parquet").alias("fmt"))
    b = IO.read_by_extension(spark, f"{base}/variants.csv", _VSCHEMA).where("id is not null").select(F.lit("csv").alias("fmt"))
    c = IO.read_by_extension(spark, f"{base}/variants.tsv", _VSCHEMA, sep="\t").where("id is not null").select(F.lit("tsv").alias("fmt"))
    return a.unionByName(b).unionByName(c).groupBy("fmt").agg(F.count(F.lit(1)).alias("n"))


_CLEAN_SQL = "replace(replace(replace(text, chr(10), ''), chr(13), ''), '>', '')"


@register("src05_fasta_scan", f"""SELECT CAST(doc_id AS VARCHAR) AS name, length({_CLEAN_SQL}) AS n, md5({_CLEAN_SQL}) AS seq_md5
FROM documents""")
def src05_fasta_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents written as FASTA records (60 characters per line) and
    parsed back into (name, sequence)."""
    from varlens.sources.tables import table
    path = IO.scratch_dir(spark, "fasta")
    d = table(spark, sf, "documents")
    seq = F.regexp_replace(F.col("text"), "[\\n\\r>]", "")
    wrapped = F.regexp_replace(seq, "(.{60})", "$1\n")
    d.select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), wrapped).alias("value")).write.text(path)
    fa = IO.read_fasta(spark, path)
    return fa.select("name", F.length("seq").alias("n"), F.md5("seq").alias("seq_md5"))


@register("src06_archive_sink", with_views("""SELECT run, count(*) AS n FROM pred WHERE run = 'O' OR epoch = 1 GROUP BY run""",
                                          "pred"))
def src06_archive_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Archive written by (run, fold); a second write of run F (epoch 1 only)
    replaces F's partitions and leaves run O untouched."""
    path = IO.scratch_dir(spark, "archive")
    p = pred_view(spark, sf)
    IO.write_archive(p, path)
    IO.write_archive(p.where((F.col("run") == "F") & (F.col("epoch") == 1)), path)
    return spark.read.parquet(path).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@register("src07_fold_files", with_views("""SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n FROM (
  SELECT (row_number() OVER (ORDER BY label, md5(CAST(id AS VARCHAR) || '|42'), id) - 1) % 10 AS fold FROM (
    SELECT id, CASE label_txt WHEN 'lof' THEN 0 ELSE 1 END AS label FROM variants WHERE label_txt <> 'neutral'))
GROUP BY fold""", "variants"))
def src07_fold_files(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified folds written one partition per fold and read back; the
    fold is an integer column, so fold 10 sorts after fold 2."""
    from varlens.operators.splits import stratified_kfold
    path = IO.scratch_dir(spark, "folds")
    v = variants_view(spark, sf).where(K.not_label(F.col("label_txt")))
    f = stratified_kfold(v.select("id", K.encode_label_strict(F.col("label_txt")).alias("label")), "id", "label", 10, 42)
    IO.write_folds(f, path)
    return IO.read_folds(spark, path).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("src08_key_catalogue", with_views("SELECT DISTINCT replace(gene, '#', '-') AS key FROM variants", "variants"))
def src08_key_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Keys recovered from file names (``<key>_esm2.npy``) in a folder; only
    file metadata is read."""
    path = IO.scratch_dir(spark, "emb")
    IO.write_named(variants_view(spark, sf).select(F.translate("gene", "#", "-").alias("gene")), path, "gene", "_esm2.npy")
    return IO.key_catalogue(spark, path, "*.npy")


@register("src09_incremental_skip", with_views("SELECT id FROM variants WHERE position % 2 = 1", "variants"))
def src09_incremental_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Keys still to process: every key minus those with output already written."""
    path = IO.scratch_dir(spark, "done")
    v = variants_view(spark, sf)
    v.where(F.col("position") % 2 == 0).select("id").write.parquet(path)
    return IO.pending(v.select("id"), spark.read.parquet(path), "id")


@register("src10_multi_run", with_views("""SELECT '(svm)linear' AS run, 'svm' AS model_kind, count(*) AS n FROM pred WHERE run = 'F'
UNION ALL SELECT 'network', 'network', count(*) FROM pred WHERE run = 'O'""", "pred"))
def src10_multi_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored runs loaded as one run-tagged archive (kind from the name)."""
    base = IO.scratch_dir(spark, "multi")
    p = pred_view(spark, sf)
    p.where(F.col("run") == "F").drop("run").write.parquet(f"{base}/a/output.parquet")
    p.where(F.col("run") == "O").drop("run", "grp").write.parquet(f"{base}/b/output.parquet")
    runs = IO.load_runs(spark, {"(svm)linear": f"{base}/a", "network": f"{base}/b"})
    return runs.groupBy("run", "model_kind").agg(F.count(F.lit(1)).alias("n"))


@register("src10_numbered_runs", with_views("""SELECT CAST(fold AS VARCHAR) AS run, count(*) AS n FROM pred GROUP BY fold""", "pred"))
def src10_numbered_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every numbered sub-directory of a folder loaded as a run."""
    base = IO.scratch_dir(spark, "numbered")
    pred_view(spark, sf).withColumn("dir", F.col("fold").cast("string")).write.partitionBy("dir").parquet(f"{base}/by")
    found = IO.numbered_runs(spark, _renamed(spark, f"{base}/by", f"{base}/runs"))
    return IO.load_runs(spark, found).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _renamed(spark: SparkSession, source: str, target: str) -> str:
    """Folders ``dir=<n>`` under ``source`` as ``target/<n>/output.parquet``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(path(source)):
        name = s.getPath().getName()
        if name.startswith("dir="):
            fs.mkdirs(path(f"{target}/{name[4:]}"))
            fs.rename(s.getPath(), path(f"{target}/{name[4:]}/output.parquet"))
    fs.mkdirs(path(f"{target}/notes"))  # not a number: skipped
    return target


@register("src11_predicted_terms", with_views("""SELECT id, CASE WHEN hpo = '"HP:9999999"' AND id % 3 = 0 THEN 'HP:PRED' ELSE hpo END AS hpo
FROM (SELECT id, CASE WHEN position % 10 = 0 THEN '"HP:9999998"' WHEN position % 10 = 1 THEN '"HP:9999999"'
   ELSE '"HP:' || CAST(id AS VARCHAR) || '"' END AS hpo FROM variants)""", "variants"))
def src11_predicted_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Sentinel terms replaced by predictions read from a JSON file."""
    path = IO.scratch_dir(spark, "pred-terms")
    v = variants_view(spark, sf)
    v.where(F.col("id") % 3 == 0).select("id", F.lit("HP:PRED").alias("term")).write.json(path)
    pred = spark.read.schema("id bigint, term string").json(path)
    h = v.select("id", F.when(F.col("position") % 10 == 0, F.lit('"HP:9999998"'))
                 .when(F.col("position") % 10 == 1, F.lit('"HP:9999999"'))
                 .otherwise(F.concat(F.lit('"HP:'), F.col("id").cast("string"), F.lit('"'))).alias("hpo"))
    return IO.override_terms(h, pred, "id", "hpo", '"HP:9999999"')
