"""Scans and sinks (SRC-*).

Every reader declares its schema (no inference pass over the data) and every
writer partitions by the keys readers filter on, so later scans prune
directories.  Paths are Hadoop paths: the same code runs on a shared
filesystem or an object store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (the shared
    folder a cluster names in ``spark.checkpoint.dir``)."""
    from varlens.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/varlens-io/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t",
                   header: bool = True) -> DataFrame:
    """Delimited text with a header and a declared schema (SRC-01); NaN and
    NA read as null."""
    return (spark.read.schema(schema).option("header", header).option("sep", sep)
                 .option("nullValue", "NA").option("nanValue", "NaN").option("mode", "FAILFAST").csv(path))


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Term-association file: tab separated, '!' comment lines, no header;
    field 2 is the symbol and field 4 the term (SRC-02)."""
    raw = spark.read.option("sep", "\t").option("comment", "!").option("header", False).csv(path)
    return raw.select(F.col("_c2").alias("symbol"), F.col("_c4").alias("term"))


def write_by_extension(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """Parquet when the path names it, else delimited text with a header (SRC-04)."""
    if ".parquet" in path:
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def read_by_extension(spark: SparkSession, path: str, schema=None, sep: str = ",") -> DataFrame:
    if ".parquet" in path:
        return spark.read.parquet(path)
    return read_delimited(spark, path, schema, sep)


def read_archive(spark: SparkSession, run_dir: str, csv_schema=None) -> DataFrame:
    """Prediction archive of one run: ``output.parquet``, or the tab CSV when
    no Parquet exists (SRC-03)."""
    pq = f"{run_dir.rstrip('/')}/output.parquet"
    if path_exists(spark, pq):
        return spark.read.parquet(pq)
    return read_delimited(spark, f"{run_dir.rstrip('/')}/output.csv", csv_schema, "\t")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) from a FASTA file (SRC-05): records split on '>', the
    first line is the name, the rest the (gapped) sequence."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split(F.col("value"), "\n")
    return raw.select(F.trim(F.get(lines, 0)).alias("name"),
                      F.array_join(F.slice(lines, 2, 1 << 30), "").alias("seq"))


def write_archive(df: DataFrame, path: str, by: tuple[str, ...] = ("run", "fold")) -> None:
    """Archive sink partitioned by run and fold; a rewrite replaces only the
    partitions present in ``df`` (dynamic overwrite), so other runs stay (SRC-06)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_folds(df: DataFrame, path: str, fold_col: str = "fold") -> None:
    """One partition per fold (SRC-07); the fold stays an int column on read."""
    df.write.mode("overwrite").partitionBy(fold_col).parquet(path)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def key_catalogue(spark: SparkSession, directory: str, pattern: str = "*", cut: str = "_esm") -> DataFrame:
    """Keys from file names (SRC-08): the stem, cut at ``cut`` when present.
    Only file metadata is read (``binaryFile`` with the content pruned)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select("path")
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(F.when(F.instr(stem, cut) > 0, F.substring_index(stem, cut, 1)).otherwise(stem).alias("key"))


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that have no output yet (SRC-09)."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def load_runs(spark: SparkSession, runs: dict[str, str], reader=None) -> DataFrame:
    """Run-tagged union of several archives (SRC-10); the kind comes from the
    name prefix ``(svm)`` / ``(gbm)``, else network."""
    reader = reader or (lambda p: read_archive(spark, p))
    out = None
    for name, path in runs.items():
        kind = "svm" if name.startswith("(svm)") else "gbm" if name.startswith("(gbm)") else "network"
        df = reader(path).withColumn("run", F.lit(name)).withColumn("model_kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def numbered_runs(spark: SparkSession, path: str) -> dict[str, str]:
    """{name: folder} of every sub-directory of ``path`` whose name is a whole
    number, in integer order (SRC-10); only the folder listing is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return {n: f"{path.rstrip('/')}/{n}" for n in sorted((n for n in names if n.isdigit()), key=int)}


def write_named(df: DataFrame, directory: str, key: str, suffix: str) -> None:
    """One one-byte file per key, named ``<key><suffix>`` (the layout the key
    catalogue reads).  Files are made one by one: for small sets of keys."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(directory)
    fs = base.getFileSystem(conf)
    for (name,) in df.select(key).distinct().toLocalIterator():  # one small file per key
        out = fs.create(jvm.org.apache.hadoop.fs.Path(base, f"{name}{suffix}"))
        out.writeByte(0)
        out.close()


def override_terms(df: DataFrame, predicted: DataFrame, key: str, col: str, sentinel: str) -> DataFrame:
    """Replace the sentinel in ``col`` by a predicted term when one exists (SRC-11)."""
    p = predicted.select(key, F.col("term").alias("__pred"))
    j = df.join(p, key, "left")
    return j.withColumn(col, F.when((F.col(col) == sentinel) & F.col("__pred").isNotNull(), F.col("__pred"))
                        .otherwise(F.col(col))).drop("__pred")
