"""Helpers shared by the operators: table access, stored intermediates, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder and
    read it back: columnar and compressed, cuts the lineage, survives lost
    executors, and several branches of a plan can read it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/varlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(modulus)


def is_remainder(doc_id: Column, modulus: int, value: int) -> Column:
    """True if the id's remainder is ``value``; a null id is never held out."""
    return F.coalesce(id_remainder(doc_id, modulus) == F.lit(value), F.lit(False))


def chunks(rows: list, weights: list[int], limit: int):
    """Consecutive slices (start, stop) of ``rows`` whose weights sum to about
    ``limit``; a single heavier row is a slice of its own."""
    start, total = 0, 0
    for i, w in enumerate(weights):
        if i > start and total + w > limit:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(rows):
        yield start, len(rows)
