"""Corpus pipeline: language ID, quality rules, near-duplicate removal, secret
scans and packing, each stage on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns they were given.

Defined results: null and empty texts go at the first stage (no letter); rows
with one id are one document; an empty table passes through empty.  A stage
reads ``doc_id``, ``text``, ``lang`` (which must be there) and ``n_chars``; all
other columns, whatever their names, come back as they were.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.llm import jaccard, langid, packing, quality, secrets
from varlens.llm.common import stored, table

#: Columns that the stages read.
_READ = ("doc_id", "text", "lang", "n_chars")
#: Least share of the likelihood that the predicted language must have.
LEAST_SHARE = 0.5
#: Near copies share this many percent of their runs of so many words.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage reads under names that no operator adds."""
    return docs.toDF(*[c if c in _READ else f"__kept_{i}" for i, c in enumerate(docs.columns)])


def _as_given(found: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*named.columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language, or between two; fills a missing ``lang``."""
    own = _named(docs)
    found = langid.predict(own, langid.fit(own))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return _as_given(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), own, docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that a rule rejects."""
    own = _named(docs)
    return _as_given(quality.judge(own).where("passed"), own, docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    own = _named(docs)
    return _as_given(jaccard.first_of_groups(own, width=NEAR_WIDTH, percent=NEAR_PERCENT), own, docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, also those joined to others; ``n_chars`` follows."""
    own = _named(docs)
    found = secrets.scan(own, joined=True)
    clean = found.withColumn("text", F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    if "n_chars" in own.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _as_given(clean, own, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences of 4096."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard),
          ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]

#: Language ID and packing can't be expressed in SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
