"""The operators' queries over the driver tables: thin, whole-table, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.llm import fingerprints, jaccard, langid, lm, merkle, packing, pieces, quality, secrets, spelling, topk, toxicity, urls
from varlens.llm.common import id_remainder, is_remainder, table
from varlens.llm.sql import SQL

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = is_remainder(F.col("doc_id"), 7, 2)
    scored = lm.score(docs, ~held_out)
    return scored.select("doc_id", is_remainder(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, measures=True)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed.alias("base_failed"), (~base_failed & F.col("passed")).alias("kept"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = is_remainder(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), joined=True)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = is_remainder(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda n_chars: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    n_chars = F.col("n_chars")
    tampered = F.when(id_remainder(F.col("doc_id"), 7) == 0, leaf(F.coalesce(F.try_add(n_chars, F.lit(1)), n_chars)))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf(n_chars).alias("leaf"), tampered.alias("tampered"))
    found = merkle.manifest(rows, node="leaf", group="lang", order=["doc_id"])
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("witness")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(merkle.proof(F.col("witness")), ""), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, QueryFn]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_fingerprints, op4_url_filters, op5_toxicity, op6_secret_scans, op7_sentencepiece,
                                    op8_best_fit_packing, op9_language_id, op10_ngram_jaccard, op11_merkle_manifest, op12_exact_topk, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
