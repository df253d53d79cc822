"""Pipeline stages on tables with clashing columns, and on empty ones."""

import corpus_pipeline
import pytest
from awkward import awkward

NAMES = "Passed SCORE spans lang_pred _text _base component_id n_shingles hashes"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_columns_of_any_name_come_back(spark, name, stage):
    docs = awkward(spark, NAMES)
    out = stage(spark, docs, "")
    rows = out.collect()
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert rows and all(r[n] == "clash" for r in rows for n in NAMES.split())
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_tables_pass_through(spark, name, stage):
    assert stage(spark, awkward(spark, "score").where("false"), "").count() == 0


def test_packing_reads_tables_with_any_columns(spark):
    out = corpus_pipeline.best_fit_packing(spark, awkward(spark, "piece length offset sequence_id"), "")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.where("doc_id = 4").count() == 2
