"""Composed preparation, Euclidean silhouettes, archive scoring, the entry's guard."""

import builtins

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.operators import ml as ML
from varlens.operators.preparation import Preparation


def frames(spark):
    variants = spark.createDataFrame([("a", "G1", "lof", "MKV"), ("b", "G1", "gof", "MKL"), ("c", "G2", "neutral", "MA"), ("d", "G2", "gof", "MB"), ("e", "G3", "lof", "MC")],
                                     "VarID string, gene string, netChange string, sequence string")
    ann = spark.createDataFrame([
        ("a", "G1", 0.5, None, '"HP:1,HP:2"', '"HP:2"', "GO:1;GO:2", 1.0, 2.0, 10, "m"),
        ("b", "G1", None, 2.0, '"HP:1,HP:1"', '"HP:9"', '"GO:2"', 1.0, 2.0, 10, "m"),
        ("c", "G2", 9.0, 9.0, '"HP:7"', '"HP:7"', "GO:7", 1.0, 2.0, 10, "m"),
        ("d", "G2", 1.5, 4.0, '"HP:9999998"', '"HP:9999998"', "GO:0", 1.0, 2.0, 10, "m"),
        ("x", "G9", 7.0, 7.0, '"HP:8"', '"HP:8"', "GO:8", 1.0, 2.0, 10, "m")],
        "VarID string, gene string, AM double, esm_llr double, HPOTerms string, HPOTermParents string, GOTerms string, rel_x double, abs_x double, position int, MIM string")
    return variants, ann


def sparse(rows, vocabulary):
    return {r["VarID"]: {vocabulary[p]: v for p, v in zip(r["terms"], r["values"])} for r in rows}


def test_dataset_is_prepared_as_described(spark, tmp_path):
    variants, ann = frames(spark)
    Preparation().fit(variants, ann).save(f"{tmp_path}/p")
    p = Preparation.load(spark, f"{tmp_path}/p")
    assert p.means == {"AM": 1.0, "esm_llr": 3.0}
    names = [r["term"] for r in p.vocabulary.orderBy("place").collect()]
    assert names == sorted(["HP:1", "HP:2", "HP:9", "GO:1", "GO:2", "GO:0", "HP:9999998"])
    out = p.dataset(variants, ann)
    assert out.columns == ["VarID", "gene", "netChange", "sequence", "AM", "esm_llr", "terms", "values"]
    rows = out.collect()
    assert {r["VarID"]: (r["netChange"], r["AM"], r["esm_llr"]) for r in rows} == {"a": (0, 0.5, 3.0), "b": (1, 1.0, 2.0), "d": (1, 1.5, 4.0)}
    assert sparse(rows, names) == {"a": {"HP:1": 1, "HP:2": 2, "GO:1": 1, "GO:2": 1}, "b": {"HP:1": 1, "HP:9": 1, "GO:2": 1}, "d": {"HP:9999998": 2, "GO:0": 1}}
    # terms that were not there when fitting have no place
    more = ann.where("VarID = 'x'").withColumn("GOTerms", F.lit("GO:2;GO:99"))
    assert sparse(p.annotations(more).collect(), names) == {"x": {"GO:2": 1}}


def test_flags(spark):
    variants, ann = frames(spark)
    only = Preparation(keep_only_hpo=True, include_go=False).fit(variants, ann)
    assert sorted(r["VarID"] for r in only.dataset(variants, ann).collect()) == ["a", "b"] and only.means["AM"] == 1.0
    assert all(t["term"].startswith("HP") for t in only.vocabulary.collect())
    bare = Preparation(basic_features=False, expression_levels=True).fit(variants, ann).dataset(variants, ann)
    assert bare.columns == ["VarID", "netChange", "gene", "sequence", "terms", "values"]
    wide = Preparation(expression_levels=True, include_go=False, include_hpo=False).fit(variants, ann).dataset(variants, ann)
    assert wide.columns[-4:] == ["rel_x", "abs_x", "terms", "values"] and all(r["terms"] == [] for r in wide.collect())
    assert Preparation().fit(variants.where("false"), ann).dataset(variants.where("false"), ann).count() == 0
    with pytest.raises(Exception, match="unknown label"):
        Preparation().fit(variants, ann).dataset(variants.withColumn("netChange", F.lit("odd")), ann).collect()


@pytest.mark.parametrize("block", [7, 4096])
def test_silhouettes_equal_dense(spark, monkeypatch, block):
    monkeypatch.setattr(ML, "SILHOUETTE_ROWS", block)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (20, 3)), rng.normal(3, 1, (15, 3)), [[9, 9, 9]], [[0, 0, 0]] * 3])
    labels = np.stack([np.r_[[0] * 20, [1] * 15, [1], [0] * 3], np.r_[[0] * 20, [1] * 15, [2], [0] * 3], rng.integers(0, 4, 39), np.zeros(39, int)], 1)
    df = spark.createDataFrame([(list(map(float, v)), list(map(int, c))) for v, c in zip(x, labels)], "vector array<double>, labels array<int>").repartition(3)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for c in range(3):
        own, s = labels[:, c], []
        for i in range(len(x)):
            same = (own == own[i]) & (np.arange(len(x)) != i)
            if not same.any():
                s.append(0.0)
                continue
            a, b = far[i][same].mean(), min(far[i][own == k].mean() for k in set(own) if k != own[i])
            s.append((b - a) / max(a, b))
        want.append(np.mean(s))
    got = ML.silhouettes(df, [2, 3, 4, 1])
    assert np.allclose(got[:3], want, atol=1e-6) and got[3] is None
    assert ML.silhouettes(df.where("false"), [2]) == [None]


def test_archive_scoring_can_be_repeated(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    df = spark.createDataFrame([(i, float(i % 7), int(i % 7 > 3)) for i in range(40)], "id long, x double, label int")
    LogisticRegression(featuresCol="features", labelCol="label", maxIter=3).fit(ML.assemble(df, ["x"])).save(f"{tmp_path}/m")
    seen = []
    for fold, epoch in ((0, 0), (1, 0), (1, 2), (1, 0)):
        ML.score_to_archive(f"{tmp_path}/m", df.where(F.col("id") % 2 == fold), ["x"], f"{tmp_path}/archive", "lr", fold, epoch, ["id", "label"])
        rows = spark.read.parquet(f"{tmp_path}/archive").select("run", "fold", "epoch", "mode", "id", "label", "pred").collect()
        seen.append(sorted(map(tuple, rows)))
    assert seen[2] == seen[3] and len(seen[3]) == 60
    assert {(r[0], r[1], r[2], r[3]) for r in seen[3]} == {("lr", 0, 0, "eval"), ("lr", 1, 0, "eval"), ("lr", 1, 2, "eval")}
    assert all(r[4] % 2 == r[1] and (r[6] > 0) == (r[5] == 1) for r in seen[3])


def test_entry_without_the_other_subpackage(monkeypatch):
    """What can't be imported is not registered; all else is."""
    import __spark_entry__ as entry
    from varlens.plans import catalog
    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name in ("varlens.llm", "corpus_pipeline"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())


def test_feature_audit_p_values(spark):
    from varlens.operators import pvalues
    z = {"a": 1.959963984540054, "b": -2.5758293035489, "c": 0.0}
    audit = spark.createDataFrame([(t, 0.5, v) for t, v in z.items()], "term string, log2_or double, z double")
    got = {r["term"]: r for r in pvalues.feature_audit(audit).collect()}
    assert [round(got[t]["p"], 6) for t in "abc"] == [0.05, 0.01, 1.0]
    assert [round(got[t]["p_holm"], 6) for t in "abc"] == [0.1, 0.03, 1.0]
    assert [round(got[t]["p_bh"], 6) for t in "abc"] == [0.075, 0.03, 1.0]
