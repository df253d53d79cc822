"""Row ranks that cross the cluster once, mutants spread over tasks, silhouettes in small batches."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from varlens.functions.prefix import row_ranks
from varlens.operators import ml as ML
from varlens.operators import sequence as Q


def test_row_ranks_move_the_rows_once(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 60), rnd.choice([0.5, None, 1.5])) for _ in range(400)]
    df = spark.createDataFrame(rows, "key string, id long, value double")
    digest = F.md5(F.col("id").cast("string"))
    ranked = row_ranks(df, ["key"], [digest, "id"], bucket_on=F.conv(F.substring(digest, 1, 13), 16, 10).cast("double"))
    assert ranked.columns == ["key", "id", "value", "__row"]
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    got = ranked.collect()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)[:3]) for r in got)
    for key in ("a", "b", None):
        own = sorted((r for r in got if r.key == key), key=lambda r: r["__row"])
        assert [r["__row"] for r in own] == list(range(1, len(own) + 1))
        order = [(hashlib.md5(str(r.id).encode()).hexdigest(), r.id) for r in own]
        assert order == sorted(order)
    assert row_ranks(df.where("false"), ["key"], "id").collect() == []


def test_mutants_are_spread_and_nested(spark, monkeypatch):
    monkeypatch.setattr(Q, "MUTANT_RESIDUES", 4)
    seqs = spark.createDataFrame([(i, t) for i, t in enumerate(["ACD", "é😀\n", "", None, "A", "A"])], "id long, text string").coalesce(1)
    flat = Q.single_mutants(seqs, "id", "text")
    assert flat.rdd.getNumPartitions() > 1  # before: all in the one partition of the input
    rows = sorted((r.id, r.position, r.wt, r.aa, r.mutant) for r in flat.collect())
    want = sorted((i, p + 1, t[p], a, t[:p] + a + t[p + 1:]) for i, t in enumerate(["ACD", "é😀\n", "", None, "A", "A"]) for p in range(len(t or "")) for a in Q.AMINO_ACIDS)
    assert rows == want
    nested = Q.single_mutants(seqs, ["id"], "text", by_residue=True).collect()
    assert sorted((r.id, r.position, r.wt, x.aa, x.mutant) for r in nested for x in r.mutants) == want
    assert len(nested) * 20 == len(want)


def test_silhouettes_do_not_depend_on_the_batch(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    points, labels = rnd.normal(size=(50, 3)), rnd.integers(0, 3, 50)
    df = spark.createDataFrame([(p.tolist(), [int(c)]) for p, c in zip(points, labels)], "vector array<double>, labels array<int>").coalesce(1)
    whole = ML.silhouettes(df, [3])
    monkeypatch.setattr(ML, "SILHOUETTE_BATCH", 7)
    assert np.allclose(ML.silhouettes(df, [3]), whole)
