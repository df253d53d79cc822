"""Prefix sums, ranks and curves against brute force on small tables."""

import itertools
import random

from pyspark.sql import functions as F

from varlens.functions.prefix import avg_rank, prefix_sum, prefix_extreme
from varlens.operators import curves as C
from varlens.operators import metrics as M


def _pred(spark, rows):
    return spark.createDataFrame(rows, "run string, fold int, epoch int, id long, grp long, score double, label int")


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_prefix_sum_matches_cumsum_and_is_partition_independent(spark):
    rnd = random.Random(3)
    rows = [("a" if i % 3 else "b", float(i), rnd.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, x double, v long")
    expect = {}
    for k in ("a", "b"):
        acc = 0
        for kk, x, v in sorted(r for r in rows if r[0] == k):
            acc += v
            expect[(k, x)] = acc
    for parts in (1, 17):
        out = prefix_sum(df.repartition(parts), ["k"], "x", ["v"], n_buckets=7).collect()
        assert {(r.k, r.x): r.v_cum for r in out} == expect


def test_prefix_extreme_running_max(spark):
    rows = [(i, float((i * 7) % 11)) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, v double")
    out = {r.i: r.v_max for r in prefix_extreme(df, [], "i", "v", "max", n_buckets=5).collect()}
    m = float("-inf")
    for i, v in rows:
        m = max(m, v)
        assert out[i] == m


def test_avg_rank_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (3.0,), (3.0,)], "x double").withColumn("k", F.lit(1))
    r = {row.x: row.rank for row in avg_rank(df, ["k"], "x").collect()}
    assert r == {1.0: 1.0, 2.0: 2.5, 3.0: 5.0}


def test_auc_matches_brute_force_with_ties_and_single_class(spark):
    rnd = random.Random(7)
    rows = []
    for fold in range(4):
        for i in range(60):
            s = rnd.choice([0.1, 0.2, 0.5, 0.5, 0.7, 0.9])
            y = (0 if fold == 3 else rnd.randint(0, 1))  # fold 3 has one class
            rows.append(("r", fold, 1, i, 0, s, y))
    st = M.score_table(_pred(spark, rows), ("run", "fold"), materialized=False)
    got = {r.fold: r.auc for r in C.roc_auc(st, ["run", "fold"]).collect()}
    for fold in range(4):
        sc = [r[5] for r in rows if r[1] == fold]
        lb = [r[6] for r in rows if r[1] == fold]
        exp = brute_auc(sc, lb)
        if exp is None:
            assert got[fold] is None
        else:
            assert abs(got[fold] - exp) < 1e-12


def test_auc_symmetry_and_roc_endpoints(spark):
    rnd = random.Random(11)
    rows = [("r", 0, 1, i, 0, rnd.random(), rnd.randint(0, 1)) for i in range(100)]
    p = _pred(spark, rows)
    st = M.score_table(p, ("run", "fold"), materialized=False)
    neg = M.score_table(p.withColumn("score", -F.col("score")), ("run", "fold"), materialized=False)
    a = C.roc_auc(st, ["run", "fold"]).first().auc
    b = C.roc_auc(neg, ["run", "fold"]).first().auc
    assert abs(a + b - 1.0) < 1e-12
    roc = C.roc_curve(st, ["run", "fold"]).collect()
    assert max((r.fpr, r.tpr) for r in roc) == (1.0, 1.0)
    assert min((r.fpr, r.tpr) for r in roc) == (0.0, 0.0)


def test_confusion_counts_sum_to_n(spark):
    rows = [("r", 0, 1, i, 0, (i % 10) / 10.0, i % 2) for i in range(37)]
    st = M.score_table(_pred(spark, rows), ("run", "fold"), materialized=False)
    cm = M.confusion_from_table(st, ["run", "fold"]).first()
    assert cm.tn + cm.fp + cm.fn + cm.tp == cm.n == 37


def test_best_epoch_earliest_on_ties(spark):
    loss = spark.createDataFrame([("r", 0, 1, 0.5), ("r", 0, 2, 0.3), ("r", 0, 3, 0.3)],
                                 "run string, fold int, epoch int, loss double")
    assert M.best_epoch(loss).first().best_epoch == 2


def test_sweep_and_calibration_do_not_depend_on_partitions(spark):
    rnd = random.Random(11)
    rows = [("a", f, i / 1000, rnd.randint(0, 4), rnd.randint(0, 4)) for f in range(3) for i in range(0, 1001, 3)]
    st = spark.createDataFrame(rows, "run string, fold int, score double, pos long, neg long")
    seen = [(sorted(map(tuple, C.threshold_sweep(st.repartition(n), ["run"]).collect())),
             sorted(tuple(r)[:2] + tuple(r)[3:] for r in C.calibration(st.repartition(n), ["run", "fold"], ["run", "fold"]).collect()),
             sorted(r["prob_pred"] for r in C.calibration(st.repartition(n), ["run", "fold"], ["run", "fold"]).collect())) for n in (1, 7, 64)]
    assert seen[0] == seen[1] == seen[2]
