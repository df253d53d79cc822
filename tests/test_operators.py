"""Keys, density, splits, stats and tails on hand-made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.functions import tails
from varlens.operators import density as D
from varlens.operators import keys as K
from varlens.operators import splits as S
from varlens.operators import stats as ST


def test_strict_label_raises_on_unknown(spark):
    df = spark.createDataFrame([("lof",), ("gof",), ("other",)], "l string")
    with pytest.raises(Exception):
        df.select(K.encode_label_strict(F.col("l"))).collect()


def test_neutral_filter_keeps_null(spark):
    df = spark.createDataFrame([("lof",), ("neutral",), (None,)], "l string")
    assert df.where(K.not_label(F.col("l"))).count() == 2


def test_parse_and_reformat_keys(spark):
    df = spark.createDataFrame([("scn1a:104:A:V",)], "fk string")
    assert df.select(K.reformat_foreign_key(F.col("fk"))).first()[0] == "SCN1A_A_104_V"
    r = spark.createDataFrame([("SCN1A_A_104_V",)], "v string").select(*K.parse_varid(F.col("v"))).first()
    assert (r.gene, r.ref_aa, r.position, r.alt_aa) == ("SCN1A", "A", 104, "V")


def _ring_brute(v, w):
    n = len(v)
    lo, hi = D.ring_offsets(w)
    return [sum(v[(i + k) % n] for k in range(lo, hi + 1)) / w for i in range(n)]


def test_ring_offsets_match_documented_filter():
    # width 2 on [2,8,0,4,1,9,9,0] with weights (1,1)/2: element i averages x[i], x[i+1]
    x = [2, 8, 0, 4, 1, 9, 9, 0]
    assert D.ring_offsets(2) == (0, 1) and D.ring_offsets(10) == (-4, 5) and D.ring_offsets(3) == (-1, 1)
    assert _ring_brute(x, 2)[0] == (2 + 8) / 2 and _ring_brute(x, 2)[-1] == (0 + 2) / 2


def test_density_with_gaps_and_short_gene(spark):
    # gene 1: gaps at start, middle and end; gene 2 shorter than the window
    genes = D.gene_columns(spark.createDataFrame([("f", 1, "--AB-CDE--"), ("f", 2, "X-Y-------")],
                                                 "family string, gene long, row string"))
    variants = spark.createDataFrame([("f", 1, 1, 1), ("f", 1, 5, 1), ("f", 2, 2, 1), ("f", 1, 3, 0)],
                                     "family string, gene long, position int, cls int")
    rc = {(r.gene, r.residue): r.col for r in D.residue_columns(genes).collect()}
    assert rc[(1, 1)] == 3 and rc[(1, 3)] == 6 and rc[(2, 2)] == 3
    prof = D.family_profile(D.position_frequency(variants, genes))
    ring = {(r.gene, r.cls, r.width, r.residue): r.dens
            for r in D.ring_average(prof, genes).collect()}
    # brute force: profile of class 1 on columns, projected to each gene
    prof_cols = {(r.cls, r.col): r.freq for r in prof.collect()}
    for gene, n in ((1, 5), (2, 2)):
        v = [prof_cols.get((1, rc[(gene, i + 1)]), 0) for i in range(n)]
        for w in (10, 3):
            exp = _ring_brute(v, w)
            for i in range(n):
                assert abs(ring.get((gene, 1, w, i + 1), 0.0) - exp[i]) < 1e-12
            assert abs(sum(exp) - sum(v)) < 1e-9  # the ring average keeps the total


def test_position_past_end_raises(spark):
    genes = D.gene_columns(spark.createDataFrame([("f", 1, "A-")], "family string, gene long, row string"))
    for position in (2, 0):
        variants = spark.createDataFrame([("f", 1, position, 1)], "family string, gene long, position int, cls int")
        with pytest.raises(Exception, match="past the end"):
            D.position_frequency(variants, genes).collect()
    folded = variants.selectExpr("*", "0 as outer", "0 as inner")
    with pytest.raises(Exception, match="past the end"):
        D.cross_fitted(folded, genes, "outer", "inner").collect()


def test_density_map_counts_shared_variants_only(spark):
    """Two variants on one residue, one of them outside the feature table: the
    residue counts once.  Five residues, width 10: the window of every residue
    goes twice round, so 2 x 1 / 10; width 3: 1 / 3 at the residue and beside it."""
    genes = D.gene_columns(spark.createDataFrame([("f", 1, "ABCDE")], "family string, gene long, row string"))
    train = spark.createDataFrame([("a", "f", 1, 2, 1), ("b", "f", 1, 2, 1)], "id string, family string, gene long, position int, cls int")
    feats = spark.createDataFrame([("a", "f", 1, 2, 1), ("c", "f", 1, 3, 1), ("d", "f", 1, 5, 0)], train.schema)
    got = {r.id: (r.densgof, r.densgof3aa, r.denslof) for r in D.density_map(train, feats, genes, ["id"]).collect()}
    for name, third in (("a", 1 / 3), ("c", 1 / 3), ("d", 0.0)):
        assert abs(got[name][0] - 0.2) < 1e-12 and abs(got[name][1] - third) < 1e-12 and got[name][2] == 0
    near = {r.id: r.densgof for r in D.density_map(train, feats, genes, ["id"], widths=(3,)).withColumn("densgof", F.col("densgof3aa")).collect()}
    assert abs(near["a"] - 1 / 3) < 1e-12


def test_zeros_are_filled_from_the_first_point(spark):
    from varlens.operators.curves import fill_interior_zeros
    curve = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([0, 0, 0, 4, 0, 2, 0])], "run string, i int, y double")
    got = [r.y for r in fill_interior_zeros(curve, ("run",), "i", "y").orderBy("i").collect()]
    assert [round(y, 6) for y in got] == [0, 1.333333, 2.666667, 4, 3, 2, 0]


def test_fraction_of_a_class_rounds_half_to_even(spark):
    rows = [(i, "two") for i in range(2)] + [(10 + i, "six") for i in range(6)] + [(20 + i, "ten") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = {r.label: r["count"] for r in S.sample_per_class(df, ["label"], "id", 0.25).groupBy("label").count().collect()}
    assert got == {"six": 2, "ten": 2}  # 0.5, 1.5 and 2.5 rows


def test_delimited_files_are_comma_separated_by_default(spark, tmp_path):
    from varlens.sources import io as IO
    df = spark.createDataFrame([(1, "a,b"), (2, "c")], "id long, t string")
    IO.write_by_extension(df, str(tmp_path / "x.csv"))
    text = "".join(p.read_text() for p in (tmp_path / "x.csv").glob("part-*"))
    assert '1,"a,b"' in text
    assert sorted(map(tuple, IO.read_by_extension(spark, str(tmp_path / "x.csv"), "id long, t string").collect())) == [(1, "a,b"), (2, "c")]


def test_jaccard_pairs_over_blocks(spark):
    import itertools
    sets = {f"g{i}": {t for t in range(12) if (i * 7 + t * t) % 5 < 2 or t == 0} for i in range(9)}
    df = spark.createDataFrame([(g, t) for g, ts in sets.items() for t in ts], "g string, t int")
    got = {(r.item_a, r.item_b): (r.inter, round(r.jaccard, 9)) for r in ST.jaccard_pairs(df, "g", "t", blocks=3).collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9))
                   for a, b in itertools.combinations(sorted(sets), 2)}


def test_stratified_kfold_counts(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, label int")
    f = S.stratified_kfold(df, "id", "label", k=10).groupBy("fold", "label").count().collect()
    sizes = {}
    for r in f:
        sizes.setdefault(r.label, []).append(r["count"])
    for lab, cs in sizes.items():
        assert max(cs) - min(cs) <= 1
    assert sum(r["count"] for r in f) == 103


def test_largest_remainder():
    assert S.largest_remainder({0: 7, 1: 3}, 3) == {0: 2, 1: 1}
    assert sum(S.largest_remainder({0: 5, 1: 5, 2: 1}, 4).values()) == 4


def test_holm_bh(spark):
    ps = [0.01, 0.04, 0.03, 0.2]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id long, p double")
    out = {r.id: (r.p_holm, r.p_bh) for r in ST.adjust_pvalues(df, [], "p", "id").collect()}
    # hand-computed: sorted 0.01, 0.03, 0.04, 0.2
    assert abs(out[0][0] - 0.04) < 1e-12 and abs(out[2][0] - 0.09) < 1e-12 and abs(out[1][0] - 0.09) < 1e-12
    assert abs(out[0][1] - 0.04) < 1e-12 and abs(out[1][1] - 0.0533333333333) < 1e-9


def test_tails_against_table_values():
    assert abs(tails.norm_sf(1.959963984540054) - 0.025) < 1e-12
    assert abs(tails.t_two_sided(2.262157, 9) - 0.05) < 1e-6
    assert abs(tails.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(tails.f_sf(4.964603, 1, 10) - 0.05) < 1e-6
    assert abs(tails.studentized_range_sf(3.314, 3) - 0.05) < 2e-3
    assert abs(tails.wilcoxon_exact_sf(8, 10) - 0.048828125) < 1e-12


def test_cross_fitted_matches_direct_refits(spark):
    """Every (outer fold, row) density equals a map refitted on that row's
    training set: dev(o) without the row's inner fold, or all of dev(o)."""
    import random
    rnd = random.Random(5)
    rows, var_rows = [], []
    for g in range(6):
        row = "".join(rnd.choice("AB--C") for _ in range(25))
        rows.append(("f", g, row))
        n = sum(ch != "-" for ch in row)
        for k in range(6):
            var_rows.append(("f", g, k, rnd.randint(1, n), k % 2, g % 3, (g + k) % 2))
    genes = D.gene_columns(spark.createDataFrame(rows, "family string, gene long, row string"))
    v = spark.createDataFrame(var_rows, "family string, gene long, k int, position int, cls int, outer int, inner int")
    names = ("densgof", "densgof3aa", "denslof", "denslof3aa")
    got = {(r.for_outer, r.gene, r.k): [r[c] for c in names] for r in D.cross_fitted(v, genes, "outer", "inner").collect()}
    rounded = {(r.for_outer, r.gene, r.k): [r[c] for c in names] for r in D.cross_fitted(v, genes, "outer", "inner", digits=2).collect()}
    assert len(got) == 3 * len(var_rows)
    for o in range(3):
        for j in (None, 0, 1):  # the map of the outer test rows, and of each inner fold
            train = v.where(F.col("outer") != o)
            if j is not None:
                train = train.where(F.col("inner") != j)
            # the training rows are feature rows, so every row is looked up in one map
            maps = {(r.gene, r.k): [r[c] for c in names] for r in D.density_map(train, v, genes, ["gene", "k"]).collect()}
            own = [r for r in var_rows if (r[5] == o if j is None else r[5] != o and r[6] == j)]
            table = np.array([maps[(r[1], r[2])] for r in own])
            spread = table.std(0)
            z = np.rint((table - table.mean(0)) / np.where(spread > 0, spread, 1) * 100) / 100
            for r, x, y in zip(own, table, z):
                assert np.allclose(got[(o, r[1], r[2])], x, atol=1e-9)
                assert np.allclose(rounded[(o, r[1], r[2])], y, atol=0.0101)


def test_p_values_against_published_tables(spark):
    """Literal values from standard tables and worked examples."""
    from varlens.operators import pvalues as P
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)], "d double")
    t = P.paired_t(d, rho=0.25).first()  # mean 5.5, sd 3.02765, t = 5.7446 on 9 df
    assert abs(t.t - 5.744562646) < 1e-6 and abs(t.p - 0.000278) < 2e-6 and t.p_corrected > t.p
    w = P.wilcoxon(d).first()
    assert w.w_plus == 55 and abs(w.p - 2 / 1024) < 1e-12  # all positive: 2 of 2^10 sign patterns
    assert P.wilcoxon_p(0, 0, 0, 0) == 1.0
    none = P.wilcoxon(d.select((F.col("d") * 0).alias("d"))).first()
    assert none.n == 0 and none.p == 1.0
    assert abs(P.wilcoxon_p(60, 60 * 61 / 4, 0, 0) - 1) < 1e-12
    # U = 0 for 10 and 10 untied values: z = (50 - 0.5) / sqrt(175) = 3.7418
    assert abs(P.rank_sum_p(10, 10, 0, 0) - 0.000182672) < 1e-7
    assert abs(P.rank_sum_p(10, 10, 100, 0, "greater") - 0.000091336) < 1e-7
    assert P.rank_sum_p(10, 10, 100, 0, "less") > 0.9999 and P.rank_sum_p(3, 4, 6, 7 ** 3 - 7) == 1.0
    # limiting Kolmogorov distribution: 5 % at 1.3581, 1 % at 1.6276
    assert abs(P.kolmogorov_p(1.3581 / 10, 200, 200) - 0.05) < 1e-4 and abs(P.kolmogorov_p(1.6276 / 10, 200, 200) - 0.01) < 1e-4


def test_group_tests_and_pairwise_holm(spark):
    from varlens.operators import pvalues as P
    rows = [(f, r, v) for f, vs in enumerate([(1, 2, 3), (2, 3, 5), (1, 3, 4), (2, 4, 5)]) for r, v in zip("abc", vs)]
    scores = spark.createDataFrame([(f, r, float(v)) for f, r, v in rows], "fold int, run string, value double")
    fr = P.friedman(scores).first()  # ranks 1, 2, 3 in all four blocks: chi2 = 8 on 2 df
    assert abs(fr.chi2 - 8) < 1e-9 and abs(fr.p - math.exp(-4)) < 1e-9
    nem = {(r.run_a, r.run_b): r.p for r in P.nemenyi(scores).collect()}
    assert nem[("a", "c")] < 0.05 < nem[("a", "b")]
    an = P.rm_anova(scores).first()
    assert an.df1 == 2 and an.df2 == 6 and abs(an.f - 54.6) < 1e-6 and abs(an.p - 19.2 ** -3) < 1e-9
    pw = {(r.run_a, r.run_b): r for r in P.pairwise_t(scores).collect()}
    assert len(pw) == 3 and pw[("a", "c")].n == 4
    ps = sorted(r.p for r in pw.values())
    holm = sorted(r.p_holm for r in pw.values())
    running = 0.0
    for i, p in enumerate(ps):
        running = max(running, min(1.0, (3 - i) * p))
        assert abs(holm[i] - running) < 1e-12
    groups = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3)] + [("y", float(v)) for v in (4, 5, 6)] + [("z", float(v)) for v in (7, 8, 9)],
                                   "g string, v double")
    kw = P.kruskal(groups, "g", "v").first()  # H = 7.2 on 2 df
    assert abs(kw.h - 7.2) < 1e-9 and abs(kw.p - math.exp(-3.6)) < 1e-9


def test_group_kfold_is_greedy(spark):
    rows = [(g, i) for g, n in (("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int")
    got = {r.g: r.fold for r in S.group_kfold(df, "g", 2).select("g", "fold").distinct().collect()}
    # a -> 0 (5), b -> 1 (4), c -> 1 (7), d -> 0 (8), e -> 1 (8)
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_model_stage_invariants(spark):
    from varlens.operators import ml as ML
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(4, 0.3, (40, 2))])
    df = spark.createDataFrame([(i, float(a), float(b), int(i >= 40)) for i, (a, b) in enumerate(x)], "id long, a double, b double, label int")
    found = ML.choice_of_k(df, ["a", "b"], 3, restarts=3)
    dense = ((x - x.mean(0)) ** 2).sum()
    assert abs(found[0][1] - dense) < 1e-6 * dense and found[0][2] is None
    two = sum(((p - p.mean(0)) ** 2).sum() for p in (x[:40], x[40:]))
    assert abs(found[1][1] - two) < 1e-6 * dense and found[1][2] > 0.9 > found[2][2]
    _, ratio, singular = ML.pca_scores(df, ["a", "b"], 2)
    exact = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(singular, exact, rtol=1e-6) and abs(sum(ratio) - 1) < 1e-9
    grid = dict(maxIter=(3,), stepSize=(0.1,), subsamplingRate=(1.0,), maxDepth=(1, 2), minInstancesPerNode=(1,))
    scored, table = ML.tuned_holdout(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), ["a", "b"], "id", grid=grid)
    assert len(table) == 2 and all(r == 1.0 for _, r in table)
    assert all((r.score > 0) == (r.label == 1) and math.isfinite(r.score) for r in scored.collect())


def test_registered_model_queries_run_the_whole_search(spark, monkeypatch):
    """No query hands the operators fewer settings, trees, restarts or k than their defaults."""
    from varlens.operators import ml as ML
    from varlens.plans import q_ml
    seen = {}

    class Stop(Exception):
        pass

    def stand_in(name):
        def call(*args, **named):
            seen[name] = (args, named)
            raise Stop
        return call

    for query, name in (("ml02_grid_search", "grid_search"), ("ml03_tuned_holdout", "tuned_holdout"),
                        ("ml04_nested_cv", "nested_cv"), ("ml06_choice_of_k", "choice_of_k")):
        monkeypatch.setattr(ML, name, stand_in(name))
        with pytest.raises(Stop):
            getattr(q_ml, query)(spark, "/root/testdata/sf0.001")
        assert not set(seen[name][1]) & {"grid", "folds", "setting", "restarts"}
    assert seen["choice_of_k"][0][2] == 9
    sizes = [len(v) for v in ML.GBT_GRID.values()]
    assert sizes == [2, 2, 2, 3, 3] and ML.GBT_PARAMS["maxIter"] == 200


def test_permuted_values_are_permutations(spark):
    from varlens.operators import stats as ST
    values = spark.createDataFrame([(i, i / 7) for i in range(12)], "g long, a double")
    one = {r.g: r.permuted for r in ST.permuted_values(values, "g", "a", 40, seed=5).collect()}
    two = {r.g: r.permuted for r in ST.permuted_values(values.repartition(7), "g", "a", 40, seed=5).collect()}
    assert one == two
    table = np.array([one[g] for g in range(12)])
    assert np.allclose(np.sort(table, 0), np.arange(12)[:, None] / 7)
    assert len({tuple(c) for c in table.T}) > 35  # the relabellings differ


def _dense_mantel(v, a):
    n = len(a)
    i, j = np.triu_indices(n, 1)
    return 1 - (v @ v.T)[i, j], np.abs(a[i] - a[j])


def test_cosine_mantel_equals_dense(spark):
    from varlens.operators import stats as ST
    rng = np.random.default_rng(8)
    w = rng.random((14, 9)) * (rng.random((14, 9)) < 0.4)
    w[0] = 0  # an item without terms
    w[3] = w[4]
    a = np.round(rng.random(14), 1)
    rows = [(int(i), f"t{t}", float(w[i, t])) for i, t in zip(*np.nonzero(w))] + [(2, "t0", 0.0)]
    weights = spark.createDataFrame(rows, "g long, term string, w double")
    values = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "g long, a double")
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    v = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)
    x, y = _dense_mantel(v, a)
    got = ST.mantel_cosine(weights, values, "g", "term", "w", "a").first()
    assert got.n_pairs == 91 and abs(got.r - np.corrcoef(x, y)[0, 1]) < 1e-9
    pairs = {(p.item_a, p.item_b): p for p in ST.weighted_pairs(weights, values, "g", "term", "w", "a").collect()}
    for i in range(14):
        for j in range(i + 1, 14):
            dot = float(v[i] @ v[j])
            assert ((i, j) in pairs) == (dot > 0)
            if dot > 0:
                assert abs(pairs[i, j].cosine - dot) < 1e-9 and abs(pairs[i, j].scalar_distance - abs(a[i] - a[j])) < 1e-12
    found = ST.mantel_permutation(ST.weighted_pairs(weights, values, "g", "term", "w", "a"), values, "g", "a", 200, similarity="cosine",
                                  observed=ST.mantel_cosine(weights, values, "g", "term", "w", "a")).first()
    table = {r.g: r.permuted for r in ST.permuted_values(values, "g", "a", 200).collect()}
    perms = np.array([table[g] for g in range(14)]).T
    r = [np.corrcoef(x, _dense_mantel(v, p)[1])[0, 1] for p in perms]
    want = (sum(abs(q) >= abs(got.r) - 1e-12 for q in r) + 1) / 201
    assert found.permutations == 200 and abs(found.p_value - want) < 1e-9


def test_group_kfold_equals_the_plain_rule(spark):
    rng = np.random.default_rng(3)
    for k, sizes in ((3, [1] * 17), (4, list(rng.integers(1, 5, 40)) + [30, 9]), (5, [7, 7, 7]), (2, [100, 1, 1, 1, 50, 50])):
        rows = [(f"g{i:02d}", j) for i, n in enumerate(sizes) for j in range(int(n))]
        loads, want = [0] * k, {}
        for n, name in sorted(((-int(n), f"g{i:02d}") for i, n in enumerate(sizes))):
            fold = min(range(k), key=lambda f: (loads[f], f))
            loads[fold] -= n
            want[name] = fold
        got = {r.g: r.fold for r in S.group_kfold(spark.createDataFrame(rows, "g string, i int"), "g", k).select("g", "fold").distinct().collect()}
        assert got == want, (k, sizes)
        alone = {r.g: r.fold for r in S.leave_one_group_out(spark.createDataFrame(rows, "g string, i int"), "g").select("g", "fold").distinct().collect()}
        assert alone == {name: i for i, (_, name) in enumerate(sorted((-int(n), f"g{i:02d}") for i, n in enumerate(sizes)))}


def test_edits_are_spliced_into_sequences(spark):
    from varlens.operators import sequence as Q
    seqs = spark.createDataFrame([(1, "abcdé😀g"), (2, ""), (3, "xyz"), (4, "q")], "k long, s string")
    edits = [(1, 1, "A", 0), (1, 7, "G", 0), (1, 6, "F", 1), (1, 6, "f", 2), (1, 9, "!", 0), (1, 0, "!", 0), (2, 1, "z", 0), (4, 1, "q", 0)]
    v = spark.createDataFrame(edits, "k long, position int, alt string, o int")
    got = {r.k: (r.sequence, r.n_changed) for r in Q.apply_all_variants(seqs, v, "k", "s", "o").collect()}
    assert got == {1: ("AbcdéfG", 3), 2: ("", 0), 3: ("xyz", 0), 4: ("q", 0)}


def test_padded_matrices(spark):
    from varlens.operators import arrays as AR
    res = spark.createDataFrame([(0, i, [float(i), -1.0]) for i in range(3)] + [(1, 0, [9.0, 9.0])], "s int, residue int, vec array<float>")
    sizes = spark.createDataFrame([(0, 1, 2, 4), (1, 0, 1, 1), (2, 0, 0, 2)], "s int, start int, n int, length int")
    for front, want in ((False, [[1, -1], [2, -1], [0, 0], [0, 0]]), (True, [[0, 0], [0, 0], [1, -1], [2, -1]])):
        got = {}
        for r in AR.padded(res, sizes, "s", "length", 2, front).collect():
            got.setdefault(r.s, {})[r.idx] = list(r.vec)
        assert [got[0][i] for i in range(4)] == want and got[1] == {0: [9.0, 9.0]} and got[2] == {0: [0, 0], 1: [0, 0]}
    cut = spark.createDataFrame([(0, 0, 3, 2)], "s int, start int, n int, length int")
    assert sorted((r.idx, r.vec[0]) for r in AR.padded(res, cut, "s", "length", 2).collect()) == [(0, 0.0), (1, 1.0)]
    assert sorted((r.idx, r.vec[0]) for r in AR.padded(res, cut, "s", "length", 2, True).collect()) == [(0, 1.0), (1, 2.0)]
