"""Group-level statistics over score tables (STA-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.functions.prefix import hex_lead, row_ranks


def permute_within(df: DataFrame, keys: Sequence[str], tie_cols: Sequence[str], draws: Sequence[tuple[Column, str, str]]) -> DataFrame:
    """Seeded permutations of values within each key.  Of each draw (hash column,
    value, out) the row at position r in the natural order (``tie_cols``)
    receives in ``out`` the ``value`` of the row at position r in hash order.
    The natural order is numbered once and each hash order once, without
    per-key windows (``row_ranks``); they meet in equi-joins on (key, r)."""
    keys, tie_cols = list(keys), list(tie_cols)
    base = df.select(*keys, *tie_cols)
    out = row_ranks(base, keys, tie_cols, splits_from=base)
    for hash_col, value, name in draws:
        b = row_ranks(base, keys, [hash_col, *tie_cols], bucket_on=hex_lead(hash_col), splits_from=base)
        out = out.join(b.select(*keys, "__row", F.col(value).alias(name)), [*keys, "__row"])
    return out


# ---------------------------------------------------------------------------
# paired tests over a score table (run, fold, value)
# ---------------------------------------------------------------------------

def paired_diffs(scores: DataFrame, a: str, b: str, block: str = "fold", run: str = "run",
                 value: str = "value") -> DataFrame:
    """(block, d = value[a] - value[b]) for blocks holding both runs."""
    x = scores.where(F.col(run) == a).select(block, F.col(value).alias("__a"))
    y = scores.where(F.col(run) == b).select(block, F.col(value).alias("__b"))
    return x.join(y, block).select(block, (F.col("__a") - F.col("__b")).alias("d"))


def paired_t(d: DataFrame, rho: float | None = None) -> DataFrame:
    """Paired t statistic (STA-02) and, with ``rho``, the corrected resampled
    t of Nadeau and Bengio, variance x (1/n + rho) (STA-03); plus the effect
    size mean / sd (STA-10).  One aggregate row."""
    agg = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd_d"),
                F.var_samp("d").alias("var_d"))
    t = F.col("mean_d") / (F.col("sd_d") / F.sqrt(F.col("n")))
    cols = [F.col("n"), F.col("mean_d"), F.col("sd_d"), t.alias("t"), (F.col("n") - 1).alias("df"),
            (F.col("mean_d") / F.col("sd_d")).alias("cohen_d")]
    if rho is not None:
        cols.append((F.col("mean_d") / F.sqrt(F.col("var_d") * (1.0 / F.col("n") + F.lit(rho)))).alias("t_corrected"))
    return agg.select(*cols)


def wilcoxon(d: DataFrame) -> DataFrame:
    """Signed-rank statistics (STA-04): zero differences dropped, average
    ranks of |d| with ties, W+ and W-; statistic = min(W+, W-).  Also the
    tie term sum(t^3 - t) for the normal approximation."""
    from varlens.functions.prefix import avg_rank
    nz = d.where(F.col("d") != 0).withColumn("absd", F.abs("d")).withColumn("__k", F.lit(1))
    r = avg_rank(nz, ["__k"], "absd")
    sides = nz.groupBy("absd").agg(F.sum((F.col("d") > 0).cast("long")).alias("up"),  # one row per value, not per difference
                                   F.sum((F.col("d") < 0).cast("long")).alias("down"))
    j = sides.join(r.select("absd", "rank"), "absd")
    zero = F.lit(0)
    agg = j.agg(F.coalesce(F.sum(F.col("up") + F.col("down")), zero).alias("n"),
                F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w_plus"),
                F.coalesce(F.sum(F.col("down") * F.col("rank")), F.lit(0.0)).alias("w_minus"))
    ties = r.agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("tie_term"))
    return agg.crossJoin(ties).select("n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("statistic"),
                                      F.coalesce("tie_term", F.lit(0)).alias("tie_term"))


def mann_whitney(df: DataFrame, keys, group: str, value: str, ties: bool = False) -> DataFrame:
    """Rank-sum test statistics per key (STA-05): U of group 1,
    U1 = R1 - n1 (n1 + 1) / 2, with average ranks over both groups; with
    ``ties`` also the tie term sum(t^3 - t)."""
    from varlens.functions.prefix import avg_rank
    keys = list(keys)
    vc = df.groupBy(*keys, value).agg(F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("n1v"),
                                      F.count(F.lit(1)).alias("nv"))
    r = avg_rank(df, keys, value)
    j = vc.join(r.select(*keys, value, "rank"), [*keys, value])
    t = F.col("nv").cast("double")
    agg = j.groupBy(*keys).agg(F.sum(F.col("n1v") * F.col("rank")).alias("r1"), F.sum("n1v").alias("n1"),
                               (F.sum("nv") - F.sum("n1v")).alias("n2"), F.sum(t * t * t - t).alias("tie_term"))
    return agg.select(*keys, "n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u1"),
                      *(["tie_term"] if ties else []))


def ks_2samp(df: DataFrame, keys, group: str, value: str) -> DataFrame:
    """Two-sample KS statistic per key (STA-05): the largest gap between the
    two empirical CDFs, over distinct values via prefix counts."""
    from varlens.functions.prefix import prefix_sum
    keys = list(keys)
    vc = df.groupBy(*keys, value).agg(F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("c1"),
                                      F.sum(F.when(F.col(group) == 1, 0).otherwise(1)).alias("c0"))
    cum = prefix_sum(vc, keys, value, ["c1", "c0"], inclusive=True, with_totals=True)
    gap = F.abs(F.col("c1_cum") / F.col("c1_total") - F.col("c0_cum") / F.col("c0_total"))
    return cum.groupBy(*keys).agg(F.max(gap).alias("ks_d"), F.first("c1_total").alias("n1"),
                                  F.first("c0_total").alias("n0"))


def friedman(scores: DataFrame, block: str = "fold", treat: str = "run", value: str = "value") -> DataFrame:
    """Friedman chi-square with the tie correction (STA-06); ranks within
    each block across treatments (a block has k rows)."""
    from pyspark.sql import Window
    wb = Window.partitionBy(block, value)
    r = scores.select(block, treat, value,
                      (F.rank().over(Window.partitionBy(block).orderBy(value)) + (F.count(F.lit(1)).over(wb) - 1) / 2.0)
                      .alias("rank"), F.count(F.lit(1)).over(wb).alias("tie"))
    rs = r.groupBy(treat).agg(F.sum("rank").alias("R"))
    k_n = scores.agg(F.count_distinct(treat).alias("k"), F.count_distinct(block).alias("n"))
    ties = r.groupBy(block, value).agg(F.first("tie").alias("t")).agg(
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tt"))
    s = rs.agg(F.sum(F.col("R") * F.col("R")).alias("sr2")).crossJoin(k_n).crossJoin(ties)
    chi = (12.0 / (F.col("n") * F.col("k") * (F.col("k") + 1)) * F.col("sr2") - 3.0 * F.col("n") * (F.col("k") + 1))
    corr = 1.0 - F.col("tt") / (F.col("n") * F.col("k") * (F.col("k") * F.col("k") - 1))
    return s.select("k", "n", (chi / corr).alias("chi2"), (F.col("k") - 1).alias("df"))


def mean_ranks(scores: DataFrame, block: str = "fold", treat: str = "run", value: str = "value") -> DataFrame:
    """Average within-block rank of each treatment (ascending value)."""
    from pyspark.sql import Window
    wb = Window.partitionBy(block, value)
    r = scores.select(block, treat, (F.rank().over(Window.partitionBy(block).orderBy(value))
                                     + (F.count(F.lit(1)).over(wb) - 1) / 2.0).alias("rank"))
    return r.groupBy(treat).agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def nemenyi(scores: DataFrame, block: str = "fold", treat: str = "run", value: str = "value") -> DataFrame:
    """Pairwise Nemenyi statistics after Friedman (STA-07):
    q = |R_a - R_b| / sqrt(k (k + 1) / (6 n)) * sqrt(2), compared with the
    studentised range.  Pairs of treatments (k is small)."""
    mr = mean_ranks(scores, block, treat, value)
    k = mr.agg(F.count(F.lit(1)).alias("k"))
    a, b = mr.alias("a"), mr.alias("b")
    p = a.join(b, F.col(f"a.{treat}") < F.col(f"b.{treat}")).crossJoin(k)
    q = F.abs(F.col("a.mean_rank") - F.col("b.mean_rank")) / F.sqrt(
        F.col("k") * (F.col("k") + 1) / (6.0 * F.col("a.n"))) * F.sqrt(F.lit(2.0))
    return p.select(F.col(f"a.{treat}").alias(f"{treat}_a"), F.col(f"b.{treat}").alias(f"{treat}_b"), "k", q.alias("q"))


def rm_anova(scores: DataFrame, block: str = "fold", treat: str = "run", value: str = "value") -> DataFrame:
    """One-way repeated-measures ANOVA, subject = block (STA-08)."""
    g = scores.agg(F.avg(value).alias("gm"), F.count_distinct(treat).alias("k"), F.count_distinct(block).alias("n"),
                   F.sum(F.col(value) * F.col(value)).alias("ss"), F.count(F.lit(1)).alias("n_obs"))
    tm = scores.groupBy(treat).agg(F.avg(value).alias("m"))
    bm = scores.groupBy(block).agg(F.avg(value).alias("m"))
    sst = tm.crossJoin(g).agg(F.sum((F.col("m") - F.col("gm")) ** 2).alias("a"))
    ssb = bm.crossJoin(g).agg(F.sum((F.col("m") - F.col("gm")) ** 2).alias("b"))
    s = g.crossJoin(sst).crossJoin(ssb)
    ss_total = F.col("ss") - F.col("n_obs") * F.col("gm") * F.col("gm")
    ss_model = F.col("n") * F.col("a")
    ss_subj = F.col("k") * F.col("b")
    ss_err = ss_total - ss_model - ss_subj
    df1, df2 = F.col("k") - 1, (F.col("k") - 1) * (F.col("n") - 1)
    return s.select(ss_model.alias("ss_model"), ss_err.alias("ss_error"), df1.alias("df1"), df2.alias("df2"),
                    ((ss_model / df1) / (ss_err / df2)).alias("f"))


def adjust_pvalues(df: DataFrame, keys, p: str = "p", tie: str = "id") -> DataFrame:
    """Holm (step-down) and Benjamini-Hochberg (step-up) adjusted p-values,
    capped at 1 (STA-09).  Both are running extremes along the sorted
    p-values, computed with range-bucketed prefix scans (no single-task
    window over all hypotheses); tied p-values get the same value either way."""
    from varlens.functions.prefix import prefix_extreme, prefix_sum
    keys = list(keys)
    d = df.withColumn("__one", F.lit(1).cast("long"))
    r = prefix_sum(d, keys, [p, tie], ["__one"], inclusive=True, suffix="_i", with_totals=True)
    r = r.withColumnRenamed("__one_i", "__i").withColumnRenamed("__one_total", "__m")
    r = r.withColumn("__holm", F.least(F.lit(1.0), (F.col("__m") - F.col("__i") + 1) * F.col(p)))
    r = r.withColumn("__bh", F.least(F.lit(1.0), F.col("__m") * F.col(p) / F.col("__i")))
    r = prefix_extreme(r, keys, [p, tie], "__holm", "max", out="p_holm")
    r = prefix_extreme(r, keys, [p, tie], "__bh", "min", descending=True, out="p_bh")
    return r.drop("__one", "__i", "__m", "__holm", "__bh")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with the tie correction (STA-12)."""
    from varlens.functions.prefix import avg_rank
    d = df.withColumn("__k", F.lit(1))
    r = avg_rank(d, ["__k"], value)
    counts = d.groupBy(group, value).agg(F.count(F.lit(1)).alias("nv"))  # one row per group and value
    j = counts.join(r.select(value, "rank"), value)
    per = j.groupBy(group).agg(F.sum(F.col("rank") * F.col("nv")).alias("R"), F.sum("nv").alias("ng"))
    N = d.agg(F.count(F.lit(1)).alias("n_total"))
    ties = r.agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("tt"))
    s = per.agg(F.sum(F.col("R") * F.col("R") / F.col("ng")).alias("s"), F.count(F.lit(1)).alias("g")).crossJoin(
        N).crossJoin(ties)
    n = F.col("n_total")
    h = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    c = 1.0 - F.col("tt") / (n * n * n - n)
    return s.select(n.alias("n_total"), "g", (h / c).alias("h"), (F.col("g") - 1).alias("df"))


def jaccard_pairs(df: DataFrame, item: str, term: str, blocks: int = 8) -> DataFrame:
    """Jaccard similarity of items' term sets for pairs sharing a term
    (STA-13): intersections from a self-join on the term, set sizes from one
    aggregate.  A term's list of items is split into ``blocks`` parts by a
    hash of the item, and pairs of parts are joined, so that a term that most
    items hold is spread over blocks x blocks join keys.  Pairs with no shared
    term have similarity 0 and are not emitted."""
    d = df.select(item, term).distinct()
    sizes = d.groupBy(item).agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = d.withColumn("__pa", part).withColumn("__pb", every).alias("a")
    b = d.withColumn("__pb", part).withColumn("__pa", every).alias("b")
    inter = (a.join(b, (F.col(f"a.{term}") == F.col(f"b.{term}")) & (F.col("a.__pa") == F.col("b.__pa"))
                    & (F.col("a.__pb") == F.col("b.__pb")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
              .groupBy(F.col(f"a.{item}").alias("item_a"), F.col(f"b.{item}").alias("item_b"))
              .agg(F.count(F.lit(1)).alias("inter")))
    sa = sizes.select(F.col(item).alias("item_a"), F.col("size").alias("size_a"))
    sb = sizes.select(F.col(item).alias("item_b"), F.col("size").alias("size_b"))
    j = inter.join(sa, "item_a").join(sb, "item_b")
    return j.select("item_a", "item_b", "inter",
                    (F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter"))).alias("jaccard"))


def _pair_sums(values: DataFrame, item: str, value: str) -> DataFrame:
    """One row: N, P = N(N-1)/2, sum over all pairs of |a_i - a_j| (from
    average ranks: sum_i a_i (2 rank_i - N - 1)) and of (a_i - a_j)^2
    (N sum a^2 - (sum a)^2), without forming the pairs."""
    from varlens.functions.prefix import avg_rank
    d = values.withColumn("__k", F.lit(1))
    r = avg_rank(d, ["__k"], value)
    tot = values.agg(F.count(F.lit(1)).alias("n_items"), F.sum(value).alias("sa"),
                     F.sum(F.col(value) * F.col(value)).alias("saa"))
    sy = r.crossJoin(tot).agg(F.sum(F.col("n") * F.col(value) * (2 * F.col("rank") - F.col("n_items") - 1)).alias("sy"))
    return tot.crossJoin(sy).select("n_items", (F.col("n_items") * (F.col("n_items") - 1) / 2).alias("P"), "sy",
                                    (F.col("n_items") * F.col("saa") - F.col("sa") * F.col("sa")).alias("syy"))


def _mantel_r(P, sj, sjj, sy, syy, sjy):
    sx = P - sj
    sxx = P - 2 * sj + sjj
    sxy = sy - sjy
    from varlens.functions.exprs import safe_div
    return safe_div(P * sxy - sx * sy, F.sqrt((P * sxx - sx * sx) * (P * syy - sy * sy)))


def mantel_sparse(jac: DataFrame, values: DataFrame, item: str, value: str) -> DataFrame:
    """Mantel r (STA-14) between x = 1 - Jaccard (0 similarity for pairs
    that share nothing) and y = |a_i - a_j| over all item pairs.  The pair
    sums come from the sparse sharing pairs plus closed forms over ranks, so
    no all-pairs table is built."""
    va = values.select(F.col(item).alias("item_a"), F.col(value).alias("__a"))
    vb = values.select(F.col(item).alias("item_b"), F.col(value).alias("__b"))
    s = (jac.join(va, "item_a").join(vb, "item_b")
            .agg(F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("sj"),
                 F.coalesce(F.sum(F.col("jaccard") * F.col("jaccard")), F.lit(0.0)).alias("sjj"),
                 F.coalesce(F.sum(F.col("jaccard") * F.abs(F.col("__a") - F.col("__b"))), F.lit(0.0)).alias("sjy")))
    t = _pair_sums(values, item, value).crossJoin(s)
    r = _mantel_r(F.col("P"), F.col("sj"), F.col("sjj"), F.col("sy"), F.col("syy"), F.col("sjy"))
    return t.select(F.col("P").cast("long").alias("n_pairs"), r.alias("r"))


def permuted_values(values: DataFrame, item: str, value: str, permutations: int, seed=404) -> DataFrame:
    """(item, ``permuted`` array): the item's value in each of ``permutations``
    relabellings.  In relabelling p the items stand in the order of a hash of
    (item, p, seed) and take the values in item order, so each one is a
    permutation, the same in any partitioning."""
    from varlens.functions.prefix import hex_lead, prefix_sum
    from varlens.operators.splits import rank_within
    base = rank_within(values.select(item, value), [], item, f"{seed}-base", "__at").select("__at", F.col(value).alias("__v"))
    many = values.select(item, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("__p"))
    many = many.withColumn("__h", F.md5(F.concat_ws("|", F.col(item).cast("string"), F.col("__p").cast("string"), F.lit(str(seed)))))
    placed = prefix_sum(many.withColumn("__one", F.lit(1).cast("long")), ["__p"], ["__h", item], ["__one"], suffix="_rank",
                        bucket_on=hex_lead(F.col("__h")))
    got = placed.join(base, F.col("__one_rank") == F.col("__at"))
    # one array of fixed length an item
    return got.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__v"))), lambda s: s["__v"]).alias("permuted"))


def mantel_permutation(pairs: DataFrame, values: DataFrame, item: str, value: str, permutations: int = 999,
                       seed: int = 404, similarity: str = "jaccard", observed: DataFrame | None = None) -> DataFrame:
    """Mantel r with a two-sided permutation p-value: (#|r_perm| >= |r| + 1) /
    (permutations + 1).  ``pairs`` holds the similarities above 0 (``item_a``,
    ``item_b``, ``similarity``); ``observed`` the r to test (default:
    ``mantel_sparse``).  Only the sum of products changes under relabelling:
    each pair meets its items' arrays of permuted values, and the products are
    added element by element inside the tasks, so neither items nor pairs are
    multiplied by the permutations."""
    import numpy as np
    import pyarrow as pa
    arrays = permuted_values(values, item, value, permutations, seed)
    met = (pairs.select("item_a", "item_b", F.col(similarity).alias("s"))
           .join(arrays.select(F.col(item).alias("item_a"), F.col("permuted").alias("a")), "item_a")
           .join(arrays.select(F.col(item).alias("item_b"), F.col("permuted").alias("b")), "item_b").select("s", "a", "b"))

    def added(batches):
        total = np.zeros(permutations)
        for batch in batches:
            if batch.num_rows:
                a, b = (batch[n].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, permutations) for n in ("a", "b"))
                total += batch["s"].to_numpy(zero_copy_only=False).astype(float) @ np.abs(a - b)
        yield pa.RecordBatch.from_arrays([pa.array(range(permutations), pa.int32()), pa.array(total)], ["perm", "part"])

    per = met.mapInArrow(added, "perm int, part double").groupBy("perm").agg(F.sum("part").alias("sjy"))
    js = pairs.agg(F.coalesce(F.sum(similarity), F.lit(0.0)).alias("sj"),
                   F.coalesce(F.sum(F.col(similarity) * F.col(similarity)), F.lit(0.0)).alias("sjj"))
    sums = _pair_sums(values, item, value).crossJoin(js)  # one row
    r_p = per.crossJoin(sums).select(
        "perm", _mantel_r(F.col("P"), F.col("sj"), F.col("sjj"), F.col("sy"), F.col("syy"), F.col("sjy")).alias("r_p"))
    obs = observed if observed is not None else mantel_sparse(pairs, values, item, value)
    j = r_p.crossJoin(obs)
    return j.groupBy("n_pairs", "r").agg(
        ((F.sum(F.when(F.abs("r_p") >= F.abs("r"), 1).otherwise(0)) + 1) / (permutations + 1.0)).alias("p_value"),
        F.count(F.lit(1)).alias("permutations"))


def unit_rows(weights: DataFrame, item: str, term: str, weight: str) -> DataFrame:
    """(item, term, ``v``): rows scaled to unit length; zeros are left out."""
    w = weights.where(F.col(weight) != 0).select(item, term, F.col(weight).cast("double").alias("__w"))
    norms = w.groupBy(item).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__n"))
    return w.join(norms, item).select(item, term, (F.col("__w") / F.col("__n")).alias("v"))


def weighted_pairs(weights: DataFrame, values: DataFrame, item: str, term: str, weight: str, value: str) -> DataFrame:
    """Cosine and scalar distance (STA-13) of the item pairs that share a term:
    ``cosine`` (similarity), 1 - it, and |a - b|.  All other pairs have cosine
    distance 1.  The result is as long as there are such pairs."""
    u = unit_rows(weights, item, term, weight)
    a, b = (u.select(F.col(item).alias(f"item_{x}"), term, F.col("v").alias(f"__{x}")) for x in "ab")
    dots = a.join(b, term).where(F.col("item_a") < F.col("item_b")).groupBy("item_a", "item_b").agg(F.sum(F.col("__a") * F.col("__b")).alias("cosine"))
    va, vb = (values.select(F.col(item).alias(f"item_{x}"), F.col(value).alias(f"__v{x}")) for x in "ab")
    return dots.join(va, "item_a").join(vb, "item_b").select(
        "item_a", "item_b", "cosine", (1 - F.col("cosine")).alias("cosine_distance"), F.abs(F.col("__va") - F.col("__vb")).alias("scalar_distance"))


def mantel_cosine(weights: DataFrame, values: DataFrame, item: str, term: str, weight: str, value: str) -> DataFrame:
    """Mantel r (STA-14) between cosine distances of weighted terms and |a_i - a_j|
    over all item pairs, without forming a pair: with unit vectors v,

    * the cosines add up to (|sum v|^2 - sum |v|^2) / 2;
    * their squares to (sum of the squared entries of the terms' Gram matrix -
      sum |v|^4) / 2, its entries being summed over the items' own term pairs;
    * their products with |a_i - a_j| to the sum of v_j (a_j P_j - Q_j), P and Q
      the sums of v and a v over the items before j in the order of a, per term.

    Items without terms have cosine 0 with all others."""
    from varlens.functions.prefix import prefix_sum
    u = unit_rows(weights, item, term, weight).join(values.select(item, F.col(value).cast("double").alias("a")), item)
    v = F.col("v")
    s1 = u.groupBy(term).agg(F.sum(v).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s_all"))
    own = u.groupBy(item).agg(F.sum(v * v).alias("q")).agg(F.sum("q").alias("q1"), F.sum(F.col("q") * F.col("q")).alias("q2"))
    x, y = (u.select(item, F.col(term).alias(f"__t{k}"), v.alias(f"__v{k}")) for k in "xy")
    gram = x.join(y, item).where(F.col("__tx") <= F.col("__ty")).groupBy("__tx", "__ty").agg(F.sum(F.col("__vx") * F.col("__vy")).alias("g"))
    twice = F.when(F.col("__tx") == F.col("__ty"), 1.0).otherwise(2.0)
    s2 = gram.agg(F.sum(twice * F.col("g") * F.col("g")).alias("g_all"))
    before = prefix_sum(u.withColumn("av", F.col("a") * v), [term], ["a", item], ["v", "av"], inclusive=False, suffix="_before")
    s3 = before.agg(F.sum(v * (F.col("a") * F.col("v_before") - F.col("av_before"))).alias("sjy"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    one = _pair_sums(values, item, value).crossJoin(s1).crossJoin(own).crossJoin(s2).crossJoin(s3)  # one row each
    r = _mantel_r(F.col("P"), (zero("s_all") - zero("q1")) / 2, (zero("g_all") - zero("q2")) / 2, F.col("sy"), F.col("syy"), zero("sjy"))
    return one.select(F.col("P").cast("long").alias("n_pairs"), r.alias("r"))


def feature_audit(rows: DataFrame, terms: DataFrame, id_col: str, term: str, correct: str) -> DataFrame:
    """Per 0/1 feature (term) against prediction correctness (STA-16,
    re-aimed): 2x2 counts, log2 odds ratio with 0.5 added to each cell and
    the z of the log odds ratio.  ``terms`` holds distinct (id, term)."""
    t_ids = terms.select(id_col, term).distinct()
    per = t_ids.join(rows.select(id_col, correct), id_col).groupBy(term).agg(
        F.count(F.lit(1)).alias("n_t"), F.sum(correct).alias("c_t"))
    tot = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("nc"))
    x = per.crossJoin(tot).select(
        term, (F.col("c_t") + 0.5).alias("a"), (F.col("n_t") - F.col("c_t") + 0.5).alias("b"),
        (F.col("nc") - F.col("c_t") + 0.5).alias("c"),
        (F.col("n") - F.col("nc") - (F.col("n_t") - F.col("c_t")) + 0.5).alias("d"))
    ratio = (F.col("a") * F.col("d")) / (F.col("b") * F.col("c"))
    se = F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d"))
    return x.select(term, F.log2(ratio).alias("log2_or"), (F.log(ratio) / se).alias("z"))
