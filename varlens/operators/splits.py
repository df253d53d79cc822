"""Splits and sampling (SPL-*).

Membership follows a seeded hash order ``md5(id|seed)``, so it does not depend
on partitioning and is the same in any engine that has md5.  Counts per fold
and per class follow the documented rules (largest remainder, striding);
membership cannot match another library's random generator.

Ranks inside a class are computed with ``prefix_sum`` over the hash order
(range-bucketed): a class holding most of the rows is spread over many tasks
instead of one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.functions.exprs import md5_key
from varlens.functions.prefix import hex_lead, prefix_sum, text_lead


def shuffle_key(df: DataFrame, id_col: str, seed=42, out: str = "shuffle_key") -> DataFrame:
    """Seeded shuffle as an order key column; the table is not sorted (SPL-01)."""
    return df.withColumn(out, md5_key(F.col(id_col), seed))


def rank_within(df: DataFrame, keys: Sequence[str], id_col: str, seed=42, out: str = "rank",
                lead: Column | None = None, extra_order: Sequence[str] = ()) -> DataFrame:
    """1-based rank of each row inside ``keys`` in seeded hash order (ties on
    the hash, which do not happen for distinct ids, fall back to the id)."""
    d = df.withColumn("__h", md5_key(F.col(id_col), seed)).withColumn("__one", F.lit(1).cast("long"))
    order = [*extra_order, "__h", id_col]
    b = lead if lead is not None else hex_lead(F.col("__h"))
    r = prefix_sum(d, keys, order, ["__one"], inclusive=True, suffix="_rank", bucket_on=b, splits_from=d)
    return r.withColumnRenamed("__one_rank", out).drop("__h", "__one")


def largest_remainder(counts: dict, total: int) -> dict:
    """Split ``total`` over classes in proportion to ``counts``: floors first,
    then one more for the largest remainders (ties by class order).  Exact
    integer arithmetic; ``counts`` has one entry per class."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    base = {k: (c * total) // n for k, c in counts.items()}
    rem = {k: (c * total) % n for k, c in counts.items()}
    left = total - sum(base.values())
    for k in sorted(counts, key=lambda k: (-rem[k], k))[:left]:
        base[k] += 1
    return base


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class, collected: one row per class (a handful)."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def stratified_holdout(df: DataFrame, id_col: str, label: str, test_frac: float = 0.1,
                       val_frac: float = 0.5, seed=42) -> DataFrame:
    """Stratified test share, then the rest cut again by ``val_frac`` into
    validation and training (SPL-02).  Sizes: ceil(frac * n) overall, spread
    over classes by largest remainder."""
    import math
    cnt = class_counts(df, label)
    n = sum(cnt.values())
    n_test = int(math.ceil(test_frac * n))
    t = largest_remainder(cnt, n_test)
    rest = {k: cnt[k] - t[k] for k in cnt}
    n_val = int(math.ceil(val_frac * sum(rest.values())))
    v = largest_remainder(rest, n_val)
    r = rank_within(df, [label], id_col, seed)
    tmap = F.create_map(*[x for k in t for x in (F.lit(k), F.lit(t[k]))]) if t else F.create_map()
    vmap = F.create_map(*[x for k in v for x in (F.lit(k), F.lit(v[k]))]) if v else F.create_map()
    nt, nv = F.element_at(tmap, F.col(label)), F.element_at(vmap, F.col(label))
    split = F.when(F.col("rank") <= nt, "test").when(F.col("rank") <= nt + nv, "val").otherwise("train")
    return r.withColumn("split", split).drop("rank")


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 10, seed=42,
                     out: str = "fold") -> DataFrame:
    """Stratified k folds (SPL-03): rows ranked over (label, hash) in one
    global order and dealt round-robin, fold = (rank - 1) % k.  Fold sizes
    differ by at most one and so do per-class counts."""
    d = df.withColumn("__lab", F.col(label))
    lead = F.col("__lab").cast("double") + hex_lead(md5_key(F.col(id_col), seed)) / float(2 ** 52)
    r = rank_within(d, [], id_col, seed, "__rank", lead=lead, extra_order=["__lab"])
    return r.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank", "__lab")


def repeated_stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 10, repeats: int = 3,
                              seed=42) -> DataFrame:
    """Repeats x k folds (SPL-04): repeat r uses seed ``seed + r``; fold index
    = r * k + fold.  Built as a union of the repeats (each a full ranking)."""
    parts = []
    for r in range(repeats):
        f = stratified_kfold(df, id_col, label, k, seed + r)
        parts.append(f.withColumn("repeat", F.lit(r)).withColumn("fold_index", F.lit(r * k) + F.col("fold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sized_groups(df: DataFrame, group: str) -> DataFrame:
    """(group, ``__n`` rows, ``__j`` place from 0 among the groups of that size,
    by key).  Ranges of the keys keep groups of one size in many tasks."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__one", F.lit(1).cast("long"))
    lead = text_lead(F.col(group)) if df.schema[group].dataType.typeName() == "string" else F.coalesce(F.col(group).cast("double"), F.lit(float("-inf")))
    placed = prefix_sum(sizes, ["__n"], [group], ["__one"], inclusive=False, suffix="_j", bucket_on=lead)
    return placed.select(group, "__n", F.col("__one_j").alias("__j"))


def leave_one_group_out(df: DataFrame, group: str, out: str = "fold") -> DataFrame:
    """One fold per group, larger groups first (ties by group key) (SPL-05).
    Groups are ranked within their size; only the table of distinct sizes is
    cumulated in one place (k of them need k^2 / 2 rows at least)."""
    from pyspark.sql import Window
    placed = _sized_groups(df, group)
    sizes = placed.groupBy("__n").agg(F.count(F.lit(1)).alias("__g"))
    before = Window.orderBy(F.col("__n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__n", F.coalesce(F.sum("__g").over(before), F.lit(0)).alias("__start"))
    folds = placed.join(starts, "__n").select(group, (F.col("__start") + F.col("__j")).cast("int").alias(out))
    return _with_group(df, folds, group)


def _with_group(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    key = folds.withColumnRenamed(group, "__group")
    return df.join(key, df[group].eqNullSafe(key["__group"])).drop("__group")


def deal_run(rows: list[int], size: int, groups: int) -> list[int]:
    """How many of ``groups`` groups of one ``size`` each fold takes, when each
    goes to the fold with the fewest rows so far (ties: lowest number)."""
    if size <= 0 or groups <= 0:
        return [0] * len(rows)
    low, high = min(rows), max(rows) + size * groups
    below = lambda top: [max(0, -(-(top - r) // size)) for r in rows]  # noqa: E731  places with fewer rows than top
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= groups else (low, middle)
    taken = below(low)
    left = groups - sum(taken)
    for i, r in enumerate(rows):  # the places at exactly ``low`` rows, by number
        if left and (low - r) >= 0 and (low - r) % size == 0:
            taken[i], left = taken[i] + 1, left - 1
    return taken


def group_kfold(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """k folds of whole groups (SPL-05 for k < groups): the largest group left
    goes to the fold with the fewest rows.  Equal sizes go by group key; equal
    folds by number.

    Groups of one size are dealt as a run: its places are (rows of the fold so
    far, fold), in order, and the j-th group takes the j-th place.  Only the
    distinct sizes go through the driver, one after the other; places and
    groups are ranked and joined in Spark."""
    spark = df.sparkSession
    placed = _sized_groups(df, group)
    runs = placed.groupBy("__n").agg(F.count(F.lit(1)).alias("__g")).collect()  # distinct sizes
    rows, dealt = [0] * k, []
    for n, groups in sorted(((r[0], r[1]) for r in runs), reverse=True):
        taken = deal_run(rows, n, groups)
        dealt += [(n, i, rows[i], c) for i, c in enumerate(taken) if c]
        rows = [r + n * c for r, c in zip(rows, taken)]
    plan = spark.createDataFrame(dealt, f"__n long, {out} int, __from long, __c long")
    places = plan.select("__n", out, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)).alias("__i"), "__from")
    places = places.select("__n", out, (F.col("__from") + F.col("__i") * F.col("__n")).alias("__rows")).withColumn("__one", F.lit(1).cast("long"))
    ranked = prefix_sum(places, ["__n"], ["__rows", out], ["__one"], inclusive=False, suffix="_j")
    folds = placed.join(ranked.select("__n", F.col("__one_j").alias("__j"), out), ["__n", "__j"]).select(group, out)
    return _with_group(df, folds, group)


def expand_folds(df: DataFrame, fold_col: str, k: int) -> DataFrame:
    """Row x fold with ``train`` = 1 unless the row's own fold (SPL-06)."""
    spark = df.sparkSession
    folds = spark.range(k).select(F.col("id").cast("int").alias("split_fold"))
    return df.crossJoin(folds).withColumn("train", (F.col("split_fold") != F.col(fold_col)).cast("int"))


def sample_per_class(df: DataFrame, keys: Sequence[str], id_col: str, n: float, seed=42) -> DataFrame:
    """``n`` rows per (keys) group, or a fraction when n < 1 (rounded half to
    even per group); n = 0 gives no rows (SPL-09)."""
    r = rank_within(df, keys, id_col, seed)
    if n <= 0:
        return r.where(F.lit(False)).drop("rank")
    if n < 1:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        r = r.join(sizes, list(keys))
        return r.where(F.col("rank") <= F.rint(F.col("__n") * F.lit(float(n)))).drop("rank", "__n")
    return r.where(F.col("rank") <= int(n)).drop("rank")


def three_way_flags(df: DataFrame, keys: Sequence[str], label: str, id_col: str, n_test: dict, m_train: int,
                    seed=42, out: str = "train") -> DataFrame:
    """Fixed test set (n per class, may differ by class) flagged 2, then m
    training rows per class flagged 1, the rest 0 (SPL-10).  The test set does
    not depend on m."""
    r = rank_within(df, [*keys, label], id_col, seed)
    nmap = F.create_map(*[x for k, v in n_test.items() for x in (F.lit(k), F.lit(v))])
    nt = F.coalesce(F.element_at(nmap, F.col(label)), F.lit(0))
    flag = F.when(F.col("rank") <= nt, 2).when(F.col("rank") <= nt + m_train, 1).otherwise(0)
    return r.withColumn(out, flag).drop("rank")


def minority_balance(df: DataFrame, group: str, label: str, id_col: str, seed=42) -> DataFrame:
    """Per group, min(class counts) rows from each class; groups missing a
    class are dropped (SPL-12)."""
    c = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("__c"))
    m = c.groupBy(group).agg(F.min("__c").alias("__m"), F.count(F.lit(1)).alias("__k"))
    n_classes = df.select(label).distinct().count()  # one number
    m = m.where(F.col("__k") == n_classes)
    r = rank_within(df.join(m, group), [group, label], id_col, seed)
    return r.where(F.col("rank") <= F.col("__m")).drop("rank", "__m", "__k")
