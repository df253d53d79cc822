"""Variant density features in alignment coordinates (DEN-*).

Inputs:
  rows(family, gene, row)             one gapped row per gene, '-' is a gap
  variants(family, gene, position, cls, ...)  1-based residue positions

Residue r of a gene stands in the column of its r-th character that is no gap.
Operators take ``genes`` as rows, or with the arrays of these columns
(``gene_columns``: ``cols[r - 1]``, ``size(cols)`` residues); rows are a quarter
of the size and best where they are shuffled.  The density of class c at residue
i is the circular moving average (width w) of the family profile of class c over
the gene's columns.  Where it is needed at given rows only (``window_density``),
a gene's places look up the columns of their own windows in one meeting with the
gene, and these meet the profile: no character of the alignment becomes a row.
The full ring (``ring_average``) is summed per gene beside its family's profile.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlens.functions.exprs import materialize

GAP = "-"
#: Characters of a group of genes, about, that meets its family's profile at once.
RING_CHARACTERS = 4 << 20
#: Characters that a task holds in columns at once, about.
SLICE = 1 << 20
# Feature names and window widths of the density map (fixed by the reference).
DENSITY_FEATURES = (("densgof", 1, 10), ("densgof3aa", 1, 3), ("denslof", 0, 10), ("denslof3aa", 0, 3))


def ring_offsets(width: int) -> tuple[int, int]:
    """Window of a centred uniform filter with wrap-around: residues
    i - (w-1)//2 .. i + w//2 (width 10: i-4..i+5, width 3: i-1..i+1)."""
    return -((width - 1) // 2), width // 2


def gene_columns(rows: DataFrame, row: str = "row") -> DataFrame:
    """(family, gene, cols): the alignment column of each residue of the gene,
    in order (DEN-01), from its gapped row."""
    chars = F.regexp_extract_all(F.col(row), F.lit("(?s)."), 0)
    at = F.transform(chars, lambda c, i: F.when(c != GAP, (i + 1).cast("int")))
    return rows.select("family", "gene", F.filter(at, lambda i: i.isNotNull()).alias("cols"))


def residue_columns(genes: DataFrame) -> DataFrame:
    """(family, gene, residue, col): ``gene_columns`` as one row per residue."""
    return genes.select("family", "gene", F.posexplode("cols").alias("at", "col")).select(
        "family", "gene", (F.col("at") + 1).alias("residue"), "col")


def _residues(genes: DataFrame):
    """A gene's number of residues."""
    return F.size("cols") if "cols" in genes.columns else F.length(F.translate("row", GAP, ""))


def _columns_of(genes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the residues of several genes (rows, or arrays of columns),
    one gene after the other, and the place of each gene's first, the end last."""
    at = np.frombuffer(genes.buffers()[1], np.int64 if pa.types.is_large_string(genes.type) or pa.types.is_large_list(genes.type) else np.int32)
    at = at[genes.offset:genes.offset + len(genes) + 1].astype(np.int64)
    if not pa.types.is_string(genes.type) and not pa.types.is_large_string(genes.type):
        return genes.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.int64), at - at[0]
    data = np.frombuffer(genes.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    lead = (data & 0xC0) != 0x80  # a character's first byte
    ends = lambda marked: np.concatenate([[0], np.cumsum(marked)])
    starts = ends(lead)[at - at[0]]
    solid = data[lead] != ord(GAP)
    firsts = ends(solid)[starts]
    return np.flatnonzero(solid) - np.repeat(starts[:-1], np.diff(firsts)) + 1, firsts


def _slices(genes: pa.Array, most: int):
    """Ranges of genes with about ``most`` characters each."""
    sizes = np.cumsum((genes.value_lengths() if hasattr(genes, "value_lengths") else pc.binary_length(genes)).fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(sizes // most)) + 1
    return zip([0, *cuts], [*cuts, len(genes)])


def _look_up(offsets: Sequence[int], ring: bool):
    """A UDF of (gene, positions): per position, the columns of the residues at
    these ``offsets`` from it, around the ring, or else null outside the gene."""
    steps = np.array(list(offsets), np.int64)

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def found(genes: pa.Array, positions: pa.Array) -> pa.Array:
        out = []
        for a, b in _slices(genes, SLICE):
            cols, firsts = _columns_of(genes.slice(a, b - a))
            own = positions.slice(a, b - a)
            parent = np.repeat(np.arange(b - a), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            place = own.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(firsts)[parent]
            at = place[:, None] - 1 + steps[None]
            inside = (n > 0)[:, None] if ring else (at >= 0) & (at < n[:, None])
            at = at % np.maximum(n, 1)[:, None] if ring else np.where(inside, at, 0)
            value = cols[np.where(inside, at + firsts[:-1][parent][:, None], 0)] if len(cols) else np.zeros(at.shape, np.int64)
            flat = pa.array(value.ravel().astype(np.int32), mask=~np.broadcast_to(inside, at.shape).ravel())
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * len(steps)), flat)
            ends = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=b - a))]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), each))
        return pa.concat_arrays(out)

    return found


def _at_genes(places: DataFrame, genes: DataFrame, offsets: Sequence[int], ring: bool, how: str) -> DataFrame:
    """``places`` (family, gene, position, ...) with ``at``, the columns at
    ``offsets`` from the position.  A gene's places are gathered, so that its row
    is read once; the result stays partitioned by (family, gene)."""
    rest = [c for c in places.columns if c not in ("family", "gene")]
    own = places.repartition("family", "gene").groupBy("family", "gene").agg(F.collect_list(F.struct(*rest)).alias("__p"))
    held = "cols" if "cols" in genes.columns else "row"
    j = own.join(genes.select("family", "gene", held), ["family", "gene"], how)
    at = _look_up(offsets, ring)(F.col(held), F.transform("__p", lambda p: p["position"].cast("long")))
    j = j.select("family", "gene", "__p", at.alias("at"))
    return j.select("family", "gene", F.explode(F.arrays_zip("__p", "at")).alias("o")).select("family", "gene", "o.__p.*", "o.at")


def position_frequency(variants: DataFrame, genes: DataFrame, cls: str = "cls", keys: Sequence[str] = ()) -> DataFrame:
    """(family, gene, cls, *keys, col, freq): variant counts per residue
    scattered to alignment columns (DEN-02).  A position past the gene's last
    residue, or before its first, raises."""
    cnt = variants.repartition("family", "gene").groupBy("family", "gene", cls, *keys, "position").agg(F.count(F.lit(1)).alias("freq"))
    j = _at_genes(cnt, genes, [0], False, "left").withColumn("col", F.get("at", F.lit(0)))
    msg = F.concat(F.lit("position past the end of gene "), F.col("gene").cast("string"))
    ok = F.coalesce(F.when(F.col("col").isNull(), F.raise_error(msg)).cast("boolean"), F.lit(True))
    return j.where(ok).select("family", "gene", cls, *keys, "col", "freq")


def family_profile(freq: DataFrame, cls: str = "cls", keys: Sequence[str] = ()) -> DataFrame:
    """(family, cls, *keys, col, freq): sum over the family's genes per class (DEN-03)."""
    return freq.groupBy("family", cls, *keys, "col").agg(F.sum("freq").alias("freq"))


def _ring_sums(widths: Sequence[int], schema: pa.Schema):
    """Per gene of a group, class and width: the window sums of its family's
    profile, residue by residue.  Rows of one gene are added."""
    def run(genes: pa.Table, profile: pa.Table) -> pa.Table:
        tables = []
        if genes.num_rows and profile.num_rows:
            genes = genes.sort_by("gene").combine_chunks()
            family, ids, held = (genes[c].combine_chunks() for c in ("family", "gene", "held"))
            names = ids.to_pylist()
            parts = [(r["cls"], np.array(r["cols"], np.int64), np.array(r["freqs"], np.int64)) for r in profile.to_pylist()]
            last = max(c.max() for _, c, _ in parts)
            for a, b in _slices(held, SLICE):
                cols, firsts = _columns_of(held.slice(a, b - a))
                n = np.diff(firsts)
                start, size = np.repeat(firsts[:-1], n), np.repeat(n, n)
                own, met = np.arange(len(cols)) - start, np.minimum(cols, last + 1)
                steps = {k: start + (own + k) % size for w in widths for k in range(ring_offsets(w)[0], ring_offsets(w)[1] + 1)}
                for c, at, freq in parts:
                    dense = np.zeros(last + 2, np.int64)
                    dense[at] = freq
                    value = dense[met]
                    for w in widths:
                        lo, hi = ring_offsets(w)
                        sums = pa.array(sum(value[steps[k]] for k in range(lo, hi + 1)))
                        lists = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), sums)
                        tables.append(pa.table([family.slice(a, b - a), ids.slice(a, b - a), pa.array([c] * (b - a), schema.field("cls").type),
                                                pa.array([w] * (b - a), pa.int32()), lists], schema=schema))
            if any(x == y for x, y in zip(names, names[1:])):
                tables = [_added(pa.concat_tables(tables))]
        return pa.concat_tables(tables) if tables else schema.empty_table()
    return run


def _added(rings: pa.Table) -> pa.Table:
    """One row per gene, class and width: the sums of its rows, the shorter ones ending before."""
    total: dict[tuple, np.ndarray] = {}
    for r in rings.to_pylist():
        key, own = tuple(r[c] for c in rings.column_names[:-1]), np.array(r["sums"], np.int64)
        old = total.get(key, own[:0])
        whole = np.zeros(max(len(old), len(own)), np.int64)
        whole[:len(old)] += old
        whole[:len(own)] += own
        total[key] = whole
    return pa.Table.from_pylist([dict(zip(rings.column_names, (*k, v))) for k, v in total.items()], rings.schema)


def ring_average(profile: DataFrame, genes: DataFrame, widths: Sequence[int] = (10, 3),
                 cls: str = "cls") -> DataFrame:
    """(family, gene, cls, width, residue, dens): the profile projected onto
    each gene's residues (gap columns dropped) and averaged on a ring of
    ``width`` residues (DEN-04).  Only non-zero results are produced.  Genes meet
    their family's profile, which is as long as the alignment, in groups of about
    ``RING_CHARACTERS`` characters."""
    from pyspark.sql.pandas.types import to_arrow_schema
    held = "cols" if "cols" in genes.columns else "row"
    length = F.size("cols") if held == "cols" else F.length("row")
    total = genes.agg(F.sum(length).alias("n")).first()["n"] or 0
    groups = max(1, -(-total // RING_CHARACTERS))
    kinds = T.StructType([genes.schema["family"], genes.schema["gene"], T.StructField("cls", profile.schema[cls].dataType),
                          T.StructField("width", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    some = genes.where("family IS NOT NULL").select("family", "gene", F.col(held).alias("held"),
                                                   F.pmod(F.xxhash64("gene"), F.lit(groups)).alias("__group"))
    packed = profile.where((F.col("freq") != 0) & F.col("family").isNotNull()).groupBy("family", F.col(cls).alias("cls")).agg(F.collect_list(F.struct("col", "freq")).alias("p"))
    packed = packed.select("family", "cls", F.col("p.col").alias("cols"), F.col("p.freq").alias("freqs"),
                           F.explode(F.sequence(F.lit(0), F.lit(groups - 1).cast("long"))).alias("__group"))
    rings = some.groupBy("family", "__group").cogroup(packed.groupBy("family", "__group")).applyInArrow(_ring_sums(widths, to_arrow_schema(kinds)), kinds)
    return (rings.select("family", "gene", F.col("cls").alias(cls), "width", F.posexplode("sums").alias("at", "total")).where("total <> 0")
            .select("family", "gene", cls, "width", (F.col("at") + 1).alias("residue"), (F.col("total") / F.col("width")).alias("dens")))


def gather(features: DataFrame, dens: DataFrame, cls: str = "cls",
           names=DENSITY_FEATURES) -> DataFrame:
    """Density columns at each feature row's position (DEN-05, DEN-06);
    a residue with no contribution gets 0."""
    d = dens.withColumnRenamed("residue", "position")
    aggs = [F.sum(F.when((F.col(cls) == c) & (F.col("width") == w), F.col("dens"))).alias(n) for n, c, w in names]
    per_pos = d.groupBy("family", "gene", "position").agg(*aggs)
    j = features.join(per_pos, ["family", "gene", "position"], "left")
    return j.na.fill(0.0, [n for n, _, _ in names])


def _union(widths: Sequence[int]) -> list[int]:
    """The offsets of all windows, each once."""
    return sorted({k for w in widths for k in range(ring_offsets(w)[0], ring_offsets(w)[1] + 1)})


def _windows(places: DataFrame, genes: DataFrame, widths: Sequence[int]) -> DataFrame:
    """``places`` with one row per residue of their windows: offset ``k`` and ``col``."""
    steps = _union(widths)
    at = _at_genes(places.where(F.col("position").isNotNull()), genes, steps, True, "inner")
    win = at.select(*[c for c in at.columns if c != "at"], F.posexplode("at").alias("i", "col"))
    return win.withColumn("k", F.col("i") + steps[0]).drop("i")


def _class_counts(cls: str, value: str = "freq") -> list:
    """A profile's counts as one column per class that the features use."""
    return [F.sum(F.when(F.col(cls) == c, F.col(value)).otherwise(0)).alias(f"__f{c}") for c in sorted({c for _, c, _ in DENSITY_FEATURES})]


def _window_sums(names, count) -> list:
    """The density columns from rows of ``_windows``; ``count(c)`` is the column of class c."""
    return [(F.sum(F.when(F.col("k").between(*ring_offsets(w)), count(c)).otherwise(0)) / w).alias(n) for n, c, w in names]


def window_density(features: DataFrame, profile: DataFrame, genes: DataFrame, widths: Sequence[int] = (10, 3),
                   cls: str = "cls", keys: Sequence[str] = ()) -> DataFrame:
    """The four density columns at each feature row, reading only the w
    residues of the row's own window (DEN-04 + DEN-05 evaluated where they
    are needed).  ``profile`` has (family, cls, col, *keys, freq); feature
    rows carry the same ``keys`` (for per-training-set profiles).  Best a stored
    table: Spark then knows its size and can send it to the windows."""
    keys = list(keys)
    names = [f for f in DENSITY_FEATURES if f[2] in widths]
    places = features.select("family", "gene", "position", *keys).distinct()
    counts = profile.groupBy("family", "col", *keys).agg(*_class_counts(cls))
    hit = _windows(places, genes, widths).join(counts, ["family", "col", *keys])
    dens = hit.groupBy("family", "gene", "position", *keys).agg(*_window_sums(names, lambda c: F.col(f"__f{c}")))
    return features.join(dens, ["family", "gene", "position", *keys], "left").na.fill(0.0, [n for n, _, _ in names])


def density_map(train: DataFrame, features: DataFrame, genes: DataFrame, key: Sequence[str], cls: str = "cls",
                widths: Sequence[int] = (10, 3)) -> DataFrame:
    """Composed density map (DEN-06): profiles from the ``train`` rows whose
    variant ``key`` is also in ``features``, evaluated at every feature row.
    Another variant at the same residue is not counted.  Families without
    training data and genes missing from the alignment give no rows."""
    tr = train.join(features.select(*key).distinct(), list(key), "left_semi")
    prof = materialize(family_profile(position_frequency(tr, genes, cls), cls))
    fams = prof.select("family").distinct()
    feats = features.join(fams, "family", "left_semi").join(
        genes.where(_residues(genes) > 0).select("family", "gene"), ["family", "gene"], "left_semi")
    return window_density(feats, prof, genes, widths, cls)


def standardize_round(df: DataFrame, cols: Sequence[str], digits: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """z-score with the population std over the frame, or over each group of
    ``keys``, then rounded half to even on the binary value (as numpy does)
    (DEN-07).  A constant column gives 0.  The statistics are one aggregate row
    per group; ``df`` is stored, as they and the result both read it."""
    df = materialize(df)
    aggs = [*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols]]
    if keys:
        st = df.groupBy(*keys).agg(*aggs)
        st = st.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in st.columns if c not in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        j = df.join(st, same).drop(*[f"__k_{k}" for k in keys])
    else:
        j = df.crossJoin(df.agg(*aggs))
    scale = float(10 ** digits)
    for c in cols:
        z = F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(
            F.col(c) - F.col(f"__m_{c}"))
        j = j.withColumn(c, F.rint(z * scale) / scale)
    return j.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


def cross_fitted(variants: DataFrame, genes: DataFrame, outer: str, inner: str, cls: str = "cls",
                 widths: Sequence[int] = (10, 3), digits: int | None = None) -> DataFrame:
    """Cross-fitted densities for every outer fold o (DEN-09):

    * a row of dev(o) (outer fold != o) in inner fold j gets the map fitted on
      dev(o) without inner fold j (role ``inner``);
    * a row of outer fold o gets the map fitted on all of dev(o) (``outer_test``).

    The map is linear in the variant counts, so the profile of dev(o) without
    inner fold j is: all - outer o - inner j + cell (o, j), and of dev(o): all -
    outer o.  These are put together on the profiles, one row per column and
    inner fold, so that a row's window is read once and meets one row per residue;
    no fold is routed to another and no list of folds leaves the cluster.  A row
    appears once per outer fold, which is the size of the result.  With ``digits``
    each map is standardised over its rows and rounded.  Variants without
    a family count nowhere and get 0."""
    names = [f for f in DENSITY_FEATURES if f[2] in widths]
    classes = sorted({c for _, c, _ in DENSITY_FEATURES})
    known = F.col("family").isNotNull()
    freq = position_frequency(variants.where(known), genes, cls, [outer, inner])
    cells = materialize(freq.groupBy("family", "col", F.col(outer).alias("__o"), F.col(inner).alias("__j")).agg(*_class_counts(cls)))
    every = materialize(variants.select(F.col(outer).alias("__o"), F.col(inner).alias("__j")).distinct())
    sums = lambda keys, tag: cells.groupBy("family", "col", *keys).agg(*[F.sum(f"__f{c}").alias(f"{tag}{c}") for c in classes])
    wide = (sums([], "all").crossJoin(every.select("__o").distinct()).crossJoin(every.select("__j").distinct())
            .join(sums(["__o"], "out"), ["family", "col", "__o"], "left").join(sums(["__j"], "inn"), ["family", "col", "__j"], "left")
            .join(sums(["__o", "__j"], "both"), ["family", "col", "__o", "__j"], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    dev = lambda c: F.col(f"all{c}") - zero(f"out{c}")
    maps = F.struct(F.col("__o").alias("for_outer"), *[dev(c).alias(f"dev{c}") for c in classes],
                    *[(dev(c) - zero(f"inn{c}") + zero(f"both{c}")).alias(f"less{c}") for c in classes])
    maps = materialize(wide.groupBy("family", "col", F.col("__j").alias("__mj")).agg(F.collect_list(maps).alias("maps")))

    places = variants.where(known).select("family", "gene", "position", F.col(outer).alias("__o"), F.col(inner).alias("__j")).distinct()
    win = _windows(places, genes, widths).withColumnRenamed("family", "__family").withColumnRenamed("col", "__col")
    hit = win.join(maps, (F.col("__family") == F.col("family")) & (F.col("__col") == F.col("col")) & F.col("__j").eqNullSafe(F.col("__mj")))
    place = ["gene", "position", "__o", "__j"]
    role = F.when(F.col("__o") == F.col("m.for_outer"), "outer_test").otherwise("inner")
    hit = hit.select("__family", *place, "k", F.explode("maps").alias("m")).select("__family", *place, "k", F.col("m.for_outer").alias("for_outer"), role.alias("role"), *[
        F.when(role == "outer_test", F.col(f"m.dev{c}")).otherwise(F.col(f"m.less{c}")).alias(f"__f{c}") for c in classes])
    dens = hit.groupBy("__family", *place, "for_outer", "role").agg(*_window_sums(names, lambda c: F.col(f"__f{c}")))
    per = dens.groupBy("__family", *place).agg(F.collect_list(F.struct("for_outer", "role", *[n for n, _, _ in names])).alias("__maps"))
    per = per.select(*[F.col(c).alias(f"__r{c.strip('_')}") for c in per.columns if c != "__maps"], "__maps")
    j = variants.join(per, (F.col("family") == F.col("__rfamily")) & (F.col("gene") == F.col("__rgene")) & (F.col("position") == F.col("__rposition"))
                      & F.col(outer).eqNullSafe(F.col("__ro")) & F.col(inner).eqNullSafe(F.col("__rj")))
    out = j.select(*variants.columns, F.explode("__maps").alias("__m")).select(*variants.columns, "__m.*")
    none = variants.where(~known).crossJoin(every.select(F.col("__o").alias("for_outer")).distinct())  # no family, no profile
    out = out.unionByName(none.select(*variants.columns, "for_outer", F.when(F.col(outer) == F.col("for_outer"), "outer_test").otherwise("inner").alias("role"),
                                      *[F.lit(0.0).alias(n) for n, _, _ in names]))
    if digits is None:
        return out
    fold = F.when(F.col("role") == "inner", F.col(inner))
    return standardize_round(out.withColumn("__map", fold), [n for n, _, _ in names], digits, ["for_outer", "role", "__map"]).drop("__map")
