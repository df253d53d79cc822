"""Projections, key parsing, label encoding and filters (PRJ-*, FIL-*)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: class labels and their codes,
# missing-term codes, and the family prefixes of the gene classifiers.
LABEL_CODES = {"lof": 0, "gof": 1}
NEUTRAL = "neutral"
HPO_MISSING = ('"HP:9999998"', '"HP:9999999"')
GO_MISSING = "GO:0"
POTASSIUM_PREFIXES = ("KCN", "HCN")
FIVE_WAY_FAMILIES = ("KCN", "CACNA", "SCN", "Sh")


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the named columns that exist, in the given order (PRJ-01)."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def drop_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop named columns, ignoring missing ones (PRJ-02)."""
    return df.drop(*cols)


def drop_by_name(df: DataFrame, prefixes: Sequence[str] = ("rel_", "abs_"),
                 contains: Sequence[str] = ("dens",)) -> DataFrame:
    """Drop columns whose name starts with a prefix or contains a substring (PRJ-03)."""
    keep = [c for c in df.columns
            if not any(c.startswith(p) for p in prefixes) and not any(s in c for s in contains)]
    return df.select(*keep)


def parse_varid(varid: Column) -> list[Column]:
    """``GENE_ref_pos_alt`` -> gene, ref_aa, position (int, 1-based), alt_aa (PRJ-04)."""
    parts = F.split(varid, "_")
    return [F.get(parts, 0).alias("gene"), F.get(parts, 1).alias("ref_aa"),
            F.get(parts, 2).cast("int").alias("position"), F.get(parts, 3).alias("alt_aa")]


def reformat_foreign_key(key: Column) -> Column:
    """``gene:pos:ref:alt`` -> ``GENE_ref_pos_alt`` with the gene upper-cased (PRJ-05)."""
    p = F.split(key, ":")
    return F.concat_ws("_", F.upper(F.get(p, 0)), F.get(p, 2), F.get(p, 1), F.get(p, 3))


def encode_label_strict(label: Column) -> Column:
    """lof -> 0, gof -> 1; anything else raises at run time (PRJ-06)."""
    expr = None
    for k, v in LABEL_CODES.items():
        expr = F.when(label == k, F.lit(v)) if expr is None else expr.when(label == k, F.lit(v))
    return expr.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def encode_label_map(label: Column) -> Column:
    """Mapping with null for any other value (pandas ``map``) (PRJ-07)."""
    expr = None
    for k, v in LABEL_CODES.items():
        expr = F.when(label == k, F.lit(v)) if expr is None else expr.when(label == k, F.lit(v))
    return expr


def encode_label_replace(label: Column) -> Column:
    """Replacement that leaves other values as they are (pandas ``replace``) (PRJ-07)."""
    return F.coalesce(encode_label_map(label).cast("string"), label)


def family_two_way(gene: Column) -> Column:
    """potassium when the symbol starts with KCN or HCN or is SH (any case),
    else sodium_calcium (PRJ-08)."""
    up = F.upper(gene)
    test = None
    for p in POTASSIUM_PREFIXES:
        t = up.startswith(p)
        test = t if test is None else test | t
    return F.when(test | (up == "SH"), "potassium").otherwise("sodium_calcium")


def family_five_way(gene: Column) -> Column:
    """First family whose tag is a substring of the symbol, else other (PRJ-09)."""
    expr = None
    for fam in FIVE_WAY_FAMILIES:
        expr = F.when(gene.contains(fam), fam) if expr is None else expr.when(gene.contains(fam), fam)
    return expr.otherwise("other")


def count_label(name: Column, n: Column) -> Column:
    """Display label ``(n) name`` (PRJ-13)."""
    return F.concat(F.lit("("), n.cast("string"), F.lit(") "), name)


def parse_count_label(label: Column) -> Column:
    """Inverse of ``count_label``: the count as an int."""
    return F.regexp_extract(label, r"^\((\d+)\)", 1).cast("int")


def not_label(label: Column, value: str = NEUTRAL) -> Column:
    """pandas ``!=``: keeps nulls, which Spark's ``!=`` would drop (FIL-01)."""
    return ~label.eqNullSafe(F.lit(value))


def not_sentinel(terms: Column, codes: Sequence[str] = HPO_MISSING) -> Column:
    """Rows whose term string is not a missing code (FIL-04); null kept."""
    return ~F.coalesce(terms.isin(*codes), F.lit(False))


def min_length(seq: Column, n: int = 10, strict: bool = False) -> Column:
    """Filter predicate for sequences of at least ``n`` characters; with
    ``strict`` a shorter one raises instead (FIL-05)."""
    ok = F.length(seq) >= n
    if strict:
        return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"sequence shorter than {n}")).cast("boolean"))
    return ok


def schema_guard(a: DataFrame, b: DataFrame) -> None:
    """Same columns in the same order, else ValueError (PRJ-11).  Driver-side:
    only the schemas are compared."""
    if a.columns != b.columns:
        raise ValueError(f"column mismatch: {a.columns} != {b.columns}")
