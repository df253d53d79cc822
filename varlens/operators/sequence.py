"""Sequence operators (SEQ-*): point mutations, truncation around a site,
all variants of a gene, all single mutants, gene tags, clipped site index.
Sequences are strings; positions are 1-based."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.operators.digests import mutant_ends

# Fixed values that must equal the reference's: model input limit and its half
# window, the 20 amino acids of the exhaustive scan, and the tag tokens.
MAX_LEN = 1022
HALF = 511
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
TAG_TOKENS = ["L", "A", "G", "V", "S", "E", "R", "T", "I", "D", "P", "K", "Q", "N", "F", "Y", "M", "H", "W", "C",
              "X", "B", "U", "Z", "O"]


def _checked(seq: Column, pos: Column, expect: Column, what: str) -> Column:
    ok = F.substring(seq, pos, 1) == expect
    msg = F.concat(F.lit(f"{what} mismatch at "), pos.cast("string"))
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(msg).cast("boolean"))


def set_residue(seq: Column, pos: Column, new: Column) -> Column:
    """seq with the residue at 1-based ``pos`` replaced by ``new``."""
    return F.overlay(seq, new, pos, F.lit(1))


def apply_mutation(seq: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Mutant from wild type (SEQ-01): the residue must equal ``ref`` (else
    the query fails), then it becomes ``alt``."""
    return F.when(_checked(seq, pos, ref, "reference residue"), set_residue(seq, pos, alt))


def revert_mutation(seq: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Wild type from mutant (SEQ-02): the residue must equal ``alt``."""
    return F.when(_checked(seq, pos, alt, "mutant residue"), set_residue(seq, pos, ref))


def truncate_around(seq: Column, pos: Column, max_len: int = MAX_LEN, half: int = HALF) -> Column:
    """At most ``max_len`` residues around the site (SEQ-03): short sequences
    unchanged, sites near the start keep the head, near the end the tail,
    otherwise the slice [pos - (half - 1), pos + half + 1) in 0-based terms."""
    n = F.length(seq)
    start0 = F.greatest(F.lit(0), pos - (half - 1))
    end0 = F.least(n, pos + half + 1)
    return (F.when(n <= max_len, seq)
             .when(pos < half, F.substring(seq, 1, max_len))
             .when(pos >= n - half, F.substring(seq, n - max_len + 1, max_len))
             .otherwise(F.substring(seq, start0 + 1, end0 - start0)))


def clipped_site(pos: Column, gene_length: Column, max_len: int = MAX_LEN, half: int = HALF) -> Column:
    """Index of the site inside a truncated model input (SEQ-07); the gene
    length counts the two special tokens."""
    return (F.when(gene_length <= max_len, pos).when(pos < half, pos)
             .when(pos >= gene_length - half, F.lit(max_len + 2) - (gene_length - pos) - 1)
             .otherwise(F.lit(half + 1)))


def apply_all_variants(seqs: DataFrame, variants: DataFrame, key: str, seq: str, order: str) -> DataFrame:
    """All variants of a gene written into one sequence, later rows (by
    ``order``) overwriting earlier ones at the same position (SEQ-04).  A
    gene's last edits are gathered to one array, at most one per position, and
    set between the pieces of the sequence that they leave; no residue becomes
    a row.  Positions outside the sequence change nothing."""
    last = variants.groupBy(key, "position").agg(F.max_by("alt", F.col(order)).alias("alt"))
    edits = last.where(F.col("alt").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("position").cast("int").alias("position"), "alt"))).alias("__e"))
    text = F.col(seq)
    e = F.filter(F.coalesce("__e", F.array().cast(edits.schema["__e"].dataType)), lambda x: (x["position"] >= 1) & (x["position"] <= F.length(text)))
    d = seqs.select(key, seq).join(edits, key, "left").withColumn("__e", e)
    size = F.size("__e")
    pieces = F.transform("__e", lambda x, i: F.concat(
        F.substr(text, F.coalesce(F.get(F.col("__e"), i - 1)["position"], F.lit(0)) + 1, x["position"] - F.coalesce(F.get(F.col("__e"), i - 1)["position"], F.lit(0)) - 1), x["alt"]))
    rest = F.substr(text, F.get("__e", size - 1)["position"] + 1)
    changed = F.filter("__e", lambda x: x["alt"] != F.substr(text, x["position"], F.lit(1)))
    return d.select(key, F.when(size == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest)).alias("sequence"),
                    F.size(changed).cast("long").alias("n_changed"))


#: Residues whose mutants a task makes, about.
MUTANT_RESIDUES = 50_000
#: Sequences whose mutants are hashed together.
MUTANT_BATCH = 128
_ACID_BYTES = np.frombuffer(AMINO_ACIDS.encode(), np.uint8)


def _digest_rows(seq: str):
    """Per sequence the counts of its mutants and the ends of their digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, MUTANT_BATCH) for at in range(0, whole.num_rows, MUTANT_BATCH)):
                texts = [t.encode() if t else b"" for t in b[seq].to_pylist()]
                ends = mutant_ends(texts, AMINO_ACIDS)
                codes = [np.frombuffer(t, np.uint8) for t in texts]
                n = [int(((c & 0xC0) != 0x80).sum()) * len(AMINO_ACIDS) for c in codes]  # bytes that begin a code point
                same = [int(np.isin(c, _ACID_BYTES).sum()) for c in codes]
                columns = [pa.array(n, pa.int64()), pa.array([x - y for x, y in zip(n, same)], pa.int64()),
                           *[pa.array([e and e[i].hex() for e in ends], pa.string()) for i in (0, 1)]]
                names = [c for c in b.schema.names if c != seq]
                out = pa.RecordBatch.from_arrays([*[b[c] for c in names], *columns], [*names, "n_mutants", "n_changed", "first_md5", "last_md5"])
                yield out.filter(pc.greater(out["n_mutants"], 0))
    return run


def single_mutants(seqs: DataFrame, keys: str | list[str], seq: str, by_residue: bool = False, digests: bool = False) -> DataFrame:
    """Every position x every amino acid, wild-type residue included (SEQ-05):
    (*keys, position, wt, aa, mutant), or with ``by_residue`` one row per
    position with the array ``mutants`` of (aa, mutant).  The mutant string is
    built lazily, so a query that only counts never materialises it.  With
    ``digests`` all mutants are hashed where they are made and a sequence is one
    row: ``n_mutants``, ``n_changed`` (unlike the wild type) and the least and
    greatest md5; sequences without residues have none.  Sequences
    are spread over tasks by their keys, some ``MUTANT_RESIDUES`` residues each."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = seqs.agg(F.sum(F.length(seq)).alias("n")).first()["n"] or 0
    spread = seqs.select(*keys, seq).repartition(max(1, -(-total // MUTANT_RESIDUES)), *keys)
    if digests:
        given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema.fields if f.name != seq)
        return spread.mapInArrow(_digest_rows(seq), f"{given}, n_mutants long, n_changed long, first_md5 string, last_md5 string")
    chars = spread.select(*keys, seq, F.posexplode(F.regexp_extract_all(F.col(seq), F.lit("(?s)."), 0)).alias("p0", "wt"))
    if by_residue:
        ends = F.struct(F.substr(F.col(seq), F.lit(1), F.col("p0")).alias("head"), F.substr(F.col(seq), F.col("p0") + 2).alias("tail"))  # cut once a residue
        made = F.transform(F.array(ends), lambda e: F.transform(F.array(*[F.lit(a) for a in AMINO_ACIDS]), lambda a: F.struct(
            a.alias("aa"), F.concat(e["head"], a, e["tail"]).alias("mutant"))))
        return chars.select(*keys, (F.col("p0") + 1).alias("position"), "wt", F.get(made, F.lit(0)).alias("mutants"))
    m = chars.select(*keys, seq, "p0", "wt", F.explode(F.array(*[F.lit(a) for a in AMINO_ACIDS])).alias("aa"))  # 20 rows per residue
    return m.select(*keys, (F.col("p0") + 1).alias("position"), "wt", "aa",
                    set_residue(F.col(seq), F.col("p0") + 1, F.col("aa")).alias("mutant"))


def gene_tags(genes: DataFrame, key: str, seed=0, tokens=TAG_TOKENS) -> DataFrame:
    """A distinct ordered pair of distinct tokens per gene (SEQ-06): genes
    are numbered in seeded hash order and the number picks the pair; more
    genes than pairs raises."""
    from varlens.operators.splits import rank_within
    t = len(tokens)
    n_pairs = t * (t - 1)
    r = rank_within(genes.select(key).distinct(), [], key, seed, "__g").withColumn("__g", F.col("__g") - 1)
    arr = F.array(*[F.lit(x) for x in tokens])
    i = (F.col("__g") / (t - 1)).cast("int")
    jr = F.col("__g") % (t - 1)
    j = F.when(jr >= i, jr + 1).otherwise(jr)
    ok = F.when(F.col("__g") < n_pairs, F.lit(True)).otherwise(F.raise_error(F.lit("more genes than tag pairs")).cast("boolean"))
    return r.where(ok).select(key, F.concat(F.get(arr, i), F.get(arr, j)).alias("tag"))
