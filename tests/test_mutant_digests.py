"""Digests of all single mutants without a string per mutant."""

import hashlib
import random

from varlens.operators import digests as D
from varlens.operators import sequence as Q


def brute(text):
    found = [hashlib.md5((text[:i] + a + text[i + 1:]).encode()).hexdigest() for i in range(len(text)) for a in Q.AMINO_ACIDS]
    return (min(found), max(found)) if found else None


def test_mutant_ends_equal_brute_force(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abAC é😀ß\n") for _ in range(n)) for n in (0, 1, 2, 54, 55, 56, 57, 63, 64, 65, 119, 120, 121, 300)]
    texts += ["A" * 55, "é" * 28, "é" * 32, "😀" * 16, "a" * 64]  # lengths around a block's end, also after a shorter residue
    for slab in (D.SLAB, 37):
        monkeypatch.setattr(D, "SLAB", slab)
        got = D.mutant_ends([t.encode() for t in texts], Q.AMINO_ACIDS)
        assert [e and (e[0].hex(), e[1].hex()) for e in got] == [brute(t) for t in texts]
    assert D.mutant_ends([], Q.AMINO_ACIDS) == []


def test_single_mutants_as_digests(spark, monkeypatch):
    monkeypatch.setattr(Q, "MUTANT_RESIDUES", 4)
    rows = [(1, "ACD"), (None, "é😀\n"), (2, ""), (3, None), (4, "A"), (4, "B")]
    got = Q.single_mutants(spark.createDataFrame(rows, "id long, text string"), "id", "text", digests=True)
    assert got.columns == ["id", "n_mutants", "n_changed", "first_md5", "last_md5"]
    want = [(i, 20 * len(t), sum(a != c for c in t for a in Q.AMINO_ACIDS), *brute(t)) for i, t in rows if t]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
