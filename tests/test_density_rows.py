"""Density operators on gapped rows: several groups of genes, rings shorter than
a window, repeated genes, characters of several bytes, null folds."""

import random

import pytest
from pyspark.sql import functions as F

from varlens.operators import density as D


def _ring(rows, profile, widths=(10, 3)):
    """(family, gene, cls, width, residue): density, residue by residue."""
    out = {}
    for family, gene, row in rows:
        cols = [i + 1 for i, ch in enumerate(row or "") if ch != "-"]
        for (f, cls, col), freq in profile.items():
            if f != family:
                continue
            for at in (i for i, c in enumerate(cols) if c == col):
                for w in widths:
                    for k in range(-((w - 1) // 2), w // 2 + 1):
                        key = (family, gene, cls, w, (at - k) % len(cols) + 1)
                        out[key] = out.get(key, 0) + freq / w
    return out


@pytest.mark.parametrize("characters", [1 << 20, 40])
def test_ring_over_groups_of_genes(spark, monkeypatch, characters):
    monkeypatch.setattr(D, "RING_CHARACTERS", characters)
    monkeypatch.setattr(D, "SLICE", characters)
    rnd = random.Random(3)
    rows = [(f, g, "".join(rnd.choice("Aé--😀\n") for _ in range(rnd.randint(1, 30)))) for f in "xy" for g in range(8)]
    rows += [rows[0], ("x", rows[1][1], "AB-C"), ("x", 90, None), ("x", 91, "---"), ("z", 1, "AAA"), (None, 1, "AAA")]
    profile = {(f, c, col): rnd.randint(1, 4) for f in ("x", "y", "w") for c in (0, 1) for col in rnd.sample(range(1, 32), 9)}
    given = spark.createDataFrame([(*k, v) for k, v in profile.items()] + [("x", 0, 31, 0)][:("x", 0, 31) not in profile], "family string, cls int, col int, freq long")
    genes = spark.createDataFrame(rows, "family string, gene long, row string")
    want = _ring(rows, profile)
    for held in (genes, D.gene_columns(genes)):
        found = D.ring_average(given, held).collect()
        got = {(r.family, r.gene, r.cls, r.width, r.residue): r.dens for r in found}
        assert len(got) == len(found) and got == pytest.approx(want)


def test_windows_read_rows_as_columns(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE", 40)
    rnd = random.Random(4)
    rows = [("x", g, "".join(rnd.choice("Aé--😀") for _ in range(25)) + "A") for g in range(9)] + [("x", 20, None), ("x", 21, "")]
    places = [("x", g, k, rnd.randint(1, sum(c != "-" for c in row)), k % 2) for _, g, row in rows[:9] for k in range(4)]
    genes, pos = spark.createDataFrame(rows, "family string, gene long, row string"), spark.createDataFrame(places, "family string, gene long, k int, position int, cls int")
    read = lambda held: sorted(map(tuple, D.window_density(pos, D.family_profile(D.position_frequency(pos, held)), held).collect()))
    got = read(genes)
    assert got == read(D.gene_columns(genes)) and len(got) == len(places)
    cols = {g: [i + 1 for i, ch in enumerate(row) if ch != "-"] for _, g, row in rows[:9]}
    profile = {}
    for f, g, _, p, c in places:
        profile[f, c, cols[g][p - 1]] = profile.get((f, c, cols[g][p - 1]), 0) + 1
    ring = _ring(rows, profile)
    for f, g, p, _, _, *dens in got:
        assert dens == pytest.approx([ring.get((f, g, c, w, p), 0.0) for _, c, w in D.DENSITY_FEATURES])
    for family, gene, at in (("x", 0, 99), ("x", 0, 0), ("x", 20, 1), ("x", 77, 1), (None, 1, 1)):
        with pytest.raises(Exception, match="past the end|null|NULL"):
            D.position_frequency(spark.createDataFrame([(family, gene, 1, at, 0)], pos.schema), genes).collect()


def test_cross_fitting_meets_one_row_a_residue(spark):
    """Windows met every cell of folds and class in their columns: rows of the
    join grew with the number of cells; now one row per residue of a window."""
    rnd = random.Random(6)
    rows = [("x", g, "".join(rnd.choice("A-BC") for _ in range(20)) + "A") for g in range(12)]
    n = {g: sum(c != "-" for c in row) for _, g, row in rows}
    v = [("x", g, k, rnd.randint(1, n[g]), k % 2, None if g == 5 else g % 4, None if g == 6 else k % 3) for g in n for k in range(6)]
    genes = spark.createDataFrame(rows, "family string, gene long, row string")
    variants = spark.createDataFrame([*v, (None, 0, 9, 1, 1, 0, 0)], "family string, gene long, k int, position int, cls int, o int, j int")
    found = D.cross_fitted(variants, genes, "o", "j").collect()
    assert len(found) == 5 * (len(v) + 1)  # outer folds 0 to 3 and null
    assert len(D.cross_fitted(variants, genes, "o", "j", digits=2).collect()) == len(found)
    cols = {g: [i + 1 for i, ch in enumerate(row) if ch != "-"] for _, g, row in rows}
    maps = {}
    for r in found:
        tested = r.o is not None and r.o == r.for_outer
        assert r.role == ("outer_test" if tested else "inner")
        key = (r.for_outer, None if tested else r.j)
        if key not in maps:
            profile = {}
            for f, g, _, p, c, o, j in v:
                if (key[0] is None or o != key[0]) and (key[1] is None or j != key[1]):
                    profile[f, c, cols[g][p - 1]] = profile.get((f, c, cols[g][p - 1]), 0) + 1
            maps[key] = _ring(rows, profile)
        want = [maps[key].get((r.family, r.gene, c, w, r.position), 0.0) for _, c, w in D.DENSITY_FEATURES]
        assert [r.densgof, r.densgof3aa, r.denslof, r.denslof3aa] == pytest.approx(want)
