"""Isotopologues against known answers and a convolution atom by atom."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peakforge.functions import chem
from peakforge.operators.isotopes import ISOTOPES, isotopologues

FLAT = {e: [(0, 1.0)] for e in chem.MASSES} | {e: [(a, p) for a, _, p in iso] for e, iso in ISOTOPES.items()}


def convolved(counts):
    """Share of each isotopologue, atom after atom: {((element, mass number), ...) counts: share}."""
    out = {(): 1.0}
    for e, n in sorted(counts.items()):
        for _ in range(n):
            new = defaultdict(float)
            for key, p in out.items():
                for j, (a, q) in enumerate(FLAT[e]):
                    new[tuple(sorted((*key, (e, a)))) if j else key] += p * q
            out = new
    return out


def label(key):
    seen = defaultdict(int)
    for x in key:
        seen[x] += 1
    return "".join(f"[{a}{e}]{n if n > 1 else ''}" for (e, a), n in sorted(seen.items()))


def found(spark, formulas, floor):
    df = spark.createDataFrame([(f,) for f in formulas], "formula string").withColumn("counts", chem.element_counts(F.col("formula")))
    out = defaultdict(dict)
    for r in isotopologues(df, floor=floor).collect():
        out[r["formula"]][r["label"]] = (r["shift"], r["abundance"], r["relative"])
    return out


def test_known_answers(spark):
    got = found(spark, ["C6H5Cl", "CHBr3", "H2O", "NaCl"], 1e-5)
    mono = got["C6H5Cl"][""]
    assert mono[1] == pytest.approx(0.9893**6 * 0.999885**5 * 0.7576, rel=1e-12)
    assert got["C6H5Cl"]["[37Cl]"][1] / mono[1] == pytest.approx(0.2424 / 0.7576)
    assert got["C6H5Cl"]["[37Cl]"][0] == pytest.approx(1.99704992)
    # three bromines: about 1 : 3 : 3 : 1, and the second is the strongest
    br = {k: v for k, v in got["CHBr3"].items() if "C" not in k and "H" not in k}
    assert [round(br[k][1] / br[""][1], 4) for k in ("[81Br]", "[81Br]2", "[81Br]3")] == [2.9183, 2.8389, 0.9205]
    assert br["[81Br]"][2] == max(v[2] for v in got["CHBr3"].values()) == 1.0
    assert got["H2O"][""][1] == pytest.approx(0.99734, abs=2e-4)
    assert set(got["NaCl"]) == {"", "[37Cl]"}


def test_equals_convolution(spark):
    rng = random.Random(8)
    formulas = {}
    for _ in range(12):
        counts = {e: rng.randrange(0, 4) for e in ("C", "H", "N", "O", "S", "Cl", "Br", "Si", "F")}
        counts = {e: n for e, n in counts.items() if n}
        formulas["".join(f"{e}{n}" for e, n in counts.items())] = counts
    for floor in (1e-2, 1e-4):
        got = found(spark, formulas, floor)
        for f, counts in formulas.items():
            whole = {label(k): p for k, p in convolved(counts).items()}
            top = max(whole.values())
            want = {k: p for k, p in whole.items() if p / top >= floor}
            assert {k: v[1] for k, v in got[f].items()} == pytest.approx(want, rel=1e-9)
            masses = {(e, a): m - ISOTOPES[e][0][1] for e, iso in ISOTOPES.items() for a, m, _ in iso}
            keys = {label(k): k for k in convolved(counts)}
            for k, v in got[f].items():
                assert v[0] == pytest.approx(sum(masses[x] for x in keys[k]), abs=1e-9)


def test_unknown_elements_and_repeated_formulas(spark):
    got = found(spark, ["Xx2", "C2", "C2"], 1e-2)
    assert set(got) == {"C2"} and set(got["C2"]) == {"", "[13C]"}
