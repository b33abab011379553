"""The search of compositions against a walk through the whole box."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from peakforge.functions import chem
from peakforge.operators.compositions import BONDS, search
from peakforge.sources.fixtures import Tables

BODY = {"+H+": (chem.MASSES["H"], 1), "-H+": (-chem.MASSES["H"], -1), "+Cl-": (chem.MASSES["Cl"], -1)}


def brute(peaks, ranges, ppm, unsaturation, whole, most):
    names = list(ranges)
    boxes = [(dict(zip(names, c, strict=True))) for c in itertools.product(*(range(a, b + 1) for a, b in ranges.values()))]
    weighed = [(sum(chem.MASSES[e] * n for e, n in c.items()), 1 + sum(BONDS[e] * n for e, n in c.items()) / 2, c) for c in boxes]
    out = set()
    for i, mz in peaks:
        for m, (body, z) in BODY.items():
            neutral = mz - (body - z * chem.ELECTRON)
            hits = []
            if abs(neutral) <= mz * ppm * 1e-6:
                out.add((i, m, "()", 1))
                continue
            if neutral <= 0:
                continue
            for mass, rings, c in weighed:
                if abs(neutral - mass) <= mz * ppm * 1e-6 and unsaturation[0] <= rings <= unsaturation[1] and (not whole or rings == int(rings)):
                    order = ["C", "H", *sorted(set(c) - {"C", "H"})] if c.get("C") else sorted(c)
                    text = "".join(e + (str(c[e]) if c[e] > 1 else "") for e in order if c.get(e))
                    hits.append((abs(neutral - mass) / mz * 1e6, text))
            out |= {(i, m, text, k) for k, (_, text) in enumerate(sorted(hits)[:most], 1)}
    return out


@pytest.mark.parametrize("whole,most,unsaturation", [(False, 100, (0.0, 50.0)), (True, 3, (-1.0, 6.0))])
def test_equals_the_whole_box(spark, sf_dir, whole, most, unsaturation):
    ranges = {"C": (0, 9), "H": (0, 14), "N": (0, 2), "O": (1, 3), "S": (0, 1), "Cl": (0, 1), "P": (0, 1), "Br": (0, 1)}
    rng = random.Random(2)
    peaks = [(k, sum(chem.MASSES[e] * rng.randint(a, b) for e, (a, b) in ranges.items()) + rng.choice([1.00727, -1.00727, 34.9694])) for k in range(25)]
    peaks += [(90, chem.MASSES["H"] - chem.ELECTRON), (91, chem.MASSES["Cl"] + chem.ELECTRON), (92, 0.5)]
    m = Tables(spark, sf_dir).mechanisms.where(F.col("mechanism").isin(*BODY))
    box = spark.createDataFrame([(e, a, b) for e, (a, b) in ranges.items()], "element string, low int, high int")
    got = search(spark.createDataFrame(peaks, "id long, mz double"), box, m, ppm=50.0, unsaturation=unsaturation, whole=whole, most=most)
    assert {(r["id"], r["mechanism"], r["formula"], r["place"]) for r in got.collect()} == brute(peaks, ranges, 50.0, unsaturation, whole, most)


def test_nothing_to_search_and_unknown_elements(spark, sf_dir):
    m = Tables(spark, sf_dir).mechanisms
    box = spark.createDataFrame([("C", 0, 3)], "element string, low int, high int")
    assert search(spark.createDataFrame([], "id long, mz double"), box, m).count() == 0
    assert search(spark.createDataFrame([(1, 13.00727)], "id long, mz double"), box, m, ppm=5.0).where("mechanism = '+H+'").select("formula").collect() == [("C",)]
    with pytest.raises(ValueError):
        search(spark.createDataFrame([(1, 13.0)], "id long, mz double"), spark.createDataFrame([("Xx", 0, 3)], "element string, low int, high int"), m)
