"""Names of files, verdicts, candidates and listings on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from peakforge.plans import registry
from peakforge.plans.details import annotated, match_samples_listed
from peakforge.sources import filenames, reference
from peakforge.sources.verdicts import Verdicts

assert registry.QUERIES


def test_times_in_names(spark):
    want = {
        "Orbi_2024.03.05-07h08m09s_x": dt.datetime(2024, 3, 5, 7, 8, 9),
        "tof_20240305_0708_b": dt.datetime(2024, 3, 5, 7, 8),
        "tof_20240305070809": dt.datetime(2024, 3, 5, 7, 8, 9),
        "tof_20240305-070809": dt.datetime(2024, 3, 5, 7, 8, 9),
        "tof_20240305-0708": dt.datetime(2024, 3, 5, 7, 8),
        "tof_20240305": dt.datetime(2024, 3, 5),
        "tof_20240230": None,  # no such day
        "tof_99999999_0708_x": None,
        "lab": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(n,) for n in want], "name string")
    got = df.select("name", filenames.acquired(F.col("name")).alias("t"), filenames.instrument_class(filenames.instrument(F.col("name"))).alias("c")).collect()
    assert {r["name"]: r["t"] for r in got} == want
    assert {r["c"] for r in got if r["name"] and "_" in r["name"]} == {"orbi", "tof"} and next(r["c"] for r in got if r["name"] == "lab") is None


def test_verdicts_keep_their_scores(spark, tmp_path):
    store = Verdicts(spark, f"file://{tmp_path}/v")
    scores = lambda x: spark.createDataFrame([(k, x, x, x) for k in (1, 2)], "assignment long, fit_score double, evidence double, p_correct double")
    told = lambda rows: spark.createDataFrame(rows, "assignment long, verdict string, evidence_level string")
    store.record(told([(1, "confirmed", "standard"), (2, "rejected", None)]), scores(0.9), 0)
    store.record(told([(1, "unsure", None)]), scores(0.1), 1)
    store.record(told([(1, "unsure", None)]), scores(0.2), 1)  # the same append again
    groups = spark.createDataFrame([(1, "a"), (2, "a")], "assignment long, who string")
    rows = sorted((r["place"], r["assignment"], r["verdict"], r["fit_score"]) for r in store.newest_first(groups, "who").collect())
    assert rows == [(1, 1, "unsure", 0.2), (2, 2, "rejected", 0.9), (3, 1, "confirmed", 0.9)]
    for bad in ([(3, "rejected", None)], [(1, "maybe", None)], [(1, "confirmed", None)]):
        with pytest.raises(ValueError):
            store.record(told(bad), scores(0.5), 2)
    assert store.all().count() == 3


def test_known_only_and_listing_filters(spark):
    c = spark.createDataFrame([(1, "CH4"), (2, "XY")], "ion_id long, formula string")
    k = spark.createDataFrame([("CH4", "methane"), ("CH4", "marsh gas"), ("CH4", "methane")], "formula string, compound_name string")
    assert sorted(map(tuple, annotated(c, k).collect())) == [(1, "CH4", "marsh gas|methane", True), (2, "XY", None, False)]
    assert [tuple(r) for r in annotated(c, k, known_only=True).collect()] == [(1, "CH4", "marsh gas|methane", True)]
    ions = spark.createDataFrame([(1, 10, 2), (1, 11, 0), (2, 10, 1), (3, 10, 0)], "sid long, ion_id long, category int")
    s = spark.createDataFrame([(1, "b1", "one"), (2, "b1", "two"), (3, "b2", "three")], "sid long, batch string, sample_name string")
    sids = lambda **o: sorted(r["sid"] for r in match_samples_listed(ions, s, **o).collect())
    assert sids() == [1, 2, 3] and sids(least=1) == [1, 2] and sids(batches=["b2"]) == [3] and sids(sids=[2, 3], least=1) == [2]


def test_versions_of_a_source(spark, tmp_path):
    base = f"file://{tmp_path}/ref"
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "formula string")
    reference.ingest_version(rows("CH4"), base, "a", "2024")
    reference.ingest_version(rows("CH4", "H2O"), base, "b", "1")
    old = reference.read_active(spark, base, "a", "formula string")
    reference.ingest_version(rows("C2H6", "C3H8"), base, "a", "2025")
    assert [r["formula"] for r in old.collect()] == ["CH4"]  # a reader keeps the version that it began with
    assert sorted(r["formula"] for r in reference.read_active(spark, base, "a", "formula string").collect()) == ["C2H6", "C3H8"]
    with pytest.raises(ValueError):
        reference.ingest_version(rows("x").limit(0), base, "a", "2026")
    assert sorted((r["source"], r["version"], r["n"]) for r in reference.active(spark, base).collect()) == [("a", "2025", 2), ("b", "1", 2)]
    reference.ingest_version(rows("CH4"), base, "a", "2024")  # back to an earlier one
    assert reference.active(spark, base).where("source = 'a'").first()["version"] == "2024"
