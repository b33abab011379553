"""The match chain by blocks of ions: no library goes through the driver, no candidate is exchanged, and no pair is lost at a border."""

import random

import pytest

from peakforge.operators.joins import dealt_ions, nearest_peak
from peakforge.operators.matching import match_stats, with_expected
from peakforge.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["candidate_range_join", "nearest_peak", "match_stats", "apply_match_params"])
def test_library_is_not_broadcast(spark, sf_dir, name):
    joins = [line for line in plan(QUERIES[name](spark, sf_dir)).splitlines() if "BroadcastHashJoin" in line]
    assert not [j for j in joins if any(k in j for k in ("_bucket", "block", "ion_id", "isotope_id"))]


@pytest.mark.parametrize("name", ["nearest_peak", "match_stats", "apply_match_params", "match_ions", "fit_score_v2"])
def test_candidates_are_not_exchanged(spark, sf_dir, name):
    assert "hashpartitioning(sid" not in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("wide", [0.0, 2.0, 90.0])
def test_nearest_and_expected_equal_loops(spark, wide):
    rng = random.Random(7)
    isotopes = [(ion * 3 + k, ion, round(100 + ion * 1.5 + k * wide / 2, 2), rng.choice([0.9, 0.5, 0.1])) for ion in range(40) for k in range(3)]
    edges = [(m + d) for _, _, m, _ in isotopes[::5] for d in (-0.5, 0.5, 0.0, 0.5000001)]
    peaks = [(s, f"p{s}-{j}", m, 1.0 + j, 5) for s in range(3) for j, m in enumerate([*edges, *(100 + rng.random() * 150 for _ in range(100))])]
    p = spark.createDataFrame(peaks, "sid long, peak_id string, mz double, intensity double, snr long")
    i = spark.createDataFrame(isotopes, "isotope_id long, ion_id long, mz double, relative_abundance double")
    want = {}
    for iso, _, mz, _ in isotopes:
        for s in range(3):
            near = [(abs(q[2] - mz), q[2], q[1]) for q in peaks if q[0] == s and mz - 0.5 <= q[2] <= mz + 0.5]
            if near:
                want[s, iso] = min(near)[2]
    for shares in (1, 4):
        dealt = dealt_ions(i, 0.5, shares=shares)
        found = nearest_peak(p, i, key="sid", target="isotope_id", window=0.5, dealt=dealt, shares=shares)
        assert {(r["sid"], r["isotope_id"]): r["peak_id"] for r in found.collect()} == want
        cells = lambda df: sorted(map(repr, df.select("sid", "ion_id", "isotope_id", "peak_id", "main_intensity", "main_abundance", "score", "found").collect()))
        assert cells(match_stats(with_expected(found, i, dealt))) == cells(match_stats(with_expected(found.drop("block"), i)))


@pytest.mark.parametrize("name", ["orphan_matches_sample", "orphan_matches_batch", "assign_compositions", "match_isotopic_pattern"])
def test_library_keys_are_merged(spark, sf_dir, name):
    joins = [line for line in plan(QUERIES[name](spark, sf_dir)).splitlines() if "BroadcastHashJoin" in line]
    assert not [j for j in joins if "ion_id" in j or "isotope_id" in j]


@pytest.mark.parametrize("name", ["orphan_matches_sample", "samples_for_ion", "assemble_isotope_frame", "export_batch_sheets"])
def test_pairs_of_sample_and_ion_stay_in_their_block(spark, sf_dir, name):
    assert "hashpartitioning(sid" not in plan(QUERIES[name](spark, sf_dir))


def test_formulas_are_dealt_out(spark, sf_dir):
    assert QUERIES["neutral_of"](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
