"""Work that grows as the input: what is exchanged, matched or kept once, where it was once for each pair or each use."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from peakforge.operators import alignment, calibration, joins, signal
from peakforge.plans.registry import QUERIES
from peakforge.plans.streams import drift_alerts, median_of_many


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df):
    return [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["select_retained_few", "select_retained_many"])
def test_points_are_matched_once(spark, sf_dir, name):
    assert "min_by" not in plan(QUERIES[name](spark, sf_dir))


def test_fit_quality_reads_what_was_kept(spark, sf_dir):
    assert "min_by" not in plan(QUERIES["fit_quality"](spark, sf_dir))


@pytest.mark.parametrize("name", ["centroids_per_scan", "apply_mz_factor", "main_isotope_refs", "mass_accuracy", "reset_mz_factor"])
def test_nearest_peaks_alone_are_enough(spark, sf_dir, name):
    found = plan(QUERIES[name](spark, sf_dir))
    assert "map_from_entries" not in found
    assert name != "mass_accuracy" or found.count("lineitem.parquet") == 1


def test_draws_are_not_exchanged(spark, sf_dir):
    assert not [e for e in exchanged(QUERIES["score_resample_std"](spark, sf_dir)) if "sid" in e]


def test_a_line_through_one_point_is_null_whatever_the_others_do(spark):
    rng = random.Random(5)
    rows = [(1, 1.0, 2.0)] + [(2, float(x), 3.0 * x + rng.gauss(0, 1) + (40 if x % 7 == 0 else 0)) for x in range(60)]
    line = {r["sid"]: r for r in calibration.huber_line(spark.createDataFrame(rows, "sid long, x double, y double"), key="sid", x="x", y="y").collect()}
    assert set(line) == {1, 2} and line[1]["slope"] is None and abs(line[2]["slope"] - 3) < 0.1


def test_isotopologues_are_dealt_out_and_equal_counts_expanded_once(spark, sf_dir):
    df = QUERIES["expand_isotopologues"](spark, sf_dir)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [e for e in exchanged(df) if "_formula" in e]


def test_clusters_carry_their_columns(spark, sf_dir):
    assert not [line for line in plan(QUERIES["sum_spectrum_clusters"](spark, sf_dir)).splitlines() if "Join" in line and "peak_id" in line]


def border_peaks():
    """Peaks of six spectra around borders of cells, where bins go across, and a chain wider than a bin may be."""
    rng, out = random.Random(9), []
    for cell in range(6000, 6012):
        edge = math.exp(cell * 1e-3)
        for s in range(6):
            if rng.random() < 0.9:
                out.append((s, edge * (1 + rng.uniform(-8e-6, 8e-6))))
            out.append((s, edge * (1 + 4e-4 + rng.uniform(-3e-6, 3e-6))))
    out += [(s, math.exp(6.02) * (1 + k * 1.5e-5 + s * 1e-9)) for s in range(6) for k in range(100)]
    return [("a", s, f"p{i}", m, 1.0 + i % 5) for i, (s, m) in enumerate(out)]


def bins_by_loop(rows):
    out, last, n = {}, None, 0
    for _, s, p, m, i in sorted(rows, key=lambda r: (r[3], r[2])):
        n += last is not None and (m - last) / last * 1e6 > 20
        out.setdefault(n, []).append((s, p, m, i))
        last = m
    return out


def test_bins_across_cells_equal_loops(spark):
    rows = border_peaks()
    df = spark.createDataFrame(rows, "batch string, sid long, peak_id string, mz double, intensity double")
    whole = [(min(m), max(m), sum(m) / len(m)) for b in bins_by_loop(rows).values() if len({x[0] for x in b}) == len(b) >= 3 for m in [[x[2] for x in b]] if (max(m) - min(m)) / min(m) * 1e6 <= 20]
    clear = [p for k, (low, high, p) in enumerate(whole) if (k == 0 or whole[k - 1][1] * (1 + 2e-5) < low) and (k + 1 == len(whole) or whole[k + 1][0] > high * (1 + 2e-5))]
    found = alignment.vlm_points(df)
    assert sorted(round(r["point"], 8) for r in found.collect()) == sorted(round(p, 8) for p in clear)
    assert not [e for e in exchanged(found) if "bin" in e or "_part" in e]
    moved = alignment.vlm_correct(df, found).collect()
    want = bins_by_loop([("a", r["sid"], r["peak_id"], r["corrected"], r["intensity"]) for r in moved])
    got = {r["bin"]: (round(r["mz"], 6), r["intensity"], r["spectra"]) for r in alignment.align_batch(df).collect()}
    assert got == {n: (round(sum(x[2] * x[3] for x in b) / sum(x[3] for x in b), 6), sum(x[3] for x in b), len({x[0] for x in b})) for n, b in want.items()}


def test_anchors_are_found_without_passing_over_the_rest_for_each_peak(spark, sf_dir):
    assert "unboundedfollowing" not in plan(QUERIES["vlm_correct"](spark, sf_dir)).lower()


def test_bins_in_cells_have_one_exchange(spark, sf_dir):
    df = spark.createDataFrame(border_peaks(), "batch string, sid long, peak_id string, mz double, intensity double")
    assert len(exchanged(signal.gap_bins_in_cells(df, ppm=20.0, keys=("batch",)))) == 1


def test_window_sums_equal_loops_where_windows_hold_many_targets(spark, sf_dir):
    rng = random.Random(3)
    targets = [(k, 500_000 + k * 0.45) for k in range(120)] + [(1000 + k, 100 + k * 0.45) for k in range(20)]
    peaks = [(k % 3, k % 2, m + rng.choice([0, 1, -1]) * m * 5e-6, float(k)) for k, (_, m) in enumerate(targets * 3)]
    low, high = joins.ppm_window(F.col("mz"), 5.0)
    t = spark.createDataFrame(targets, "target long, mz double").withColumns({"low": low, "high": high}).drop("mz")
    p = spark.createDataFrame(peaks, "sid long, day long, mz double, intensity double")
    want = {}
    for (k, m), (s, d, q, i) in itertools.product(targets, peaks):
        if m - m * (5.0 * 1e-6) <= q <= m + m * (5.0 * 1e-6):
            want[k, s, d] = want.get((k, s, d), 0.0) + i
    rows = joins.window_sums(p, t, target="target", keys=("sid", "day"), value="intensity", ppm=5.0).collect()
    assert len(rows) == len(want) and {(r["target"], r["sid"], r["day"]): r["intensity"] for r in rows} == want
    assert not [e for e in exchanged(QUERIES["xic"](spark, sf_dir)) if "isotope_id" in e]


@pytest.mark.parametrize("bins", [1, 2, 32])
def test_median_of_many_equals_loops(spark, bins):
    rng = random.Random(1)
    rows = [(s, rng.choice([rng.uniform(-15, 15), -15.0, 15.0, 0.0, rng.gauss(0, 0.1)]), rng.choice([1, 1, 2, 5])) for s in range(25) for _ in range(s + 1)]
    got = {r["sid"]: (r["n"], r["median"]) for r in median_of_many(spark.createDataFrame(rows, "sid long, v double, n long"), "sid", "v", "n", least=-15.0, most=15.0, bins=bins).collect()}
    for s in range(25):
        values = [v for k, v, n in rows if k == s for _ in range(n)]
        assert got[s] == (len(values), statistics.median(values))


def test_drift_keeps_peaks_not_pairs(spark, tmp_path):
    peaks = [(1, 500_000 + k * 0.3) for k in range(50)]
    spark.createDataFrame(peaks, "sid long, mz double").write.parquet(str(tmp_path / "in"))
    calibrants = spark.createDataFrame([(500_000 + k * 0.45,) for k in range(60)], "target_mz double")
    samples = spark.createDataFrame([(1, "orbi")], "sid long, instrument string")
    stream = spark.readStream.schema("sid long, mz double").parquet(str(tmp_path / "in"))
    [alert] = drift_alerts(stream, calibrants, samples, str(tmp_path / "base")).collect()
    errors = [1e6 * (m - c) / c for _, m in peaks for c in (500_000 + k * 0.45 for k in range(60)) if c - c * (15.0 * 1e-6) <= m <= c + c * (15.0 * 1e-6)]
    assert alert["n"] == len(errors) > 20 * len(peaks) and alert["drift"] == pytest.approx(statistics.median(errors))
    assert spark.read.parquet(str(tmp_path / "base/table")).count() == len(peaks)


def test_batches_are_aligned_by_ionization_mode(spark, sf_dir):
    """Peaks of different polarity never share a bin, as in the batch aggregation, which aligns and sums each mode by itself."""
    from peakforge.sources.fixtures import Tables

    t = Tables(spark, sf_dir)
    p = t.peaks.join(t.samples.select("sid", "batch"), "sid")
    want = {(r["batch"], r["polarity"]): round(r["i"], 1) for r in p.groupBy("batch", "polarity").agg(F.sum("intensity").alias("i")).collect()}
    got = QUERIES["align_batch"](spark, sf_dir).groupBy("batch", "polarity").agg(F.sum("intensity").alias("i")).collect()
    assert {(r["batch"], r["polarity"]): round(r["i"], 1) for r in got} == want and {k[1] for k in want} == {"+", "-"}


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_spaced_peaks_equal_loops_in_one_pass(spark, batch):
    """Runs go over any number of batches; no group of peaks has a call of its own."""
    rng = random.Random(8)
    peaks = [(s, f"p{s}-{k:03}", 100 + rng.choice([rng.random() * 0.05, k * 0.01, 3.0]), float(rng.randrange(6))) for s in range(4) for k in range(90)] + [(9, "alone", 100.0, 1.0)]
    want = []
    for s in {p[0] for p in peaks}:
        taken = []
        for p in sorted((p for p in peaks if p[0] == s), key=lambda p: (-p[3], p[2], p[1])):
            if all(abs(q - p[2]) / p[2] * 1e6 >= 50.0 for q in taken):
                taken.append(p[2])
                want.append(p[1])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = signal.spaced(spark.createDataFrame(peaks, "sid long, peak_id string, mz double, intensity double"), ppm=50.0)
        assert sorted(r["peak_id"] for r in found.collect()) == sorted(want)
        assert "FlatMapGroups" not in plan(found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("how", ["mean", "median"])
def test_averages_over_a_grid_equal_loops_without_a_row_for_each_value(spark, how, parts):
    rng = random.Random(2)
    rows = [(b, s, float(rng.randrange(60)), rng.choice([1.5, 2.0, 40.0, None])) for b in "ab" for s in range(5) for _ in range(rng.randrange(1, 25))] + [("c", 1, None, 5.0), ("c", 2, 7.0, None)]
    df = spark.createDataFrame(rows, "batch string, sid long, mz double, intensity double")
    want = {}
    for b in "abc":
        own = {}
        for _, s, m, i in (r for r in rows if r[0] == b):
            own.setdefault(s, {}).setdefault(m, []).append(i)
        lines = [sorted((m, sum(x for x in i if x is not None)) for m, i in spec.items() if m is not None and any(x is not None for x in i)) for spec in own.values()]
        for m in {r[2] for r in rows if r[0] == b}:
            v = []
            for line in lines:
                low, high = [p for p in line if m is not None and p[0] <= m], [p for p in line if m is not None and p[0] >= m]
                (x, y), (x2, y2) = (low[-1], high[0]) if low and high else ((0, 0), (0, 0))
                v.append(y if x == x2 else y + (y2 - y) * (m - x) / (x2 - x))
            want[b, m] = statistics.mean(v) if how == "mean" else statistics.median(v)
    found = alignment.averaged(df, how, parts=parts, cells=20)
    got = {(r["batch"], r["mz"]): r["intensity"] for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["composition_fit", "match_isotopes", "match_assign", "visual_isotope_context", "match_isotope_display", "match_ions"])
def test_rows_of_the_match_chain_are_not_exchanged(spark, sf_dir, name):
    """Peaks are dealt to blocks, ions to the same ones; what an ion shows in a sample is neither exchanged nor joined to itself."""
    keyed = [e for e in exchanged(QUERIES[name](spark, sf_dir)) if "hashpartitioning(block" not in e and "hashpartitioning(ion_id" not in e]
    assert not [e for e in keyed if "sid" in e or "isotope_id" in e]


@pytest.mark.parametrize("name", ["match_ions", "match_isotope_display", "match_assign", "aggregate_matches"])
def test_rows_of_the_match_chain_are_not_sorted(spark, sf_dir, name):
    found = plan(QUERIES[name](spark, sf_dir))
    assert "Sort [block" not in found and "Sort [sid" not in found
    assert found.count("lineitem.parquet") == 1


def test_best_of_a_window_equals_loops_and_pairs_are_not_exchanged(spark, sf_dir):
    rng = random.Random(4)
    targets = [(k, 500_000 + k * 0.45) for k in range(80)] + [(1000 + k, 100 + k * 0.45) for k in range(20)]
    peaks = [(k % 3, f"p{k}", m + rng.choice([0, 1, -1]) * m * 1e-5, rng.choice([1.0, 2.0, None])) for k, (_, m) in enumerate(targets * 3)]
    low, high = F.col("mz") - F.col("mz") * 1e-5, F.col("mz") + F.col("mz") * 1e-5
    t = spark.createDataFrame(targets, "target long, mz double").withColumns({"low": low, "high": high}).drop("mz")
    want = {}
    for (k, m), (s, p, q, i) in itertools.product(targets, peaks):
        if m - m * 1e-5 <= q <= m + m * 1e-5:
            want[k, s] = max(want.get((k, s), (-1.0, "")), (-0.5 if i is None else i, p))
    rows = joins.window_best(spark.createDataFrame(peaks, "sid long, peak_id string, mz double, intensity double"), t, target="target", keys=("sid",), values=("intensity", "peak_id"), ppm=10.0).collect()
    assert len(rows) == len(want) and {(r["target"], r["sid"]): (-0.5 if r["intensity"] is None else r["intensity"], r["peak_id"]) for r in rows} == want
    assert not [e for e in exchanged(QUERIES["max_intensity_in_window"](spark, sf_dir)) if "isotope_id" in e]
