"""Operators without an SQL twin, against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from peakforge.operators.matching import match_assign
from peakforge.operators.signal import window_cluster
from peakforge.plans.registry import QUERIES
from peakforge.sources.fixtures import Tables


def greedy(peaks, isotopes, window=0.5):
    out = []
    for sid in {p[0] for p in peaks}:
        for ion in {i[1] for i in isotopes}:
            taken = []
            for iso, _, mz, _ in sorted((i for i in isotopes if i[1] == ion), key=lambda i: (-i[3], i[2], i[0])):
                near = sorted((abs(p[2] - mz), p[2], p[1]) for p in peaks if p[0] == sid and abs(p[2] - mz) <= window)
                for _, pm, pid in near:
                    if all(q[3] != pid and (pm > q[2] if q[1] < mz else pm < q[2]) for q in taken):
                        taken.append((iso, mz, pm, pid))
                        break
            out += [(sid, ion, iso, pid) for iso, _, _, pid in taken]
    return sorted(out)


def test_match_assign_equals_greedy(spark):
    rng = random.Random(3)
    isotopes = [(ion * 3 + k, ion, 100 + ion * 1.7 + k * rng.choice([0.4, 1.0]), rng.choice([0.9, 0.5, 0.5, 0.1])) for ion in range(25) for k in range(3)]
    peaks = [(s, f"p{s}-{j}", 100 + rng.random() * 45, 1.0, 5) for s in range(3) for j in range(150)]
    got = match_assign(spark.createDataFrame(peaks, "sid long, peak_id string, mz double, intensity double, snr long"), spark.createDataFrame(isotopes, "isotope_id long, ion_id long, mz double, relative_abundance double"))
    assert sorted((r["sid"], r["ion_id"], r["isotope_id"], r["peak_id"]) for r in got.collect()) == greedy(peaks, isotopes)


def test_window_cluster_is_anchored_at_its_first_member(spark):
    rng = random.Random(4)
    peaks = [(s, f"p{s}-{j}", 100 + rng.random() * 0.2, 1.0) for s in range(2) for j in range(120)]
    got = {r["peak_id"]: r["cluster"] for r in window_cluster(spark.createDataFrame(peaks, "sid long, peak_id string, mz double, intensity double"), ppm=20.0).collect()}
    for s in range(2):
        start = None
        for _, pid, mz, _ in sorted((p for p in peaks if p[0] == s), key=lambda p: (p[2], p[1])):
            if start is None or (mz - start) / start * 1e6 > 20.0:
                start = mz
            assert got[pid] == start


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    t = Tables(spark, sf_dir)
    peaks = [tuple(r) for r in t.peaks.select("sid", "peak_id", "mz", "intensity", "snr", "ts").collect()]
    isotopes = [tuple(r) for r in t.isotopes.select("isotope_id", "ion_id", "mz", "relative_abundance").collect()]
    return peaks, isotopes


def test_match_assign_query(spark, sf_dir, small):
    peaks, isotopes = small
    got = sorted((r["sid"], r["ion_id"], r["isotope_id"], r["peak_id"]) for r in QUERIES["match_assign"](spark, sf_dir).collect())
    by_sid, by_ion, want = defaultdict(list), defaultdict(list), []
    for p in peaks:
        by_sid[p[0]].append(p)
    for i in isotopes:
        by_ion[i[1]].append(i)
    for sid, ps in by_sid.items():
        for ion, its in by_ion.items():
            low, high = min(i[2] for i in its) - 0.5, max(i[2] for i in its) + 0.5
            want += greedy([p for p in ps if low <= p[2] <= high] or [(sid, "", -9.0)], its)
    assert got == sorted(want)
    full = QUERIES["match_isotopes"](spark, sf_dir).collect()
    assert sorted((r["sid"], r["ion_id"], r["isotope_id"], r["peak_id"]) for r in full if r["found"]) == got
    assert all(r["score"] == 0 and r["abundance_error"] == 1 for r in full if not r["found"])
    assert len(full) == len({(r["sid"], r["ion_id"]) for r in full}) * 3


def test_cluster_queries(spark, sf_dir, small):
    peaks, _ = small
    starts, sums, kept = {}, defaultdict(list), []
    for sid in {p[0] for p in peaks}:
        start = None
        own = sorted((p for p in peaks if p[0] == sid), key=lambda p: (p[2], p[1]))
        for p in own:
            if start is None or (p[2] - start) / start * 1e6 > 10.0:
                start = p[2]
            starts[sid, p[1]] = round(start, 6)
            sums[sid, start].append(p)
        taken = []
        for p in sorted(own, key=lambda p: (-p[3], p[2], p[1])):
            if all(abs(q - p[2]) / p[2] * 1e6 >= 50.0 for q in taken):
                taken.append(p[2])
                kept.append((sid, p[1]))
    got = {(r["sid"], r["peak_id"]): r["cluster"] for r in QUERIES["window_cluster"](spark, sf_dir).collect()}
    assert got.keys() == starts.keys() and all(abs(got[k] - v) < 2e-6 for k, v in starts.items())
    rows = {(r["sid"], r["peaks"]): r for r in QUERIES["sum_spectrum_clusters"](spark, sf_dir).collect()}
    assert len(rows) == len(sums)
    scans = {sid: len({p[5] for p in peaks if p[0] == sid}) for sid in {p[0] for p in peaks}}
    for (sid, _), ps in sums.items():
        r, total = rows[sid, ",".join(sorted(p[1] for p in ps))], sum(p[3] for p in ps)
        assert r["intensity"] == pytest.approx(total) and r["per_scan"] == pytest.approx(total / scans[sid], abs=1e-5)
        assert r["mz"] == pytest.approx(sum(p[2] * p[3] for p in ps) / total, abs=2e-6) and r["snr"] == pytest.approx(sum(p[4] * p[3] for p in ps) / total, abs=2e-6)
    assert sorted((r["sid"], r["peak_id"]) for r in QUERIES["peak_distance_select"](spark, sf_dir).collect()) == sorted(kept)


def test_step_scores(spark, sf_dir):
    series = defaultdict(list)
    for r in Tables(spark, sf_dir).scans.select("sid", "ion", "ts", "event_id", "height").collect():
        series[r["sid"], r["ion"]].append((r["ts"], r["event_id"], r["height"]))

    def cost(x):
        return sum(v * v for v in x) - sum(x) ** 2 / len(x)

    got = {(r["sid"], r["ion"]): (r["n"], r["score"]) for r in QUERIES["intensity_change_score"](spark, sf_dir).collect()}
    assert got.keys() == series.keys()
    for key, rows in series.items():
        v = [h for *_, h in sorted(rows)]
        n = len(v)
        s = [sum(v[max(0, i - 5) : i + 6]) / len(v[max(0, i - 5) : i + 6]) for i in range(n)]

        def best(a, b):
            cuts = [(cost(s[a:b]) - cost(s[a:c]) - cost(s[c:b]), -c) for c in range(a + 2, b - 1)]
            return max(((round(g, 9), c) for g, c in cuts), default=None)

        want = 0.0
        if n >= 6 and cost(v) > 1e-9:
            cut = -best(0, n)[1]
            other = max((x for x in (best(0, cut), best(cut, n)) if x), default=None)
            ends = sorted({0, cut, n} | ({-other[1]} if other else set()))
            want = 1 - sum(cost(v[a:b]) for a, b in zip(ends, ends[1:], strict=False)) / cost(v)
        assert got[key][0] == n and math.isclose(got[key][1], want, abs_tol=2e-6), key


def test_robust_line(spark, sf_dir, small):
    peaks, _ = small
    got = {r["sid"]: (r["slope"], r["intercept"]) for r in QUERIES["resolution_fit_tof"](spark, sf_dir).collect()}
    for sid in {p[0] for p in peaks if p[0] % 2}:
        x = np.array([p[2] for p in peaks if p[0] == sid])
        y = x / (1000.0 * np.array([float(p[4]) for p in peaks if p[0] == sid]))
        a, b = np.polyfit(x, y, 1)
        for _ in range(10):
            r = y - (a * x + b)
            s = 1.4826 * np.median(np.abs(r - np.median(r)))
            w = np.where(np.abs(r) > 1.345 * s, 1.345 * s / np.maximum(np.abs(r), 1e-300), 1.0)
            old, (a, b) = (a, b), np.polyfit(x, y, 1, w=np.sqrt(w))
            if np.allclose(old, (a, b), rtol=1e-4, atol=1e-6):
                break
        assert got[sid] == pytest.approx((a, b), rel=1e-5, abs=2e-7)
