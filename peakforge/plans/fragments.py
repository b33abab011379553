"""Queries on fragment spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.operators import fragments, joins, signal
from peakforge.plans.registry import query
from peakforge.sources.fixtures import Tables

#: m/z of the reagent ion and mass that a proton transfer leaves behind, parameters of a recording
REAGENT, TRANSFER = 62.15, 50.0

P = """fp AS (SELECT f.*, c.parent FROM fragments f JOIN (SELECT sid, parent_mz, CAST(sum(fresh) OVER (PARTITION BY sid ORDER BY parent_mz ROWS UNBOUNDED PRECEDING) AS BIGINT) AS parent FROM (
    SELECT *, CASE WHEN parent_mz - lag(parent_mz) OVER (PARTITION BY sid ORDER BY parent_mz) > 1e-3 THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT sid, parent_mz FROM fragments))) c USING (sid, parent_mz)),
    pm AS (SELECT sid, parent, median(parent_mz) AS parent_mz, count(*) AS scans FROM (SELECT DISTINCT sid, parent, scan, parent_mz FROM fp) GROUP BY ALL),
    fb AS (SELECT *, sum(fresh) OVER (PARTITION BY sid, parent ORDER BY mz, peak_id ROWS UNBOUNDED PRECEDING) AS bin FROM (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 > 2e1 THEN 1 ELSE 0 END AS fresh
    FROM fp WHERE snr >= 3 WINDOW w AS (PARTITION BY sid, parent ORDER BY mz, peak_id))),
    fc AS (SELECT g.sid, g.parent, pm.parent_mz, pm.scans, g.bin, g.mz, g.total / pm.scans AS intensity, g.n_peaks FROM (SELECT sid, parent, CAST(bin AS BIGINT) AS bin, sum(mz * intensity) / sum(intensity) AS mz, sum(intensity) AS total, count(*) AS n_peaks
    FROM fb GROUP BY sid, parent, bin) g JOIN pm USING (sid, parent))"""
LOOK = f"""{P}, lk AS (SELECT sid, parent, parent_mz, sum(intensity) AS tic, arg_min({{'mz': mz, 'i': intensity}}, {{'d': abs(mz - {REAGENT}e0), 'mz': mz}}) AS reagent,
    arg_min({{'mz': mz, 'i': intensity}}, {{'d': abs(mz - (parent_mz - {TRANSFER}e0)), 'mz': mz}}) AS analyte, arg_min({{'mz': mz, 'i': intensity}}, {{'d': abs(mz - parent_mz), 'mz': mz}}) AS own FROM fc GROUP BY sid, parent, parent_mz),
    cl AS (SELECT *, CASE WHEN ri < tic * 0.01e0 AND ai < tic * 0.01e0 THEN 'Undetermined' WHEN ri >= ai THEN 'Declustering' ELSE 'Proton transfer' END AS type FROM (
    SELECT *, CASE WHEN abs(reagent.mz - {REAGENT}e0) < 0.01e0 THEN reagent.i ELSE 0e0 END AS ri, CASE WHEN abs(analyte.mz - (parent_mz - {TRANSFER}e0)) < 0.01e0 THEN analyte.i ELSE 0e0 END AS ai FROM lk WHERE tic > 0))"""


def spectra(t: Tables):
    return fragments.centroids(fragments.with_parent(t.fragments))


def classified(t: Tables):
    own = F.col("parent_mz")
    return fragments.classify(fragments.looked_up(spectra(t), reagent=F.lit(REAGENT), analyte=own - TRANSFER, own=own), REAGENT, TRANSFER)


@query("ms2_parent_clusters", f"WITH {P} SELECT sid, parent, round(parent_mz, 6) AS parent_mz, scans FROM pm", "fragments")
def _(t: Tables):
    return fragments.parents(fragments.with_parent(t.fragments)).select("sid", "parent", F.round("parent_mz", 6).alias("parent_mz"), "scans")


@query("ms2_centroids_by_parent", f"WITH {P} SELECT sid, parent, bin, round(mz, 8) AS mz, round(intensity, 9) AS intensity, n_peaks FROM fc", "fragments")
def _(t: Tables):
    return spectra(t).select("sid", "parent", "bin", F.round("mz", 8).alias("mz"), F.round("intensity", 9).alias("intensity"), "n_peaks")


@query(
    "ms2_summary",
    f"""WITH {P} SELECT f.sid, f.parent, count(DISTINCT scan) AS scans, count(*) FILTER (WHERE snr >= 3) AS centroids, string_agg(DISTINCT CAST(energy AS VARCHAR), ',' ORDER BY CAST(energy AS VARCHAR)) AS energies,
    round(max(f.parent_mz) - min(f.parent_mz), 8) AS spread FROM fp f GROUP BY f.sid, f.parent""",
    "fragments",
)
def _(t: Tables):
    g = fragments.with_parent(t.fragments).groupBy("sid", "parent")
    return g.agg(
        F.countDistinct("scan").alias("scans"), F.count_if(F.col("snr") >= 3).alias("centroids"), F.array_join(F.array_sort(F.collect_set(F.col("energy").cast("string"))), ",").alias("energies"),
        F.round(F.max("parent_mz") - F.min("parent_mz"), 8).alias("spread"),
    )


@query(
    "ms2_fragment_timeseries",
    """WITH b AS (SELECT *, sum(fresh) OVER (PARTITION BY sid ORDER BY mz, peak_id ROWS UNBOUNDED PRECEDING) AS bin FROM (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 > 1e1 THEN 1 ELSE 0 END AS fresh
    FROM fragments WHERE snr >= 3 WINDOW w AS (PARTITION BY sid ORDER BY mz, peak_id))), tic AS (SELECT sid, ts, sum(intensity) AS tic FROM fragments GROUP BY sid, ts)
    SELECT b.sid, CAST(bin AS BIGINT) AS bin, b.ts, round(sum(intensity) / any_value(tic), 8) AS share FROM b JOIN tic USING (sid, ts) GROUP BY b.sid, bin, b.ts""",
    "fragments",
)
def _(t: Tables):
    tic = t.fragments.groupBy("sid", "ts").agg(F.sum("intensity").alias("tic"))
    per = signal.gap_bin(t.fragments.where("snr >= 3"), ppm=10.0).groupBy("sid", "bin", "ts").agg(F.sum("intensity").alias("i"))
    return per.join(tic, ["sid", "ts"]).select("sid", "bin", "ts", F.round(F.col("i") / F.col("tic"), 8).alias("share"))


@query("ms2_classify", f"WITH {LOOK} SELECT sid, parent, type, round(ri, 6) AS reagent_intensity, round(ai, 6) AS analyte_intensity FROM cl", "fragments")
def _(t: Tables):
    return classified(t).select("sid", "parent", "type", F.round("reagent_intensity", 6).alias("reagent_intensity"), F.round("analyte_intensity", 6).alias("analyte_intensity"))


def fraction(rows, fragment: str):
    """Shares of a fragment and of the parent in their sum, in percent."""
    total = F.col("own.intensity") + F.col(fragment)
    share = lambda c: F.round(100 * c / total, 6)
    return rows.where(total > 0).select("sid", "parent", share(F.col(fragment)).alias("fragment_percent"), share(F.col("own.intensity")).alias("parent_percent"))


@query("ms2_declustering_fraction", f"WITH {LOOK} SELECT sid, parent, round(100 * ri / (ri + own.i), 6) AS fragment_percent, round(100 * own.i / (ri + own.i), 6) AS parent_percent FROM cl WHERE type = 'Declustering' AND ri > 0", "fragments")
def _(t: Tables):
    return fraction(classified(t).where("type = 'Declustering' AND reagent_intensity > 0"), "reagent_intensity")


@query("ms2_proton_transfer_fraction", f"WITH {LOOK} SELECT sid, parent, round(100 * ai / (ai + own.i), 6) AS fragment_percent, round(100 * own.i / (ai + own.i), 6) AS parent_percent FROM cl WHERE type = 'Proton transfer' AND ai > 0", "fragments")
def _(t: Tables):
    return fraction(classified(t).where("type = 'Proton transfer' AND analyte_intensity > 0"), "analyte_intensity")


@query(
    "ms2_target_fraction",
    f"WITH {LOOK} SELECT parent, round(avg(100 * ri / (ri + own.i)), 6) AS fragment_percent, round(avg(100 * own.i / (ri + own.i)), 6) AS parent_percent, count(*) AS n FROM cl WHERE ri + own.i > 0 GROUP BY parent",
    "fragments",
)
def _(t: Tables):
    rows = classified(t)
    total = F.col("reagent_intensity") + F.col("own.intensity")
    g = rows.where(total > 0).groupBy("parent")
    return g.agg(F.round(F.avg(100 * F.col("reagent_intensity") / total), 6).alias("fragment_percent"), F.round(F.avg(100 * F.col("own.intensity") / total), 6).alias("parent_percent"), F.count("*").alias("n"))


MS1 = """b1 AS (SELECT *, sum(fresh) OVER (PARTITION BY sid ORDER BY mz, peak_id ROWS UNBOUNDED PRECEDING) AS bin FROM (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 > 2e1 THEN 1 ELSE 0 END AS fresh
    FROM peaks WHERE polarity = '+' AND snr >= 3 WINDOW w AS (PARTITION BY sid ORDER BY mz, peak_id))), n1 AS (SELECT sid, count(DISTINCT ts) AS scans FROM peaks WHERE polarity = '+' GROUP BY sid),
    m1 AS (SELECT b1.sid, CAST(bin AS BIGINT) AS bin, sum(mz * intensity) / sum(intensity) AS mz, sum(intensity) / any_value(scans) AS intensity FROM b1 JOIN n1 USING (sid) GROUP BY b1.sid, bin)"""


def ms1(t: Tables):
    """Averaged centroids of the positive survey scans."""
    rows = t.peaks.where("polarity = '+'")
    n = rows.groupBy("sid").agg(F.countDistinct("ts").alias("scans"))
    per = signal.bin_centroids(signal.gap_bin(rows.where("snr >= 3"), ppm=20.0))
    return per.join(n, "sid").select("sid", "bin", "mz", (F.col("intensity") / F.col("scans")).alias("intensity"))


@query("ms1_averaged_centroids", f"WITH {MS1} SELECT sid, bin, round(mz, 8) AS mz, round(intensity, 9) AS intensity FROM m1", "peaks")
def _(t: Tables):
    return ms1(t).select("sid", "bin", F.round("mz", 8).alias("mz"), F.round("intensity", 9).alias("intensity"))


@query(
    "ms2_parent_info",
    f"""WITH {MS1}, pa AS (SELECT DISTINCT sid, round(parent_mz, 2) AS parent_mz FROM fragments), c AS (SELECT pa.sid, pa.parent_mz, m1.mz, m1.intensity FROM pa JOIN m1 ON m1.sid = pa.sid AND m1.mz BETWEEN pa.parent_mz - 0.5e0 AND pa.parent_mz + 0.5e0)
    SELECT sid, parent_mz, round(arg_min(intensity, {{'d': abs(mz - parent_mz), 'mz': mz}}), 6) AS intensity, round(100 * arg_min(intensity, {{'d': abs(mz - parent_mz), 'mz': mz}}) / sum(intensity), 6) AS percent FROM c GROUP BY sid, parent_mz""",
    "peaks fragments",
)
def _(t: Tables):
    pa = t.fragments.select("sid", F.round("parent_mz", 2).alias("parent_mz")).distinct()
    m = ms1(t).select("sid", "mz", "intensity")
    near = joins.range_join(m, pa, low=F.col("parent_mz") - 0.5, high=F.col("parent_mz") + 0.5, width=1.0, on=("sid",))
    own = F.min_by("intensity", F.struct(F.abs(F.col("mz") - F.col("parent_mz")), "mz"))
    return near.groupBy("sid", "parent_mz").agg(F.round(own, 6).alias("intensity"), F.round(100 * own / F.sum("intensity"), 6).alias("percent"))
