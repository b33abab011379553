"""Queries on batches: normalisation, background, correlation, stages, error rates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.operators import confidence, signal
from peakforge.plans.registry import query
from peakforge.sources.fixtures import Tables


@query("load_peaks", "SELECT s.batch, s.sample_name, p.peak_id, p.intensity FROM peaks p JOIN samples s USING (sid) WHERE contains(lower(s.batch), 'nation_1')", "peaks samples")
def _(t: Tables):
    s = t.samples.where(F.lower("batch").contains("nation_1")).select("sid", "batch", "sample_name")
    return t.peaks.join(s, "sid").select("batch", "sample_name", "peak_id", "intensity")


@query("load_peak_timeseries", "SELECT event_id, sid, height FROM scans WHERE ion = 'view' AND sid IN (SELECT sid FROM samples WHERE instrument = 'orbi')", "scans samples")
def _(t: Tables):
    s = t.samples.where("instrument = 'orbi'").select("sid")
    return t.scans.where("ion = 'view'").join(s, "sid", "left_semi").select("event_id", "sid", "height")


@query("load_peaks_by_stage", "SELECT sid, ion, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'a' WHEN ts < TIMESTAMP '2024-01-21' THEN 'b' ELSE 'c' END AS stage, round(avg(height), 6) AS height FROM scans GROUP BY ALL", "scans")
def _(t: Tables):
    stage = F.expr("CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'a' WHEN ts < TIMESTAMP '2024-01-21' THEN 'b' ELSE 'c' END").alias("stage")
    return t.scans.groupBy("sid", "ion", stage).agg(F.round(F.avg("height"), 6).alias("height"))


@query("ts_ion", "SELECT sid, ion_id, round(sum(intensity), 4) AS height FROM gated WHERE score >= 0.5e0 GROUP BY ALL", "gated")
def _(t: Tables):
    return t.gated.where("score >= 0.5").groupBy("sid", "ion_id").agg(F.round(F.sum("intensity"), 4).alias("height"))


@query("ts_compound", "SELECT sid, compound_id, round(sum(intensity), 4) AS height FROM gated WHERE score >= 0.5e0 GROUP BY ALL", "gated")
def _(t: Tables):
    return t.gated.where("score >= 0.5").groupBy("sid", "compound_id").agg(F.round(F.sum("intensity"), 4).alias("height"))


@query("ts_isotope", "SELECT sid, isotope_id, round(sum(intensity), 4) AS height FROM gated WHERE score >= 0.5e0 GROUP BY ALL", "gated")
def _(t: Tables):
    return t.gated.where("score >= 0.5").groupBy("sid", "isotope_id").agg(F.round(F.sum("intensity"), 4).alias("height"))


@query("ts_rebin", "SELECT ion, time_bucket(INTERVAL 1 HOUR, ts) AS bin, round(avg(height), 6) AS height, count(*) AS n FROM scans GROUP BY ALL", "scans")
def _(t: Tables):
    return t.scans.groupBy("ion", F.window("ts", "1 hour").alias("w")).agg(F.round(F.avg("height"), 6).alias("height"), F.count("*").alias("n")).select("ion", F.col("w.start").alias("bin"), "height", "n")


@query("tic_normalize", "SELECT peak_id, round(intensity / sum(intensity) OVER (PARTITION BY sid) * 1e6, 6) AS share FROM (SELECT DISTINCT sid, peak_id, intensity FROM peaks)", "peaks")
def _(t: Tables):
    p = t.peaks.select("sid", "peak_id", "intensity").dropDuplicates()
    return p.select("peak_id", F.round(F.col("intensity") / F.sum("intensity").over(W.partitionBy("sid")) * 1e6, 6).alias("share"))


@query(
    "reagent_normalize",
    """WITH r AS (SELECT sid, sum(intensity) AS reagent FROM peaks WHERE flag = 'R' GROUP BY sid) SELECT p.peak_id, round(p.intensity / r.reagent, 9) AS share
    FROM peaks p JOIN r USING (sid) WHERE p.flag <> 'R'""",
    "peaks",
)
def _(t: Tables):
    reagent = t.peaks.where("flag = 'R'").groupBy("sid").agg(F.sum("intensity").alias("reagent"))
    return t.peaks.where("flag <> 'R'").join(reagent, "sid").select("peak_id", F.round(F.col("intensity") / F.col("reagent"), 9).alias("share"))


@query(
    "background_subtract_ions",
    """WITH i AS (SELECT s.batch, m.sid, m.ion_id, m.intensity FROM ions m JOIN samples s USING (sid)), b AS (SELECT batch, min(sid) AS sid FROM i GROUP BY batch)
    SELECT i.sid, i.ion_id, round(i.intensity - coalesce(g.intensity, 0e0), 4) AS net, CASE WHEN i.intensity > 0 THEN round(coalesce(g.intensity, 0e0) / i.intensity, 6) END AS fraction FROM i LEFT JOIN (SELECT i.* FROM i JOIN b USING (batch, sid)) g ON g.batch = i.batch AND g.ion_id = i.ion_id""",
    "ions samples",
)
def _(t: Tables):
    i = t.ions.join(t.samples.select("sid", "batch"), "sid").select("batch", "sid", "ion_id", "intensity")
    blank = i.groupBy("batch").agg(F.min("sid").alias("sid"))
    g = i.join(blank, ["batch", "sid"]).select("batch", "ion_id", F.col("intensity").alias("background"))
    return i.join(g, ["batch", "ion_id"], "left").select("sid", "ion_id", F.round(F.col("intensity") - F.coalesce("background", F.lit(0.0)), 4).alias("net"), F.when(F.col("intensity") > 0, F.round(F.coalesce("background", F.lit(0.0)) / F.col("intensity"), 6)).alias("fraction"))


@query(
    "intensity_matrix_filter",
    "SELECT ion_id, count(*) AS n, round(median(intensity), 4) AS med FROM ions WHERE intensity > 0 GROUP BY ion_id HAVING count(*) >= 0.3e0 * (SELECT count(*) FROM samples) AND median(intensity) >= 3e4",
    "ions samples",
)
def _(t: Tables):
    g = t.ions.where("intensity > 0").groupBy("ion_id").agg(F.count("*").alias("n"), F.median("intensity").alias("med"))
    total = t.samples.agg(F.count("*").alias("total"))  # one row
    return g.join(total, (F.col("n") >= 0.3 * F.col("total")) & (F.col("med") >= 3e4)).select("ion_id", "n", F.round("med", 4).alias("med"))


DAILY = "d AS (SELECT sid, ion, strftime(ts, '%Y-%m-%d') AS day, sum(height) AS h FROM scans GROUP BY ALL)"


def daily(t: Tables):
    return t.scans.groupBy("sid", "ion", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("height").alias("h"))


@query(
    "correlation_matrix",
    f"""WITH {DAILY} SELECT x.ion AS a, y.ion AS b, round(corr(x.h, y.h), 6) AS r, count(*) AS n FROM d x JOIN d y ON x.sid = y.sid AND x.day = y.day WHERE x.ion < y.ion GROUP BY ALL HAVING count(*) >= 5""",
    "scans",
)
def _(t: Tables):
    d = daily(t).withColumn("key", F.concat_ws("|", "sid", "day"))
    return signal.correlations(d, item="ion", key="key", value="h", min_periods=5).select("a", "b", F.round("r", 6).alias("r"), "n")


@query(
    "correlate_with_reference",
    f"WITH {DAILY} SELECT x.ion, round(corr(x.h, y.h), 6) AS r FROM d x JOIN d y ON x.sid = y.sid AND x.day = y.day WHERE y.ion = 'view' AND x.ion <> 'view' GROUP BY x.ion HAVING count(*) >= 5",
    "scans",
)
def _(t: Tables):
    d = daily(t)
    ref = d.where("ion = 'view'").select("sid", "day", F.col("h").alias("ref"))
    g = d.where("ion <> 'view'").join(ref, ["sid", "day"]).groupBy("ion").agg(F.corr("h", "ref").alias("r"), F.count("*").alias("n"))
    return g.where("n >= 5").select("ion", F.round("r", 6).alias("r"))


STAGED = "st AS (SELECT sid, ion, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'a' WHEN ts < TIMESTAMP '2024-01-21' THEN 'b' ELSE 'c' END AS stage, sum(height) AS h FROM scans GROUP BY ALL)"


def staged(t: Tables):
    stage = F.expr("CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'a' WHEN ts < TIMESTAMP '2024-01-21' THEN 'b' ELSE 'c' END").alias("stage")
    return t.scans.groupBy("sid", "ion", stage).agg(F.sum("height").alias("h"))


@query(
    "stage_average",
    f"""WITH {STAGED}, g AS (SELECT k.sid, k.ion, s.stage, coalesce(st.h, 0e0) AS h FROM (SELECT DISTINCT sid, ion FROM scans) k CROSS JOIN (VALUES ('a'), ('b'), ('c')) s(stage) LEFT JOIN st ON st.sid = k.sid AND st.ion = k.ion AND st.stage = s.stage)
    SELECT ion, stage, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, count(*) AS n FROM g GROUP BY ion, stage""",
    "scans",
)
def _(t: Tables):
    grid = t.scans.select("sid", "ion").distinct().withColumn("stage", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    rows = grid.join(staged(t), ["sid", "ion", "stage"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
    return rows.groupBy("ion", "stage").agg(F.round(F.avg("h"), 6).alias("mean"), F.round(F.stddev_samp("h"), 6).alias("std"), F.count("*").alias("n"))


@query(
    "stage_log2_fold_change",
    f"""WITH {STAGED}, m AS (SELECT ion, stage, avg(h) AS h FROM st GROUP BY ALL) SELECT m.ion, m.stage, round(log2(m.h / r.h), 6) AS change FROM m JOIN m r ON r.ion = m.ion AND r.stage = 'a' WHERE m.h > 0 AND r.h > 0""",
    "scans",
)
def _(t: Tables):
    m = staged(t).groupBy("ion", "stage").agg(F.avg("h").alias("h")).where("h > 0")
    ref = m.where("stage = 'a'").select("ion", F.col("h").alias("ref"))
    return m.join(ref, "ion").select("ion", "stage", F.round(F.log2(F.col("h") / F.col("ref")), 6).alias("change"))


@query("stage_comparison", f"WITH {STAGED} SELECT ion, stage, round(avg(h), 6) AS height FROM st GROUP BY ALL", "scans")
def _(t: Tables):
    return staged(t).groupBy("ion", "stage").agg(F.round(F.avg("h"), 6).alias("height"))


@query(
    "top_bins",
    "SELECT ion_id, round(med, 4) AS med FROM (SELECT ion_id, median(intensity) AS med FROM ions WHERE intensity > 0 GROUP BY ion_id) ORDER BY round(med, 4) DESC, ion_id LIMIT 200",
    "ions",
)
def _(t: Tables):
    g = t.ions.where("intensity > 0").groupBy("ion_id").agg(F.round(F.median("intensity"), 4).alias("med"))
    return g.orderBy(F.desc("med"), "ion_id").limit(200)


@query("mass_defect", "SELECT peak_id, round(mz - round_even(mz, 0), 6) AS defect, round(log10(greatest(intensity, 1e0)), 6) AS size FROM peaks", "peaks")
def _(t: Tables):
    return t.peaks.select("peak_id", F.round(F.col("mz") - F.bround("mz", 0), 6).alias("defect"), F.round(F.log10(F.greatest("intensity", F.lit(1.0))), 6).alias("size"))


@query(
    "isolation_window_tic",
    "SELECT i.isotope_id, count(*) AS n, round(sum(p.intensity), 2) AS tic FROM peaks p JOIN isotopes i ON p.mz BETWEEN i.mz - 0.25e0 AND i.mz + 0.25e0 WHERE i.k = 0 GROUP BY i.isotope_id",
    "peaks isotopes",
)
def _(t: Tables):
    from peakforge.operators.joins import range_join

    i = t.isotopes.where("k = 0").select("isotope_id", F.col("mz").alias("target_mz"))
    near = range_join(t.peaks.select("mz", "intensity"), i, low=F.col("target_mz") - 0.25, high=F.col("target_mz") + 0.25, width=0.5)
    return near.groupBy("isotope_id").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("tic"))


@query(
    "top_fragments",
    "SELECT sid, peak_id, round(100 * intensity / tic, 6) AS percent FROM (SELECT *, sum(intensity) OVER (PARTITION BY sid) AS tic, row_number() OVER (PARTITION BY sid ORDER BY intensity DESC, peak_id) AS n FROM peaks) WHERE n <= 5",
    "peaks",
)
def _(t: Tables):
    tic = t.peaks.groupBy("sid").agg(F.sum("intensity").alias("tic"))
    n = F.row_number().over(W.partitionBy("sid").orderBy(F.desc("intensity"), "peak_id"))
    top = t.peaks.select("sid", "peak_id", "intensity").withColumn("n", n).where("n <= 5")
    return top.join(tic, "sid").select("sid", "peak_id", F.round(100 * F.col("intensity") / F.col("tic"), 6).alias("percent"))


CURVE = """cu AS (SELECT *, min(fdr) OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM (
    SELECT *, sum(CASE WHEN is_correct THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING) / rn AS fdr FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY confidence DESC, is_correct, doc_id) AS rn FROM labelled)))"""


@query("fdr_curve", f"WITH {CURVE} SELECT doc_id, rn AS rank, round(fdr, 6) AS fdr, round(q, 6) AS q FROM cu", "labelled")
def _(t: Tables):
    return confidence.fdr_curve(t.labelled).select("doc_id", "rank", F.round("fdr", 6).alias("fdr"), F.round("q", 6).alias("q"))


@query("threshold_at_fdr", f"WITH {CURVE} SELECT instrument, round(min(confidence), 6) AS threshold, count(*) AS n_kept FROM cu WHERE q <= 0.2e0 GROUP BY instrument", "labelled")
def _(t: Tables):
    return confidence.threshold_at_fdr(confidence.fdr_curve(t.labelled), 0.2).select("instrument", F.round("threshold", 6).alias("threshold"), "n_kept")


@query(
    "calibration_error",
    """SELECT instrument, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT instrument, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c,
    avg(CASE WHEN is_correct THEN 1e0 ELSE 0e0 END) AS a FROM labelled GROUP BY ALL) GROUP BY instrument""",
    "labelled",
)
def _(t: Tables):
    return confidence.calibration_error(t.labelled).select("instrument", F.round("ece", 6).alias("ece"), "n")


@query(
    "discrimination_auc",
    """SELECT instrument, CASE WHEN pos > 0 AND neg > 0 THEN round((ranks - pos * (pos + 1) / 2) / (pos * neg), 6) END AS auc, pos, neg FROM (SELECT instrument, sum(CASE WHEN is_correct THEN rk END) AS ranks,
    count(*) FILTER (WHERE is_correct) AS pos, count(*) FILTER (WHERE NOT is_correct) AS neg FROM (SELECT *, rank() OVER (PARTITION BY instrument ORDER BY confidence) + (count(*) OVER (PARTITION BY instrument, confidence) - 1) / 2e0 AS rk FROM labelled) GROUP BY instrument)""",
    "labelled",
)
def _(t: Tables):
    return confidence.discrimination_auc(t.labelled).select("instrument", F.round("auc", 6).alias("auc"), "pos", "neg")


#: fixed values of the shipped calibration: slope and offset
SLOPE, OFFSET = 5.738, -3.3625


@query("apply_calibration", f"SELECT doc_id, round(1e0 / (1e0 + exp(-({SLOPE}e0 * confidence + {OFFSET}e0))), 6) AS probability FROM labelled", "labelled")
def _(t: Tables):
    return t.labelled.select("doc_id", F.round(confidence.sigmoid(F.col("confidence"), SLOPE, OFFSET), 6).alias("probability"))


@query(
    "candidate_rank",
    "SELECT peak_id, isotope_id, r FROM (SELECT peak_id, isotope_id, rank() OVER (PARTITION BY peak_id ORDER BY round(score, 9) DESC) AS r, count(*) OVER (PARTITION BY peak_id) AS n FROM matches WHERE found) WHERE n > 1",
    "matches",
)
def _(t: Tables):
    peak = W.partitionBy("peak_id")
    rows = t.matches.where("found").withColumns({"r": F.rank().over(peak.orderBy(F.desc(F.round("score", 9)))), "n": F.count("*").over(peak)})
    return rows.where("n > 1").select("peak_id", "isotope_id", "r")


@query("adduct_corroboration", "SELECT sid, compound_id, count(DISTINCT mechanism) AS n, round(1e0 - pow(2e0, -(count(DISTINCT mechanism) - 1)), 6) AS score FROM gated WHERE score > 0 GROUP BY ALL", "gated")
def _(t: Tables):
    g = t.gated.where("score > 0").groupBy("sid", "compound_id").agg(F.countDistinct("mechanism").alias("n"))
    return g.select("sid", "compound_id", "n", F.round(1 - F.pow(F.lit(2.0), -(F.col("n") - 1)), 6).alias("score"))
