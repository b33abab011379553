"""Queries on spectra and series: sums, clusters, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.operators import joins, signal
from peakforge.plans.registry import query
from peakforge.sources.fixtures import Tables


@query("sum_spectrum", "SELECT sid, round(mz, 6) AS mz, round(sum(intensity), 4) AS intensity FROM peaks GROUP BY sid, mz", "peaks")
def _(t: Tables):
    return signal.sum_spectrum(t.peaks).select("sid", F.round("mz", 6).alias("mz"), F.round("intensity", 4).alias("intensity"))


@query(
    "average_spectrum",
    """WITH n AS (SELECT sid, count(DISTINCT ts) AS n FROM peaks GROUP BY sid) SELECT sid, mz, ((CAST(sum(CAST(round(intensity * 100) AS BIGINT)) AS BIGINT) * 200 + any_value(n)) // (2 * any_value(n))) / 1e4 AS intensity
    FROM peaks JOIN n USING (sid) GROUP BY sid, mz""",
    "peaks",
)
def _(t: Tables):
    # hundredths as whole numbers, divided and rounded once: neither the order of the sums nor a tie can change the result
    cents = t.peaks.withColumn("intensity", F.round(F.col("intensity") * 100).cast("long"))
    mean = F.expr("((total * 200 + n) div (2 * n)) / 1e4")
    return signal.sum_spectrum(cents, scans=True).select("sid", "mz", mean.alias("intensity"))


@query(
    "tic_per_scan",
    """SELECT sid, ts, round(x * stored / sum(x) OVER (PARTITION BY sid), 4) AS tic FROM (
    SELECT p.sid, p.ts, sum(p.intensity) AS x, any_value(s.tic) AS stored FROM peaks p JOIN samples s USING (sid) GROUP BY p.sid, p.ts)""",
    "peaks samples",
)
def _(t: Tables):
    per = t.peaks.groupBy("sid", "ts").agg(F.sum("intensity").alias("x")).join(t.samples.select("sid", F.col("tic").alias("stored")), "sid")
    return per.select("sid", "ts", F.round(F.col("x") * F.col("stored") / F.sum("x").over(W.partitionBy("sid")), 4).alias("tic"))


@query("peak_totals", "SELECT sid, ion, round(sum(height), 4) AS total, round(avg(height), 6) AS average, count(*) AS n FROM scans GROUP BY ALL", "scans")
def _(t: Tables):
    return t.scans.groupBy("sid", "ion").agg(F.round(F.sum("height"), 4).alias("total"), F.round(F.avg("height"), 6).alias("average"), F.count("*").alias("n"))


@query(
    "peak_totals_range",
    "SELECT sid, ion, round(sum(height), 4) AS total FROM scans WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY ALL",
    "scans",
)
def _(t: Tables):
    rows = t.scans.where("ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
    return rows.groupBy("sid", "ion").agg(F.round(F.sum(F.coalesce("height", F.lit(0.0))), 4).alias("total"))


@query("mean_peak_intensity", "SELECT sid, ion, round(avg(height), 6) AS height FROM scans GROUP BY ALL HAVING avg(height) > 5", "scans")
def _(t: Tables):
    return t.scans.groupBy("sid", "ion").agg(F.avg("height").alias("h")).where("h > 5").select("sid", "ion", F.round("h", 6).alias("height"))


@query(
    "normalize_timeseries",
    """SELECT event_id, round(height / sum(height) OVER w * 1000, 6) AS height, round(avg(CASE WHEN height > 5 THEN 0e0 ELSE 1e0 END) OVER w, 6) AS sparsity
    FROM scans WINDOW w AS (PARTITION BY sid, ion)""",
    "scans",
)
def _(t: Tables):
    w = W.partitionBy("sid", "ion")
    sparse = F.avg(F.when(F.col("height") > 5, 0.0).otherwise(1.0)).over(w)
    return t.scans.select("event_id", F.round(F.col("height") / F.sum("height").over(w) * 1000, 6).alias("height"), F.round(sparse, 6).alias("sparsity"))


@query("backfill_sparsity", "SELECT sid, round(count(*) FILTER (WHERE height <= 5) / count(*), 6) AS sparsity FROM scans GROUP BY sid", "scans")
def _(t: Tables):
    return t.scans.groupBy("sid").agg(F.round(F.count_if(F.col("height") <= 5) / F.count("*"), 6).alias("sparsity"))


BINS = """b AS (SELECT *, sum(fresh) OVER (PARTITION BY sid ORDER BY mz, peak_id ROWS UNBOUNDED PRECEDING) AS bin FROM (
    SELECT *, CASE WHEN (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 > 2e1 THEN 1 ELSE 0 END AS fresh FROM peaks WINDOW w AS (PARTITION BY sid ORDER BY mz, peak_id)))"""


@query("gap_bin", f"WITH {BINS} SELECT peak_id, CAST(bin AS BIGINT) AS bin FROM b", "peaks")
def _(t: Tables):
    return signal.gap_bin(t.peaks, ppm=20.0).select("peak_id", "bin")


@query(
    "average_centroids",
    f"""WITH {BINS}, n AS (SELECT sid, count(DISTINCT ts) AS scans FROM peaks GROUP BY sid) SELECT b.sid, CAST(bin AS BIGINT) AS bin, round(sum(mz * intensity) / sum(intensity), 8) AS mz, round(sum(intensity), 4) AS intensity,
    round(sum(intensity) / any_value(scans), 8) AS per_scan, round(sum(snr * intensity) / sum(intensity), 6) AS snr, round(sum(1e3 * snr * intensity) / sum(intensity), 3) AS resolution, count(*) AS n_peaks
    FROM b JOIN n USING (sid) GROUP BY b.sid, bin""",
    "peaks",
)
def _(t: Tables):
    c = signal.bin_centroids(signal.gap_bin(t.peaks.withColumn("resolution", 1000.0 * F.col("snr")), ppm=20.0), also=("resolution",))
    n = t.peaks.groupBy("sid").agg(F.countDistinct("ts").alias("scans"))
    per = F.round(F.col("intensity") / F.col("scans"), 8).alias("per_scan")
    return c.join(n, "sid").select("sid", "bin", F.round("mz", 8).alias("mz"), F.round("intensity", 4).alias("intensity"), per, F.round("snr", 6).alias("snr"), F.round("resolution", 3).alias("resolution"), "n_peaks")


@query("window_cluster")
def _(t: Tables):
    return signal.window_cluster(t.peaks, ppm=10.0).select("sid", "peak_id", F.round("cluster", 6).alias("cluster"))


@query("sum_spectrum_clusters")
def _(t: Tables):
    """Clusters with weighted m/z, intensity in all and per scan, weighted S/N and their members; a loop checks it on a small fixture."""
    c = signal.window_cluster(t.peaks, ppm=10.0, also=("snr",)).groupBy("sid", "cluster")
    weighted = lambda x: F.round(F.sum(F.col(x) * F.col("intensity")) / F.sum("intensity"), 6).alias(x)
    rows = c.agg(weighted("mz"), weighted("snr"), F.sum("intensity").alias("i"), F.array_join(F.array_sort(F.collect_list("peak_id")), ",").alias("peaks"))
    scans = t.peaks.groupBy("sid").agg(F.countDistinct("ts").alias("scans"))
    rows = rows.join(scans, "sid")
    return rows.select("sid", F.round("cluster", 6).alias("cluster"), "mz", "snr", F.round("i", 4).alias("intensity"), F.round(F.col("i") / F.col("scans"), 6).alias("per_scan"), "peaks")


@query(
    "dominated_peaks",
    """SELECT peak_id FROM peaks p WHERE EXISTS (SELECT 1 FROM peaks s WHERE s.sid = p.sid AND s.polarity = p.polarity AND abs(s.mz - p.mz) <= p.mz * (1e2 * 1e-6) AND s.intensity >= 1e1 * p.intensity)""",
    "peaks",
)
def _(t: Tables):
    return signal.dominated(t.peaks).select("peak_id")


@query(
    "dedup_close_peaks",
    f"WITH {BINS} SELECT peak_id FROM (SELECT peak_id, row_number() OVER (PARTITION BY sid, bin ORDER BY intensity DESC, ts DESC, peak_id) AS n FROM b) WHERE n = 1",
    "peaks",
)
def _(t: Tables):
    n = F.row_number().over(W.partitionBy("sid", "bin").orderBy(F.desc("intensity"), F.desc("ts"), "peak_id"))
    return signal.gap_bin(t.peaks, ppm=20.0).withColumn("n", n).where("n = 1").select("peak_id")


@query(
    "overlap_resolution_filter",
    """SELECT peak_id FROM (SELECT peak_id, mz - lag(mz) OVER w AS below, lead(mz) OVER w - mz AS above, mz * 1e-4 AS fwhm FROM peaks WINDOW w AS (PARTITION BY sid ORDER BY mz, peak_id))
    WHERE coalesce(below, 1e9) > fwhm AND coalesce(above, 1e9) > fwhm""",
    "peaks",
)
def _(t: Tables):
    w = W.partitionBy("sid").orderBy("mz", "peak_id")
    rows = t.peaks.select("peak_id", (F.col("mz") - F.lag("mz").over(w)).alias("below"), (F.lead("mz").over(w) - F.col("mz")).alias("above"), (F.col("mz") * 1e-4).alias("fwhm"))
    far = F.lit(1e9)
    return rows.where((F.coalesce("below", far) > F.col("fwhm")) & (F.coalesce("above", far) > F.col("fwhm"))).select("peak_id")


@query(
    "lock_mass_calibrate",
    """WITH f AS (SELECT sid, 2.3e2 / arg_max(mz, {'i': intensity, 'p': peak_id}) AS factor FROM peaks WHERE abs(mz - 2.3e2) <= 5 GROUP BY sid)
    SELECT peak_id, round(mz * coalesce(factor, 1e0), 8) AS mz, factor IS NOT NULL AS locked FROM peaks LEFT JOIN f USING (sid)""",
    "peaks",
)
def _(t: Tables):
    f = t.peaks.where("abs(mz - 2.3e2) <= 5").groupBy("sid").agg((230.0 / F.max_by("mz", F.struct("intensity", "peak_id"))).alias("factor"))
    # peaks of a sample without a lock peak stay as they are and say so
    return t.peaks.join(f, "sid", "left").select("peak_id", F.round(F.col("mz") * F.coalesce("factor", F.lit(1.0)), 8).alias("mz"), F.col("factor").isNotNull().alias("locked"))


@query(
    "resolution_fit_orbi",
    """SELECT sid, round(sum(snr * 1e3 / sqrt(mz)) / sum(1e0 / mz), 4) AS a, count(*) AS n FROM peaks WHERE sid % 2 = 0 GROUP BY sid""",
    "peaks",
)
def _(t: Tables):
    x = 1 / F.sqrt("mz")
    return t.peaks.where("sid % 2 = 0").groupBy("sid").agg(F.round(F.sum(F.col("snr") * 1000 * x) / F.sum(1 / F.col("mz")), 4).alias("a"), F.count("*").alias("n"))


@query(
    "tof_snr",
    """WITH w AS (SELECT p.*, mz / CASE WHEN s.instrument = 'orbi' THEN 1e5 / sqrt(mz) ELSE mz / (1e-4 * mz + 1e-3) END AS width FROM peaks p JOIN samples s USING (sid)),
    a AS (SELECT p.sid, p.peak_id, any_value(p.intensity) AS h, stddev_pop(b.intensity) AS s FROM w p LEFT JOIN peaks b ON b.sid = p.sid AND ((b.mz > p.mz + 2 * p.width AND b.mz <= p.mz + 2e1 * p.width)
    OR (b.mz < p.mz - 2 * p.width AND b.mz >= p.mz - 2e1 * p.width)) GROUP BY p.sid, p.peak_id) SELECT peak_id, CASE WHEN s > 1e-3 THEN round(h / s, 4) END AS snr FROM a""",
    "peaks samples",
)
def _(t: Tables):
    """Signal over the spread of what lies between 2 and 20 widths beside a peak in its own sample, widths by the resolution of its instrument there."""
    rows = t.peaks.join(t.samples.select("sid", "instrument"), "sid").select("sid", "peak_id", "mz", "intensity", "instrument")
    m = F.col("mz")
    noise = signal.ring_noise(rows, m / F.when(F.col("instrument") == "orbi", 1e5 / F.sqrt(m)).otherwise(m / (1e-4 * m + 1e-3)))
    return rows.join(noise, ["sid", "peak_id"]).select("peak_id", F.when(F.col("noise") > 1e-3, F.round(F.col("intensity") / F.col("noise"), 4)).alias("snr"))


@query(
    "asof_nearest",
    """WITH q AS (SELECT sid, file_id, created + INTERVAL 26 YEAR AS asked FROM files),
    u AS (SELECT sid, ts, max(height) AS height FROM scans GROUP BY sid, ts),
    c AS (SELECT q.sid, q.asked, u.ts, u.height, row_number() OVER (PARTITION BY q.sid, q.file_id ORDER BY abs(epoch_us(u.ts) - epoch_us(q.asked)), u.ts) AS n FROM q JOIN u ON u.sid = q.sid)
    SELECT sid, asked, ts AS scan_time, height FROM c WHERE n = 1""",
    "files scans",
)
def _(t: Tables):
    q = t.files.selectExpr("sid", "CAST(created + INTERVAL 26 YEARS AS TIMESTAMP) AS asked")
    scans = t.scans.groupBy("sid", F.col("ts").alias("asked")).agg(F.max("height").alias("height"))
    return joins.asof_nearest(q, scans, key="sid", time="asked", value="height").where("scan_time IS NOT NULL")


@query(
    "tic_align",
    """WITH t AS (SELECT sid, ts, sum(height) AS tic FROM scans WHERE ion = 'view' GROUP BY sid, ts), q AS (SELECT event_id, sid, ts, height FROM scans WHERE ion = 'click'),
    c AS (SELECT q.event_id, q.height, t.tic, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(epoch_us(t.ts) - epoch_us(q.ts)), t.ts) AS n, abs(epoch_us(t.ts) - epoch_us(q.ts)) AS d FROM q JOIN t USING (sid))
    SELECT event_id, round(height / tic, 6) AS share FROM c WHERE n = 1 AND d <= 36000000000 AND tic > 0""",
    "scans",
)
def _(t: Tables):
    tic = t.scans.where("ion = 'view'").groupBy("sid", "ts").agg(F.sum("height").alias("tic"))
    q = t.scans.where("ion = 'click'").select("event_id", "sid", "ts", "height")
    near = joins.asof_nearest(q.select("sid", "ts").distinct(), tic, key="sid", time="ts", value="tic")
    ok = near.where((F.abs(F.unix_micros("scan_time") - F.unix_micros("ts")) <= 36_000_000_000) & (F.col("tic") > 0))
    return q.join(ok, ["sid", "ts"]).select("event_id", F.round(F.col("height") / F.col("tic"), 6).alias("share"))


@query(
    "rolling_mean_centered",
    "SELECT event_id, round(avg(height) OVER (PARTITION BY sid, ion ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smooth FROM scans",
    "scans",
)
def _(t: Tables):
    return signal.rolling_mean(t.scans, "height", keys=("sid", "ion"), order=("ts", "event_id")).select("event_id", F.round("smooth", 6).alias("smooth"))


@query(
    "smooth_signal",
    """SELECT event_id, round((3 * height + coalesce(2 * lag(height) OVER w, 0) + coalesce(2 * lead(height) OVER w, 0) + coalesce(lag(height, 2) OVER w, 0) + coalesce(lead(height, 2) OVER w, 0))
    / (3 + CASE WHEN lag(height) OVER w IS NULL THEN 0 ELSE 2 END + CASE WHEN lead(height) OVER w IS NULL THEN 0 ELSE 2 END + CASE WHEN lag(height, 2) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(height, 2) OVER w IS NULL THEN 0 ELSE 1 END), 6) AS smooth
    FROM scans WHERE height IS NOT NULL WINDOW w AS (PARTITION BY sid, ion ORDER BY ts, event_id)""",
    "scans",
)
def _(t: Tables):
    rows = signal.smooth(t.scans.where("height IS NOT NULL"), "height", signal.kernel("triangle", 5), keys=("sid", "ion"), order=("ts", "event_id"))
    return rows.select("event_id", F.round("smooth", 6).alias("smooth"))


@query(
    "interpolate_gaps",
    """WITH x AS (SELECT event_id, sid, epoch_us(ts) / 1e6 AS t, ts, CASE WHEN event_id % 4 <> 1 THEN height END AS h FROM scans),
    y AS (SELECT *, last_value(CASE WHEN h IS NOT NULL THEN {'t': t, 'v': h} END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b,
    first_value(CASE WHEN h IS NOT NULL THEN {'t': t, 'v': h} END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM x)
    SELECT event_id, round(coalesce(h, b.v + (a.v - b.v) * CASE WHEN a.t > b.t THEN (t - b.t) / (a.t - b.t) ELSE 0e0 END, b.v, a.v), 4) AS filled FROM y""",
    "scans",
)
def _(t: Tables):
    x = t.scans.select("event_id", "sid", "ts", F.when(F.col("event_id") % 4 != 1, F.col("height")).alias("h"))
    return signal.interpolate_gaps(x, "h", keys=("sid",), time="ts", tie="event_id").select("event_id", F.round("filled", 4).alias("filled"))


@query("cumulative_presence", "SELECT ion, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT ion, count(*) FILTER (WHERE height > 5) AS n FROM scans GROUP BY ion)", "scans")
def _(t: Tables):
    n = t.scans.groupBy("ion").agg(F.count_if(F.col("height") > 5).alias("n"))
    return n.select("ion", "n", F.rank().over(W.orderBy(F.desc("n"))).alias("r"))  # one row for each ion


@query("datetime_of_scan", "SELECT event_id, ts + INTERVAL 1 SECOND * CAST(floor(height) AS INT) AS at FROM scans", "scans")
def _(t: Tables):
    return t.scans.select("event_id", F.timestamp_micros(F.unix_micros("ts") + F.floor("height").cast("long") * 1_000_000).alias("at"))


@query("scan_times", "SELECT DISTINCT sid, ts FROM scans WHERE ts < TIMESTAMP '2024-01-10'", "scans")
def _(t: Tables):
    return t.scans.where("ts < TIMESTAMP '2024-01-10'").select("sid", "ts").distinct()


@query("polarity_options", "SELECT sid, string_agg(DISTINCT polarity, '' ORDER BY polarity) AS polarities FROM peaks GROUP BY sid", "peaks")
def _(t: Tables):
    return t.peaks.groupBy("sid").agg(F.array_join(F.array_sort(F.collect_set("polarity")), "").alias("polarities"))


@query(
    "cluster_timeseries",
    "SELECT sid, ion, d.day, round(coalesce(h, 0e0), 4) AS height FROM (SELECT DISTINCT sid, ion FROM scans) k CROSS JOIN (SELECT strftime(unnest(range(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM scans) d LEFT JOIN (SELECT sid, ion, strftime(ts, '%Y-%m-%d') AS day, sum(height) AS h FROM scans GROUP BY ALL) x USING (sid, ion, day)",
    "scans",
)
def _(t: Tables):
    rows = t.scans.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("sid", "ion", "day").agg(F.sum("height").alias("h"))
    bounds = t.scans.agg(F.min(F.to_date("ts")).alias("low"), F.max(F.to_date("ts")).alias("high"))  # one row
    # every (sample, ion) with every day of the recording: each key makes its own days
    grid = t.scans.select("sid", "ion").distinct().crossJoin(F.broadcast(bounds))
    grid = grid.select("sid", "ion", F.explode(F.sequence("low", "high")).alias("day")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return grid.join(rows, ["sid", "ion", "day"], "left").select("sid", "ion", "day", F.round(F.coalesce("h", F.lit(0.0)), 4).alias("height"))
