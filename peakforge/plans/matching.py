"""Queries on matching: predicates, range joins, statistics, scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.operators import joins, matching, rollup
from peakforge.plans.registry import query
from peakforge.sources.fixtures import Tables


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


@query("scan_peaks", "SELECT sid, peak_id, round(mz, 6) AS mz, intensity FROM peaks WHERE polarity = '+' AND mz BETWEEN 2e2 AND 4e2", "peaks")
def _(t: Tables):
    return t.peaks.where("polarity = '+' AND mz BETWEEN 2e2 AND 4e2").select("sid", "peak_id", r("mz"), "intensity")


@query("filter_centroids", "SELECT peak_id, intensity, snr FROM peaks WHERE intensity >= 4e4 AND snr >= 3", "peaks")
def _(t: Tables):
    return t.peaks.where("intensity >= 4e4 AND snr >= 3").select("peak_id", "intensity", "snr")


@query("flag_weak_peaks", "SELECT peak_id, snr < 3 AS is_weak FROM peaks", "peaks")
def _(t: Tables):
    return t.peaks.select("peak_id", (F.col("snr") < 3).alias("is_weak"))


@query(
    "filter_peaks",
    "SELECT sid, round(mz, 6) AS mz, sum(intensity) AS intensity FROM peaks WHERE mz BETWEEN 1e2 AND 6e2 AND ts >= TIMESTAMP '1995-01-01' GROUP BY sid, mz HAVING sum(intensity) > 3e4",
    "peaks",
)
def _(t: Tables):
    rows = t.peaks.where("mz BETWEEN 1e2 AND 6e2 AND ts >= TIMESTAMP '1995-01-01'")
    return rows.groupBy("sid", "mz").agg(F.sum("intensity").alias("intensity")).where("intensity > 3e4").select("sid", r("mz"), "intensity")


@query(
    "filter_near_nominal",
    "SELECT sid, peak_id FROM peaks WHERE EXISTS (SELECT 1 FROM (VALUES (1.2e2), (2.5e2), (5.01e2)) v(m) WHERE abs(mz - m) <= 0.5e0)",
    "peaks",
)
def _(t: Tables):
    near = F.exists(F.array(*(F.lit(x) for x in (120.0, 250.0, 501.0))), lambda m: F.abs(F.col("mz") - m) <= 0.5)
    return t.peaks.where(near).select("sid", "peak_id")


@query("candidate_range_join", "SELECT sid, isotope_id, peak_id, round(diff, 6) AS diff FROM cand", "cand")
def _(t: Tables):
    c = joins.candidates(t.peaks.select("sid", "peak_id", "mz", "intensity", "snr"), t.isotopes)
    return c.select("sid", "isotope_id", "peak_id", F.round(F.abs(F.col("mz") - F.col("target_mz")), 6).alias("diff"))


@query("nearest_peak", "SELECT sid, isotope_id, peak_id, round(mz, 6) AS mz FROM nearest", "nearest")
def _(t: Tables):
    return t.nearest.select("sid", "isotope_id", "peak_id", r("mz"))


@query("within_window_semi", "SELECT peak_id FROM peaks p WHERE EXISTS (SELECT 1 FROM isotopes i WHERE i.mz BETWEEN p.mz - 1e-2 AND p.mz + 1e-2)", "peaks isotopes")
def _(t: Tables):
    i = t.isotopes.select(F.col("mz").alias("target_mz"))
    hit = joins.range_join(t.peaks.select("peak_id", "mz"), i, low=F.col("target_mz") - 0.01, high=F.col("target_mz") + 0.01, width=0.02, how="left_semi")
    return hit.select("peak_id")


@query(
    "refine_window_semi",
    "SELECT peak_id FROM peaks p WHERE EXISTS (SELECT 1 FROM isotopes i WHERE i.collection_type = 'CALIBRANTS' AND p.mz BETWEEN i.mz - i.mz * 5e-6 AND i.mz + i.mz * 5e-6)",
    "peaks isotopes",
)
def _(t: Tables):
    i = t.isotopes.where("collection_type = 'CALIBRANTS'").select(F.col("mz").alias("target_mz"))
    low, high = F.col("target_mz") - F.col("target_mz") * 5e-6, F.col("target_mz") + F.col("target_mz") * 5e-6
    return joins.range_join(t.peaks.select("peak_id", "mz"), i, low=low, high=high, ppm=5.0, how="left_semi").select("peak_id")


@query(
    "max_intensity_in_window",
    """SELECT sid, isotope_id, peak_id, intensity FROM (
    SELECT p.sid, i.isotope_id, p.peak_id, p.intensity, row_number() OVER (PARTITION BY p.sid, i.isotope_id ORDER BY p.intensity DESC, p.peak_id DESC) AS rn
    FROM peaks p JOIN isotopes i ON p.mz BETWEEN i.mz - i.mz * 1e-5 AND i.mz + i.mz * 1e-5 WHERE i.collection_type = 'CALIBRANTS') WHERE rn = 1""",
    "peaks isotopes",
)
def _(t: Tables):
    i = t.isotopes.where("collection_type = 'CALIBRANTS'").select("isotope_id", F.col("mz").alias("target_mz"))
    low, high = F.col("target_mz") - F.col("target_mz") * 1e-5, F.col("target_mz") + F.col("target_mz") * 1e-5
    best = joins.window_best(t.peaks, i.withColumns({"low": low, "high": high}), target="isotope_id", keys=("sid",), values=("intensity", "peak_id"), ppm=10.0)
    return best.select("sid", "isotope_id", "peak_id", "intensity")


@query(
    "xic",
    """SELECT p.sid, i.isotope_id, strftime(p.ts, '%Y-%m-%d') AS day, round(sum(p.intensity), 4) AS intensity
    FROM peaks p JOIN isotopes i ON p.mz BETWEEN i.mz - i.mz * 5e-6 AND i.mz + i.mz * 5e-6 WHERE i.k = 0 GROUP BY ALL""",
    "peaks isotopes",
)
def _(t: Tables):
    i = t.isotopes.where("k = 0").select("isotope_id", F.col("mz").alias("target_mz"))
    low, high = F.col("target_mz") - F.col("target_mz") * 5e-6, F.col("target_mz") + F.col("target_mz") * 5e-6
    p = t.peaks.select("sid", F.date_format("ts", "yyyy-MM-dd").alias("day"), "mz", "intensity")
    x = joins.window_sums(p, i.withColumns({"low": low, "high": high}), target="isotope_id", keys=("sid", "day"), value="intensity", ppm=5.0)
    return x.select("sid", "isotope_id", "day", F.round("intensity", 4).alias("intensity"))


@query("match_assign")
def _(t: Tables):
    return matching.match_assign(t.peaks, t.isotopes).select("sid", "ion_id", "isotope_id", "peak_id", r("mz"))


@query(
    "match_stats",
    """SELECT sid, isotope_id, ion_id, found, round(intensity_relative, 6) AS intensity_relative, round(abundance_error, 6) AS abundance_error,
    round(mz_error, 6) AS mz_error, round(score, 6) AS score FROM matches""",
    "matches",
)
def _(t: Tables):
    return t.matches.select("sid", "isotope_id", "ion_id", "found", r("intensity_relative"), r("abundance_error"), r("mz_error"), r("score"))


@query("apply_match_params", "SELECT sid, isotope_id, instrument, round(score, 6) AS score, intensity, category FROM gated", "gated")
def _(t: Tables):
    return t.gated.select("sid", "isotope_id", "instrument", r("score"), "intensity", "category")


@query("reconstruct_unmatched", "SELECT sid, isotope_id, round(peak_mz, 6) AS peak_mz, intensity, abundance_error FROM matches WHERE NOT found", "matches")
def _(t: Tables):
    return t.matches.where("NOT found").select("sid", "isotope_id", r("peak_mz"), "intensity", "abundance_error")


@query(
    "select_to_persist",
    """SELECT sid, isotope_id, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY sid, ion_id) AS best,
    row_number() OVER (PARTITION BY sid, ion_id ORDER BY relative_abundance DESC, target_mz, isotope_id) AS rn FROM gated) WHERE score > 0 OR (best <= 0 AND rn = 1)""",
    "gated",
)
def _(t: Tables):
    return matching.select_to_persist(t.gated).select("sid", "isotope_id", r("score"))


@query("remove_unmatched", "SELECT sid, isotope_id, round(score, 6) AS score FROM gated WHERE score > 0", "gated")
def _(t: Tables):
    return t.gated.where("score > 0").select("sid", "isotope_id", r("score"))


@query(
    "tier_for_score",
    """SELECT sid, isotope_id, CASE WHEN score >= 0.8e0 THEN 'identified' WHEN score >= 0.5e0 THEN 'candidate' ELSE 'below_assignability' END AS tier FROM matches""",
    "matches",
)
def _(t: Tables):
    return t.matches.select("sid", "isotope_id", matching.tier(F.col("score")).alias("tier"))


@query(
    "main_isotope",
    "SELECT ion_id, isotope_id FROM (SELECT *, row_number() OVER (PARTITION BY ion_id ORDER BY relative_abundance DESC, mz, isotope_id) AS rn FROM isotopes) WHERE rn = 1",
    "isotopes",
)
def _(t: Tables):
    w = W.partitionBy("ion_id").orderBy(F.desc("relative_abundance"), "mz", "isotope_id")
    return t.isotopes.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("ion_id", "isotope_id")


@query(
    "isotope_label",
    """SELECT isotope_id, CASE WHEN n = 0 THEN 'M0' WHEN n > 0 THEN 'M+' || n ELSE 'M' || n END AS label FROM (
    SELECT isotope_id, CAST(round(mz - first_value(mz) OVER (PARTITION BY ion_id ORDER BY relative_abundance DESC, mz, isotope_id)) AS BIGINT) AS n FROM isotopes)""",
    "isotopes",
)
def _(t: Tables):
    w = W.partitionBy("ion_id").orderBy(F.desc("relative_abundance"), "mz", "isotope_id")
    n = F.round(F.col("mz") - F.first("mz").over(w)).cast("long")
    label = F.when(F.col("n") == 0, "M0").when(F.col("n") > 0, F.concat(F.lit("M+"), F.col("n"))).otherwise(F.concat(F.lit("M"), F.col("n")))
    return t.isotopes.withColumn("n", n).select("isotope_id", label.alias("label"))


@query("isotope_abundance_filter", "SELECT isotope_id FROM isotopes WHERE relative_abundance >= CASE WHEN mechanism = 0 THEN 1e-2 ELSE 1e-1 END", "isotopes")
def _(t: Tables):
    limit = F.when(F.col("mechanism") == 0, 1e-2).otherwise(1e-1)
    return t.isotopes.where(F.col("relative_abundance") >= limit).select("isotope_id")


@query(
    "subthreshold_audit",
    """SELECT instrument, count(*) FILTER (WHERE relative_abundance < 1e-2) AS n_below, count(*) FILTER (WHERE relative_abundance < 1e-2 AND score > 0) AS n_matched,
    count(*) AS n_rows FROM gated GROUP BY instrument""",
    "gated",
)
def _(t: Tables):
    low = F.col("relative_abundance") < 1e-2
    return t.gated.groupBy("instrument").agg(F.count_if(low).alias("n_below"), F.count_if(low & (F.col("score") > 0)).alias("n_matched"), F.count("*").alias("n_rows"))


@query("match_ions", "SELECT sid, ion_id, compound_id, collection_id, round(score, 6) AS score, round(intensity, 4) AS intensity, category FROM ions", "ions")
def _(t: Tables):
    return t.ions.select("sid", "ion_id", "compound_id", "collection_id", r("score"), r("intensity", 4), "category")


@query("match_ions_light", "SELECT sid, ion_id, round(sum(score * relative_abundance), 6) AS score, round(sum(intensity), 4) AS intensity FROM gated GROUP BY ALL", "gated")
def _(t: Tables):
    agg = t.gated.groupBy("sid", "ion_id").agg(F.sum(F.col("score") * F.col("relative_abundance")).alias("score"), F.sum("intensity").alias("intensity"))
    return agg.select("sid", "ion_id", r("score"), r("intensity", 4))


BEST = "(max({'category': category, 'score': score}))"
COMPOUNDS = f"""compounds AS (SELECT sid, compound_id, collection_id, collection_type, {BEST}.category AS category, {BEST}.score AS score,
    sum(intensity) AS intensity FROM ions GROUP BY sid, compound_id, collection_id, collection_type)"""


@query("match_compounds", f"WITH {COMPOUNDS} SELECT sid, compound_id, collection_id, category, round(score, 6) AS score, round(intensity, 4) AS intensity FROM compounds", "ions")
def _(t: Tables):
    return rollup.match_compounds(t.ions).select("sid", "compound_id", "collection_id", "category", r("score"), r("intensity", 4))


@query("match_compounds_light", "SELECT sid, compound_id, round(max(score), 6) AS score, round(sum(intensity), 4) AS intensity FROM ions GROUP BY ALL", "ions")
def _(t: Tables):
    return t.ions.groupBy("sid", "compound_id").agg(F.round(F.max("score"), 6).alias("score"), F.round(F.sum("intensity"), 4).alias("intensity"))


@query(
    "match_collections",
    f"""WITH {COMPOUNDS} SELECT sid, collection_id, collection_type, {BEST}.category AS category, round({BEST}.score, 6) AS score, round(sum(intensity), 4) AS intensity
    FROM compounds GROUP BY sid, collection_id, collection_type""",
    "ions",
)
def _(t: Tables):
    c = rollup.match_collections(rollup.match_compounds(t.ions))
    return c.select("sid", "collection_id", "collection_type", "category", r("score"), r("intensity", 4))


SAMPLES = f"""{COMPOUNDS}, once AS (SELECT *, collection_type = 'TARGETS' AS alarming, row_number() OVER (PARTITION BY sid, compound_id
    ORDER BY collection_type = 'TARGETS' DESC, category DESC, score DESC, collection_id) AS rn FROM compounds),
    per_sample AS (SELECT sid, max({{'alarming': alarming, 'category': category, 'score': score}}) AS b, sum(intensity) AS intensity, count(*) AS n_compounds
    FROM once WHERE rn = 1 GROUP BY sid)"""


@query(
    "match_samples",
    f"WITH {SAMPLES} SELECT sid, b.alarming AS alarming, b.category AS category, round(b.score, 6) AS score, round(intensity, 4) AS intensity, n_compounds FROM per_sample",
    "ions",
)
def _(t: Tables):
    return rollup.match_samples(rollup.match_compounds(t.ions)).select("sid", "alarming", "category", r("score"), r("intensity", 4), "n_compounds")


@query(
    "compile_samples",
    f"""WITH {SAMPLES} SELECT s.sid, s.sample_name, p.sid IS NOT NULL AS matched, coalesce(p.b.category, 0) AS category, coalesce(round(p.b.score, 6), 0e0) AS score
    FROM samples s LEFT JOIN per_sample p USING (sid)""",
    "ions samples",
)
def _(t: Tables):
    m = rollup.match_samples(rollup.match_compounds(t.ions)).withColumn("matched", F.lit(True))
    rows = t.samples.join(m, "sid", "left")
    return rows.select(
        "sid", "sample_name", F.coalesce("matched", F.lit(False)).alias("matched"), F.coalesce("category", F.lit(0)).alias("category"), F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score")
    )


@query(
    "dedup_by_collection_priority",
    f"""WITH {COMPOUNDS} SELECT sid, compound_id, collection_id FROM (SELECT *, row_number() OVER (PARTITION BY sid, compound_id
    ORDER BY CASE collection_type WHEN 'TARGETS' THEN 0 WHEN 'DIAGNOSTICS' THEN 1 ELSE 2 END, collection_id) AS rn FROM compounds) WHERE rn = 1""",
    "ions",
)
def _(t: Tables):
    return rollup.dedup_by_collection_priority(rollup.match_compounds(t.ions)).select("sid", "compound_id", "collection_id")


@query("ion_match_category", "SELECT sid, ion_id, CASE WHEN score >= 0.8e0 THEN 2 WHEN score >= 0.5e0 THEN 1 ELSE 0 END AS category FROM ions", "ions")
def _(t: Tables):
    return t.ions.select("sid", "ion_id", matching.category(F.col("score"), 2).alias("category"))


@query(
    "sdk_peak_scores",
    """SELECT sid, ion_id, compound_id, round(score, 6) AS ion_score, round(max(score) OVER (PARTITION BY sid, compound_id), 6) AS compound_score FROM ions""",
    "ions",
)
def _(t: Tables):
    best = F.max("score").over(W.partitionBy("sid", "compound_id"))
    return t.ions.select("sid", "ion_id", "compound_id", F.round("score", 6).alias("ion_score"), F.round(best, 6).alias("compound_score"))


@query(
    "ion_series",
    """SELECT ion_id, string_agg(CAST(sid AS VARCHAR), ',' ORDER BY sid) AS sids, string_agg(CAST(category AS VARCHAR), ',' ORDER BY sid) AS categories FROM ions GROUP BY ion_id""",
    "ions",
)
def _(t: Tables):
    rows = t.ions.groupBy("ion_id").agg(F.array_sort(F.collect_list(F.struct("sid", "category"))).alias("s"))
    join = lambda f: F.array_join(F.transform("s", lambda x: x[f].cast("string")), ",")
    return rows.select("ion_id", join("sid").alias("sids"), join("category").alias("categories"))


ACCURACY = """anchors AS (SELECT sid, mz_error FROM matches WHERE intensity > 0), mus AS (SELECT sid, median(mz_error) AS mu, count(*) AS anchors FROM anchors GROUP BY sid),
    acc AS (SELECT sid, CASE WHEN anchors >= 8 THEN mu ELSE 0e0 END AS mu, CASE WHEN anchors >= 8 THEN greatest(1.4826e0 * mad, 0.05e0) END AS sigma, anchors FROM (
    SELECT sid, any_value(mu) AS mu, any_value(anchors) AS anchors, median(abs(mz_error - mu)) AS mad FROM anchors JOIN mus USING (sid) GROUP BY sid))"""


@query("mass_accuracy", f"WITH {ACCURACY} SELECT sid, round(mu, 6) AS mu, round(sigma, 6) AS sigma, anchors FROM acc", "matches")
def _(t: Tables):
    return matching.mass_accuracy(t.near_of("true")).select("sid", r("mu"), r("sigma"), "anchors")


@query("noise_floor", "SELECT sid, round(quantile_cont(intensity, 0.02e0), 6) AS floor FROM matches WHERE intensity > 0 GROUP BY sid", "matches")
def _(t: Tables):
    return t.near_of("true").where("intensity > 0").groupBy("sid").agg(F.round(F.percentile("intensity", F.lit(0.02)), 6).alias("floor"))


FIT = """fit AS (SELECT sid, ion_id, coalesce(exp(sum(w * ln(l)) / sum(w)), 0e0) AS fit_score FROM (
    SELECT *, CASE WHEN l IS NOT NULL AND pr > 0 THEN pr END AS w FROM (
    SELECT *, CASE WHEN base_int > 0 THEN greatest(likely, 1e-6) END AS l FROM (
    SELECT *, CASE WHEN rn = 1 THEN mass WHEN intensity > 0 THEN mass * exp(-0.5e0 * pow((rel - pr) / greatest(rel * sqrt(inv * inv + binv * binv), 0.05e0 * pr, 1e-3), 2))
        WHEN CASE WHEN base_snr > 0 THEN pr * base_snr >= 3e0 ELSE pr >= 0.1e0 END THEN 0.3e0 END AS likely FROM (
    SELECT *, relative_abundance / base_rel AS pr, CASE WHEN base_snr > 0 THEN 1e0 / base_snr ELSE 0e0 END AS binv, CASE WHEN base_int > 0 THEN intensity / base_int END AS rel,
        exp(-0.5e0 * pow(mz_error / sqrt(4e0 + pow(2.36e0 * inv, 2)), 2)) AS mass FROM (
    SELECT *, CASE WHEN snr > 0 THEN 1e0 / snr ELSE 0e0 END AS inv, row_number() OVER w AS rn, first_value(intensity) OVER w AS base_int,
        first_value(snr) OVER w AS base_snr, first_value(relative_abundance) OVER w AS base_rel
    FROM matches WINDOW w AS (PARTITION BY sid, ion_id ORDER BY relative_abundance DESC, target_mz, isotope_id)))))) GROUP BY sid, ion_id)"""


FIT_ROWS = FIT.replace("fit AS (SELECT sid, ion_id, coalesce(exp(sum(w * ln(l)) / sum(w)), 0e0) AS fit_score FROM", "fit AS (SELECT *, coalesce(exp(sum(w * ln(l)) OVER ion / sum(w) OVER ion), 0e0) AS fit_score FROM")
FIT_ROWS = FIT_ROWS.removesuffix(" GROUP BY sid, ion_id)") + " WINDOW ion AS (PARTITION BY sid, ion_id))"


@query("fit_score_v2", f"WITH {FIT} SELECT sid, ion_id, round(fit_score, 6) AS fit_score FROM fit", "matches")
def _(t: Tables):
    return matching.fit_score_v2(t.matches).select("sid", "ion_id", r("fit_score"))


@query(
    "score_ions_by_fit",
    f"""WITH {FIT_ROWS} SELECT sid, isotope_id, round(fit_score, 6) AS fit_score, CASE WHEN fit_score >= 0.8e0 THEN 'identified' WHEN fit_score >= 0.5e0 THEN 'candidate'
    ELSE 'below_assignability' END AS tier FROM fit""",
    "matches",
)
def _(t: Tables):
    return matching.with_fit(t.matches).select("sid", "isotope_id", r("fit_score"), matching.tier(F.col("fit_score")).alias("tier"))


@query(
    "peak_owner",
    f"""WITH {FIT_ROWS}, c AS (SELECT sid, peak_id, isotope_id, ion_id, fit_score, abs(mz_error) AS e FROM fit WHERE found)
    SELECT sid, peak_id, isotope_id, round(fit_score, 6) AS fit_score, n FROM (SELECT *, row_number() OVER (PARTITION BY sid, peak_id ORDER BY round(fit_score, 9) DESC, round(e, 9), isotope_id) AS rn,
    count(*) OVER (PARTITION BY sid, peak_id) AS n FROM c) WHERE rn = 1""",
    "matches",
)
def _(t: Tables):
    c = matching.with_fit(t.matches).where("found").select("sid", "peak_id", "isotope_id", "fit_score", "mz_error")
    peak = W.partitionBy("sid", "peak_id")
    rank = F.row_number().over(peak.orderBy(F.desc(F.round("fit_score", 9)), F.round(F.abs("mz_error"), 9), "isotope_id"))
    return c.withColumns({"rn": rank, "n": F.count("*").over(peak)}).where("rn = 1").select("sid", "peak_id", "isotope_id", r("fit_score"), "n")


@query("unassigned_peaks", "SELECT peak_id FROM peaks ANTI JOIN (SELECT peak_id FROM gated WHERE score > 0) g USING (peak_id)", "peaks gated")
def _(t: Tables):
    return t.peaks.select("peak_id").join(t.gated.where("score > 0").select("peak_id"), "peak_id", "left_anti")


@query(
    "ledger_union",
    """WITH a AS (SELECT DISTINCT peak_id FROM gated WHERE score > 0), b AS (SELECT DISTINCT peak_id FROM nearest ANTI JOIN a USING (peak_id))
    SELECT peak_id, 'assigned' AS role FROM a UNION ALL SELECT peak_id, 'candidate' FROM b
    UNION ALL SELECT peak_id, 'unassigned' FROM peaks WHERE peak_id NOT IN (SELECT peak_id FROM a UNION SELECT peak_id FROM b)""",
    "peaks nearest gated",
)
def _(t: Tables):
    rank = t.gated.where("score > 0").select("peak_id", F.lit(0).alias("role")).unionByName(t.nearest.select("peak_id", F.lit(1).alias("role")))
    best = rank.unionByName(t.peaks.select("peak_id", F.lit(2).alias("role"))).groupBy("peak_id").agg(F.min("role").alias("role"))
    return best.select("peak_id", F.element_at(F.array(F.lit("assigned"), F.lit("candidate"), F.lit("unassigned")), F.col("role") + 1).alias("role"))


@query("expected_keys_union", "SELECT sid, isotope_id FROM nearest UNION SELECT sid, isotope_id FROM matches", "nearest matches")
def _(t: Tables):
    keys = ["block", "sid", "isotope_id"]  # the block follows from the other two, and both sides are dealt out by it
    return t.nearest.select(keys).union(t.matches.select(keys)).distinct().drop("block")


@query(
    "mz_calibrate_orbi",
    """SELECT sid, round(factor, 9) AS factor, n, round(before, 6) AS ppm_before, round(abs(1e6 * (factor * obs - 1e0)), 6) AS ppm_after FROM (
    SELECT sid, median(target_mz / peak_mz) AS factor, median(peak_mz / target_mz) AS obs, median(mz_error) AS before, count(*) AS n
    FROM matches WHERE found AND collection_type = 'CALIBRANTS' AND abs(mz_error) <= 15 GROUP BY sid)""",
    "matches",
)
def _(t: Tables):
    good = t.near_of("collection_type = 'CALIBRANTS'", 15.0)
    per = good.groupBy("sid").agg(
        F.median(F.col("target_mz") / F.col("peak_mz")).alias("factor"), F.median(F.col("peak_mz") / F.col("target_mz")).alias("obs"), F.median("mz_error").alias("before"), F.count("*").alias("n")
    )
    after = F.abs(1e6 * (F.col("factor") * F.col("obs") - 1))
    return per.select("sid", r("factor", 9), "n", F.round("before", 6).alias("ppm_before"), F.round(after, 6).alias("ppm_after"))


@query(
    "acquisition_drift",
    """SELECT s.sid, s.instrument, abs(median(m.mz_error)) > CASE WHEN s.instrument = 'orbi' THEN 1e1 ELSE 5e1 END AS drifted FROM matches m JOIN samples s USING (sid)
    WHERE m.found AND abs(m.mz_error) <= 1e2 GROUP BY s.sid, s.instrument""",
    "matches samples",
)
def _(t: Tables):
    rows = t.near_of("true", 100.0).join(t.samples.select("sid", "instrument"), "sid")
    limit = F.when(F.col("instrument") == "orbi", 10.0).otherwise(50.0)
    return rows.groupBy("sid", "instrument").agg(F.abs(F.median("mz_error")).alias("e")).select("sid", "instrument", (F.col("e") > limit).alias("drifted"))


@query(
    "apply_mz_factor",
    """WITH f AS (SELECT sid, median(target_mz / peak_mz) AS factor FROM matches WHERE found AND abs(mz_error) <= 15 GROUP BY sid)
    SELECT peak_id, round(mz * coalesce(factor, 1e0), 6) AS mz FROM peaks LEFT JOIN f USING (sid)""",
    "matches peaks",
)
def _(t: Tables):
    f = t.near_of("true", 15.0).groupBy("sid").agg(F.median(F.col("target_mz") / F.col("peak_mz")).alias("factor"))
    return t.peaks.join(f, "sid", "left").select("peak_id", F.round(F.col("mz") * F.coalesce("factor", F.lit(1.0)), 6).alias("mz"))
